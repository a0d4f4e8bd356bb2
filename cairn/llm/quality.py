"""Operator 8: quality of documents from overlapping heuristic labellers, without using quality labels.

Each labeller votes good, bad or nothing. Expectation-maximisation estimates the labellers' accuracies from the counts of vote
patterns over all documents (a bounded table: three to the power of the labellers). The posterior of each document's
pattern is the target of a hashed linear scorer, trained on a bounded sample (``SAMPLE`` rows, by hash).

Defined results: null text votes as empty text (bad by the length labeller); documents without any vote have the prior as
posterior; rows that repeat an id are assessed one by one, a null id stays null; texts of any length are read whole; extra
columns, whatever their names, are ignored; empty tables give no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import ngrams
from cairn.llm.common import batches_by_chars
from cairn.llm.language import sparse_sample

SAMPLE, EPOCHS, RATE, SCALE = 4000, 5, 2.0, 30.0
#: Frequent words of English, French, German and Spanish running text.
COMMON = "the of and to in is that for le la de et les des un une der die und das ist ein eine el los que y en por para"


LABELLERS = ("long_enough", "mostly_letters", "few_marks", "few_digits", "own_words", "own_lines", "common_words", "sentences")
#: Characters of markup and code, and those that end sentences.
MARKS, ENDS = "#$%&*|<>{}\\[]=_~^+@", ".!?"
_COMMON, _FLAGS = frozenset(COMMON.split()), []


def _flags() -> np.ndarray:
    """For every code point: 1 a letter, 2 a mark, 4 a digit, 8 an end of sentences."""
    if not _FLAGS:
        out = ngrams.letters().astype(np.uint8)
        for flag, chars in ((2, MARKS), (4, "0123456789"), (8, ENDS)):
            out[[ord(c) for c in chars]] |= flag
        _FLAGS.append(out)
    return _FLAGS[0]


def votes(texts: list[str | None]) -> np.ndarray:
    """A row for each text and a column for each labeller: 1 (good), 0 (bad) or -1 (no vote)."""
    texts = [t or "" for t in texts]
    out = np.full((len(texts), len(LABELLERS)), -1, np.int8)
    for lo, hi in batches_by_chars(texts, 1_000_000):
        group = texts[lo:hi]
        flags = _flags()[np.frombuffer("".join(group).encode("utf-32-le", "replace"), np.uint32)]
        ends = np.cumsum([0] + [len(t) for t in group])
        per = lambda flag: np.diff(np.concatenate([[0], np.cumsum((flags & flag) > 0)])[ends])  # noqa: B023, E731
        chars = np.maximum(1, np.diff(ends))
        letters, marks, digits, stops = (per(flag) for flag in (1, 2, 4, 8))
        n, kinds, lines, own, common = np.array([_words(t) for t in group]).T
        distinct, repeated, stops = kinds / np.maximum(1, n), 1 - own / np.maximum(1, lines), stops / np.maximum(1, n)
        letters, marks, digits = letters / chars, marks / chars, digits / chars
        good_bad = (
            (n >= 50, n < 15),
            (letters > 0.75, letters < 0.6),
            (marks < 0.005, marks > 0.03),
            (digits < 0.02, digits > 0.15),
            ((n >= 30) & (distinct > 0.35), (n >= 30) & (distinct < 0.15)),
            ((lines >= 3) & (repeated == 0), repeated > 0.2),
            (common >= 5, (n >= 30) & (common <= 1)),
            ((n >= 20) & (stops > 0.02) & (stops < 0.3), (n >= 20) & ((stops < 0.004) | (stops > 0.5))),
        )
        for k, (good, bad) in enumerate(good_bad):
            out[lo:hi, k] = np.where(bad, 0, np.where(good, 1, -1))
    return out


def _words(text: str) -> tuple[int, int, int, int, int]:
    """Words, distinct words, lines that aren't blank, distinct ones, and frequent words that occur."""
    words = text.lower().split()
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    kinds = set(words)
    return len(words), len(kinds), len(lines), len(set(lines)), len(kinds & _COMMON)


def codes(texts: list[str | None]) -> np.ndarray:
    """The votes on each text as one number to the base of three."""
    heard = votes(texts)
    return np.where(heard < 0, 2, heard) @ 3 ** np.arange(len(LABELLERS), dtype=np.int64)


def patterns_of(docs: DataFrame) -> DataFrame:
    """Rows (pattern, n): how many texts got these votes; counted by batch before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kinds, n = np.unique(codes(pdf["text"].tolist()), return_counts=True)
            yield pd.DataFrame({"pattern": kinds, "n": n})

    return docs.select("text").mapInPandas(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def estimate(patterns: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each pattern (votes 1, 0, -1 for none), accuracies (for good, for bad documents) and the prior."""
    good, bad = patterns == 1, patterns == 0
    voted = good | bad
    p = np.where(voted.any(axis=1), (good.sum(axis=1) + 1) / (voted.sum(axis=1) + 2), 0.5)
    accuracy, prior = np.full((2, patterns.shape[1]), 0.7), 0.5
    for _ in range(rounds):
        w1, w0 = n * p, n * (1 - p)
        new = np.stack([(w1 @ good + 7) / (w1 @ voted + 10), (w0 @ bad + 7) / (w0 @ voted + 10)])
        prior = float((w1.sum() + 1) / (n.sum() + 2))
        one = good @ np.log(new[0]) + bad @ np.log(1 - new[0])
        zero = good @ np.log(1 - new[1]) + bad @ np.log(new[1])
        p = 1 / (1 + np.exp(np.clip(zero + np.log(1 - prior) - one - np.log(prior), -50, 50)))
        if np.abs(new - accuracy).max() < 1e-8:
            break
        accuracy = new
    return p, new, prior


def train_scorer(found: list) -> np.ndarray:
    """Logistic regression on posterior targets over hashed n-gram frequencies; the last row is the bias."""
    w, g2 = np.zeros(ngrams.SIZE + 1), np.full(ngrams.SIZE + 1, 1e-6)
    rng = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(found)).tolist():
            r, index, value = found[k]
            index, value = np.append(index, ngrams.SIZE), np.append(value * SCALE, 1.0)
            g = (1 / (1 + np.exp(-np.clip(value @ w[index], -30, 30))) - r["posterior"]) * value
            g2[index] += g * g
            w[index] -= 0.1 * RATE * g / np.sqrt(g2[index] + 1)
    return w


def assess(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_votes, posterior, score, keep); keep: the mean of posterior and score is at least one half."""
    spark = docs.sparkSession
    own = F.col("doc_id").cast("long")
    rows = docs.select(own.alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = patterns_of(rows).collect()  # at most 3 ** 8 rows
    found_codes = np.array([r.pattern for r in table], np.int64)
    digits = found_codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 if len(table) else np.zeros((0, len(LABELLERS)))
    patterns = np.where(digits == 2, -1, digits)
    posterior, _, prior = estimate(patterns, np.array([r.n for r in table], float)) if len(table) else (np.zeros(0), None, 0.5)
    of = dict(zip(found_codes.tolist(), posterior.tolist(), strict=True))
    n_votes = dict(zip(found_codes.tolist(), (patterns >= 0).sum(axis=1).tolist(), strict=True))

    size = max(1, sum(r.n for r in table))
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit(13)), F.lit(1 << 30)) / (1 << 30)
    found = sparse_sample(rows.filter(chance < min(1.0, SAMPLE / size)), ["doc_id"], ("pattern long", codes))
    found = sorted(found, key=lambda r: (r[0]["doc_id"] if r[0]["doc_id"] is not None else -1, r[1].tobytes()))
    found = [({"posterior": of.get(r["pattern"], prior)}, i, v) for r, i, v in found if len(i)]
    sent = spark.sparkContext.broadcast((train_scorer(found), of, n_votes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, of, n_votes = sent.value
        table = (w[:-1, None] * SCALE).astype(np.float32)
        for pdf in batches:
            texts = pdf["text"].tolist()
            x, _ = ngrams.scores(texts, table)
            s = 1 / (1 + np.exp(-np.clip(x[:, 0] + w[-1], -30, 30)))
            pattern = pd.Series(codes(texts), index=pdf.index)
            yield pd.DataFrame({"row": pdf["row"], "no_id": pdf["no_id"], "n_votes": pattern.map(n_votes), "posterior": pattern.map(of), "score": s})

    flat = rows.select(F.coalesce("doc_id", F.lit(0)).alias("row"), F.col("doc_id").isNull().alias("no_id"), "text")
    out = flat.mapInPandas(run, "row long, no_id boolean, n_votes long, posterior double, score double")
    keep = (F.col("posterior") + F.col("score")) >= 1.0
    return out.select(F.when(~F.col("no_id"), F.col("row")).alias("doc_id"), "n_votes", "posterior", "score", keep.alias("keep"))


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality over the whole of ``documents``."""
    return assess(spark.read.parquet(f"{sf_dir}/documents.parquet"))

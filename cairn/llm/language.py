"""Operator 6: language of whole texts by sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all rows that may be learned from. The weights are trained by
follow-the-regularised-leader with elastic-net penalties on a bounded sample (``SAMPLE`` rows, dealt evenly to the
languages and chosen by hash), of which a fifth sets the temperature that calibrates the probabilities.

Defined results: null text and text without a letter are ``und`` with score 0, as is everything if nothing can be learned;
a null id is in no fold and is not learned from; rows are scored one by one whatever their copies or ids; texts of any length
are read whole; of equally likely languages the first by name is taken; extra columns, whatever their names, are ignored; empty tables give no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import ngrams
from cairn.llm.common import fold, staged

SAMPLE, EPOCHS, SLICES = 4000, 4, 256
ALPHA, BETA, L1, L2, SCALE = 0.5, 1.0, 0.02, 0.1, 30.0


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Number of texts that hold each hashed n-gram, and of all texts; counts are added up on executors, slice by slice."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(ngrams.SIZE, np.int64), 0
        for pdf in batches:
            for g, _ in ngrams.grams(pdf["text"].tolist()):
                seen = np.zeros(ngrams.SIZE, bool)
                seen[g] = True
                total += seen
                n += 1
        parts = np.split(total, SLICES)
        if n:
            yield pd.DataFrame({"slice": range(SLICES), "counts": [p.tobytes() for p in parts], "n": n})

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        both = np.sum([np.frombuffer(c, np.int64) for c in pdf["counts"]], axis=0)
        return pd.DataFrame({"slice": [key[0]], "counts": [both.tobytes()], "n": [int(pdf["n"].sum())]})

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(count, "slice int, counts binary, n long")
    rows = staged(rows.groupBy("slice").applyInPandas(add, "slice int, counts binary, n long"), "frequencies").collect()  # SLICES rows
    out = np.zeros(ngrams.SIZE, np.int64)
    for r in rows:
        out[r.slice * (ngrams.SIZE // SLICES) : (r.slice + 1) * (ngrams.SIZE // SLICES)] = np.frombuffer(r.counts, np.int64)
    return out, rows[0].n if rows else 0


def sparse_sample(rows: DataFrame, keep: list[str], also: tuple[str, Callable[[list], np.ndarray]] | None = None) -> list:
    """Collect n-gram frequencies (index, value arrays) of the rows of a bounded sample, and what else is asked of their texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = [ngrams.counts(g) for g, _ in ngrams.grams(pdf["text"].tolist())]
            more = {also[0].split()[0]: also[1](pdf["text"].tolist())} if also else {}
            yield pdf[keep].assign(**more, index=[p[0].tobytes() for p in pairs], value=[p[1].tobytes() for p in pairs])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(keep).schema) + (f", {also[0]}" if also else "")
    found = rows.select(*keep, "text").mapInPandas(run, f"{kinds}, index binary, value binary").collect()
    return [(r, np.frombuffer(r["index"], np.int32), np.frombuffer(r["value"], np.float32)) for r in found]


class Ftrl:
    """Multinomial logistic regression, one example at a time; weights are zero until their evidence beats the L1 penalty."""

    def __init__(self, size: int, classes: int) -> None:
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))

    def weights(self, index: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    def learn(self, index: np.ndarray, value: np.ndarray, target: np.ndarray) -> None:
        w = self.weights(index)
        g = value[:, None] * (softmax(value @ w) - target)[None, :]
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[index] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, float]:
    """Languages, a table of weight times inverse document frequency, and the temperature; docs: text, lang, doc_id."""
    frequency, n = document_frequencies(docs)
    sizes = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros((ngrams.SIZE, 1)), 1.0
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, SAMPLE / len(languages) / sizes[k])))])
    chance = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) / (1 << 20)
    found = sparse_sample(docs.filter(chance < share[F.col("lang")]).select("doc_id", "lang", "text"), ["doc_id", "lang"])
    found.sort(key=lambda r: (r[0]["doc_id"], r[0]["lang"], r[1].tobytes()))
    idf = SCALE * np.log((1 + n) / (1 + frequency))
    rng = np.random.default_rng(3)
    held = rng.random(len(found)) < 0.2
    model, eye = Ftrl(ngrams.SIZE, len(languages)), np.eye(len(languages))
    own = {k: eye[i] for i, k in enumerate(languages)}
    for _ in range(EPOCHS):
        for k in rng.permutation(np.flatnonzero(~held) if (~held).any() else len(found)).tolist():
            r, index, value = found[k]
            if len(index):
                model.learn(index, value * idf[index], own[r["lang"]])
    table = (model.weights(slice(None)) * idf[:, None]).astype(np.float32)
    logits = np.array([value @ table[index] for (r, index, value), h in zip(found, held, strict=True) if h and len(index)])
    truth = np.array([languages.index(r["lang"]) for (r, index, _), h in zip(found, held, strict=True) if h and len(index)])
    heat = np.geomspace(0.05, 20, 61)
    loss = [-np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in heat] if len(truth) else [0.0]
    return languages, table, float(heat[int(np.argmin(loss))]) if len(truth) else 1.0


@dataclass
class Identifier:
    """Gives language and score of a text (a struct of lang_pred and score) as a column; knows what it has learned."""

    languages: list[str]
    column: Callable[[F.Column], F.Column]

    def __call__(self, text: F.Column) -> F.Column:
        return self.column(text)

    def least_score(self) -> float:
        """Somewhat more than the least score that the best of so many languages can have: such texts are like none of them."""
        return min(0.9, 1.2 / max(1, len(self.languages)))


def learned(docs: DataFrame) -> Identifier:
    """The identifier learned from the fold."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", 4) != 2))
    trained = train(known)
    sent = docs.sparkSession.sparkContext.broadcast(trained)  # bounded: n-grams times languages

    @F.pandas_udf("lang_pred string, score double")
    def found(texts: pd.Series) -> pd.DataFrame:
        languages, table, heat = sent.value
        logits, has = ngrams.scores(texts.tolist(), table)
        p = softmax(logits / heat)
        has &= bool(languages)
        best = p.argmax(axis=1)
        pred = [languages[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)]
        return pd.DataFrame({"lang_pred": pred, "score": np.where(has, p.max(axis=1), 0.0)})

    return Identifier(trained[0], lambda text: found(text.cast("string")))


def identify(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score)."""
    found = learned(docs)(F.col("text"))
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out, found.alias("found"))
    return out.select("doc_id", "held_out", "found.lang_pred", "found.score")


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 6 over the whole of ``documents``."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))

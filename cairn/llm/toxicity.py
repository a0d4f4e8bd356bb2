"""Operator 7: toxicity of whole texts by a weighted finite-state pattern grammar over clauses.

The lexicon transducer reads words and writes classes: insults (words, and stems that several insults of a language share) are
learned with their weights from all labelled rows of the fold; threats, intents, targets, negation and reported
speech are short word lists. It is composed with transducers for heaps of insults, threats (a verb of harm and its target,
with or without intent), negation, reported speech and targets before the insult; a second composed machine reads the clause
backwards for targets and reports behind it. The matches of a clause are scored by their context. What a document's
clauses scored in each context, at best, in all and by the word, goes into a logistic regression, fitted on a bounded sample
(about ``SAMPLE`` labelled rows, by hash).

Defined results: null and empty texts hold no clause and get the score of a text without matches; without labels
nothing is an insult and every score is 0; repeated labels of a document count as one (the largest); rows that repeat an id
are scored one by one, a null id is in no fold; texts of any length are read whole; extra columns, whatever their names, are
ignored by ``score``; empty tables give no row.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import fold, mix64, staged
from cairn.llm.near_dup import shingle_sets

SAMPLE, THRESHOLD, LEAST_DOCS = 8000, 0.7, 3
#: Power of two of the bits that tell labelled ids, at most.
MOST_BITS = 27
#: Characters of a stem, and the number of toxic words that must share it.
STEM, LEAST_WORDS = (3, 6), 3
#: Words that are added to a text's own where its matches are taken by the hundred words, so that one match in a few words is no density.
EVEN = 50
#: Word classes of the grammar in English, French, German and Spanish.
THREATS = "kill hurt destroy beat shoot stab burn tuer frapper brûler töten schlagen verbrennen matar golpear quemar"
INTENTS = "will going gonna shall should must vais allons va werde werden sollte voy vamos deberían"
TARGETS = "you your yourself they them he she him her tu toi vous ton votre ils elles du dich dir dein ihr euch sie tú ti te usted ustedes vosotros ellos"
NEGATIONS = "not no never neither nor isn't wasn't don't ne pas jamais nicht kein keine nie niemals nunca jamás tampoco"
REPORTS = "said says saying wrote writes claimed quoted called dit disait écrit appelé sagte sagt schrieb nannte dijo dice escribió llamó"
_TOKEN = re.compile(r"[^\W\d_]+(?:'t)?|[.!?;\n]")
_ENDS = frozenset(".!?;\n")
CONTEXTS = ("plain", "targeted", "negated", "reported", "threat")


class Transducer:
    """A deterministic transducer: (state, symbol) to (state, symbol); symbols without an arc pass and keep the state."""

    def __init__(self, states: int, arcs: dict[tuple[int, str], tuple[int, str]]) -> None:
        self.states, self.arcs = states, arcs

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.arcs.get((state, symbol), (state, symbol))

    def run(self, symbols: str) -> str:
        state, out = 0, []
        for x in symbols:
            state, y = self.step(state, x)
            out.append(y)
        return "".join(out)

    def compose(self, other: Transducer) -> Transducer:
        """The machine that feeds this one's output to the other; its states are pairs."""
        arcs = {}
        for a, b, symbol in itertools.product(range(self.states), range(other.states), ALPHABET):
            a2, out = self.step(a, symbol)
            b2, out = other.step(b, out)
            arcs[a * other.states + b, symbol] = (a2 * other.states + b2, out)
        return Transducer(self.states * other.states, arcs)


#: Symbols of words: I insult, H harm, W intent, T target, N negation, R report, O other word. Symbols that transducers write: J further
#: insult of a heap, h harm with a target, g the same with intent; t targeted, n negated, r reported.
ALPHABET = "IHWTNROJhgtnr"
_REACH = 3


def insults() -> Transducer:
    """The first insult of a clause, and those that are heaped on it."""
    return Transducer(2, {(0, "I"): (1, "I"), (1, "I"): (1, "J")})


def threats() -> Transducer:
    """A verb of harm with a target at most three words on; states: nothing, intent, then words left without and with intent."""
    arcs = {(0, "W"): (1, "O"), (0, "H"): (1 + _REACH, "O"), (1, "W"): (1, "O"), (1, "H"): (1 + 2 * _REACH, "O")}
    for with_intent in (0, 1):
        for left in range(1, _REACH + 1):
            state = 1 + with_intent * _REACH + left
            after = state - 1 if left > 1 else with_intent
            arcs |= {(state, x): (after, "O" if x in "WH" else x) for x in ALPHABET}
            arcs[state, "T"] = (with_intent, "g" if with_intent else "h")
    return Transducer(2 + 2 * _REACH, arcs)


def negation() -> Transducer:
    """Negates matches up to three words on."""
    arcs = {(s, "N"): (_REACH, "O") for s in range(_REACH + 1)}
    arcs |= {(s, x): (s - 1, "n" if x in "IJhg" else x) for s in range(1, _REACH + 1) for x in ALPHABET if x != "N"}
    return Transducer(_REACH + 1, arcs)


def reports() -> Transducer:
    """Matches after a word of reported speech, to the clause's end."""
    return Transducer(2, {(0, "R"): (1, "R")} | {(1, x): (1, "r") for x in "IJhgt"})


def targets() -> Transducer:
    """Insults after a target, also after one that a threat has used."""
    return Transducer(2, {(0, x): (1, x) for x in "Thg"} | {(1, x): (1, "t") for x in "IJ"})


FORWARD = (insults, threats, negation, reports, targets)
BACKWARD = (targets, reports)


def composed(parts: tuple[Callable[[], Transducer], ...]) -> Transducer:
    return reduce(Transducer.compose, (make() for make in parts))


#: Context and weight of each match that is written in the end; an insult counts by its own weight.
_OUT = {"I": (0, 1.0), "J": (0, 1.0), "t": (1, 1.0), "n": (2, 1.0), "r": (3, 1.0), "h": (4, 1.0), "g": (4, 2.0)}


class Words(dict):
    """Class and weight by word; unknown words are looked up by their longest stem, and remembered up to a bound."""

    MOST = 400_000

    def __init__(self, lexicon: dict[str, float]) -> None:
        fixed = ((REPORTS, "R"), (NEGATIONS, "N"), (TARGETS, "T"), (INTENTS, "W"), (THREATS, "H"))
        super().__init__({w: (k, 1.0) for ws, k in fixed for w in ws.split()})
        self.update({w: ("I", x) for w, x in lexicon.items() if not w.endswith("*")})
        self.stems = {w[:-1]: ("I", x) for w, x in lexicon.items() if w.endswith("*")}
        self.most = len(self) + self.MOST

    def __missing__(self, word: str) -> tuple[str, float]:
        found = next((self.stems[word[:k]] for k in range(min(STEM[1], len(word) - 1), STEM[0] - 1, -1) if word[:k] in self.stems), ("O", 0.0))
        if len(self) < self.most:
            self[word] = found
        return found


class Scorer:
    """Features of a text: per context the weight of its best clause, of all of them on a log scale, and by the hundred words."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon, self.words = lexicon, Words(lexicon)
        self.forward, self.backward = composed(FORWARD).arcs, composed(BACKWARD).arcs

    def __reduce__(self) -> tuple:
        return Scorer, (self.lexicon,)

    def clause(self, found: list[tuple[str, float]]) -> np.ndarray:
        """Weights by context of a clause of (class, weight) words."""
        out, state, arcs = [], 0, self.forward
        for symbol, _ in found:
            state, y = arcs[state, symbol]
            out.append(y)
        state, arcs, weights = 0, self.backward, np.zeros(len(CONTEXTS))
        for y, (symbol, weight) in zip(reversed(out), reversed(found), strict=True):
            state, y = arcs[state, y]
            if y in _OUT:
                context, factor = _OUT[y]
                weights[context] += factor * (weight if symbol == "I" else 1.0)
        return weights

    def features(self, text: str | None) -> np.ndarray:
        best, total = np.zeros(len(CONTEXTS)), np.zeros(len(CONTEXTS))
        found, words = _TOKEN.findall((text or "").lower()), self.words
        if any(words[w][0] in "IH" for w in set(found)):
            at = [-1, *(i for i, w in enumerate(found) if w in _ENDS), len(found)]
            for a, b in itertools.pairwise(at):
                clause = [words[w] for w in found[a + 1 : b]]
                if any(k in "IH" for k, _ in clause):
                    weights = self.clause(clause)
                    best, total = np.maximum(best, weights), total + weights
        return np.concatenate([best, np.log1p(total), np.log1p(100 * total / (len(found) + EVEN))])


@F.pandas_udf(T.BinaryType())
def _copy_key(texts: pd.Series) -> pd.Series:
    """Two least hashes of a text's shingles: near copies mostly share them, other texts hardly ever do."""
    least = lambda s: s.min().tobytes() + mix64(s).min().tobytes() if len(s) else b""
    return pd.Series([least(s) for s in shingle_sets(texts.tolist())], dtype=object)


def without_copies(labelled: DataFrame) -> DataFrame:
    """Rows (text, toxic): one text of each group of equal or near copies, for each label that the group has; labelled: text, toxic.

    Copies are told by the two least hashes of their shingles, so no text is compared with another; a group of near copies may
    count a few times, by as many keys as it has.
    """
    keyed = labelled.select("text", "toxic", _copy_key("text").alias("key"))
    return keyed.groupBy("key", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def _ratio(t: F.Column, c: F.Column, rate: float) -> F.Column:
    """Log-likelihood ratio of the share of t in t + c against the given rate."""
    size = t + c
    part = lambda x, p: F.when(x > 0, x * F.log(x / (size * p))).otherwise(0.0)
    return 2 * (part(t, rate) + part(c, 1 - rate))


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Words, and stems marked by ``*``, with their log odds, where the evidence beats chance over all words seen.

    Copies count once, toxic or clean. A word is judged by the documents that hold it. A stem must stand out in documents and
    in the words of documents, and at least ``LEAST_WORDS`` different words of toxic documents must share it, none of them
    with more than half of the evidence.
    """
    labelled = staged(without_copies(labelled), "once")
    totals = labelled.groupBy("toxic").count().collect()
    n = {r.toxic: r["count"] for r in totals}
    if not n.get(1) or not n.get(0):
        return {}
    words = labelled.select("toxic", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("words"))
    lengths = F.array(*[F.lit(k) for k in range(STEM[0], STEM[1] + 1)])
    stems_of = lambda w: F.transform(F.filter(lengths, lambda k: k < F.length(w)), lambda k: F.concat(F.substr(w, F.lit(1), k), F.lit("*")))
    keys = F.concat("words", F.array_distinct(F.flatten(F.transform("words", stems_of))))
    counted = words.select("toxic", F.explode(keys).alias("word")).groupBy("word").agg(F.sum("toxic").cast("double").alias("t"), F.sum(1 - F.col("toxic")).cast("double").alias("c"))
    counted = staged(counted, "words")
    rate, stem = n[1] / (n[0] + n[1]), F.endswith("word", F.lit("*"))
    whole, stems = counted.filter(~stem), counted.filter(stem)
    all_words = whole.agg(F.count("*").alias("n"), F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    if not all_words.n:
        return {}
    beyond = 2 * float(np.log(max(2, all_words.n))) + 2
    odds = F.log(((F.col("t") + 0.5) / (n[1] + 1)) / ((F.col("c") + 0.5) / (n[0] + 1)))
    size = F.col("t") + F.col("c")
    insulting = (F.col("t") >= LEAST_DOCS) & (F.col("t") > 0.5 * size) & (odds > 0) & (_ratio(F.col("t"), F.col("c"), rate) > beyond)
    # Bounded: each word explains toxic documents beyond chance, and a document holds a limited number of distinct words.
    found = {r.word: r.odds for r in whole.filter(insulting).select("word", odds.alias("odds")).collect()}

    likely = stems.filter((F.col("t") >= LEAST_DOCS) & (odds > 0) & (_ratio(F.col("t"), F.col("c"), rate) > 10.0)).select("word")
    parts = whole.select(F.explode(stems_of(F.col("word"))).alias("word"), "t", "c").groupBy("word")
    parts = parts.agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count_if(F.col("t") > 0).alias("kinds"), F.max("t").alias("most"))
    share = all_words.t / (all_words.t + all_words.c)
    strong = (F.col("kinds") >= LEAST_WORDS) & (F.col("most") <= 0.5 * F.col("t")) & (F.col("t") > 0.5 * size) & (_ratio(F.col("t"), F.col("c"), share) > beyond)
    weight = F.log(((F.col("t") + 0.5) / (all_words.t + 1)) / ((F.col("c") + 0.5) / (all_words.c + 1)))
    chosen = parts.filter(strong).join(likely.hint("merge"), "word", "left_semi")
    return found | {r.word: r.weight for r in chosen.select("word", weight.alias("weight")).collect()}


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Logistic regression with a ridge penalty by Newton steps; weights of matches aren't negative."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [penalty] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge
        w = w - np.linalg.solve(h, x.T @ (p - y) + ridge @ w)
        w[1:] = np.maximum(w[1:], 0)
    return w


def among(ids: DataFrame) -> Callable[[F.Column], F.Column]:
    """A test that each of the given ids (doc_id) passes and few others do; an exact join has to follow.

    A Bloom filter of two bits an id, with 8 to 16 bits of room for each: about 2 to 5 % of other ids pass. It is sent whole and holds
    ``MOST_BITS`` at most (16 MB); beyond 16 million ids others pass more often.
    """
    bits = 1 << min(MOST_BITS, max(15, (8 * ids.count()).bit_length()))
    places = lambda column: [F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(bits)) for seed in (1, 2)]
    at = ids.select(F.explode(F.array(*[p + 1 for p in places("doc_id")])).alias("at"))  # Spark's bitmaps count from 1
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map")).collect()
    held = np.zeros(bits // 8, np.uint8)
    for r in parts:
        held[(r.part - 1) * len(r.map) : r.part * len(r.map)] = np.frombuffer(bytes(r.map), np.uint8)
    sent = ids.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf(T.BooleanType())
    def passes(one: pd.Series, two: pd.Series) -> pd.Series:
        bit = lambda x: (sent.value[x >> 3] >> (x & 7).astype(np.uint8)) & 1
        return pd.Series((bit(one.to_numpy()) & bit(two.to_numpy())).astype(bool))

    return lambda column: passes(*places(column))


def learned(docs: DataFrame, labels: DataFrame) -> Callable[[F.Column], F.Column]:
    """The score of a text, as a column function, learned from the labelled documents of the fold; null text is empty."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # Labels grow with the documents, so they aren't broadcast at any size; the texts that go to meet them are mostly labelled ones.
    texts = rows.filter((fold("doc_id", 3) != 1) & F.col("text").isNotNull())
    texts = texts.filter(among(marks.select("doc_id").filter(fold("doc_id", 3) != 1))("doc_id"))
    known = staged(texts.join(marks.hint("merge"), "doc_id"), "labelled")
    lexicon = learn_lexicon(known)
    sent = spark.sparkContext.broadcast(Scorer(lexicon))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"toxic": pdf["toxic"], "x": [sent.value.features(t).tolist() for t in pdf["text"]]})

    n = max(1, known.count())
    chance = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / (1 << 30)
    sample = known.filter(chance < min(1.0, SAMPLE / n)).select("toxic", "text")
    found = sample.mapInPandas(features, "toxic int, x array<double>").collect()  # about SAMPLE rows of numbers
    if not lexicon or not found:
        return lambda text: F.lit(0.0)
    weights = fit(np.array([r.x for r in found]), np.array([r.toxic for r in found]))

    @F.pandas_udf(T.DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        x = np.array([sent.value.features(t) for t in texts]).reshape(len(texts), -1)
        return pd.Series(1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30))) if len(texts) else np.zeros(0))

    return lambda text: scored(text.cast("string"))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted)."""
    scored = learned(docs, labels)(F.col("text"))
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out, scored.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 7 over the whole of ``documents``."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

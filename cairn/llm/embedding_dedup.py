"""Operator 3: near-duplicate vectors by iterative quantisation, multi-index Hamming tables and exact reranking.

Rotations that balance binary codes are learned on a bounded sample (about ``SAMPLE`` vectors, by hash). Every vector is coded;
the code bits are cut into substrings, one hash table each, and vectors that share a substring and lie within a Hamming bound
are compared by cosine of the original vectors. The number of tables is chosen so that pairs exactly at the
threshold are missed at most ``MISS`` of the time, as measured with the learned rotations on vectors that they weren't learned
from; tables are added, and in the end keys shortened, until that holds (down to one bucket, which compares all).

Dense groups cost no pairs: a vector within half the threshold angle of its table leader joins the leader's ball, and any two members
of a ball are links by the triangle inequality. Only pairs of different balls are compared; in a hot bucket the rows
of its largest ball are dealt out in blocks.

Defined results: null vectors, empty ones, zero ones and those with null or non-finite components link with nothing,
as do vectors of different lengths; equal vectors are links; rows with equal ids each get their row; a null id is ignored in
component_id unless all are null; vectors may be of any length; extra columns, whatever their names, are ignored; empty tables give no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import bounds, key_groups, staged
from cairn.llm.components import components

COSINE, SAMPLE, MISS, BUCKET, BLOCK = 0.9, 4096, 0.003, 32, 512
#: Room for rounding where a ball decides without looking at a pair.
MARGIN = 1e-7


def vertices_of(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, v, x, dim): key and unit vector (double precision, bytes); null where the vector links with nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, units = [], []
            for e in pdf["embedding"]:
                x = np.array([], float) if e is None else np.array([np.nan if c is None else c for c in e] if e.dtype == object else e, np.float64)
                top = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
                if top == 0:
                    keys.append(None)
                    units.append(None)
                    continue
                x = x / top  # so that squares neither overflow nor vanish
                x = np.ascontiguousarray(x / np.linalg.norm(x) + 0.0)
                units.append(x.tobytes())
                keys.append(hashlib.blake2b(units[-1], digest_size=16).digest())
            yield pd.DataFrame({"row": pdf["row"], "no_id": pdf["no_id"], "v": keys, "x": units})

    own = F.col("vec_id").cast("long")
    rows = vectors.select(F.coalesce(own, F.lit(0)).alias("row"), own.isNull().alias("no_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    out = rows.mapInPandas(run, "row long, no_id boolean, v binary, x binary")
    return out.select(F.when(~F.col("no_id"), F.col("row")).alias("vec_id"), "v", "x", F.coalesce(F.length("x") / 8, F.lit(0)).cast("int").alias("dim"))


class Quantiser:
    """Iterative quantisation: principal directions, then rotations learned by alternating codes and Procrustes."""

    #: After so many rotations in vain the keys get a bit shorter, until the tables reach the recall.
    PATIENCE = 64

    def __init__(self, sample: np.ndarray, n_vectors: int, cosine: float = COSINE, seed: int = 7, rounds: int = 30) -> None:
        rng = np.random.default_rng(seed)
        self.mean = sample.mean(axis=0)
        self.width = int(max(6, np.ceil(np.log2(max(2, n_vectors) / BUCKET))))
        # Rotations are learned on one half and the recall is measured on the other, where there are enough vectors.
        fitted, measured = (sample[::2], sample[1::2]) if len(sample) >= 512 else (sample, sample)
        _, _, axes = np.linalg.svd(fitted - self.mean, full_matrices=True)
        flat = (fitted - self.mean) @ axes.T
        near = self._at(measured, cosine, rng)
        self.axes, self.rotations = axes, []
        while True:
            r = np.linalg.qr(rng.normal(size=(len(axes), len(axes))))[0]
            for _ in range(rounds):
                code = np.sign(flat @ r) + (flat @ r == 0)
                u, _, w = np.linalg.svd(code.T @ flat)
                r = w.T @ u.T
            self.rotations.append(r)
            same = self.bits(measured) == self.bits(near)
            last = same.shape[1] - same.shape[1] % self.width
            per_table = 1 - same[:, :last].reshape(len(measured), -1, self.width).all(axis=2).mean(axis=0)
            keep = np.cumprod(per_table)
            if len(keep) and keep[-1] <= MISS:
                n_tables = int(np.argmax(keep <= MISS)) + 1
                self.tables = [np.arange(k * self.width, (k + 1) * self.width) for k in range(n_tables)]
                break
            if len(self.rotations) % self.PATIENCE == 0:
                self.width -= 1
                if not self.width:  # no code tells these vectors apart reliably: one bucket, compared whole in blocks
                    self.tables, same = [np.arange(0)], np.zeros_like(same)
                    break
        apart = (~same).sum(axis=1)
        #: Hamming bound that pairs at the threshold keep, with room beyond the sample.
        self.most = int(np.ceil(apart.mean() + 5 * apart.std() + 1))

    @staticmethod
    def _at(x: np.ndarray, cosine: float, rng: np.random.Generator) -> np.ndarray:
        """For each vector another one at exactly the given cosine."""
        y = rng.normal(size=x.shape)
        y -= (y * x).sum(axis=1, keepdims=True) * x
        norm = np.linalg.norm(y, axis=1, keepdims=True)
        return cosine * x + np.sqrt(1 - cosine**2) * y / np.where(norm > 0, norm, 1)

    def bits(self, x: np.ndarray) -> np.ndarray:
        flat = (x - self.mean) @ self.axes.T
        return np.concatenate([flat @ r >= 0 for r in self.rotations], axis=1)

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Table keys (a column per table) and the packed code, padded to whole 64-bit words."""
        bits = self.bits(x)
        keys = np.stack([bits[:, t] @ (np.int64(1) << np.arange(self.width, dtype=np.int64)) for t in self.tables], axis=1)
        pad = -bits.shape[1] % 64
        packed = np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1)
        return keys, np.ascontiguousarray(packed).view(np.int64)


def learn(vertices: DataFrame, n: int, cosine: float = COSINE) -> Quantiser:
    """On a bounded sample: about ``SAMPLE`` vectors, by a bound on their hash."""
    chance = F.pmod(F.xxhash64("v", F.lit(5)), F.lit(1 << 30)) / (1 << 30)
    rows = vertices.filter(chance < min(1.0, SAMPLE / max(1, n))).select("x").collect()
    return Quantiser(np.array([np.frombuffer(r.x) for r in rows]), n, cosine)


def _unit(x: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(x), np.float64).reshape(len(x), -1)


def _linked(pairs: DataFrame, vertices: DataFrame, least: float, keep: list[str]) -> DataFrame:
    """Pairs (a, b, ...) whose cosine is at least the given one."""
    one, two = (vertices.select(F.col("v").alias(c), F.col("x").alias(f"x{c}")) for c in "ab")
    both = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.loc[np.einsum("ij,ij->i", _unit(pdf["xa"]), _unit(pdf["xb"])) >= least, keep]

    return both.mapInPandas(run, pairs.select(keep).schema)


def _one_length(vertices: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """Balls (v, ball) and links (a, b) between different balls, among vectors of one length."""
    n = vertices.count()
    quantiser = learn(vertices, n, cosine)
    sent = vertices.sparkSession.sparkContext.broadcast(quantiser)  # bounded: matrices of the vectors' length
    words = -(-len(quantiser.rotations) * len(quantiser.axes) // 64)
    code_names = [f"c{k}" for k in range(words)]

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                keys, codes = sent.value.codes(_unit(pdf["x"]))
                yield pd.DataFrame({"v": pdf["v"], "keys": list(keys), **{c: codes[:, k] for k, c in enumerate(code_names)}})

    schema = "v binary, keys array<long>, " + ", ".join(f"{c} long" for c in code_names)
    coded = staged(vertices.select("v", "x").mapInPandas(code, schema), "codes")
    rows = coded.select("v", *code_names, F.posexplode("keys").alias("t", "key"))
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"least.{c}"))) for c in code_names])
    leaders = rows.groupBy("t", "key").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("v").alias("rank"), "v", *code_names)).alias("least")).filter("size > 1")
    met = rows.join(leaders.hint("merge"), ["t", "key"])
    proposals = met.filter((apart <= quantiser.most) & (F.col("v") != F.col("least.v"))).select(F.col("v").alias("a"), F.col("least.v").alias("b")).distinct()
    half = float(np.cos(np.arccos(cosine) / 2)) + MARGIN
    near = _linked(proposals, vertices, half, ["a", "b"])
    chosen = near.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("rank"), "b")).alias("m")).select(F.col("a").alias("v"), F.col("m.b").alias("ball"))
    balls = staged(coded.select("v").join(chosen.hint("merge"), "v", "left").select("v", F.coalesce("ball", "v").alias("ball")), "balls")

    # Buckets that hold more than one ball: rows of the largest ball in blocks, against the rest, and the rest against itself.
    rows = staged(rows.join(balls.hint("merge"), "v"), "rows")
    by_ball = rows.groupBy("t", "key", "ball").agg(F.count("*").alias("n"))
    mixed = by_ball.groupBy("t", "key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "ball")).alias("big")).filter("all > big.n")
    rows = rows.join(mixed.hint("merge"), ["t", "key"])
    n_big, n_rest = F.ceil(F.col("big.n") / BLOCK).cast("int"), F.ceil((F.col("all") - F.col("big.n")) / BLOCK).cast("int")
    big = F.col("ball") == F.col("big.ball")
    own = F.pmod(F.xxhash64("v", F.lit(1)), F.when(big, n_big).otherwise(n_rest)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    meet = F.when(big, F.transform(upto(n_rest), lambda j: F.struct(F.lit(True).alias("cross"), own.alias("i"), j.alias("j"), F.lit(0).alias("side")))).otherwise(
        F.concat(
            F.transform(upto(n_big), lambda i: F.struct(F.lit(True).alias("cross"), i.alias("i"), own.alias("j"), F.lit(1).alias("side"))),
            F.transform(upto(n_rest), lambda j: F.struct(F.lit(False).alias("cross"), F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), (own > j).cast("int").alias("side"))),
        )
    )
    dealt = rows.select("v", "ball", *code_names, "t", "key", F.explode(meet).alias("m"))
    dealt = dealt.select(F.xxhash64("t", "key", "m.cross", "m.i", "m.j").alias("group"), F.col("m.side").alias("side"), (F.col("m.cross") | (F.col("m.i") != F.col("m.j"))).alias("two"), "v", "ball", *code_names)
    most = quantiser.most

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in key_groups(batches, "group"):
            codes = pdf[code_names].to_numpy().view(np.uint64)
            v, ball, side = pdf["v"].to_numpy(), pdf["ball"].to_numpy(), pdf["side"].to_numpy()
            two, pairs = pdf["two"].to_numpy(), []
            for a, b in zip(*(x.tolist() for x in bounds(pdf["group"].to_numpy())), strict=True):
                if b - a < 2:
                    continue
                left = np.flatnonzero(side[a:b] == 0) + a if two[a] else np.arange(a, b)
                right = np.flatnonzero(side[a:b] == 1) + a if two[a] else left
                for i in left.tolist():
                    against = right if two[a] else right[right > i]
                    hit = against[np.bitwise_count(codes[against] ^ codes[i]).sum(axis=1) <= most]
                    pairs += [(v[i], v[j]) if v[i] < v[j] else (v[j], v[i]) for j in hit.tolist() if ball[i] != ball[j]]
            yield pd.DataFrame(pairs, columns=["a", "b"]).drop_duplicates()

    found = dealt.repartition("group").sortWithinPartitions("group").mapInPandas(compare, "a binary, b binary").distinct()
    return balls, staged(_linked(found, vertices, cosine, ["a", "b"]), "links")


def near_vectors(vectors: DataFrame, *, cosine: float = COSINE) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per vector."""
    rows = staged(vertices_of(vectors), "vectors")
    vertices = rows.filter(F.col("v").isNotNull()).groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.first("x").alias("x"), F.first("dim").alias("dim"))
    vertices = staged(vertices, "vertices")
    lengths = sorted(r.dim for r in vertices.select("dim").distinct().collect())  # a few lengths at most
    if not lengths:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    parts = [_one_length(vertices.filter(F.col("dim") == d).select("v", "x"), cosine) for d in lengths]
    balls, links = (reduce(DataFrame.unionByName, [p[k] for p in parts]) for k in (0, 1))

    mass = vertices.select("v", "n")
    in_ball = balls.join(mass.hint("merge"), "v").groupBy("ball").agg(F.sum("n").alias("mass"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beyond = both.join(mass.select(F.col("v").alias("b"), "n").hint("merge"), "b").groupBy("a").agg(F.sum("n").alias("more"))
    counted = balls.join(in_ball.hint("merge"), "ball").join(beyond.withColumnRenamed("a", "v").hint("merge"), "v", "left")
    counted = counted.select("v", (F.col("mass") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))

    first = balls.groupBy("ball").agg(F.min("v").alias("a"))
    ties = balls.join(first.hint("merge"), "ball").select("a", F.col("v").alias("b"))
    roots = components(links.unionByName(ties))
    linked = vertices.select("v", "vec_id").join(roots.hint("merge"), "v", "left").withColumn("root", F.coalesce("root", "v"))
    least = linked.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    named = linked.join(least.hint("merge"), "root").select("v", "component_id")
    out = rows.select("vec_id", "v").join(counted.join(named.hint("merge"), "v").hint("merge"), "v", "left")
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def embedding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 3 over the whole of ``embeddings``."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

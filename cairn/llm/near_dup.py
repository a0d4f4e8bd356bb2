"""Operator 9: near-duplicate documents by a chosen-path set similarity join.

A document's set of five-word shingles is hashed to 64-bit tokens. Documents of equal sets are one vertex, keyed by a
128-bit digest of the set. For every vertex a fixed number of minwise tokens is kept. A tree sends a vertex from node to
node: each node chooses one of the minwise tokens, and with the probability that makes 1/similarity children on average a
second one; vertices with the same token share a child. Independent trees are repeated to reach the target recall.

Work in a node: every vertex is compared with a leader of the node, chosen differently in each tree, which joins large groups
of copies at linear cost. Nodes that then still hold several components are compared exhaustively, on full sets, when they are small.
The vertices of larger ones go through deeper trees of their own, so many that as few pairs are missed as by the first trees; what is
large at the deepest level is compared in blocks. Vertices of one component need no further comparison. Links are confirmed on
the full sets of hashed shingles, read again from the texts of the vertices concerned.

Defined results: null text, empty text and text without words have an empty set and link with nothing; a shorter text
is one shingle; rows with equal ids each get their row; a null id is ignored in component_id unless all are null; texts of
any length are read whole; extra columns, whatever their names, are ignored; empty tables give no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import batches_by_chars, bounds, key_groups, mix64, staged, unused_name
from cairn.llm.components import components, neighbour_labels
from cairn.llm.tokens import span_hashes

WORDS, PERCENT = 5, 85
#: Minwise tokens of a vertex, levels that the first trees have, levels between trees, and the deepest level.
MINWISE, DEPTH, STEP, DEEPEST = 128, 2, 2, 8
#: Share of the pairs at the threshold that the trees of one depth may miss together: that of six trees of two levels at 85 percent.
MISSED = 1.3e-4
#: Nodes of at most this many vertices are compared exhaustively.
SMALL = 2048
#: Pairs whose estimated similarity is this many standard deviations below the threshold aren't confirmed.
DEVIATIONS = 4
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_FACTORS = mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[str | None], n_words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct hashed shingles of each text."""
    texts = [t or "" for t in texts]
    for lo, hi in batches_by_chars(texts, 1_000_000):
        encoded = [t.encode().translate(_LOWER) for t in texts[lo:hi]]
        data = np.frombuffer(b" ".join(encoded), np.uint8)
        blank = _BLANK[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        hashes = span_hashes(data, starts, ends)
        at = np.searchsorted(starts, np.cumsum([0] + [len(e) + 1 for e in encoded]))
        with np.errstate(over="ignore"):
            whole = np.zeros(len(hashes), np.uint64)
            for k in range(min(n_words, len(hashes))):
                whole[: len(hashes) - k] += hashes[k:] * _FACTORS[k]
            whole = mix64(whole)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if b - a >= n_words:
                    yield np.unique(whole[a : b - n_words + 1])
                elif b > a:  # the whole sequence, which no five words can equal
                    parts = hashes[a:b] * _FACTORS[: b - a]
                    yield mix64(np.array([parts.sum() + np.uint64(b - a)], np.uint64))
                else:
                    yield np.zeros(0, np.uint64)


def minwise(sets: list[np.ndarray], n: int = MINWISE) -> list[bytes | None]:
    """n minwise tokens, 16 bits each, of every set: the least values of as many hash functions; None for empty sets."""
    full = [i for i, x in enumerate(sets) if len(x)]
    out: list[bytes | None] = [None] * len(sets)
    if not full:
        return out
    tokens = np.concatenate([sets[i] for i in full])
    starts = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
    least = np.zeros((len(full), n), "<u2")
    with np.errstate(over="ignore"):
        for k in range(n):
            x = tokens * _FACTORS[k]
            x ^= x >> np.uint64(32)
            x *= _FACTORS[k + 128]
            least[:, k] = _short(np.minimum.reduceat(x, starts))
    for i, row in zip(full, least, strict=True):
        out[i] = row.tobytes()
    return out


def _short(least: np.ndarray) -> np.ndarray:
    return (mix64(least) >> np.uint64(48)).astype(np.uint16)


def set_key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def sketch(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, at, v, n_shingles, tokens): key of id and text, vertex and minwise tokens; the last and v null for an empty set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v, n, tokens, held, size = [], [], [], [], 0
            for s in shingle_sets(pdf["text"].tolist()):
                v.append(set_key(s) if len(s) else None)
                n.append(len(s))
                held.append(s)
                size += len(s)
                if size > 200_000:
                    tokens += minwise(held)
                    held, size = [], 0
            tokens += minwise(held)
            yield pd.DataFrame({"row": pdf["row"], "at": pdf["at"], "no_id": pdf["no_id"], "v": v, "n_shingles": n, "tokens": tokens})

    doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(F.coalesce(doc, F.lit(0)).alias("row"), _at(doc, text), doc.isNull().alias("no_id"), text.alias("text"))
    out = rows.mapInPandas(run, "row long, at long, no_id boolean, v binary, n_shingles long, tokens binary")
    return out.select(F.when(~F.col("no_id"), F.col("row")).alias("doc_id"), "at", "v", "n_shingles", "tokens")


def _at(doc: F.Column, text: F.Column) -> F.Column:
    """Key by which a text is read again; it needs no id."""
    return F.xxhash64(doc, text).alias("at")


def _children(keys: np.ndarray, tokens: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of the children: one chosen token for each node, and a second for some nodes."""
    n = tokens.shape[1]
    h = mix64(keys)
    first = (h % np.uint64(n)).astype(np.int64)
    second = ((h >> np.uint64(20)) % np.uint64(n)).astype(np.int64)
    more = ((h >> np.uint64(40)) % np.uint64(percent)) < np.uint64(100 - percent)
    rows = np.arange(len(keys))
    with np.errstate(over="ignore"):
        a = mix64(keys * np.uint64(31) + (first.astype(np.uint64) << np.uint64(32)) + tokens[rows, first])
        more &= second != first
        b = mix64(keys[more] * np.uint64(31) + (second[more].astype(np.uint64) << np.uint64(32)) + tokens[rows[more], second[more]])
    return np.concatenate([rows, rows[more]]), np.concatenate([a, b])


def missed(percent: int, depth: int) -> float:
    """Share of the pairs at the threshold that share no node at this depth of one tree."""
    same, found = percent / 100, 1.0
    for _ in range(depth):  # by the first child, or by the second where there is one
        found = 1 - (1 - same * found) * (1 - (1 - same) * found)
    return 1 - found


def trees_for(percent: int, depth: int) -> int:
    """Trees of this depth that miss at most ``MISSED`` of the pairs at the threshold."""
    one = missed(percent, depth)
    return max(1, int(np.ceil(np.log(MISSED) / np.log(one)))) if one > 0 else 1


def least_agreeing(percent: int) -> int:
    """Least number of minwise tokens that agree in a pair worth confirming."""
    same = percent / 100
    return int(np.floor((same - DEVIATIONS * (same * (1 - same) / MINWISE) ** 0.5) * MINWISE))


def paths(vertices: DataFrame, *, percent: int, trees: int, depth: int = DEPTH, first: int = 0) -> DataFrame:
    """Rows (tree, node, v, rank) for the nodes at the given depth of all trees; rank orders leaders, tree by tree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tokens = _matrix(pdf["tokens"])
            own = np.array([int.from_bytes(v[:8], "little") for v in pdf["v"]], np.uint64)
            for tree in range(first, first + trees):
                rows, keys = np.arange(len(pdf)), np.full(len(pdf), mix64(np.array([tree], np.uint64))[0])
                for _ in range(depth):
                    which, keys = _children(keys, tokens[rows], percent)
                    rows = rows[which]
                rank = mix64(own[rows] ^ mix64(np.array([tree + 1000], np.uint64))).view(np.int64)
                yield pd.DataFrame({"tree": tree, "node": keys.view(np.int64), "v": pdf["v"].to_numpy()[rows], "rank": rank})

    return vertices.select("v", "tokens").mapInPandas(run, "tree int, node long, v binary, rank long")


def _matrix(tokens: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(tokens), "<u2").reshape(len(tokens), -1) if len(tokens) else np.zeros((0, MINWISE), np.uint16)


def _estimated(a: str, b: str) -> F.Column:
    return _alike(F.col(a), F.col(b))


@F.pandas_udf(T.IntegerType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Number of minwise tokens that agree."""
    return pd.Series((_matrix(a) == _matrix(b)).sum(axis=1).astype(np.int32))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity."""
    one, two = (sets.select(F.col("v").alias(x), F.col("tokens").alias(f"s{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    both = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            same = [len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True)) for x, y in zip(pdf["sa"], pdf["sb"], strict=True)]
            same = np.array(same, np.int64)
            linked = 100 * same >= percent * (pdf["na"].to_numpy() + pdf["nb"].to_numpy() - same)
            yield pdf.loc[linked, ["a", "b"]]

    return both.mapInPandas(run, "a binary, b binary")


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Full sets (v, tokens, n) of the wanted vertices, from the text of one document (that with the least id, if any has one) of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(set_key(s), s.astype("<u8").tobytes(), len(s)) for s in shingle_sets(pdf["text"].tolist())]
            yield pd.DataFrame(found, columns=["v", "tokens", "n"])

    text = F.col("text").cast("string")
    texts = docs.select(_at(F.col("doc_id").cast("long"), text), text.alias("text"))
    # Rows that share id and text each yield their set; the semi join keeps one wanted set of each kind.
    picked = texts.join(wanted.select("at").distinct().hint("merge"), "at", "left_semi")
    sets = picked.mapInPandas(run, "v binary, tokens binary, n long")
    sets = sets.join(wanted.select("v").distinct().hint("merge"), "v", "left_semi")
    return sets.groupBy("v").agg(F.max(F.struct("n", "tokens")).alias("s")).select("v", "s.tokens", "s.n")


def links(docs: DataFrame, vertices: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """Confirmed links (a, b) between vertices that join the same components as all links do.

    vertices: rows (v, at, tokens), with the key of one document of that set.
    """
    least, trees = least_agreeing(percent), trees_for(percent, DEPTH)
    nodes = staged(paths(vertices, percent=percent, trees=trees), "nodes")
    several = nodes.groupBy("tree", "node").agg(F.count("*").alias("size"), F.min(F.struct("rank", "v")).alias("least"), F.max(F.struct("rank", "v")).alias("most")).filter("size > 1")
    several = several.select("tree", "node", F.array("least.v", "most.v").alias("leaders"))
    shared = staged(nodes.join(several.hint("merge"), ["tree", "node"]).select("tree", "node", "v", "leaders"), "shared")

    tokens = vertices.select("v", "tokens")

    def likely(pairs: DataFrame) -> DataFrame:
        """Distinct pairs whose minwise tokens agree often enough."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
        one, two = (tokens.select(F.col("v").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab")
        both = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b")
        return staged(both.filter(_estimated("ta", "tb") >= least).select("a", "b"), "likely")

    first = likely(shared.select(F.explode("leaders").alias("a"), F.col("v").alias("b")))
    ends = first.select(F.col("a").alias("v")).union(first.select(F.col("b").alias("v"))).distinct()
    # Sets are needed of all vertices that share a node and may be compared later on.
    found = staged(_confirmed(first, staged(_full_sets(docs, vertices.join(ends.hint("merge"), "v", "left_semi")), "sets"), percent), "links")
    level, begun = shared.select("tree", "node", "v"), trees
    done: list[DataFrame] = []
    roots = staged(neighbour_labels(found), "roots")
    for depth in range(DEPTH, DEEPEST + 1, STEP):
        if depth > DEPTH:  # new trees, since a pair seldom stays together over more levels of the same few
            crowded, n = staged(large.select("v").distinct().join(tokens.hint("merge"), "v"), "crowded"), trees_for(percent, depth)
            level = paths(crowded, percent=percent, trees=n, depth=depth, first=begun).select("tree", "node", "v")
            level, begun = staged(level, "level"), begun + n
        small, large = _residual(level, roots, tokens, least)
        done.append(small)
        if large.isEmpty():
            break
    else:  # these agree in so many chosen tokens that branching doesn't part them: blocks against blocks
        done.append(staged(_candidates(_blocks(large, roots), tokens, least), "candidates"))
    rest = _union(done)
    wanted = vertices.join(rest.select("v").distinct().hint("merge"), "v", "left_semi")
    more = _compared(rest, staged(_full_sets(docs, wanted), "sets"), percent, least)
    return found.unionByName(more)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _residual(level: DataFrame, roots: DataFrame, tokens: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Candidates in the small nodes that hold several components, and rows (tree, node, v) of the large ones."""
    rooted = level.join(roots.hint("merge"), "v", "left").select("tree", "node", "v", F.coalesce("root", "v").alias("root"))
    mixed = rooted.groupBy("tree", "node").agg(F.count("*").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    rooted = staged(rooted.join(mixed.select("tree", "node", "size").hint("merge"), ["tree", "node"]), "mixed")
    small = rooted.filter(F.col("size") <= SMALL).select(F.xxhash64("tree", "node").alias("node"), "v", "root", F.lit(0).alias("side"))
    return staged(_candidates(small, tokens, least), "candidates"), rooted.filter(F.col("size") > SMALL).select("tree", "node", "v")


def _blocks(level: DataFrame, roots: DataFrame, block: int = 256) -> DataFrame:
    """Nodes of any size as pairs of blocks, each pair a node of bounded size: side 0 against side 1, or a block against itself."""
    rooted = level.join(roots.hint("merge"), "v", "left").select("tree", "node", "v", F.coalesce("root", "v").alias("root"))
    n = F.ceil(F.col("size") / block).cast("int")
    size = rooted.groupBy("tree", "node").agg(F.count("*").alias("size"))
    rows = rooted.join(size.hint("merge"), ["tree", "node"]).withColumn("own", F.pmod(F.xxhash64("v"), n).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    key = F.xxhash64("tree", "node", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return rows.select(key.alias("node"), "v", "root", side.alias("side"))


def _candidates(nodes: DataFrame, tokens: DataFrame, least: int) -> DataFrame:
    """Those vertices (node, v, root, side, tokens) that have a likely partner of another component in their node."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in key_groups(batches, "node"):
            m, root, side = _matrix(pdf["tokens"]), pdf["root"].to_numpy(), pdf["side"].to_numpy()
            wanted = np.zeros(len(pdf), bool)
            for a, b in zip(*(x.tolist() for x in bounds(pdf["node"].to_numpy())), strict=True):
                for i in range(a, b - 1):
                    near = np.flatnonzero((m[i + 1 : b] == m[i]).sum(axis=1) >= least) + i + 1
                    near = near[(root[near] != root[i]) & ((side[near] != side[i]) | (side[i] == 0))]
                    if len(near):
                        wanted[i] = wanted[near] = True
            yield pdf[wanted]

    rows = nodes.join(tokens.hint("merge"), "v").select("node", "v", "root", "side", "tokens")
    return rows.repartition("node").sortWithinPartitions("node").mapInPandas(pick, rows.schema)


def _compared(rows: DataFrame, sets: DataFrame, percent: int, least: int) -> DataFrame:
    """Links (a, b) that join the vertices of each node: likely pairs of different components, on their full sets.

    What a node has joined already isn't compared again, so a node gives fewer links than it has vertices.
    """
    full = rows.join(sets.withColumnRenamed("tokens", "members").hint("merge"), "v")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in key_groups(batches, "node"):
            m, v, side = _matrix(pdf["tokens"]), pdf["v"].to_numpy(), pdf["side"].to_numpy()
            names, root = np.unique(pdf["root"].to_numpy(), return_inverse=True)
            sets_ = [np.frombuffer(x, "<u8") for x in pdf["members"]]
            links_ = []
            for a, b in zip(*(x.tolist() for x in bounds(pdf["node"].to_numpy())), strict=True):
                own = root[a:b].copy()
                for i in range(b - a - 1):
                    near = np.flatnonzero((m[a + i + 1 : b] == m[a + i]).sum(axis=1) >= least) + i + 1
                    for j in near.tolist():
                        if own[i] == own[j] or side[a + i] == side[a + j] != 0:
                            continue
                        x, y = sets_[a + i], sets_[a + j]
                        same = len(np.intersect1d(x, y, assume_unique=True))
                        if 100 * same >= percent * (len(x) + len(y) - same):
                            links_.append((v[a + i], v[a + j]))
                            own[own == own[j]] = own[i]
            yield pd.DataFrame(links_, columns=["a", "b"])

    cols = ["node", "v", "root", "side", "tokens", "members"]
    return full.select(cols).repartition("node").sortWithinPartitions("node").mapInPandas(compare, "a binary, b binary")


def near_duplicates(docs: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one per document."""
    rows = staged(sketch(docs), "sketch")
    vertices = rows.filter(F.col("v").isNotNull()).groupBy("v").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "at")).alias("one"), F.min("tokens").alias("tokens"))
    vertices = staged(vertices.select("v", "doc_id", "one.at", "tokens"), "vertices")
    roots = components(links(docs, vertices, percent=percent))
    linked = vertices.select("v", "doc_id").join(roots.hint("merge"), "v")
    least = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = linked.join(least.hint("merge"), "root").select("v", "component_id")
    classes = vertices.select("v", "doc_id").join(named.hint("merge"), "v", "left")
    classes = classes.select("v", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = rows.select("doc_id", "v", "n_shingles").join(classes.hint("merge"), "v", "left")
    component = F.when(F.col("v").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """The rows that stay when of each group of near duplicates the one with the least id does, first by row where ids are equal or null.

    Rows are told apart by a number of their own, so rows that repeat an id or have none are judged by their own text; texts
    without words are in no group. All columns are kept.
    """
    row = unused_name(docs, "row")
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), percent=percent).select(F.col("doc_id").alias(row), "component_id")
    named = rows.select(row, F.col("doc_id").alias("own")).join(groups.hint("merge"), row)
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("own").isNull(), "own", row)).alias("one")).select(F.col(f"one.{row}").alias(row))
    return rows.join(first.hint("merge"), row, "left_semi").select(docs.columns)


def near_dup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 9 over the whole of ``documents``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

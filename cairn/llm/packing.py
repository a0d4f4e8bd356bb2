"""Operator 10: documents packed into fixed-length sequences by a grouping genetic algorithm on islands.

A document's ids and the end id are cut into pieces of the capacity; full pieces are sequences by themselves. The
others are dealt into blocks of a bounded number of pieces. For each block several islands evolve populations of whole
packings that start from varied orders: crossover injects well-filled bins of one parent into the other, removes bins that hold a
duplicate, and puts the displaced pieces back, first where they fill a bin better than what it holds (what they replace is
displaced in turn), the rest by best fit. Between epochs each island's elite migrates to the next one; a block is done when it needs no more
bins than its tokens fill. Bins that stay loose are dealt into new blocks and packed again, until one block is left or
another turn saves nothing.

Defined results: null text is a document of the end id only; rows that repeat an id are packed each, a null id stays null;
very long texts become many pieces; extra columns, whatever their names, are ignored; empty tables give no row.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import mix64, staged
from cairn.llm.tokens import encoder

CAPACITY, BLOCK, ISLANDS, EPOCHS = 2048, 2048, 3, 3
POPULATION, GENERATIONS, LOOSEST = 6, 6, 16
#: A bin filled less than this share of the capacity is packed again with those of other blocks.
LOOSE = 0.97


def pieces(docs: DataFrame, tokenizer_path: str, *, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Rows (uid, doc_id, piece, start, length, ids_crc32); uid tells repeated rows apart."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer_path)
        uid = TaskContext.get().partitionId() << 33
        for pdf in batches:
            rows = []
            for doc, none, ids in zip(pdf["doc_id"].tolist(), pdf["no_id"].tolist(), enc.encode_all(pdf["text"].tolist()), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((uid, None if none else doc, k, at, len(part), zlib.crc32(part.tobytes())))
                    uid += 1
            out = pd.DataFrame(rows, columns=["uid", "doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    doc = F.col("doc_id").cast("long")
    rows = docs.select(F.coalesce(doc, F.lit(0)).alias("doc_id"), doc.isNull().alias("no_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(cut, "uid long, doc_id long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Bins with room kept by residual, so that best fit takes one step on a bit mask."""

    def __init__(self, sizes: list[int], capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.room: list[int] = []
        self._with: list[list[int]] = [[] for _ in range(capacity + 1)]
        self._mask = 0

    def add(self, items: list[int]) -> None:
        left = self.capacity - sum(self.sizes[i] for i in items)
        self.bins.append(items)
        self.room.append(left)
        self._file(len(self.bins) - 1, left)

    def _file(self, b: int, left: int) -> None:
        if left:
            self._with[left].append(b)
            self._mask |= 1 << left

    def best_fit(self, item: int) -> None:
        """Into the bin with the least room that suffices, else into a new one."""
        size = self.sizes[item]
        fits = self._mask >> size
        if not fits:
            self.add([item])
            return
        left = size + (fits & -fits).bit_length() - 1
        b = self._with[left].pop()
        if not self._with[left]:
            self._mask &= ~(1 << left)
        self.bins[b].append(item)
        self.room[b] = left - size
        self._file(b, left - size)

    def replace(self, b: int, gone: tuple[int, ...], item: int) -> None:
        """Put an item in the place of others; it must fit."""
        before = self.room[b]
        if before:
            self._with[before].remove(b)
            if not self._with[before]:
                self._mask &= ~(1 << before)
        self.bins[b] = [i for i in self.bins[b] if i not in gone] + [item]
        self.room[b] = before + sum(self.sizes[i] for i in gone) - self.sizes[item]
        self._file(b, self.room[b])

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then fuller ones (mean square of the fill)."""
        return -len(self.bins), sum((self.capacity - r) ** 2 for r in self.room)


def best_fit_in(sizes: list[int], capacity: int, order: np.ndarray) -> Bins:
    """Best fit in the given order."""
    out = Bins(sizes, capacity)
    for i in order.tolist():
        out.best_fit(i)
    return out


def restore(out: Bins, displaced: list[int]) -> Bins:
    """Put pieces back: into the ``LOOSEST`` bins where one fills more than one or two that it replaces, then by best fit, largest first.

    Replaced pieces are displaced in turn; every replacement fills a bin further, so this ends.
    """
    sizes = out.sizes
    waiting = sorted((sizes[i], i) for i in displaced)
    for k in np.argsort(out.room, kind="stable")[::-1][:LOOSEST].tolist():
        left, best = out.room[k], None
        items = sorted(out.bins[k], key=sizes.__getitem__) if left and waiting else []
        for which in [(i,) for i in items] + list(itertools.combinations(items, 2)):
            held = sum(sizes[i] for i in which)
            at = bisect.bisect_right(waiting, (held + left, len(sizes))) - 1
            if at >= 0 and waiting[at][0] > held and (best is None or waiting[at][0] - held > best[0]):
                best = (waiting[at][0] - held, at, which)
        if best:
            out.replace(k, best[2], waiting.pop(best[1])[1])
            for i in best[2]:
                bisect.insort(waiting, (sizes[i], i))
    for _, i in reversed(waiting):
        out.best_fit(i)
    return out


def crossover(a: Bins, b: Bins, rng: np.random.Generator) -> Bins:
    """Whole well-filled bins of b go into a; bins of a with a duplicate go, and what they alone held is put back."""
    full = np.argsort(b.room, kind="stable")
    chosen = full[: max(1, len(full) // 2)]
    chosen = chosen[rng.random(len(chosen)) < 0.5] if len(chosen) > 1 else chosen
    child, held, displaced = Bins(a.sizes, a.capacity), set(), []
    for k in chosen.tolist():
        child.add(list(b.bins[k]))
        held.update(b.bins[k])
    for items in a.bins:
        if held.isdisjoint(items):
            child.add(list(items))
        else:
            displaced += [i for i in items if i not in held]
    return restore(child, displaced)


def mutate(a: Bins, rng: np.random.Generator) -> Bins:
    """Empty the least filled bins and a few others, and put back what they held."""
    order = np.argsort(a.room, kind="stable")[::-1]
    few = max(2, len(order) // 20)
    gone = set(order[:few].tolist()) | set(rng.integers(0, len(order), few).tolist())
    out, displaced = Bins(a.sizes, a.capacity), []
    for k, items in enumerate(a.bins):
        if k in gone:
            displaced += items
        else:
            out.add(list(items))
    return restore(out, displaced)


def beginners(sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Iterator[Bins]:
    """Varied packings: best fit in roughly decreasing order and in any order."""
    items = sizes.tolist()
    while True:
        yield best_fit_in(items, capacity, np.argsort(-(sizes * rng.uniform(0.7, 1.0, len(sizes))), kind="stable"))
        yield best_fit_in(items, capacity, rng.permutation(len(sizes)))


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """No packing needs fewer: what the total fills, and what no two of share a bin."""
    return max(-(-int(sizes.sum()) // capacity), int((2 * sizes > capacity).sum()))


def decreasing(sizes: np.ndarray, capacity: int) -> Bins:
    return best_fit_in(sizes.tolist(), capacity, np.argsort(-sizes, kind="stable"))


def evolve(sizes: np.ndarray, capacity: int, seed: int, elites: list[np.ndarray], generations: int = GENERATIONS) -> np.ndarray:
    """The bin of each item in the island's best packing after its generations; stops at the least possible number."""
    items, rng = sizes.tolist(), np.random.default_rng(seed)
    least, new = least_bins(sizes, capacity), beginners(sizes, capacity, rng)
    people = [from_bins(items, capacity, assigned) for assigned in elites] or [next(new)]
    best = max(people, key=Bins.fitness)
    for _ in range(generations):
        if len(best.bins) <= least:
            break
        while len(people) < POPULATION:
            people.append(next(new))
        x, y, z = rng.choice(len(people), 3, replace=False)
        children = [crossover(people[x], people[y], rng), crossover(people[y], people[x], rng), mutate(best, rng), mutate(people[z], rng)]
        people = sorted([*people, *children], key=Bins.fitness, reverse=True)[:POPULATION]
        best = people[0]
    return assigned_bins(best)


def assigned_bins(packing: Bins) -> np.ndarray:
    out = np.zeros(len(packing.sizes), np.int64)
    for k, members in enumerate(packing.bins):
        out[members] = k
    return out


def from_bins(items: list[int], capacity: int, assigned: np.ndarray) -> Bins:
    person = Bins(items, capacity)
    by_bin = np.argsort(assigned, kind="stable")
    for members in np.split(by_bin, np.flatnonzero(np.diff(assigned[by_bin])) + 1):
        person.add(members.tolist())
    return person


def _round(items: DataFrame, n_blocks: int, capacity: int, seed: int) -> DataFrame:
    """One packing of (uid, length) rows; adds block and bin, the bin's room and the offset in it.

    Each block begins with best fit in decreasing order. Blocks that this leaves with more bins than the bound evolve on islands.
    """
    block = F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(n_blocks)).cast("int")

    def begin(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", kind="stable")
        sizes = pdf["length"].to_numpy()
        packing = decreasing(sizes, capacity)
        return pdf.assign(bin=assigned_bins(packing), open=len(packing.bins) > least_bins(sizes, capacity))

    schema = "uid long, length long, block int, bin long"
    begun = items.select("uid", "length", block.alias("block")).groupBy("block").applyInPandas(begin, f"{schema}, open boolean")
    begun = staged(begun, "begun")
    # The first island goes on from there, the others start anew; every island's elite stays and also goes to the next island.
    state = begun.filter("open").drop("open").withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    state = state.withColumn("origin", F.when(F.col("island") == 0, 0).otherwise(-1))

    def island(epoch: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            groups = [g for _, g in pdf.sort_values(["origin", "uid"], kind="stable").groupby("origin", sort=True)]
            elites = [g["bin"].to_numpy() for g in groups if g["origin"].iloc[0] >= 0]
            own = int(mix64(np.array([(key[0] * 1000 + key[1]) * 1000 + seed * 10 + epoch], np.uint64))[0] >> np.uint64(1))
            best = evolve(groups[0]["length"].to_numpy(), capacity, own, elites)
            return groups[0].assign(bin=best, island=key[1], origin=key[1])

        return run

    for epoch in range(EPOCHS):
        state = state.groupBy("block", "island").applyInPandas(island(epoch), f"{schema}, island int, origin int")
        if epoch + 1 < EPOCHS:
            both = F.array(F.col("origin"), F.pmod(F.col("origin") + 1, F.lit(ISLANDS)))
            state = state.withColumn("island", F.explode(F.array_distinct(both)))

    def choose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        groups = [g.sort_values("uid", kind="stable") for _, g in pdf.groupby("origin", sort=True)]
        best = min(groups, key=lambda g: (g["bin"].nunique(), g["origin"].iloc[0]))
        bins = best.groupby("bin")["length"]
        return best[["uid", "length", "block", "bin"]].assign(room=capacity - bins.transform("sum"), offset=bins.cumsum() - best["length"])

    settled = begun.filter("not open").drop("open").withColumn("origin", F.lit(0))
    every = settled.unionByName(state.select(settled.columns))
    return every.groupBy("block").applyInPandas(choose, f"{schema}, room long, offset long")


def pack(rows: DataFrame, *, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Adds sequence_id and offset to rows with uid and length."""
    left = rows.filter(F.col("length") < capacity).select("uid", "length")
    done, before, n, turn, n_bins = [], None, left.count(), 0, None
    while n:
        n_blocks = -(-n // block)
        sequence = F.lit(turn + 1).cast("long") * (1 << 56) + F.col("block").cast("long") * (1 << 24) + F.col("bin")
        packed = staged(_round(left, n_blocks, capacity, turn), "packed").withColumn("sequence_id", sequence)
        loose = F.col("room") > int(capacity * (1 - LOOSE))
        first = F.col("offset") == 0  # one piece of each sequence
        r = packed.agg(F.count_if(first).alias("bins"), F.count_if(first & loose).alias("loose"), F.count_if(loose).alias("n")).first()
        if before is not None and r.bins >= n_bins:
            done.append(before)
            break
        if n_blocks == 1:
            done.append(packed)
            break
        done.append(packed.filter(~loose))
        before = packed.filter(loose)
        left, n, n_bins, turn = before.select("uid", "length"), r.n, r.loose, turn + 1
    if done:
        placed = reduce(DataFrame.unionByName, (x.select("uid", "sequence_id", "offset") for x in done))
    else:
        placed = left.select("uid", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    full = rows.filter(F.col("length") >= capacity).withColumns({"sequence_id": F.col("uid"), "offset": F.lit(0).cast("long")})
    return rows.filter(F.col("length") < capacity).join(placed, "uid").unionByName(full)


def pack_documents(docs: DataFrame, tokenizer_path: str, *, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    out = pack(staged(pieces(docs, tokenizer_path, end_id=end_id, capacity=capacity), "pieces"), capacity=capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 10 over the whole of ``documents``."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))

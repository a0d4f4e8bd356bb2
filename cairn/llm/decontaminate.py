"""Operator 4: benchmark passages found in documents by Wu-Manber multi-pattern search over words.

Windows of 13 words (a shorter item is one window) are the patterns, grouped by length. A shift table over blocks of two words skips
places where no pattern can end; where the shift is 0, the bucket of that suffix block, narrowed by the window's first
block, holds the patterns that are compared word by word.

The patterns are sent to every task, so they come in parts of at most ``part_bytes`` of benchmark text; documents are
scanned once for each part and the hits are united, so a benchmark of any size is searched whole.

Defined results: null text has no words, and neither does text of separators only; such documents are clean. A null
item id is listed as ``null``; equal items count once per id. Without a benchmark every document is clean. Rows that repeat an
id, or have none, are judged each by its own text; texts of any length are searched whole; extra columns, whatever their names, are ignored
(kept by ``clean_rows``); empty tables give no row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import staged, unused_name

WINDOW, PART_BYTES = 13, 8_000_000
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
#: Every byte that separates words becomes a space, A to Z become lower case.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Maximal runs of digits, letters and characters beyond ASCII, with A-Z in lower case."""
    return [w for w in (text or "").encode().translate(_TABLE).split(b" ") if w]


class Patterns:
    """Shift tables and suffix buckets of all windows, by window length."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        by_length: dict[int, dict[tuple, set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            found = words(text)
            n = min(window, len(found))
            for at in range(len(found) - n + 1 if n else 0):
                by_length[n][tuple(found[at : at + n])].add(item)
        self.tables = [_table(n, patterns) for n, patterns in sorted(by_length.items())]

    def search(self, text: list[bytes]) -> tuple[bytearray, set[str]]:
        """A mark for each word that lies in an occurrence, and the items that occur."""
        marks, items = bytearray(len(text)), set()
        for n, block, shift, buckets in self.tables:
            ones = b"\x01" * n
            far, i, end = n - block + 1, n - 1, len(text)
            skip = shift.get
            while i < end:
                last = (text[i - 1], text[i]) if block == 2 else text[i]
                step = skip(last, far)
                if step:
                    i += step
                    continue
                at = i - n + 1
                first = (text[at], text[at + 1]) if block == 2 else text[at]
                bucket = buckets[last].get(first)
                if bucket:
                    found = bucket.get(tuple(text[at : i + 1]))
                    if found:
                        marks[at : i + 1] = ones
                        items |= found
                i += 1
        return marks, items


def _table(n: int, patterns: dict[tuple, set[str]]) -> tuple[int, int, dict, dict]:
    block = 2 if n > 1 else 1
    shift: dict = {}
    buckets: dict = defaultdict(lambda: defaultdict(dict))
    for pattern, items in patterns.items():
        blocks = list(zip(pattern, pattern[1:], strict=False)) if block == 2 else list(pattern)
        for k, b in enumerate(blocks):
            shift[b] = min(shift.get(b, n), len(blocks) - 1 - k)
        buckets[blocks[-1]][blocks[0]][pattern] = items
    return n, block, shift, {k: dict(v) for k, v in buckets.items()}


def _parts(benchmark: DataFrame, part_bytes: int) -> list[DataFrame]:
    """Parts of items whose text is about ``part_bytes`` each."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-size // part_bytes) or 1
    if n == 1:
        return [benchmark]
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [benchmark.filter(part == k) for k in range(n)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, items, contaminated); items are the sorted ids of those that occur."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("string").alias("text"))
    parts = _parts(items, part_bytes)

    def scan(df: DataFrame, part: DataFrame) -> DataFrame:
        # Bounded: one part holds about part_bytes of text.
        sent = spark.sparkContext.broadcast([(r.item_id, r.text) for r in part.collect()])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            patterns = Patterns(sent.value, window)
            for pdf in batches:
                n, hit, found, marked = [], [], [], []
                for text in pdf["__text"]:
                    in_order = words(text)
                    marks, names = patterns.search(in_order)
                    n.append(len(in_order))
                    hit.append(sum(marks))
                    found.append(sorted(names))
                    marked.append(bytes(marks) if hit[-1] and several else None)
                out = pdf.drop(columns="__text")
                yield out.assign(n_words=n, n_hit=hit, items=found, marks=marked)

        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "__text")
        return df.mapInPandas(run, f"{kept}, n_words long, n_hit long, items array<string>, marks binary")

    several = len(parts) > 1
    if not several:
        # Ids travel as text: pandas would make floats of integers among nulls.
        slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("__text"))
        found = scan(slim, parts[0]).drop("marks")
        return _judged(found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)))
    base = staged(docs.select("doc_id", F.col("text").cast("string").alias("__text")).withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = [staged(scan(base.select("__row", "__text"), p), "hits") for p in parts]
    united = found[0]
    for more in found[1:]:
        united = united.unionByName(more)

    merged = united.groupBy("__row").agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.collect_list("marks").alias("all"),
    )
    n_hit = F.when(F.size("all") == 0, F.lit(0)).otherwise(_count_either("all")).cast("long")
    merged = merged.select("__row", "n_words", n_hit.alias("n_hit"), "items")
    return _judged(base.select("doc_id", "__row").join(merged, "__row").drop("__row"))


@F.pandas_udf(T.LongType())
def _count_either(all_marks: pd.Series) -> pd.Series:
    """Words marked in any of the parts."""
    return all_marks.map(lambda xs: int(np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in xs]).sum()) if len(xs) else 0)


def clean_rows(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows whose own text isn't contaminated, whatever their ids; all columns are kept.

    A benchmark of one part filters rows in place, without shuffle; more parts are united by a number of each row.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("string").alias("text"))
    if len(_parts(items, part_bytes)) > 1:
        row = unused_name(docs, "row")
        rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
        found = decontaminate(rows.select(F.col(row).alias("doc_id"), "text"), benchmark, window=window, part_bytes=part_bytes)
        return rows.join(found.filter("contaminated").select(F.col("doc_id").alias(row)).hint("merge"), row, "left_anti").select(docs.columns)
    sent = docs.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in items.collect()])  # at most part_bytes of text

    @F.pandas_udf(T.BooleanType())
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        patterns = Patterns(sent.value, window)
        for texts in batches:
            out = []
            for text in texts:
                in_order = words(text)
                n_hit = sum(patterns.search(in_order)[0])
                out.append(not (n_hit and SHARE * n_hit >= len(in_order)))
            yield pd.Series(out, dtype=bool)

    return docs.filter(clean(F.col("text").cast("string")))


def _judged(df: DataFrame) -> DataFrame:
    return df.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def digest(items: DataFrame) -> DataFrame:
    return items.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 4 over the whole of ``documents`` and ``benchmark``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))

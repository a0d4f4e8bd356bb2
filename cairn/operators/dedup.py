"""Global deduplication, statistics, reassembly and entry integrity."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stats(refs: DataFrame, by: list[str]) -> DataFrame:
    """References, unique blocks, bytes, unique bytes and what deduplication saves; two-step, so no hot group is collected."""
    per_block = refs.groupBy(*by, "block_hash").agg(F.count("*").alias("n"), F.max(F.length("raw")).cast("long").alias("size"))
    return per_block.groupBy(*by).agg(
        F.sum("n").alias("n_refs"), F.count("*").alias("unique_blocks"), F.sum(F.col("n") * F.col("size")).alias("total_bytes"),
        F.sum("size").alias("unique_bytes"), F.sum((F.col("n") - 1) * F.col("size")).alias("saved_bytes"),
    )


def tree_hash(entries: DataFrame) -> DataFrame:
    """One hash (tree_hash) over (path, content) in path order, row by row in one task, so that memory holds a batch at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest, n = hashlib.sha256(), 0
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                digest.update(path.encode() + (data or b""))
            n += len(pdf)
        if n:
            yield pd.DataFrame({"tree_hash": [digest.hexdigest()]})

    return entries.select("path", "content").orderBy("path", "content").coalesce(1).mapInPandas(run, "tree_hash string")


def upsert(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """New rows and the old ones whose key isn't among them."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def delete(entries: DataFrame, targets: DataFrame) -> DataFrame:
    """Without entries that are a target or lie below one; equi-joins on every ancestor, no nested loop."""
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    hit = entries.select("path", F.explode(above).alias("target")).join(targets.select("target").distinct(), "target", "left_semi").select("path").distinct()
    return entries.join(hit, "path", "left_anti")

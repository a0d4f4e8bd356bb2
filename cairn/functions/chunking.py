"""Content-defined chunks by a gear hash, vectorised: a cut depends on the last log2(target) bytes only."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the archive format: chunk sizes in bytes, and the seed of the 256 gear values.
MIN_SIZE, TARGET_SIZE, MAX_SIZE = 32 * 1024, 128 * 1024, 512 * 1024
GEAR_SEED = "QBX-GEAR-{}"


@functools.cache
def gear(target: int) -> np.ndarray:
    """The gear value of each byte modulo the target size, a power of two."""
    if target & (target - 1):
        raise ValueError("the target size must be a power of two")
    found = (int.from_bytes(hashlib.sha256(GEAR_SEED.format(i).encode()).digest()[:8]) % target for i in range(256))
    return np.fromiter(found, np.int64, 256)


def cuts(data: bytes, least: int = MIN_SIZE, target: int = TARGET_SIZE, most: int = MAX_SIZE) -> list[int]:
    """Ends of the chunks: the first candidate at or after the least size, else the largest size, else the end."""
    raw, bits = np.frombuffer(data, np.uint8), target.bit_length() - 1
    if least < bits:
        raise ValueError("the least size must cover the hash's window")
    values = gear(target)[raw]
    rolled = np.zeros(len(raw), np.int64)
    for k in range(min(bits, len(raw))):
        rolled[k:] += values[: len(raw) - k] << k
    ends, out, at = np.flatnonzero(rolled % target == 0) + 1, [], 0
    while at < len(raw):
        k = np.searchsorted(ends, at + least)
        at = min(int(ends[k]) if k < len(ends) else len(raw), at + most, len(raw))
        out.append(at)
    return out


def stream(source: BinaryIO, least: int = MIN_SIZE, target: int = TARGET_SIZE, most: int = MAX_SIZE, window: int = 4 << 20) -> Iterator[bytes]:
    """The chunks of a file of any size, with little more than a window of it in memory.

    A chunk's end depends on its own bytes only, so every chunk but the last of a window is final.
    """
    held, ended = b"", False
    while not ended:
        more = source.read(max(window, 2 * most))
        ended = not more
        held += more
        ends = cuts(held, least, target, most) if held else []
        at = 0
        for end in ends if ended else ends[:-1]:
            yield held[at:end]
            at = end
        held = held[at:]


def spread(entries: DataFrame) -> DataFrame:
    """Entries in as many partitions as there are cores, where a small table comes in fewer; larger ones stay as they are, without shuffle."""
    cores = entries.sparkSession.sparkContext.defaultParallelism
    return entries if entries.rdd.getNumPartitions() >= cores else entries.repartition(cores)


def chunk(entries: DataFrame, *, least: int = MIN_SIZE, target: int = TARGET_SIZE, most: int = MAX_SIZE) -> DataFrame:
    """Rows (path, seq, start, stop, raw) of (path, content) entries; an empty entry has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                at = 0
                for seq, end in enumerate(cuts(data, least, target, most) if data else ()):
                    rows.append((path, seq, at, end, data[at:end]))
                    at = end
            yield pd.DataFrame(rows, columns=["path", "seq", "start", "stop", "raw"])

    return entries.select("path", "content").mapInPandas(run, "path string, seq int, start long, stop long, raw binary")


def refs(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("block_hash", F.sha2("raw", 256))

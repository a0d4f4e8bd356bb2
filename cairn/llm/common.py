"""Shared folder, staged tables and row-group iteration for the operators of this subpackage."""

from __future__ import annotations

import atexit
import posixpath
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder of this application below ``spark.checkpoint.dir``; all executors see it.

    Where the setting is missing, a temporary folder is used on a local master only: on a cluster it would be
    another disk for each executor, so there the setting is required.
    """
    app = spark.sparkContext.applicationId
    if app in _ROOTS:
        return _ROOTS[app]
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="cairn-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    root = f"{base.rstrip('/')}/cairn-{app}"
    _ROOTS[app] = root
    atexit.register(_remove, spark, root)
    return root


def _remove(spark: SparkSession, root: str) -> None:
    """Tables and files live as long as the application, since lazy results may read them."""
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the JVM may have gone first
        return


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once to the shared folder and read them back; cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame doesn't have yet, whatever the case."""
    have = {c.lower() for c in df.columns}
    return next(n for n in (f"{stem}{k or ''}" for k in range(len(have) + 1)) if n not in have)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class AtomicFile:
    """A file that gets its name only when it is complete; the name is unique to the task attempt."""

    def __init__(self, folder: str, stem: str, suffix: str) -> None:
        self.uri = f"{folder}/{stem}-{uuid.uuid4().hex[:12]}{suffix}"
        self._fs, self._path = file_system(self.uri)
        self._fs.create_dir(posixpath.dirname(self._path), recursive=True)
        self._out = self._fs.open_output_stream(self._path + ".part", compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self._out.write(data)
        self.size += len(data)

    def commit(self) -> str:
        self._out.close()
        self._fs.move(self._path + ".part", self._path)
        return self.uri


def read_file(uri: str) -> bytes:
    fs, path = file_system(uri)
    with fs.open_input_file(path) as f:
        return f.read()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def key_groups(batches: Iterable[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Whole groups of equal ``key`` from batches of rows sorted by it; one frame may hold many groups.

    Only the rows of the last, perhaps unfinished group are carried from batch to batch.
    """
    carry: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        last = pdf[key].iloc[-1]
        if carry and carry[0][key].iloc[0] == last:
            carry.append(pdf)
            continue
        whole = pd.concat([*carry, pdf], ignore_index=True) if carry else pdf
        keep = (whole[key] != last).to_numpy()
        cut = int(keep.sum())
        if cut:
            yield whole.iloc[:cut]
        carry = [whole.iloc[cut:]]
    if carry:
        yield pd.concat(carry, ignore_index=True)


def bounds(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1])
    return starts, np.append(starts[1:], len(sorted_values))


def batches_by_chars(texts: list[str], limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with at most ``limit`` characters, or one longer text."""
    start, chars = 0, 0
    for i, t in enumerate(texts):
        if i > start and chars + len(t) > limit:
            yield start, i
            start, chars = i, 0
        chars += len(t)
    if start < len(texts):
        yield start, len(texts)


def fold(column: str, parts: int) -> F.Column:
    """crc32 of the id written as text, modulo ``parts``; null ids are in no fold."""
    return F.crc32(F.col(column).cast("string")) % parts

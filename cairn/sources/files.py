"""Files, directories and ZIP members as chunks of entries; zero-byte and hidden files and empty directories are kept.

A chunk table has a row (path, seq, raw, size, sha256, mode, mtime_ns) for each chunk. The last chunk of an entry carries its size and hash;
an empty entry has one row without raw. Files are read in windows, so their size isn't bounded by memory.
"""

from __future__ import annotations

import hashlib
import io
import os
import stat
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import chunking
from cairn.functions.scalars import is_safe_member

CHUNK = "path string, seq int, raw binary, size long, sha256 string, mode int, mtime_ns long"
COLUMNS = [c.split()[0] for c in CHUNK.split(", ")]
Sizes = tuple[int, int, int]
DEFAULT: Sizes = (chunking.MIN_SIZE, chunking.TARGET_SIZE, chunking.MAX_SIZE)


def walk(root: str) -> tuple[list[tuple[str, str, int, int, int]], list[str]]:
    """Files (file, path, size, mode, mtime_ns) in path order and directories below a root; links and special files are errors.

    A directory's contents are relative to it, a file stands under its own name.
    """
    top = Path(root)
    if top.is_symlink():
        raise ValueError("links aren't archived")
    if not top.exists():
        raise ValueError(f"no such source: {root}")
    base, found = (top.parent, [top]) if top.is_file() else (top, sorted(top.rglob("*"), key=lambda p: p.as_posix()))
    rows, directories = [], []
    for p in found:
        s, path = p.lstat(), p.relative_to(base).as_posix()
        if stat.S_ISDIR(s.st_mode):
            directories.append(path)
        elif stat.S_ISREG(s.st_mode):
            rows.append((str(p), path, s.st_size, stat.S_IMODE(s.st_mode), s.st_mtime_ns))
        else:
            raise ValueError(f"not a regular file: {p}")
    return rows, directories


def _chunk_rows(path: str, source: BinaryIO, mode: int, mtime_ns: int | None, sizes: Sizes) -> Iterator[tuple]:
    """Rows of one entry, one chunk late, since the last one carries size and hash."""
    digest, size, last, seq = hashlib.sha256(), 0, None, 0
    for raw in chunking.stream(source, *sizes):
        if last is not None:
            yield path, seq, last, None, None, mode, mtime_ns
            seq += 1
        digest.update(raw)
        size, last = size + len(raw), raw
    yield path, seq, last, size, digest.hexdigest(), mode, mtime_ns


def _frames(rows: Iterator[tuple], limit: int = 16 << 20) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2] or b"")
        if size >= limit or len(held) >= 4096:
            yield _frame(held)
            held, size = [], 0
    if held:
        yield _frame(held)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS).astype({"size": "Int64", "mtime_ns": "Int64"})


def chunks(spark: SparkSession, root: str, *, sizes: Sizes = DEFAULT, prefix: str = "") -> tuple[DataFrame, list[str]]:
    """Chunk table and directories of a file or tree; executors read the files, which must lie where all of them see them."""
    listed, directories = walk(root)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for pdf in batches:
                for file, path, mode, at in zip(pdf["file"], pdf["path"], pdf["mode"].tolist(), pdf["mtime_ns"].tolist(), strict=True):
                    with open(file, "rb") as f:
                        yield from _chunk_rows(path, f, mode, at, sizes)

        yield from _frames(rows())

    table = spark.createDataFrame([(f, prefix + p, n, m, t) for f, p, n, m, t in listed], "file string, path string, size long, mode int, mtime_ns long")
    return table.mapInPandas(read, CHUNK), [prefix + d for d in directories] + ([prefix.rstrip("/")] if prefix and Path(root).is_dir() else [])


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Whole entries (path, content, size, mode, mtime_ns) of a file or tree in path order, one file in memory at a time."""
    listed, _ = walk(root)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(len(pdf)):
                one = pdf.iloc[k : k + 1]
                yield one.assign(content=[Path(one["file"].iloc[0]).read_bytes()])[["path", "content", "size", "mode", "mtime_ns"]]

    table = spark.createDataFrame(listed, "file string, path string, size long, mode int, mtime_ns long")
    return table.mapInPandas(read, "path string, content binary, size long, mode int, mtime_ns long")


def _member_kind(info: zipfile.ZipInfo) -> str:
    return "link" if stat.S_ISLNK(info.external_attr >> 16) else "dir" if info.is_dir() else "file"


def zip_listing(container: str) -> tuple[list[str], list[str]]:
    """Files and directories of a ZIP file, with forward slashes; unsafe names and links are errors."""
    names: dict[str, list[str]] = {"file": [], "dir": []}
    with zipfile.ZipFile(container) as z:
        for info in z.infolist():
            kind, name = _member_kind(info), info.filename.replace("\\", "/")
            parts = [p for p in name.split("/") if p not in ("", ".")]
            if kind == "link" or not parts or name.startswith("/") or ".." in name.split("/") or "\0" in name or ":" in parts[0]:
                raise ValueError(f"unsafe member: {info.filename}")
            names[kind].append("/".join(parts))
    return names["file"], names["dir"]


def zip_chunks(spark: SparkSession, container: str, *, sizes: Sizes = DEFAULT, prefix: str = "") -> tuple[DataFrame, list[str]]:
    """Chunk table and directories of a ZIP file's members; members are decompressed in windows, of equal names the last counts."""
    files, directories = zip_listing(container)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            with zipfile.ZipFile(container) as z:
                at = {"/".join(p for p in i.filename.replace("\\", "/").split("/") if p not in ("", ".")): i for i in z.infolist() if not i.is_dir()}
                for pdf in batches:
                    for member in pdf["member"]:
                        with z.open(at[member]) as f:
                            yield from _chunk_rows(prefix + member, f, 0o644, None, sizes)

        yield from _frames(rows())

    table = spark.createDataFrame([(m,) for m in dict.fromkeys(files)], "member string").repartition(spark.sparkContext.defaultParallelism)
    return table.mapInPandas(read, CHUNK), [prefix + d for d in directories]


def zip_members(containers: DataFrame) -> DataFrame:
    """Members (container, path, content, safe) of ZIP files given as (path, content); directories are skipped, links marked unsafe."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    rows = [(name, i.filename, z.read(i), _member_kind(i) == "link") for i in z.infolist() if not i.is_dir()]
                yield pd.DataFrame(rows, columns=["container", "path", "content", "link"])

    out = containers.select("path", "content").mapInPandas(run, "container string, path string, content binary, link boolean")
    return out.select("container", F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), "content", (is_safe_member(F.col("path")) & ~F.col("link")).alias("safe"))


def write_zip(table: DataFrame, directories: list[str], output: str) -> None:
    """A ZIP file of a chunk table: Deflate 9 in path order, empty directories kept, through a temporary file."""
    part, paths = f"{output}.part", set()
    with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED, compresslevel=9, allowZip64=True) as z:
        current, out = None, None
        for r in table.select("path", "seq", "raw").orderBy("path", "seq").toLocalIterator():
            if r.path != current:
                if out:
                    out.close()
                paths.add(r.path)
                current, out = r.path, z.open(zipfile.ZipInfo(r.path), "w", force_zip64=True)
            out.write(bytes(r.raw or b""))
        if out:
            out.close()
        for d in sorted(set(directories)):
            if not any(p.startswith(f"{d}/") for p in [*paths, *directories]):
                z.writestr(f"{d}/", b"")
    os.replace(part, output)


def by_entry(batches: Iterator[pd.DataFrame], begin: Callable[[str, pd.Series], BinaryIO | None], end: Callable[[str, pd.Series, int, str, bool, BinaryIO | None], tuple]) -> Iterator[tuple]:
    """Fold rows (path, seq, raw, ...) in path and seq order into one row per entry, a chunk at a time."""
    path, first, digest, size, missing, out = None, None, None, 0, False, None
    for pdf in batches:
        for k in range(len(pdf)):
            row = pdf.iloc[k]
            if row["path"] != path:
                if path is not None:
                    yield end(path, first, size, digest.hexdigest(), missing, out)
                path, first, digest, size, missing = row["path"], row, hashlib.sha256(), 0, False
                out = begin(path, row)
            raw = row["raw"]
            missing |= raw is None and row["seq"] >= 0
            if raw is not None:
                digest.update(raw)
                size += len(raw)
                if out:
                    out.write(raw)
    if path is not None:
        yield end(path, first, size, digest.hexdigest(), missing, out)


def _status(first: pd.Series, size: int, digest: str, missing: bool) -> str:
    return "missing block" if missing else "wrong size" if size != first["want_size"] else "wrong hash" if digest != first["want_sha256"] else "ok"


def checked(refs: DataFrame) -> DataFrame:
    """Rows (path, size, sha256, status) of entries put together from (path, seq, raw, want_size, want_sha256); seq -1 for an empty entry."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = by_entry(batches, lambda *_: None, lambda path, first, size, digest, missing, _: (path, size, digest, _status(first, size, digest, missing)))
        for r in rows:
            yield pd.DataFrame([r], columns=["path", "size", "sha256", "status"])

    ordered = refs.repartition("path").sortWithinPartitions("path", "seq")
    return ordered.mapInPandas(run, "path string, size long, sha256 string, status string")


def extract(refs: DataFrame, directories: list[str], destination: str, *, overwrite: bool = False) -> DataFrame:
    """Write entries of (path, seq, raw, want_size, want_sha256, mode, mtime_ns) below the destination; rows (path, size, status).

    Each entry goes to a temporary file, which is renamed if size and hash are right; mode and time are restored. Existing targets
    are refused before anything is written, unless ``overwrite``.
    """
    top = Path(destination).resolve()

    def target_of(path: str) -> Path:
        target = (top / path).resolve()
        if not target.is_relative_to(top):
            raise ValueError(f"outside the destination: {path}")
        return target

    if not overwrite:
        taken = next((r.path for r in refs.select("path").distinct().toLocalIterator() if target_of(r.path).exists()), None)
        if taken:
            raise ValueError(f"exists already: {taken}")
    top.mkdir(parents=True, exist_ok=True)
    for d in directories:
        target_of(d).mkdir(parents=True, exist_ok=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def begin(path: str, _: pd.Series) -> BinaryIO:
            target = target_of(path)
            target.parent.mkdir(parents=True, exist_ok=True)
            return open(target.with_name(f"{target.name}.{os.getpid()}.part"), "wb")

        def end(path: str, first: pd.Series, size: int, digest: str, missing: bool, out: BinaryIO) -> tuple:
            out.flush()
            os.fsync(out.fileno())
            out.close()
            status = _status(first, size, digest, missing)
            if status == "ok":
                os.chmod(out.name, int(first["mode"]))
                if not pd.isna(first["mtime_ns"]):
                    os.utime(out.name, ns=(int(first["mtime_ns"]),) * 2)
                os.replace(out.name, target_of(path))
            else:
                os.unlink(out.name)
            return path, size, status

        for r in by_entry(batches, begin, end):
            yield pd.DataFrame([r], columns=["path", "size", "status"])

    return refs.repartition("path").sortWithinPartitions("path", "seq").mapInPandas(run, "path string, size long, status string")

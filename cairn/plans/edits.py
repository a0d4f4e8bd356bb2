"""Edits of archives: add, delete and comment. Every edit writes a new resilient archive beside the old one and then takes its place."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import dedup
from cairn.plans import store
from cairn.sources import archive, files


def _repack(table: DataFrame, directories: list[str], path: str, **options: object) -> dict:
    """Write beside the archive, then rename; the old archive stays whole if anything fails."""
    beside = Path(path).resolve()
    beside = beside.with_name(f".{beside.stem}-{uuid.uuid4().hex[:12]}.qbx")
    try:
        out = store.write(table, directories, str(beside), **options)
        os.replace(beside, path)
    finally:
        beside.unlink(missing_ok=True)
    return out


def _comment(path: str) -> str:
    return str(archive.read_manifest(path)[1].get("comment", ""))


def add_sources(spark: SparkSession, path: str, sources: list[str], *, overwrite_entries: bool = True, sizes: files.Sizes = files.DEFAULT, **options: object) -> dict:
    """Add files and directories under their own names; new entries take the place of old ones, directories are merged."""
    if not sources:
        raise archive.ArchiveError("no sources")
    old, directories = store.chunk_table(spark, path)
    tables, names = [old], {f["path"].split("/")[0] for f in archive.read_manifest(path)[1]["files"]} | {d.split("/")[0] for d in directories}
    for source in sources:
        name = Path(source).name
        if name in names and not overwrite_entries:
            raise archive.ArchiveError(f"entry exists already: {name}")
        new, more = files.chunks(spark, source, sizes=sizes, prefix=f"{name}/" if Path(source).is_dir() else "")
        tables.append(new)
        directories = directories + more
    return _repack(store.merged(tables), directories, path, comment=_comment(path), sizes=sizes, **options)


def delete_entries(spark: SparkSession, path: str, entries: list[str], **options: object) -> dict:
    """Delete entries and all below deleted directories; it is an error if none of them exists."""
    if not entries:
        raise archive.ArchiveError("no entries")
    if unsafe := next((e for e in entries if not archive.safe(e)), None):
        raise archive.ArchiveError(f"unsafe path: {unsafe}")
    wanted = {"/".join(p for p in e.split("/") if p not in ("", ".")) for e in entries}
    gone = lambda p: any(p == w or p.startswith(f"{w}/") for w in wanted)
    table, directories = store.chunk_table(spark, path)
    paths = {f["path"] for f in archive.read_manifest(path)[1]["files"]} | set(directories)
    hit = {w for w in wanted if any(p == w or p.startswith(f"{w}/") for p in paths)}
    if not hit:
        raise archive.ArchiveError("none of the entries is in the archive")
    kept = dedup.delete(table, spark.createDataFrame([(w,) for w in wanted], "target string"))
    # A directory whose last entry goes stays, as it would on disk.
    left = [d for d in store.with_parents(directories, paths) if not gone(d)]
    return _repack(kept, left, path, comment=_comment(path), **options) | {"deleted_entries": len(hit)}


def set_comment(spark: SparkSession, path: str, comment: str, **options: object) -> dict:
    table, directories = store.chunk_table(spark, path)
    return _repack(table, directories, path, comment=comment, **options) | {"comment": comment}


def list_directory(spark: SparkSession, path: str, directory: str = "") -> DataFrame:
    """Children (name, is_dir) of a directory, directories first, by name whatever its case."""
    manifest, prefix = archive.read_manifest(path)[1], f"{directory.strip('/')}/" if directory.strip("/") else ""
    rows = [(f["path"], False) for f in manifest["files"]] + [(d, True) for d in manifest.get("directories", [])]
    inside = spark.createDataFrame(rows, "path string, dir boolean").filter(F.startswith("path", F.lit(prefix)))
    rest = F.substring("path", len(prefix) + 1, 1 << 30)
    children = inside.select(F.split_part(rest, F.lit("/"), F.lit(1)).alias("name"), (F.col("dir") | F.contains(rest, F.lit("/"))).alias("is_dir"))
    return children.groupBy("name").agg(F.max("is_dir").alias("is_dir")).orderBy(F.desc("is_dir"), F.lower("name"), "name")


def find(spark: SparkSession, path: str, term: str) -> DataFrame:
    """The first entry in the manifest's order whose path holds the term, whatever its case."""
    rows = [(k, f["path"]) for k, f in enumerate(archive.read_manifest(path)[1]["files"])]
    return spark.createDataFrame(rows, "ord long, path string").filter(F.contains(F.lower("path"), F.lit(term.lower()))).orderBy("ord").limit(1).select("path")

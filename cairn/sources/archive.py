"""Native archive container: write and read manifest and records; verify, recover, extract and repair.

Wire layout: magic (8 bytes), manifest length (u64 big endian), manifest JSON, record count (u64), then per record its
SHA-256 (32 bytes), codec (u8), raw size (u64), stored size (u64) and payload, ordered by digest.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import codecs
from cairn.functions.scalars import is_safe_path

# Fixed values of the container format.
MAGICS = {2: b"QBX2\r\n\x1a\n", 3: b"QBX3\r\n\x1a\n"}
MOST_MANIFEST, MOST_BLOCK = 64 * 1024 * 1024, 512 * 1024
RECORD, LENGTH = ">BQQ", ">Q"
_HEX = re.compile("[0-9a-f]{64}")
INDEX = "record_hash string, codec int, raw_size long, stored_size long, offset long"


class ArchiveError(ValueError):
    """Invalid, unsafe, unsupported or corrupt archive."""


def write_archive(records: DataFrame, manifest: dict, output: str) -> None:
    """Records (record_hash, codec, raw_size, payload) in hash order, streamed to a temporary file that is then renamed."""
    check(manifest)
    body = json.dumps(manifest, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
    if len(body) > MOST_MANIFEST:
        raise ArchiveError("the manifest is too large")
    path = Path(output)
    part, n = path.with_name(f".{path.name}.{os.getpid()}.part"), 0
    try:
        with part.open("wb") as f:
            f.write(MAGICS[manifest["version"]] + struct.pack(LENGTH, len(body)) + body + struct.pack(LENGTH, declared(manifest)))
            for r in records.orderBy("record_hash").toLocalIterator():
                f.write(bytes.fromhex(r.record_hash) + struct.pack(RECORD, r.codec, r.raw_size, len(r.payload)) + r.payload)
                n += 1
            f.flush()
            os.fsync(f.fileno())
        if n != declared(manifest):
            raise ArchiveError(f"{n} records instead of {declared(manifest)}")
        part.replace(path)
    finally:
        part.unlink(missing_ok=True)


def declared(manifest: dict) -> int:
    """Number of records that the manifest states."""
    return manifest["statistics"]["record_count" if manifest["version"] == 3 else "unique_blocks"]


def _is_hash(x: object, strict: bool) -> bool:
    return isinstance(x, str) and (bool(_HEX.fullmatch(x)) if strict else len(x) == 64)


def _whole(x: object) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def violations(manifest: object) -> list[tuple[str, str]]:
    """(rule, key) for each broken rule of a manifest; empty if all is well. Version 3 is laxer on hashes and knows block sizes and edges."""
    if not isinstance(manifest, dict) or manifest.get("format") != "QBX" or manifest.get("version") not in MAGICS:
        return [("format or version", "")]
    third, found = manifest["version"] == 3, []
    kinds = {"files": list, "directories": list, "statistics": dict} | ({"block_sizes": dict, "repair_edges": list} if third else {})
    optional = {"directories": [], "repair_edges": []}
    parts = {k: manifest.get(k, optional.get(k)) for k in kinds}
    if bad := [("kind of collection", k) for k, kind in kinds.items() if not isinstance(parts[k], kind)]:
        return bad
    sizes, seen = parts.get("block_sizes", {}), set()

    def path_rules(path: object) -> None:
        if not isinstance(path, str) or not safe(path):
            found.append(("unsafe path", str(path)))
        elif path in seen:
            found.append(("path stands twice", path))
        else:
            seen.add(path)

    for d in parts["directories"]:
        path_rules(d)
    for entry in parts["files"]:
        if not isinstance(entry, dict):
            found.append(("entry isn't an object", ""))
            continue
        path, refs = entry.get("path"), entry.get("blocks")
        path_rules(path)
        if not _whole(entry.get("size")) or entry["size"] < 0:
            found.append(("bad size", str(path)))
        if not _is_hash(entry.get("sha256"), strict=not third):
            found.append(("bad hash", str(path)))
        if not isinstance(refs, list):
            found.append(("bad block list", str(path)))
        else:
            found += [("missing block size" if third else "bad block reference", str(path)) for r in refs if (r not in sizes if third else not _is_hash(r, True))]
    for key, size in sizes.items():
        if not _is_hash(key, False) or not _whole(size) or not 0 < size <= MOST_BLOCK:
            found.append(("bad block size", key))
    for e in parts.get("repair_edges", []):
        if not isinstance(e, dict) or e.get("a") not in sizes or e.get("b") not in sizes or not _is_hash(e.get("repair"), False):
            found.append(("bad repair edge", str(e)))
    n = parts["statistics"].get("record_count" if third else "unique_blocks")
    if not _whole(n) or n < len(sizes):
        found.append(("bad record count", str(n)))
    return found


def safe(path: str) -> bool:
    """The rule of ``is_safe_path`` on the driver."""
    steps = [p for p in path.split("/") if p not in ("", ".")]
    return not (not path or "\0" in path or "\\" in path or path.startswith("/") or not steps or ".." in steps or ":" in steps[0])


def check(manifest: object) -> dict:
    if bad := violations(manifest):
        raise ArchiveError("the manifest is invalid: " + "; ".join(f"{rule} {key}".strip() for rule, key in bad[:3]))
    return manifest


def _exact(f: object, n: int, what: str) -> bytes:
    data = f.read(n)
    if len(data) != n:
        raise ArchiveError(f"the archive ends inside {what}")
    return data


def read_manifest(archive: str) -> tuple[int, dict, int]:
    """(version, valid manifest, offset of the record count); payloads aren't touched."""
    with open(archive, "rb") as f:
        magic = f.read(8)
        version = next((v for v, m in MAGICS.items() if m == magic), None)
        if version is None:
            raise ArchiveError("not an archive")
        (n,) = struct.unpack(LENGTH, _exact(f, 8, "the manifest's length"))
        if n > MOST_MANIFEST:
            raise ArchiveError("the manifest is too large")
        try:
            manifest = json.loads(_exact(f, n, "the manifest"))
        except ValueError as e:
            raise e if isinstance(e, ArchiveError) else ArchiveError(f"the manifest can't be read: {e}") from e
    if not isinstance(manifest, dict) or manifest.get("version") != version:
        raise ArchiveError("the manifest is of another version than the archive")
    return version, check(manifest), 16 + n


def read_index(spark: SparkSession, archive: str) -> DataFrame:
    """Headers of all records with the offsets of their payloads; payloads are skipped."""
    _, manifest, at = read_manifest(archive)
    rows, seen, size = [], set(), os.path.getsize(archive)
    with open(archive, "rb") as f:
        f.seek(at)
        (n,) = struct.unpack(LENGTH, _exact(f, 8, "the record count"))
        if n != declared(manifest):
            raise ArchiveError(f"the archive holds {n} records, its manifest states {declared(manifest)}")
        for _ in range(n):
            key = _exact(f, 32, "a digest").hex()
            codec, raw, stored = struct.unpack(RECORD, _exact(f, 17, "a record"))
            if codec not in codecs.NAMES or not 0 < raw <= MOST_BLOCK or not 0 < stored <= 3 * MOST_BLOCK or key in seen:
                raise ArchiveError("a record is invalid")
            seen.add(key)
            rows.append((key, codec, raw, stored, f.tell()))
            f.seek(stored, 1)
        if f.tell() != size:
            raise ArchiveError("the archive has trailing or missing bytes")
    return spark.createDataFrame(rows, INDEX)


def block_sizes(spark: SparkSession, archive: str) -> DataFrame:
    """Rows (block_hash, size) of the blocks that hold contents: all records of version 2, those that version 3 lists."""
    version, manifest, _ = read_manifest(archive)
    if version == 2:
        return read_index(spark, archive).select(F.col("record_hash").alias("block_hash"), F.col("raw_size").cast("int").alias("size"))
    return spark.createDataFrame(list(manifest["block_sizes"].items()), "block_hash string, size int")


def inspect(archive: str) -> dict:
    """What the manifest tells, with the number of blocks of each entry in place of the blocks; no payload is read."""
    _, manifest, _ = read_manifest(archive)
    shown = ("format", "version", "product_version", "compression_profile", "planner", "statistics")
    out = {k: manifest.get(k) for k in shown} | {"comment": manifest.get("comment", ""), "features": manifest.get("features", []), "directories": manifest.get("directories", [])}
    return out | {"files": [{"path": f["path"], "size": f["size"], "sha256": f["sha256"], "blocks": len(f["blocks"])} for f in manifest["files"]]}


def read_records(spark: SparkSession, archive: str) -> DataFrame:
    """Index rows with raw bytes and a status: ok, decode_error or hash_mismatch; executors read payload slices."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open(archive, "rb") as f:
            for pdf in batches:
                payloads = []
                for at, n in zip(pdf["offset"].tolist(), pdf["stored_size"].tolist(), strict=True):
                    f.seek(at)
                    payloads.append(f.read(n))
                yield pdf.assign(payload=payloads)

    rows = read_index(spark, archive).mapInPandas(read, INDEX + ", payload binary")
    rows = rows.withColumn("d", codecs.decoded("codec", "payload", "raw_size")).withColumn("raw", F.col("d.raw"))
    return rows.withColumn("status", status(F.col("raw"), F.col("record_hash"))).drop("d", "payload")


def status(raw: Column, key: Column) -> Column:
    """State of a record by its decoded bytes: ok, decode_error or hash_mismatch."""
    return F.when(raw.isNull(), "decode_error").when(F.sha2(raw, 256) != key, "hash_mismatch").otherwise("ok")


def edges_of(spark: SparkSession, manifest: dict) -> DataFrame:
    """Repair edges (group, a, b, repair); group is the least block of the edge's component, found in the manifest."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    edges = manifest.get("repair_edges", [])
    for e in edges:
        a, b = find(e["a"]), find(e["b"])
        parent[max(a, b)] = min(a, b)
    return spark.createDataFrame([(find(e["a"]), e["a"], e["b"], e["repair"]) for e in edges], "grp string, a string, b string, repair string")


def closed_group(size: dict[str, int], raw: dict[str, bytes], links: Iterable[tuple[str, str, bytes]]) -> dict[str, int]:
    """Round of each block of a group that is intact (0) or rebuilt; raw holds the intact ones and gets the rebuilt ones.

    links: (a, b, delta) of intact deltas. A rebuilt block counts only if its hash is right.
    """
    rounds, queue = dict.fromkeys(raw, 0), list(raw)
    near: dict[str, list] = {}
    for a, b, delta in links:
        near.setdefault(a, []).append((b, delta))
        near.setdefault(b, []).append((a, delta))
    for v in queue:
        for w, delta in near.get(v, ()):
            if w not in raw and len(raw[v]) <= len(delta):
                found = codecs.recover_other(raw[v], delta, size[w])
                if hashlib.sha256(found).hexdigest() == w:
                    raw[w], rounds[w] = found, rounds[v] + 1
                    queue.append(w)
    return rounds


def recovered_blocks(records: DataFrame, edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows (block_hash, raw, round) of primary blocks that are intact (round 0) or rebuilt from a delta and a neighbour.

    A component of the repair lattice has at most seven blocks, so each is closed in one grouped step; a rebuilt block
    counts only if its hash is right.
    """
    good = records.filter("status = 'ok'").select(F.col("record_hash").alias("block_hash"), "raw")
    ends = edges.select("grp", F.explode(F.array("a", "b")).alias("block_hash")).distinct()
    state = sizes.join(good, "block_hash", "left").join(ends, "block_hash", "left")
    ties = edges.join(good.select(F.col("block_hash").alias("repair"), F.col("raw").alias("delta")), "repair").select(F.col("grp").alias("tie_grp"), "a", "b", "delta")

    def close(key: tuple, own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        size = dict(zip(own["block_hash"], own["size"].tolist(), strict=True))
        raw = {h: x for h, x in zip(own["block_hash"], own["raw"], strict=True) if x is not None}
        rounds = closed_group(size, raw, zip(links["a"], links["b"], links["delta"], strict=True))
        return pd.DataFrame([(h, x, rounds[h]) for h, x in raw.items()], columns=["block_hash", "raw", "round"])  # of this form, no rows are no floats

    tied = state.filter("grp is not null").groupBy("grp").cogroup(ties.groupBy("tie_grp"))
    closed = tied.applyInPandas(close, "block_hash string, raw binary, round int")
    return state.filter("grp is null and raw is not null").select("block_hash", "raw", F.lit(0).alias("round")).unionByName(closed)


def manifest_violations(entries: DataFrame) -> DataFrame:
    """Rows (rule, path) of entries that break a rule: path, uniqueness, size or hash; empty if all is well."""
    rules = {
        "unsafe path": ~is_safe_path(F.col("path")),
        "negative size": F.coalesce(F.col("size") < 0, F.lit(True)),
        "bad hash": ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)),
    }
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    out = entries.select(F.explode(broken).alias("rule"), "path")
    twice = entries.groupBy("path").count().filter("count > 1").select(F.lit("path stands twice").alias("rule"), "path")
    return out.unionByName(twice)

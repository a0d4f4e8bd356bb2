"""Packing chunk tables into archives and back: profiles, the write path, verification, extraction and repair."""

from __future__ import annotations

import hashlib
import json
import time
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import chunking, codecs, scalars
from cairn.operators import frontier, lattice
from cairn.sources import archive, files
from cairn.staging import staged

# Fixed values of the container format: profile names, versions and what manifests say of them.
PROFILES = {"resilient": "resilient", "resilient-v3": "resilient", "ark": "resilient", "v3": "resilient", "adaptive": "adaptive", "adaptive-v2": "adaptive", "fast": "fast", "balanced": "balanced", "smallest": "smallest"}
WRITTEN = {"resilient": "resilient-v3", "adaptive": "adaptive-v2"}
PRODUCT = {"resilient": "3.2.1", "adaptive": "2.0.0"}
COMMON_FEATURES = ["content-defined-chunking", "global-deduplication", "sha256-block-integrity", "sha256-file-integrity", "safe-path-extraction"]
FEATURES = {
    "legacy": ["adaptive-codec-selection", "bounded-memory-file-chunking", "deterministic-layout"],
    "adaptive": ["pareto-representation-pruning", "adaptive-global-representation-planning", "goal-constrained-optimization", "measured-codec-latency"],
    "resilient": ["pareto-representation-pruning", "adaptive-global-representation-planning", "goal-constrained-optimization", "ark-repair-lattice", "counterfactual-repair-representations", "self-repair-corrupt-blocks"],
}
REPAIR_PERCENT = 5.0


def profile_of(name: str) -> str:
    if name not in PROFILES:
        raise archive.ArchiveError(f"unknown profile: {name}")
    return PROFILES[name]


def plan(measured: DataFrame, order: list[str], max_size: int | None = None, max_decode: int | None = None) -> tuple[DataFrame, dict]:
    """Chosen (block_hash, cand_idx) and the plan's totals: skyline per block, then the global plan over collected metadata (no payloads)."""
    cols = ["stored_size", "encode_ns", "decode_ns"]
    kept = frontier.pareto(measured.drop("payload"), "block_hash", cols, ["block_hash", "cand_idx", "name", "level", "raw_size", *cols])
    by_block: dict[str, list] = {h: [] for h in order}
    for r in kept.collect():
        by_block[r.block_hash].append((r.stored_size, r.decode_ns, r.encode_ns, r.name, -1 if r.level is None else r.level, r.cand_idx, r.raw_size))
    options = [sorted(by_block[h]) for h in order]
    found = frontier.global_plan([[(o[0], o[2], o[1]) for o in b] for b in options], [b[0][6] for b in options], max_size, max_decode)
    rows = [(h, b[k][5]) for h, b, k in zip(order, options, found["selection"], strict=True)]
    return measured.sparkSession.createDataFrame(rows, "block_hash string, cand_idx int"), found


def _planner(found: dict, labels: DataFrame) -> dict:
    histogram = {r.label: r["count"] for r in labels.groupBy("label").count().collect()}  # a row per codec and level
    totals = {"baseline_stored_bytes": "baseline_stored", "planned_stored_bytes": "stored", "baseline_decode_ns": "baseline_decode", "planned_decode_ns": "decode", "size_budget_bytes": "size_budget", "decode_budget_ns": "decode_budget", "peak_dp_states": "peak_states"}
    return {"name": "AGRP", "version": 2, "codec_histogram": histogram} | {k: found[v] for k, v in totals.items()}


def _choose(blocks: DataFrame, order: list[str], profile: str, goals: tuple[int | None, int | None]) -> tuple[DataFrame, dict]:
    """Primary records (block_hash, codec, raw_size, payload) and the planner's block of the manifest."""
    planned = profile in WRITTEN
    # Timings differ from run to run, so candidates are written before anything is chosen.
    measured = staged(codecs.candidates(blocks, "adaptive" if planned else profile), "candidates")
    if planned:
        chosen, found = plan(measured, order, *goals)
    else:
        won = codecs.choose(measured)
        chosen = measured.join(won, ["block_hash", "codec", "stored_size"]).groupBy("block_hash").agg(F.min("cand_idx").alias("cand_idx"))
    primary = staged(measured.join(chosen, ["block_hash", "cand_idx"]).select("block_hash", "codec", "name", "level", "raw_size", "payload"), "primary")
    labels = primary.select(scalars.codec_label(F.col("name"), F.col("level")).alias("label"))
    return primary.drop("name", "level"), _planner(found, labels) if planned else {}


def _lattice(primary: DataFrame, raw: DataFrame, percent: float) -> tuple[DataFrame, dict]:
    """Repair edges with payloads, and the lattice's report."""
    stored = primary.select("block_hash", F.length("payload").alias("stored"), "raw_size")
    grouped = staged(lattice.size_groups(stored, "raw_size", "block_hash"), "groups")
    met = lattice.pairs(grouped, "block_hash", "raw_size")
    for side in "ab":
        met = met.join(raw.select(F.col("block_hash").alias(side), F.col("raw").alias(f"raw_{side}")), side)
    found = staged(lattice.deltas(met).drop("raw_a", "raw_b"), "deltas")
    costs = found.select("group_id", "a", "b", "cost")
    budgets = staged(lattice.group_budget(costs, grouped.select("group_id", "stored"), lattice.mst(costs), percent), "budgets")
    kept = staged(found.join(lattice.plan(costs, budgets).drop("cost"), ["group_id", "a", "b"]), "edges")
    return kept, lattice.report(grouped, costs, kept, budgets, percent)


def write(table: DataFrame, directories: list[str], output: str, *, profile: str = "resilient", max_size_mb: float | None = None, max_decode_ms: float | None = None, repair_percent: float = REPAIR_PERCENT, comment: str = "", sizes: files.Sizes = files.DEFAULT) -> dict:
    """Write an archive of a chunk table. Size and time goals are for planned profiles; the others ignore them."""
    began, profile = time.perf_counter(), profile_of(profile)
    planned, resilient = profile in WRITTEN, profile == "resilient"
    goals = (scalars.size_goal(max_size_mb), scalars.decode_goal(max_decode_ms)) if planned else (None, None)
    table = staged(table.withColumn("block_hash", F.sha2("raw", 256)), "chunks")
    refs = table.filter("raw is not null")
    blocks = refs.groupBy("block_hash").agg(F.any_value("raw").alias("raw"), F.min(F.struct("path", "seq")).alias("first"))
    blocks = staged(blocks, "blocks")
    order = [r.block_hash for r in blocks.select("block_hash", "first").orderBy("first" if resilient else "block_hash").collect()]
    primary, planner = _choose(blocks.drop("first"), order, profile, goals)
    records, edges, report = primary.withColumnRenamed("block_hash", "record_hash"), [], {}
    extra = {}
    if resilient:
        kept, report = _lattice(primary, blocks.select("block_hash", "raw"), repair_percent)
        edges = [r.asDict() for r in kept.select("a", "b", F.col("repair_hash").alias("repair"), F.length("delta").alias("delta_size"), F.length("payload").alias("stored_size")).orderBy("a", "b").collect()]
        repair = kept.select(F.col("repair_hash").alias("record_hash"), F.lit(codecs.ZLIB).alias("codec"), F.length("delta").alias("raw_size"), "payload").dropDuplicates(["record_hash"])
        repair = staged(repair.join(primary.select(F.col("block_hash").alias("record_hash")), "record_hash", "left_anti"), "repairs")
        more = repair.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("payload")), F.lit(0)).alias("bytes")).first()
        stored = primary.agg(F.coalesce(F.sum(F.length("payload")), F.lit(0)).alias("bytes")).first().bytes
        extra = {"repair_edges": len(edges), "repair_records": report["repair_records"], "record_count": len(order) + more.n, "primary_payload_bytes": stored, "repair_payload_bytes": more.bytes}
        records = records.unionByName(repair)
        planner = {"name": "AGRP+ARK", "version": 3, "primary": planner, "repair": report}
    manifest = {
        "format": "QBX", "version": 3 if resilient else 2, "hash": "sha256", "compression_profile": WRITTEN.get(profile, profile),
        "chunking": {"algorithm": "gear-content-defined", **dict(zip(("min", "target", "max"), sizes, strict=True))},
        "features": sorted(COMMON_FEATURES + FEATURES.get(profile, FEATURES["legacy"])), "files": _entries(table, times=resilient),
    }
    manifest["directories"] = with_parents(directories, [f["path"] for f in manifest["files"]])
    if planned:
        manifest |= {"product_version": PRODUCT[profile], "planner": planner}
    if resilient:
        manifest |= {"comment": comment, "block_sizes": {r.block_hash: r.raw_size for r in primary.select("block_hash", "raw_size").collect()}, "repair_edges": edges}
    n_refs, total = sum(len(f["blocks"]) for f in manifest["files"]), sum(f["size"] for f in manifest["files"])
    manifest["statistics"] = {"input_bytes": total, "file_count": len(manifest["files"]), "directory_count": len(manifest["directories"]), "chunk_references": n_refs, "unique_blocks": len(order)} | extra
    archive.write_archive(records, manifest, output)
    return _written(output, manifest, report, time.perf_counter() - began)


def _entries(table: DataFrame, *, times: bool) -> list[dict]:
    """Entries of the manifest in path order, with their blocks."""
    rows = table.groupBy("path").agg(
        F.array_sort(F.collect_list(F.when(F.col("raw").isNotNull(), F.struct("seq", "block_hash")))).alias("b"), F.max("size").alias("size"),
        F.max("sha256").alias("sha256"), F.max("mode").alias("mode"), F.max("mtime_ns").alias("mtime_ns"),
    )
    out = []
    for r in rows.orderBy("path").toLocalIterator():
        out.append({"path": r.path, "size": r.size, "sha256": r.sha256, "mode": r.mode, "blocks": [x.block_hash for x in r.b]})
        if times and r.mtime_ns is not None:
            out[-1]["mtime_ns"] = r.mtime_ns
    return out


def with_parents(directories: list[str], paths: list[str]) -> list[str]:
    """The directories and all that lie above them or above the paths, in order."""
    above = {"/".join(p.split("/")[:k]) for p in [*directories, *paths] for k in range(1, p.count("/") + 1)}
    return sorted(above | set(directories))


def file_hash(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _written(output: str, manifest: dict, report: dict, seconds: float) -> dict:
    s, size = manifest["statistics"], Path(output).stat().st_size
    out = {
        "ok": True, "format_version": manifest["version"], "profile": manifest["compression_profile"], "files": s["file_count"], "directories": s["directory_count"], "original": s["input_bytes"],
        "archive": size, "ratio": size / s["input_bytes"] if s["input_bytes"] else 0.0, "logical_chunks": s["chunk_references"], "unique_chunks": s["unique_blocks"],
        "deduplicated_chunks": s["chunk_references"] - s["unique_blocks"], "seconds": seconds, "archive_sha256": file_hash(output),
    }
    if manifest["version"] == 3:
        out |= {"repair_edges": s["repair_edges"], "protected_blocks": report["protected_blocks"], "repair_payload_bytes": s["repair_payload_bytes"], "repair_overhead_pct": 100 * s["repair_payload_bytes"] / max(1, s["primary_payload_bytes"])}
    return out


def pack(spark: SparkSession, source: str, output: str, *, sizes: files.Sizes = files.DEFAULT, **options: object) -> dict:
    """Write an archive of a file or the contents of a directory."""
    table, directories = files.chunks(spark, source, sizes=sizes)
    return write(table, directories, output, sizes=sizes, **options)


def pack_entries(entries: DataFrame, output: str, *, sizes: files.Sizes = files.DEFAULT, **options: object) -> dict:
    """Write an archive of (path, content, mode, mtime_ns) rows."""
    whole = entries.select("path", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), "mode", "mtime_ns")
    cut = chunking.chunk(entries, least=sizes[0], target=sizes[1], most=sizes[2]).select("path", "seq", "raw")
    table = whole.join(cut, "path", "left").select("path", F.coalesce("seq", F.lit(0)).alias("seq"), "raw", "size", "sha256", "mode", "mtime_ns")
    return write(table, [], output, sizes=sizes, **options)


def blocks_of(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame, DataFrame]:
    """Manifest, records with their status, block sizes, and the blocks that are intact or recovered."""
    _, manifest, _ = archive.read_manifest(path)
    records, sizes = archive.read_records(spark, path), archive.block_sizes(spark, path)
    return manifest, records, sizes, archive.recovered_blocks(records, archive.edges_of(spark, manifest), sizes)


def contents(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """References (path, seq, raw, want_size, want_sha256, mode, mtime_ns) of all entries and the directories; raw null for lost blocks."""
    manifest, _, _, blocks = blocks_of(spark, path)
    rows = [(f["path"], f["size"], f["sha256"], int(f.get("mode", 0o644)), f.get("mtime_ns"), f["blocks"]) for f in manifest["files"]]
    listed = spark.createDataFrame(rows, "path string, want_size long, want_sha256 string, mode int, mtime_ns long, blocks array<string>")
    refs = listed.select("*", F.posexplode_outer("blocks").alias("at", "block_hash")).drop("blocks")
    out = refs.join(blocks.select("block_hash", "raw"), "block_hash", "left")
    return out.select("path", F.coalesce("at", F.lit(-1)).alias("seq"), "raw", "want_size", "want_sha256", "mode", "mtime_ns"), manifest.get("directories", [])


def chunk_table(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The chunk table that an archive's entries were written from; damaged entries are an error."""
    refs, directories = contents(spark, path)
    refs = staged(refs, "contents")
    bad = files.checked(refs).filter("status <> 'ok'").first()
    if bad:
        raise archive.ArchiveError(f"{bad.status}: {bad.path}")
    return refs.select("path", F.greatest("seq", F.lit(0)).alias("seq"), "raw", F.col("want_size").alias("size"), F.col("want_sha256").alias("sha256"), "mode", "mtime_ns"), directories


def verify(spark: SparkSession, path: str) -> dict:
    """Counts of a healthy or degraded archive; an unrecoverable one is an error."""
    manifest, records, sizes, blocks = blocks_of(spark, path)
    state = staged(records.select("record_hash", "status"), "status")
    have = staged(blocks.select("block_hash", "round"), "have")
    if lost := sizes.join(have, "block_hash", "left_anti").first():
        raise archive.ArchiveError(f"block {lost.block_hash} is lost and can't be recovered")
    refs, _ = contents(spark, path)
    if bad := files.checked(refs).filter("status <> 'ok'").first():
        raise archive.ArchiveError(f"{bad.status}: {bad.path}")
    damaged = state.filter("status <> 'ok'").count()
    repairs = archive.edges_of(spark, manifest).select(F.col("repair").alias("record_hash")).distinct()
    recovered = sorted(r.block_hash for r in have.filter("round > 0").select("block_hash").collect())
    return {
        "ok": True, "healthy": damaged == 0, "degraded": damaged > 0, "format_version": manifest["version"], "files": len(manifest["files"]), "blocks": sizes.count(),
        "repair_edges": len(manifest.get("repair_edges", [])), "repair_records_valid": state.filter("status = 'ok'").join(repairs, "record_hash", "left_semi").count(),
        "damaged_records": damaged, "recovered_blocks": len(recovered), "recovered_block_hashes": recovered, "archive_sha256": file_hash(path),
    }


def unpack(spark: SparkSession, path: str, destination: str, *, overwrite: bool = False) -> dict:
    refs, directories = contents(spark, path)
    written = staged(files.extract(refs, directories, destination, overwrite=overwrite), "written")
    if bad := written.filter("status <> 'ok'").first():
        raise archive.ArchiveError(f"{bad.status}: {bad.path}")
    r = written.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    return {"ok": True, "files": r.files, "bytes": r.bytes}


def repair(spark: SparkSession, path: str, output: str, *, repair_percent: float = REPAIR_PERCENT, sizes: files.Sizes = files.DEFAULT) -> dict:
    """A new resilient archive from the recovered entries; the comment isn't carried over."""
    if Path(path).resolve() == Path(output).resolve():
        raise archive.ArchiveError("the repaired archive needs another name")
    table, directories = chunk_table(spark, path)
    write(table, directories, output, repair_percent=repair_percent, sizes=sizes)
    return verify(spark, output)


def merged(tables: list[DataFrame]) -> DataFrame:
    """Several sources; of equal paths the later source's rows stay."""
    rows = reduce(DataFrame.unionByName, (t.withColumn("source_ord", F.lit(k)) for k, t in enumerate(tables)))
    best = rows.groupBy("path").agg(F.max("source_ord").alias("source_ord"))
    return rows.join(best, ["path", "source_ord"]).drop("source_ord")


def emit(value: dict) -> str:
    """A result as indented JSON."""
    return json.dumps(value, indent=2, ensure_ascii=False)

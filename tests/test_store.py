import hashlib
import json
import os
import random
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from cairn.functions import chunking, codecs
from cairn.operators import lattice
from cairn.plans import bridge, edits, store
from cairn.sources import archive, files

SMALL = (1024, 4096, 16384)


def near_versions(n=5, size=4096, seed=7):
    """Blocks of one size that differ from the first in a few places."""
    rng = random.Random(seed)
    first = rng.randbytes(size)
    for k in range(n):
        changed = bytearray(first)
        for at in rng.sample(range(size), 12 + 4 * k):
            changed[at] = rng.randrange(256)
        yield bytes(changed)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "nested").mkdir(parents=True)
    (root / "empty-dir").mkdir()
    for k, data in enumerate(near_versions()):
        (root / f"v{k}.bin").write_bytes(data)
    (root / "a.txt").write_text("repeated text\n" * 2000)
    (root / "nested" / "b.txt").write_text("repeated text\n" * 2000)
    (root / "nested" / ".empty").write_bytes(b"")
    os.chmod(root / "a.txt", 0o750)
    os.utime(root / "a.txt", ns=(10**18, 10**18 + 5))
    return root


def same_tree(a, b):
    listing = lambda r: {p.relative_to(r).as_posix(): p.read_bytes() if p.is_file() else None for p in r.rglob("*")}
    assert listing(a) == listing(b)


@pytest.mark.parametrize("profile", ["resilient", "adaptive-v2", "balanced"])
def test_round_trip_keeps_directories_modes_and_times(spark, tree, tmp_path, profile):
    out = str(tmp_path / "x.qbx")
    told = store.pack(spark, str(tree), out, profile=profile, sizes=SMALL)
    assert told["files"] == 8 and told["directories"] == 2 and told["deduplicated_chunks"] > 0
    assert store.unpack(spark, out, str(tmp_path / "back"))["files"] == 8
    same_tree(tree, tmp_path / "back")
    state = (tmp_path / "back" / "a.txt").stat()
    assert state.st_mode & 0o777 == 0o750 and (profile != "resilient" or state.st_mtime_ns == 10**18 + 5)
    with pytest.raises(ValueError, match="exists already"):
        store.unpack(spark, out, str(tmp_path / "back"))
    store.unpack(spark, out, str(tmp_path / "back"), overwrite=True)
    assert store.verify(spark, out)["healthy"]
    shown = archive.inspect(out)
    assert json.loads(store.emit(shown)) == shown and {f["path"]: f["blocks"] for f in shown["files"]}["nested/.empty"] == 0


def test_damage_is_recovered_and_repaired(spark, tree, tmp_path):
    out = str(tmp_path / "x.qbx")
    assert store.pack(spark, str(tree), out, repair_percent=30.0, sizes=SMALL)["repair_edges"] > 0
    _, manifest, _ = archive.read_manifest(out)
    hit = manifest["repair_edges"][0]["a"]
    row = archive.read_index(spark, out).filter(f"record_hash = '{hit}'").first()
    data = bytearray(open(out, "rb").read())
    data[row.offset + row.stored_size // 2] ^= 0x5A
    open(out, "wb").write(data)
    state = store.verify(spark, out)
    assert state["degraded"] and state["recovered_block_hashes"] == [hit] and state["damaged_records"] == 1
    assert store.repair(spark, out, str(tmp_path / "y.qbx"), repair_percent=30.0, sizes=SMALL)["healthy"]
    with pytest.raises(archive.ArchiveError):
        store.repair(spark, out, out)
    bare = str(tmp_path / "z.qbx")
    store.pack(spark, str(tree), bare, profile="fast", sizes=SMALL)
    data = bytearray(open(bare, "rb").read())
    data[-1] ^= 0xFF
    open(bare, "wb").write(data)
    with pytest.raises(archive.ArchiveError, match="lost"):
        store.verify(spark, bare)
    with pytest.raises(archive.ArchiveError, match="missing block"):
        store.unpack(spark, bare, str(tmp_path / "none"))


def by_hand(version, entries, *, codec=0, changes=None, tail=b"", records=None):
    """The bytes of an archive of one block per entry, put together from the layout's description."""
    found = {hashlib.sha256(x).hexdigest(): x for x in entries.values()}
    listed = [{"path": p, "size": len(x), "sha256": hashlib.sha256(x).hexdigest(), "mode": 420, "blocks": [hashlib.sha256(x).hexdigest()]} for p, x in entries.items()]
    manifest = {"format": "QBX", "version": version, "files": listed, "directories": ["d"], "statistics": {"unique_blocks": len(found), "record_count": len(found)}}
    if version == 3:
        manifest |= {"block_sizes": {h: len(x) for h, x in found.items()}, "repair_edges": []}
    manifest |= changes or {}
    body = json.dumps(manifest).encode()
    out = (b"QBX2" if version == 2 else b"QBX3") + b"\r\n\x1a\n" + struct.pack(">Q", len(body)) + body + struct.pack(">Q", len(found) if records is None else records)
    pressed = {0: bytes, 1: lambda x: codecs.zstandard.compress(x), 2: zlib.compress, 3: codecs.lzma.compress}.get(codec, bytes)
    for h, x in sorted(found.items()):
        out += bytes.fromhex(h) + struct.pack(">BQQ", codec, len(x), len(pressed(x))) + pressed(x)
    return out + tail


@pytest.mark.parametrize("version", [2, 3])
@pytest.mark.parametrize("codec", [0, 1, 2, 3])
def test_archives_made_by_hand_are_read(spark, tmp_path, version, codec):
    (tmp_path / "h.qbx").write_bytes(by_hand(version, {"a.txt": b"x" * 500, "d/b": b"yz" * 70}, codec=codec))
    store.unpack(spark, str(tmp_path / "h.qbx"), str(tmp_path / "out"))
    assert (tmp_path / "out/a.txt").read_bytes() == b"x" * 500 and (tmp_path / "out/d/b").read_bytes() == b"yz" * 70


def test_invalid_archives_are_refused(spark, tmp_path):
    one = {"a.txt": b"x" * 500}
    h = hashlib.sha256(one["a.txt"]).hexdigest()
    entry = {"path": "a", "size": 1, "sha256": h, "blocks": [h]}
    cases = {
        "magic": b"not-one!x", "traversal": by_hand(2, {"../escape.txt": b"x"}), "traversal3": by_hand(3, {"a/../../b": b"x"}),
        "hash": by_hand(2, one, changes={"files": [entry | {"sha256": h.upper()}]}), "size": by_hand(2, one, changes={"files": [entry | {"size": -1}]}),
        "ref": by_hand(3, one, changes={"files": [entry | {"blocks": ["0" * 64]}]}), "edge": by_hand(3, one, changes={"repair_edges": [{"a": h, "b": "0" * 64, "repair": h}]}),
        "twice": by_hand(2, one, changes={"directories": ["a.txt"]}), "count": by_hand(2, one, records=2), "stated": by_hand(3, one, changes={"statistics": {"record_count": 0}}),
        "codec": by_hand(2, one, codec=9), "tail": by_hand(2, one, tail=b"x"), "cut": by_hand(2, one)[:-1], "version": by_hand(2, one, changes={"version": 3}), "format": by_hand(2, one, changes={"format": "x"}),
        "block": by_hand(3, one, changes={"block_sizes": {h: 1 << 20}}), "json": b"QBX2\r\n\x1a\n" + struct.pack(">Q", 2) + b"{x" + bytes(8), "long": b"QBX2\r\n\x1a\n" + struct.pack(">Q", 1 << 40),
    }
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
        with pytest.raises(archive.ArchiveError):
            archive.read_index(spark, str(tmp_path / name))
    bomb = zlib.compress(bytes(50_000_000))
    with pytest.raises(ValueError):
        codecs.decode(codecs.ZLIB, bomb, 100)


def test_profiles_and_goals(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"x" * 1000)
    for bad in ({"profile": "none"}, {"profile": "adaptive", "max_size_mb": 0}):
        with pytest.raises(ValueError):
            store.pack(spark, str(tmp_path / "x"), str(tmp_path / "x.qbx"), **bad)
    assert store.pack(spark, str(tmp_path / "x"), str(tmp_path / "x.qbx"), profile="fast", max_size_mb=0)["profile"] == "fast"
    assert store.pack(spark, str(tmp_path / "x"), str(tmp_path / "x.qbx"), profile="ark", max_size_mb=1, comment="c")["profile"] == "resilient-v3"
    assert archive.inspect(str(tmp_path / "x.qbx"))["comment"] == "c"
    first = (tmp_path / "x.qbx").read_bytes() if store.pack(spark, str(tmp_path / "x"), str(tmp_path / "x.qbx"), profile="balanced") else b""
    store.pack(spark, str(tmp_path / "x"), str(tmp_path / "y.qbx"), profile="balanced")
    assert (tmp_path / "y.qbx").read_bytes() == first


def test_edits(spark, tree, tmp_path):
    out = str(tmp_path / "x.qbx")
    store.pack(spark, str(tree), out, comment="kept", sizes=SMALL)
    (tmp_path / "new").mkdir()
    (tmp_path / "new" / "n.txt").write_text("n")
    (tmp_path / "a.txt").write_text("newer")
    edits.add_sources(spark, out, [str(tmp_path / "new"), str(tmp_path / "a.txt")], sizes=SMALL)
    with pytest.raises(archive.ArchiveError, match="exists"):
        edits.add_sources(spark, out, [str(tmp_path / "a.txt")], overwrite_entries=False)
    assert edits.delete_entries(spark, out, ["nested", "v0.bin", "nothing"], sizes=SMALL)["deleted_entries"] == 2
    for bad in ([], ["nothing"], ["../x"]):
        with pytest.raises(archive.ArchiveError):
            edits.delete_entries(spark, out, bad)
    shown = archive.inspect(out)
    assert [f["path"] for f in shown["files"]] == ["a.txt", "new/n.txt", "v1.bin", "v2.bin", "v3.bin", "v4.bin"]
    assert shown["comment"] == "kept" and shown["directories"] == ["empty-dir", "new"]
    edits.set_comment(spark, out, "other", sizes=SMALL)
    assert archive.inspect(out)["comment"] == "other" and sorted(p.name for p in tmp_path.glob(".x*")) == []
    assert [tuple(r) for r in edits.list_directory(spark, out).collect()][:3] == [("empty-dir", True), ("new", True), ("a.txt", False)]
    assert edits.find(spark, out, "V2").first().path == "v2.bin"


def test_bridge(spark, tree, tmp_path):
    data = random.Random(1).randbytes(20_000)
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("ok/a.bin", data)
        z.writestr("ok\\b.bin", data)
    told = bridge.create_archive(spark, [str(tmp_path / "z.zip")], str(tmp_path / "out.dat"), output_format=".QBX", sizes=SMALL)
    assert told["source_containers"] == ["zip"] and told["output"].endswith("out.qbx") and told["deduplicated_chunks"] > 0
    assert [f["path"] for f in archive.inspect(told["output"])["files"]] == ["ok/a.bin", "ok/b.bin"]
    back = bridge.create_archive(spark, [str(tree)], str(tmp_path / "t"), output_format="zip")
    with zipfile.ZipFile(back["output"]) as z:
        assert z.testzip() is None and "empty-dir/" in z.namelist() and z.read("a.txt") == (tree / "a.txt").read_bytes()
    both = bridge.create_archive(spark, [str(tmp_path / "z.zip"), told["output"], str(tree / "a.txt")], str(tmp_path / "both.qbx"), output_format="qbx", sizes=SMALL)
    assert {f["path"] for f in archive.inspect(both["output"])["files"]} == {"z/ok/a.bin", "z/ok/b.bin", "out/ok/a.bin", "out/ok/b.bin", "a.txt"}
    plain = bridge.create_archive(spark, [str(tmp_path / "z.zip")], str(tmp_path / "p"), output_format="zip", optimize=False)
    assert zipfile.ZipFile(plain["output"]).namelist() == ["z.zip"]
    for fmt in ("tar", "rar"):
        with pytest.raises(archive.ArchiveError):
            bridge.create_archive(spark, [str(tree)], str(tmp_path / "u"), output_format=fmt)
    with zipfile.ZipFile(tmp_path / "evil.zip", "w") as z:
        z.writestr("../escape.txt", "y")
    with pytest.raises(ValueError, match="unsafe"):
        bridge.create_archive(spark, [str(tmp_path / "evil.zip")], str(tmp_path / "u"), output_format="qbx")


def test_links_and_missing_sources(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "l").symlink_to(tmp_path)
    for source in (tmp_path / "t", tmp_path / "none"):
        with pytest.raises(ValueError):
            files.walk(str(source))


def test_streamed_chunks_equal_whole_ones(tmp_path):
    import io

    rng = random.Random(3)
    for data in (b"", b"x", rng.randbytes(300_000), b"ab" * 90_000, bytes(200_000)):
        ends = chunking.cuts(data, 64, 1024, 8192) if data else []
        got = list(chunking.stream(io.BytesIO(data), 64, 1024, 8192, window=10_000))
        assert b"".join(got) == data and [len(x) for x in got] == [b - a for a, b in zip([0, *ends], ends, strict=False)]


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("ok/a.txt", "x")
        z.writestr("../escape.txt", "y")
    got = {r.path: r.safe for r in files.zip_members(files.scan(spark, str(tmp_path / "z.zip"))).collect()}
    assert got == {"ok/a.txt": True, "../escape.txt": False}


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("partitions", ["8", "200"])
def test_positions_are_gapless_with_a_used_column(spark, adaptive, partitions):
    from cairn.operators import lattice

    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        rows = spark.range(200_000).select((F.xxhash64("id") % 5000).alias("size"), F.sha2(F.col("id").cast("string"), 256).alias("key"), F.repeat(F.lit("x"), 300).alias("more"))
        got = lattice.size_groups(rows, "size", "key")
        sizes = got.groupBy("group_id").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("p"), F.sum(F.length("more")).alias("x"))
        r = sizes.agg(F.sum("n").alias("rows"), F.max("n").alias("most"), F.count_if(F.col("n") != F.col("p")).alias("odd"), F.count("*").alias("groups"), F.sum("x").alias("x")).first()
        assert (r.rows, r.most, r.odd, r.groups, r.x) == (200_000, 7, 0, -(-200_000 // 7), 200_000 * 300)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_groups_without_an_intact_block_recover_nothing(spark):
    """The group of one text is healthy, that of the other is lost as a whole, which is a result and no error."""
    raw = spark.createDataFrame([(k // 7, str(k).encode()) for k in range(14)], "group_id long, raw binary")
    blocks = raw.withColumn("block_hash", F.sha2("raw", 256)).withColumn("n", F.length("raw"))
    for now in (F.when(F.col("group_id") == 0, F.col("raw")).otherwise(F.concat("raw", F.lit(b"!"))), F.when(F.col("group_id") == 0, F.col("raw"))):
        assert [r["round"] for r in lattice.recover_grouped(blocks, now).collect()] == [0] * 7
    assert lattice.recover_grouped(blocks, F.lit(b"!")).count() == 0
    records = blocks.select(F.col("block_hash").alias("record_hash"), F.lit(None).cast("binary").alias("raw"), F.lit("decode_error").alias("status"))
    edges = blocks.groupBy(F.lit("g").alias("grp")).agg(F.min("block_hash").alias("a"), F.max("block_hash").alias("b")).withColumn("repair", F.lit("r"))
    assert archive.recovered_blocks(records, edges, blocks.select("block_hash", F.col("n").alias("size"))).count() == 0
    nodes = blocks.select("group_id", F.col("block_hash").alias("v"), F.lit(False).alias("ok"))
    assert lattice.recover(nodes, edges.select(F.lit(0).cast("long").alias("group_id"), "a", "b")).count() == 0

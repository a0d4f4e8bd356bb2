"""Operator 1: token ids in binary shards, with a minimal perfect hash index from document keys to shard offsets.

Layout below one folder: ``shards/*.ids`` (header, raw ids of 2 or 4 bytes, trailer), ``index/*.mph`` (one minimal
perfect hash each over the keys whose hash falls to that file: level bitmaps and, per slot, a fingerprint, the shard,
the offset and the length) and a directory of shards. A lookup hashes the key, picks the file, walks the levels until a bit is
set, and reads one slot: constant time. The stored fingerprint tells foreign keys.

Defined results: null text is an empty document (its end id only); a null key is a key like any other, ordered first;
rows with equal keys are all stored, ordered by a hash of their text and told apart by their occurrence, and may fill many shards;
texts of any length are encoded whole; empty tables give no shard; other columns, whatever their names, are not carried.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import AtomicFile, mix64, new_folder, read_file, staged
from cairn.llm.tokens import encoder

MAGIC, HEADER, TRAILER = b"CAIRNIDS", "<8sII", "<QQI"
INDEX_MAGIC, INDEX_HEADER = b"CAIRNMPH", "<8sQI"
SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("start", "<u8"), ("n", "<u8")])
LEVELS = 40
#: Keys of an index file: a file is read whole by a task that looks up in it.
KEYS_PER_FILE, LEAST_FILES = 65_536, 64


@dataclass
class TokenStore:
    """What was written: ``entries`` has a row per document, ``shards`` a row per shard file (a bounded directory)."""

    root: str
    entries: DataFrame
    shards: list[dict]
    n_files: int
    index: dict[int, str] | None = None


def key_hash(keys: np.ndarray, missing: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """64 bits of a key and its occurrence; distinct ids at their first occurrence never share them."""
    h = mix64(keys.astype(np.int64).view(np.uint64))
    more = (occurrence > 0) | missing
    # Mixed twice: with one round a key would cancel an occurrence of equal value.
    h[more] = mix64(h[more] ^ mix64(mix64(occurrence[more].astype(np.uint64) * np.uint64(2) + missing[more])))
    return h


def _whole_key(key: F.Column) -> tuple[F.Column, F.Column]:
    """A key without nulls and whether it was null: pandas would make a column of keys and nulls floats, which lose large keys."""
    return F.coalesce(key, F.lit(0)).alias("key"), key.isNull().alias("no_key")


@F.pandas_udf(T.LongType())
def _hashes(key: pd.Series, missing: pd.Series, occurrence: pd.Series) -> pd.Series:
    return pd.Series(key_hash(key.to_numpy(), missing.to_numpy(), occurrence.to_numpy()).view(np.int64))


def write_store(
    docs: DataFrame, tokenizer_path: str, *, key: str = "doc_id", text: str = "text", end_id: int = 1, root: str | None = None
) -> TokenStore:
    """Encode whole texts and write the ids in ascending key order; one task writes one shard.

    Rows are dealt by key, hash of the text and row, so rows of one key spread over tasks. A task counts the occurrences of
    its own rows; those of its first key in earlier shards are added afterwards, from the directory.
    """
    spark = docs.sparkSession
    root = root or new_folder(spark, "tokens")
    folder = f"{root}/shards"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer_path)
        width = 2 if max(enc.vocab_size, end_id + 1) <= 1 << 16 else 4
        out, crc, at, n_docs, last, seen = None, 0, 0, 0, object(), 0
        part = TaskContext.get().partitionId()
        for pdf in batches:
            if not len(pdf):
                continue
            if out is None:
                out = AtomicFile(folder, "shard", ".ids")
                out.write(struct.pack(HEADER, MAGIC, width, end_id))
            missing, keys = pdf["no_key"].to_numpy(), pdf["key"].to_numpy()
            occurrence, n = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for i, ids in enumerate(enc.encode_all(pdf["text"].tolist())):
                this = (bool(missing[i]), int(keys[i]))
                seen = seen + 1 if this == last else 0
                occurrence[i], last, n[i] = seen, this, len(ids) + 1
                raw = np.append(ids, np.uint32(end_id)).astype(f"<u{width}").tobytes()
                crc = zlib.crc32(raw, crc)
                out.write(raw)
            start = at + np.concatenate([[0], np.cumsum(n)[:-1]])
            at, n_docs = at + int(n.sum()), n_docs + len(pdf)
            yield pd.DataFrame(
                {
                    "key": pd.Series(keys).astype("Int64").where(~missing),
                    "occurrence": occurrence,
                    "part": part,
                    "shard": out.uri,
                    "start": start,
                    "n": n,
                }
            )
        if out is not None:
            out.write(struct.pack(TRAILER, n_docs, at, crc))
            out.commit()

    order = [F.col("key").asc_nulls_first(), "salt", "row"]
    written = staged(
        docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
        .select("key", "text", F.xxhash64("text").alias("salt"), F.monotonically_increasing_id().alias("row"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(*_whole_key(F.col("key")), "text")
        .mapInPandas(write, "key long, occurrence long, part int, shard string, start long, n long"),
        "entries",
    )
    # The directory has a row per shard, that is per task; it is small whatever the number of documents.
    found = (
        written.groupBy("shard", "part")
        .agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), *(f(F.struct("key", "occurrence"), "start").alias(a) for f, a in ((F.min_by, "low"), (F.max_by, "high"))))
        .collect()
    )
    shards, base, before = [], 0, 0
    for i, r in enumerate(sorted(found, key=lambda r: r.part)):
        before = before if shards and shards[-1]["high"] == r.low.key else 0
        shards.append({"no": i, "path": r.shard, "base": base, "n_docs": r.n_docs, "n_tokens": r.n_tokens, "low": r.low.key, "high": r.high.key, "before": before})
        base += r.n_tokens
        before = r.high.occurrence + 1 + (before if r.low.key == r.high.key else 0)
    firsts = _shard_rows(spark, shards, "shard string, low long, before long", "path", "low", "before")
    occurrence = F.col("occurrence") + F.when(F.col("key").eqNullSafe(F.col("low")), F.col("before")).otherwise(0)
    entries = written.join(F.broadcast(firsts), "shard").select("key", occurrence.alias("occurrence"), "shard", "start", "n")
    entries = entries.withColumn("hash", _hashes(*_whole_key(F.col("key")), "occurrence"))
    n_files = max(LEAST_FILES, -(-sum(s["n_docs"] for s in shards) // KEYS_PER_FILE))
    return TokenStore(root, entries, shards, n_files)


def _shard_rows(spark: SparkSession, shards: list[dict], schema: str, *fields: str) -> DataFrame:
    return spark.createDataFrame([tuple(s[f] for f in fields) for s in shards], schema)


def _directory(spark: SparkSession, store: TokenStore) -> DataFrame:
    return _shard_rows(spark, store.shards, "shard string, shard_no int, base long", "path", "no", "base")


def _file_of(store: TokenStore) -> F.Column:
    return F.pmod(F.shiftrightunsigned("hash", 20), F.lit(store.n_files)).cast("int")


def build_index(store: TokenStore) -> TokenStore:
    """One minimal perfect hash per index file, built by as many tasks as there are files."""
    folder = f"{store.root}/index"

    def build(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        order, bitmaps = perfect_hash(pdf["hash"].to_numpy().view(np.uint64))
        slots = np.zeros(len(pdf), SLOT)
        slots["fingerprint"][order] = fingerprint(pdf["hash"].to_numpy().view(np.uint64))
        for name in ("shard", "start", "n"):
            slots[name][order] = pdf["shard_no" if name == "shard" else name].to_numpy()
        out = AtomicFile(folder, f"part-{group[0]:06d}", ".mph")
        out.write(struct.pack(INDEX_HEADER, INDEX_MAGIC, len(pdf), len(bitmaps)))
        for bits in bitmaps:
            out.write(struct.pack("<Q", len(bits)) + np.packbits(bits).tobytes())
        out.write(slots.tobytes())
        return pd.DataFrame({"file": [group[0]], "path": [out.commit()]})

    spark = store.entries.sparkSession
    rows = store.entries.join(F.broadcast(_directory(spark, store)), "shard").select(
        _file_of(store).alias("file"), "hash", "shard_no", "start", "n"
    )
    # A row per index file: at most one for KEYS_PER_FILE documents.
    store.index = {r.file: r.path for r in staged(rows.groupBy("file").applyInPandas(build, "file int, path string"), "index").collect()}
    manifest = AtomicFile(store.root, "manifest", ".json")
    manifest.write(json.dumps({"shards": store.shards, "index": store.index, "n_files": store.n_files}).encode())
    manifest.commit()
    return store


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    return (mix64(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)


def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(hashes + np.uint64(level)) % np.uint64(size)).astype(np.int64)


def perfect_hash(hashes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Slot of each key, and a bitmap per level: a key's bit is set at the first level where no other key hits it."""
    if len(np.unique(hashes)) != len(hashes):
        raise ValueError("two keys share their 64-bit hash")
    left, bitmaps, at = np.arange(len(hashes)), [], np.full(len(hashes), -1)
    offset = 0
    with np.errstate(over="ignore"):
        while len(left):
            size = max(1, 3 * len(left) // 2)
            place = _place(hashes[left], len(bitmaps), size)
            bits = np.bincount(place, minlength=size) == 1
            rank = offset + np.cumsum(bits) - 1
            alone = bits[place]
            at[left[alone]] = rank[place[alone]]
            offset += int(bits.sum())
            left = left[~alone]
            bitmaps.append(bits)
            if len(bitmaps) > 64 * LEVELS:
                raise ValueError("the keys can't be told apart")
    return at, bitmaps


class IndexFile:
    """A read index file; ``find`` answers many keys at once."""

    def __init__(self, data: bytes) -> None:
        magic, self.n, levels = struct.unpack_from(INDEX_HEADER, data)
        if magic != INDEX_MAGIC:
            raise ValueError("not an index file")
        at, self._levels, before = struct.calcsize(INDEX_HEADER), [], 0
        for _ in range(levels):
            (size,) = struct.unpack_from("<Q", data, at)
            raw = np.frombuffer(data, np.uint8, -(-size // 8), at + 8)
            bits = np.unpackbits(raw, count=size).astype(bool)
            rank = before + np.cumsum(bits) - 1
            self._levels.append((size, bits, rank))
            before, at = before + int(bits.sum()), at + 8 + len(raw)
        self._slots = np.frombuffer(data, SLOT, self.n, at)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """A slot for each key; for keys that were never stored ``n`` is 0."""
        out = np.zeros(len(hashes), SLOT)
        left = np.arange(len(hashes))
        with np.errstate(over="ignore"):
            for level, (size, bits, rank) in enumerate(self._levels):
                place = _place(hashes[left], level, size)
                hit = bits[place]
                out[left[hit]] = self._slots[rank[place[hit]]]
                left = left[~hit]
        out[out["fingerprint"] != fingerprint(hashes)] = np.zeros((), SLOT)
        return out


def read_ids(data: bytes, start: int, n: int) -> np.ndarray:
    """Ids of one document out of a shard's bytes."""
    magic, width, _ = struct.unpack_from(HEADER, data)
    if magic != MAGIC:
        raise ValueError("not a shard")
    return np.frombuffer(data, f"<u{width}", n, struct.calcsize(HEADER) + start * width)


def lookup(store: TokenStore, keys: DataFrame) -> DataFrame:
    """Shard, offset and length of (key, occurrence, hash) rows, by the index files alone; unknown keys are left out."""
    files, spark = store.index or {}, keys.sparkSession

    def find(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if group[0] not in files:
            return pdf.assign(shard_no=0, start=0, n=0)[["key", "no_key", "occurrence", "shard_no", "start", "n"]].iloc[:0]
        slots = IndexFile(read_file(files[group[0]])).find(pdf["hash"].to_numpy().view(np.uint64))
        out = pdf[["key", "no_key", "occurrence"]].assign(**{"shard_no": slots["shard"].astype(np.int32), "start": slots["start"].astype(np.int64), "n": slots["n"].astype(np.int64)})
        return out[out["n"] > 0]

    rows = keys.select(*_whole_key(F.col("key")), "occurrence", "hash", _file_of(store).alias("file"))
    out = rows.groupBy("file").applyInPandas(find, "key long, no_key boolean, occurrence long, shard_no int, start long, n long")
    out = out.withColumn("key", F.when(~F.col("no_key"), F.col("key"))).drop("no_key")
    bases = _directory(spark, store).select("shard_no", "shard", "base")
    return out.join(F.broadcast(bases), "shard_no")


def read_digests(found: DataFrame) -> DataFrame:
    """Read every found document's ids out of its shard: start among all documents, length, crc32 as 32-bit ids."""

    def read(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        data = read_file(group[0])
        crc = [zlib.crc32(read_ids(data, s, n).astype("<u4").tobytes()) for s, n in zip(pdf["start"].tolist(), pdf["n"].tolist(), strict=True)]
        return pd.DataFrame({"doc_id": pdf["key"], "no_key": pdf["no_key"], "start": pdf["base"] + pdf["start"], "n_tokens": pdf["n"], "ids_crc32": np.array(crc, np.int64)})

    rows = found.select(*_whole_key(F.col("key")), "shard", "base", "start", "n")
    out = rows.groupBy("shard").applyInPandas(read, "doc_id long, no_key boolean, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.when(~F.col("no_key"), F.col("doc_id"))).drop("no_key")


def token_store_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 1 over the whole of ``documents``."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = build_index(write_store(docs, public_tokenizers.path("word_bpe_49k.json")))
    return read_digests(lookup(store, store.entries.select("key", "occurrence", "hash")))

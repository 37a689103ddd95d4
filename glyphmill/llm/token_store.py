"""Operator 8, token-id files with a minimal perfect hash index.

Documents are dealt by range of doc_id into shards.  A shard file holds, in this order:

    magic (8 bytes) | ids, little-endian unsigned, 16 or 32 bits | keys, int64 ascending | offsets, int64, one
    more than keys | null flags, uint8 | index | footer (9 x int64)

The index is a minimal perfect hash over the distinct keys: levels of bit arrays (a key settles at the
first level at which no other key has its bit) with running counts of set bits, so a key's slot is
the number of bits set before its own.  A slot stores a 32-bit fingerprint of its key and the first
record with that key; a lookup reads one bit and one slot for each level, independent of the number
of keys, and a key that is not in the shard is recognised by its fingerprint.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, mix64, partitions, shared_dir, store, table, texts_of
from .encode import encoder

MAGIC = b"GMTOKS01"
FOOTER = np.dtype([(n, "<i8") for n in ("records", "ids", "keys_at", "offsets_at", "nulls_at", "index_at", "index_size", "slots", "width")])
READ_IDS = 1 << 20


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys; ``gamma`` bits for each key still unsettled."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest  # bit arrays as uint8; keys that no level settled, sorted
        ones = [int(x.sum()) for x in levels]
        self.before = np.concatenate(([0], np.cumsum(ones))).astype(np.int64)
        self.rank = [np.concatenate(([0], np.cumsum(x, dtype=np.int64))) for x in levels]

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys ^ U64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))) % U64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0, most: int = 40) -> PerfectHash:
        left, levels = keys.astype(np.int64).view(U64), []
        while len(left) and len(levels) < most:
            size = max(8, int(gamma * len(left)))
            at = cls.place(left, len(levels), size)
            count = np.bincount(at, minlength=size)
            levels.append((count == 1).astype(np.uint8))
            left = left[count[at] != 1]
        return cls(levels, np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no level has its bit."""
        k = np.asarray(keys, np.int64).view(U64)
        out, open_ = np.full(len(k), -1, np.int64), np.arange(len(k))
        for i, bits in enumerate(self.levels):
            at = self.place(k[open_], i, len(bits))
            hit = bits[at] == 1
            out[open_[hit]] = self.before[i] + self.rank[i][at[hit]]
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            at = np.searchsorted(self.rest, k[open_]).clip(max=len(self.rest) - 1)
            hit = self.rest[at] == k[open_]
            out[open_[hit]] = self.before[-1] + at[hit]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), len(self.rest), *map(len, self.levels)], "<i8").tobytes()
        return head + b"".join(np.packbits(x).tobytes() for x in self.levels) + self.rest.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> tuple[PerfectHash, int]:
        n, rest = np.frombuffer(raw, "<i8", 2).tolist()
        sizes, at, levels = np.frombuffer(raw, "<i8", n, 16).tolist(), 16 + 8 * n, []
        for size in sizes:
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, (size + 7) // 8, at))[:size])
            at += (size + 7) // 8
        return cls(levels, np.frombuffer(raw, "<u8", rest, at).astype(U64)), at + 8 * rest


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix64(np.asarray(keys, np.int64).view(U64) + U64(0xD6E8FEB86659FD93)) >> U64(32)).astype(np.uint32)


class ShardWriter:
    """Writes one shard; records come in ascending order of key and go to the file as they come."""

    def __init__(self, fs, path: str, width: int = 4):
        self.width = width
        self.out = fs.open_output_stream(path)
        self.out.write(MAGIC)
        self.keys: list[int] = []
        self.nulls: list[int] = []
        self.sizes: list[int] = []

    def add(self, key: int | None, ids: bytes) -> None:
        """``ids``: little-endian unsigned 32-bit integers."""
        self.out.write(ids if self.width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes())
        self.keys.append(key or 0)
        self.nulls.append(key is None)
        self.sizes.append(len(ids) // 4)

    def close(self) -> tuple[int, int]:
        keys, nulls = np.array(self.keys, "<i8"), np.array(self.nulls, np.uint8)
        offsets = np.concatenate(([0], np.cumsum(np.array(self.sizes, "<i8")))).astype("<i8")
        own = np.flatnonzero(nulls == 0)
        distinct, first = np.unique(keys[own], return_index=True)
        mph = PerfectHash.build(distinct)
        slot, n = mph.slots(distinct), len(distinct)
        marks, records = np.zeros(n, "<u4"), np.zeros(n, "<i8")
        marks[slot], records[slot] = fingerprints(distinct), own[first]
        index = mph.to_bytes() + marks.tobytes() + records.tobytes()
        at = len(MAGIC) + self.width * int(offsets[-1])
        foot = np.zeros(1, FOOTER)
        foot[0] = (len(keys), offsets[-1], at, at + keys.nbytes, at + keys.nbytes + offsets.nbytes, at + keys.nbytes + offsets.nbytes + nulls.nbytes, len(index), n, self.width)
        for part in (keys, offsets, nulls):
            self.out.write(part.tobytes())
        self.out.write(index)
        self.out.write(foot.tobytes())
        self.out.close()
        return len(keys), int(offsets[-1])


class ShardReader:
    """Reads records by position, and by key through the index."""

    def __init__(self, fs, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        foot = np.frombuffer(self.file.read_at(FOOTER.itemsize, size - FOOTER.itemsize), FOOTER)[0]
        if self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is not a token shard")
        get = lambda n, at, kind: np.frombuffer(self.file.read_at(n * np.dtype(kind).itemsize, at), kind)
        n, self.width = int(foot["records"]), int(foot["width"])
        self.keys, self.offsets = get(n, int(foot["keys_at"]), "<i8"), get(n + 1, int(foot["offsets_at"]), "<i8")
        self.nulls = get(n, int(foot["nulls_at"]), np.uint8)
        raw = self.file.read_at(int(foot["index_size"]), int(foot["index_at"]))
        self.mph, at = PerfectHash.from_bytes(raw)
        slots = int(foot["slots"])
        self.marks = np.frombuffer(raw, "<u4", slots, at)
        self.records = np.frombuffer(raw, "<i8", slots, at + 4 * slots)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first record of each key, -1 for keys that the shard does not have."""
        slot = self.mph.slots(keys)
        ok = slot >= 0
        ok[ok] = self.marks[slot[ok]] == fingerprints(np.asarray(keys)[ok])
        return np.where(ok, self.records[np.where(ok, slot, 0)] if len(self.records) else -1, -1)

    def ids(self, first: int, last: int) -> np.ndarray:
        """All ids of the records first..last-1."""
        a, b = int(self.offsets[first]), int(self.offsets[last])
        return np.frombuffer(self.file.read_at(self.width * (b - a), len(MAGIC) + self.width * a), f"<u{self.width}").astype("<u4")

    def get(self, key: int) -> np.ndarray | None:
        at = int(self.find(np.array([key]))[0])
        return None if at < 0 else self.ids(at, at + 1)


def write_shards(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, blank_free: bool = False) -> DataFrame:
    """Writes the shards; one row for each: shard, path, records, ids.  A task that runs again writes
    another file, and the manifest names the file of the attempt that succeeded."""

    def write(batches):
        enc, writer, end = encoder(vocabulary, blank_free), None, np.array([end_id], "<u4").tobytes()
        fs, at = store(folder)
        shard = TaskContext.get().partitionId()
        path = f"{at}/shard-{shard:06d}-{uuid.uuid4().hex[:8]}.tok"
        for batch in batches:
            if writer is None:
                fs.create_dir(at, recursive=True)
                writer = ShardWriter(fs, path, 2 if max(enc.model.get_vocab_size(), end_id + 1) <= 65536 else 4)
            ids, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            for k in range(0, len(ids), 2048):
                for key, got in zip(ids[k : k + 2048], enc.encode(texts[k : k + 2048])):
                    writer.add(key, got + end)
        if writer is not None:
            records, n = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "records": [records], "ids": [n]})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(write, "shard long, path string, records long, ids long")


def read_shards(spark: SparkSession, folder: str, manifest: list) -> DataFrame:
    """One row for each record: doc_id, start, n_tokens, ids_crc32, and whether the index finds it."""
    manifest = sorted(manifest, key=lambda r: r["shard"])
    start, rows = 0, []
    for r in manifest:
        rows.append((r["path"], start))
        start += r["ids"]
    shape = "doc_id long, start long, n_tokens long, ids_crc32 long, index_finds boolean"
    if not rows:
        return spark.createDataFrame([], shape)

    def read(batches):
        fs, _ = store(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = ShardReader(fs, path)
                n, a = len(shard.keys), 0
                while a < n:
                    b = max(a + 1, int(np.searchsorted(shard.offsets, shard.offsets[a] + READ_IDS)) - 1)
                    off = shard.offsets[a : b + 1] - shard.offsets[a]
                    raw = memoryview(shard.ids(a, b).tobytes())
                    crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(off[:-1].tolist(), off[1:].tolist())]
                    keys, null = shard.keys[a:b], shard.nulls[a:b] == 1
                    at = shard.find(keys)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, mask=null), pa.array(base + shard.offsets[a:b]), pa.array(np.diff(off)), pa.array(np.array(crc, np.int64)), pa.array(~null & (at >= 0) & (shard.keys[at] == keys))],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "index_finds"],
                    )
                    a = b

    files = spark.createDataFrame(rows, "path string, base long").repartition(max(1, min(len(rows), 4 * partitions(spark))))
    return files.mapInArrow(read, shape)


def token_store(docs: DataFrame, vocabulary: str, end_id: int = 0, folder: str | None = None, blank_free: bool = False) -> DataFrame:
    """Encodes every document, writes the shards and reads them back.

    Null text encodes as empty: the record is the end id alone.  Null doc_ids come first and are not
    in the index; of repeated doc_ids the index names the first record, and all records are there.
    An empty table writes no shard.  The manifest (one row for each shard) is gathered to number
    the shards; its size follows the number of partitions, not of documents.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "token-shards")
    manifest = write_shards(docs, folder, vocabulary, end_id, blank_free).collect()
    return read_shards(spark, folder, manifest)


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_store(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)

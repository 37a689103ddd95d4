"""What the operators of this subpackage share: tables, shared folders, byte hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark only (the folder may be in any Hadoop store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is unset and the session is local, as in tests, a temporary folder takes its place; on a
    cluster that would be another folder on each machine, so there an unset setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="glyphmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + base
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it again: cuts lineage, and what was
    computed is neither computed twice nor lost with an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark, label)}/table"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a number for each row, and the name of that column.

    The number is doc_id where every row has one of its own.  Else rows are numbered in order of doc_id (rows
    without one last) and written, so that the numbers stay whenever the frame is read again."""
    name = "row"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    key = F.col("doc_id").try_cast("long")
    if docs.select(key.alias("k")).groupBy("k").count().where("count > 1 or k is null").isEmpty():
        return docs.withColumn(name, key), name
    ordered = docs.orderBy(key.asc_nulls_last(), F.xxhash64("text"), F.monotonically_increasing_id())
    return staged(ordered.withColumn(name, F.monotonically_increasing_id()), "numbered-rows"), name


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared folder, for files that are not tables."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def texts_of(column: pa.Array) -> list[str]:
    """The strings of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column, null as empty, without decoding."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def key_runs(batches, key: str):
    """(key, part of a batch) for each run of equal keys in a stream of Arrow batches."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield keys[a], batch.slice(a, b - a)


def grouped(batches, key: str):
    """(key, table) for each run of equal keys in a stream of Arrow batches that is sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    at = None
    for k, part in key_runs(batches, key):
        if held and k != at:
            yield at, pa.Table.from_batches(held)
            held = []
        at = k
        held.append(part)
    if held:
        yield at, pa.Table.from_batches(held)

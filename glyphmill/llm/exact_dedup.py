"""Operator 5, exact dedup: a tree merge of sorted digest runs, all in DataFrame operations.

Every scan partition makes a run of digests, sorted.  The scan's runs are first merged into ``LEAVES`` runs at
most, several ways at once; then runs meet in the rounds of a binomial tree: in round r the runs whose
numbers differ in bit r alone are siblings, of which one sends its run to the other.  A run lies over many tasks,
dealt by digest, so that siblings' equal digests meet in one; what arrives there are sorted pieces, one from
each sender, which the sorter finds and merges, and equal neighbours become one entry.  It keeps the
smallest verified identifier, how many rows it stands for and which parts of the rows have it.  A sender
merges its own run first, so a group of copies with a third of all rows costs each task one entry a round.
After the last round one run is left.

An entry's key is the SHA-256 of the normalised text with its length in bytes and a 64-bit hash of
another family; entries merge only when all three agree, so the merge is verified at every level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, staged, table

BLANKS = " \t\n\x0b\x0c\r"
KEY = ("text_sha256", "n_bytes", "verifier")
LEAVES = 64  # runs that enter the binomial tree
PARTS = 32  # of the rows of one digest in the last join


def digest_runs(docs: DataFrame, row: str | None = None) -> DataFrame:
    """One sorted run for each scan partition: (run, row, doc_id, digest key, n_code_points, part).

    ``row`` names a column that numbers the rows; without it they are numbered here.
    """
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    text = F.coalesce(F.col("text"), F.lit(""))
    norm = F.translate(text, BLANKS, "")
    return (
        docs.select("doc_id", text.alias("text"), norm.alias("norm"), number.alias("row"))
        .select(
            F.spark_partition_id().alias("run"),
            "row",
            F.col("doc_id").cast("long").alias("doc_id"),
            F.unhex(F.sha2("norm", 256)).alias("text_sha256"),
            F.octet_length("norm").alias("n_bytes"),
            F.xxhash64("norm").alias("verifier"),
            F.char_length("text").cast("long").alias("n_code_points"),
        )
        .withColumn("part", F.pmod(F.xxhash64("row"), F.lit(PARTS)).cast("int"))
        .sortWithinPartitions(*KEY)
    )


def merge_runs(runs: DataFrame, n_runs: int, leaves: int = LEAVES) -> DataFrame:
    """The last run: one row for each digest with ``best`` (the row that stays), ``group_size`` and ``mask``, whose
    bits say which parts of the rows have the digest."""
    best = F.struct(
        (-F.col("n_code_points")).alias("rank"),
        F.col("doc_id").isNull().alias("no_id"),
        F.col("doc_id"),
        F.col("row"),
    )
    level = runs.select("run", *KEY, best.alias("best"), F.lit(1).cast("long").alias("group_size"), F.expr("shiftleft(1L, part)").alias("mask"))
    left = max(1, n_runs)
    depth = min(leaves, left) - 1
    steps = [F.pmod(F.col("run"), F.lit(depth + 1)) if left > leaves else F.col("run")]
    steps += [F.col("run").bitwiseAND(~(1 << r)) for r in range(depth.bit_length())]
    for to in steps[0 if left > leaves or not depth else 1 :]:
        level = (
            level.withColumn("run", to.cast("int"))
            .groupBy("run", *KEY)
            .agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"), F.bit_or("mask").alias("mask"))
        )
    return level.drop("run")


def exact_dedup(docs: DataFrame, row: str | None = None, leaves: int = LEAVES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting space, tab and the other characters of
    ``[\\x20\\x09-\\x0D]``; the row with the most code points in its original text stays, then the smallest
    doc_id.  Null text counts as empty; empty texts are equal to each other.  A null doc_id is larger
    than any other.  Of repeated rows with one doc_id exactly one is kept.  An empty table gives an
    empty result; other columns are not read, but for ``row``, which numbers the rows where given and
    comes back as row_number.
    """
    runs = staged(digest_runs(docs, row), "digest-runs")
    n_runs = (runs.agg(F.max("run")).first()[0] or 0) + 1
    parts = F.filter(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: F.getbit("mask", k) == 1)
    last = merge_runs(runs, n_runs, leaves).where("group_size > 1").withColumn("part", F.explode(parts)).drop("mask")
    joined = runs.join(last, [*KEY, "part"], "left")
    alone = F.col("best").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best.row") == F.col("row"))).alias("kept"),
        F.lower(F.hex("text_sha256")).alias("text_sha256"),
        F.col("row").alias("row_number"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("row_number")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
         length(coalesce(text, '')) AS n
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""


def keep_one(docs: DataFrame) -> DataFrame:
    """Pipeline stage: of rows with equal texts the one that ``exact_dedup`` keeps.  Rows go by number and never by
    doc_id, which can be null or repeated.  Empty and null texts are equal to each other, so one of them stays.
    All columns are returned as they are; an empty table stays empty."""
    own, row = numbered(docs)
    gone = exact_dedup(own.select("doc_id", "text", row), row=row).where("not kept").select(F.col("row_number").alias(row))
    return own.join(gone, row, "left_anti").select(*docs.columns)

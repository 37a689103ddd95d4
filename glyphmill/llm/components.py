"""Connected components by alternating large-star and small-star steps, all in DataFrame operations.

Every step aggregates the least neighbour of a node (with map-side combine) and joins it back to the
edges, so no node's neighbours are gathered; a hub's edges are split over ``SALTS`` parts of the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


SALTS = 32


def with_least(rows: DataFrame, key: str, value: str, several: bool = False, spread: bool = False) -> DataFrame:
    """Adds m, the least ``value`` of the row's ``key``; with ``several`` only keys of two values or more stay.

    Rows of one key are dealt over ``SALTS`` parts by their value.  The aggregate of a key says in a bit mask
    which parts it has, so that its least value is copied to these only and a rare key is not copied.  With ``spread`` the
    planner may not broadcast the rows instead, after which all rows of a key would come out of one task."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int"))
    least = salted.groupBy(key).agg(F.min(value).alias("m"), F.max(value).alias("most"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("mask"))
    if several:
        least = least.where("m < most")
    parts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.getbit("mask", k) == 1)
    least = least.select(key, "m", F.explode(parts).alias("salt"))
    return salted.join(least.hint("merge") if spread else least, [key, "salt"]).drop("salt")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge (u, v); the root is the least node of its component."""
    cur = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(cur)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = staged(with_least(both, "u", "v").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = with_least(large, "u", "v").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = staged(down.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _mark(cur)
        if now == mark:
            break
        mark = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

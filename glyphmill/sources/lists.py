"""Lint of dictionary files: word lists, correction tables and variant tables, all lines of all files at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed

CHUNK = 1 << 16  # lines that are sorted together; a file may hold a large share of all lines
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def entries(lines: DataFrame) -> DataFrame:
    """(file, kind, n, entry): the lines (file, kind, n, value) without white space at their ends, empty ones and comments."""
    rows = lines.select("file", "kind", "n", trimmed(F.col("value")).alias("entry"))
    return rows.where("entry <> '' and not startswith(entry, '#')")


def with_previous(words: DataFrame) -> DataFrame:
    """Adds before, the entry in front of each in its file, or null.  Chunks of a file are sorted apart from each other, and the first
    entry of a chunk gets the last one of the chunk before it from a table of a row a chunk."""
    rows = words.withColumn("chunk", F.floor(F.col("n") / CHUNK))
    inside = F.lag("entry").over(Window.partitionBy("file", "chunk").orderBy("n"))
    ends = rows.groupBy("file", "chunk").agg(F.max_by("entry", "n").alias("last"), F.min("n").alias("n"))
    heads = ends.select("file", "n", F.lag("last").over(Window.partitionBy("file").orderBy("chunk")).alias("carried"))
    marked = rows.withColumn("inside", inside)
    return marked.join(heads, ["file", "n"], "left").withColumn("before", F.coalesce("inside", "carried")).drop("inside", "carried", "chunk")


def lint_lists(lines: DataFrame, base: DataFrame) -> DataFrame:
    """(file, n, problem) of all lines (file, kind, n, value) of dictionary files; ``base`` (word) is the list that others must not repeat.

    Word lists: unsorted, repeated (as the line before), in-base.  Correction tables (typo, tab, fixes with commas): no-tab, empty,
    repeated (a typo that stands in an earlier line of its file), no-entries (of the file, n is null).  Variant tables (variant, tab,
    preferred): bad-variant, where either is missing or both are equal.  Letter case of ASCII does not count but in variants.  Null
    values are empty lines."""
    rows = entries(lines)
    words = rows.where("kind = 'wordlist'").withColumn("entry", _low(F.col("entry")))
    order = with_previous(words).where("before >= entry").select("file", "n", F.when(F.col("before") == F.col("entry"), "repeated").otherwise("unsorted").alias("problem"))
    known = base.select(_low(F.col("word")).alias("entry")).distinct()
    inside = words.join(known, "entry", "left_semi").select("file", "n", F.lit("in-base").alias("problem"))
    parts = F.split("entry", "\t", 2)
    fixes = F.filter(F.transform(F.split(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), ","), trimmed), lambda x: x != "")
    table = rows.where("kind = 'corrections'").select("file", "n", _low(trimmed(parts[0])).alias("typo"), F.contains("entry", F.lit("\t")).alias("tab"), F.size(fixes).alias("fixes"))
    state = F.when(~F.col("tab"), "no-tab").when((F.col("typo") == "") | (F.col("fixes") <= 0), "empty")
    table = table.withColumn("problem", state)
    good = table.where("problem is null")
    first = F.min("n").over(Window.partitionBy("file", "typo"))
    twice = good.withColumn("first", first).where("n > first").select("file", "n", F.lit("repeated").alias("problem"))
    files = lines.where("kind = 'corrections'").select("file").distinct()
    none = files.join(good.select("file").distinct(), "file", "left_anti").select("file", F.lit(None).cast("long").alias("n"), F.lit("no-entries").alias("problem"))
    left, right = trimmed(parts[0]), trimmed(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")))
    bad = rows.where("kind = 'variants'").where((left == "") | (right == "") | (left == right)).select("file", "n", F.lit("bad-variant").alias("problem"))
    out = order
    for part in (inside, table.where("problem is not null").select("file", "n", "problem"), twice, none, bad):
        out = out.unionByName(part.withColumn("n", F.col("n").cast("long")))
    return out

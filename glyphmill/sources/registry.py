"""Dictionary registries as tables: search, releases, versions, locks, lint; word files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The pattern that the semantic versioning specification publishes.
SEMVER = r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-((?:0|[1-9]\d*|\d*[a-zA-Z-][0-9a-zA-Z-]*)(?:\.(?:0|[1-9]\d*|\d*[a-zA-Z-][0-9a-zA-Z-]*))*))?(?:\+([0-9a-zA-Z-]+(?:\.[0-9a-zA-Z-]+)*))?$"


def is_semver(version: Column) -> Column:
    return version.rlike(SEMVER)


def search(index: DataFrame, text: str = "", language: str | None = None, kind: str | None = None) -> DataFrame:
    """Entries of a language and kind whose name or description has ``text``, in any letter case."""
    low = text.lower()
    rows = index.where(F.lower("name").contains(low) | F.lower("description").contains(low))
    for col, value in (("language", language), ("kind", kind)):
        rows = rows if value is None else rows.where(F.col(col) == value)
    return rows


def totals(index: DataFrame) -> DataFrame:
    """(kind, dictionaries, entries)."""
    return index.groupBy("kind").agg(F.count("*").alias("dictionaries"), F.sum("entries").cast("long").alias("entries"))


def releases(index: DataFrame) -> DataFrame:
    """(name, version, current, place): every release, the greatest version string first."""
    every = index.select("name", F.col("version").alias("now"), F.explode(F.array_distinct(F.concat(F.array("version"), "versions"))).alias("version"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("version")))
    return every.select("name", "version", (F.col("version") == F.col("now")).alias("current"), rank.alias("place"))


def select_release(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(reference, name, version, state) for references ``name`` or ``name@version``: the current release where none
    is named; state is found, no-version or no-entry."""
    name = F.split_part("reference", F.lit("@"), F.lit(1))
    asked = F.when(F.col("reference").contains("@"), F.substring_index("reference", "@", -1))
    own = index.select("name", F.col("version").alias("now"), "versions")
    rows = wanted.select("reference", name.alias("name"), asked.alias("asked")).join(own, "name", "left")
    version = F.coalesce("asked", "now")
    known = (version == F.col("now")) | F.array_contains("versions", version)
    state = F.when(F.col("now").isNull(), "no-entry").when(known, "found").otherwise("no-version")
    return rows.select("reference", "name", F.when(state == "found", version).alias("version"), state.alias("state"))


def lint(index: DataFrame) -> DataFrame:
    """(name, problem): repeated names, versions that are not semantic, missing licence."""
    twice = index.groupBy("name").count().where("count > 1").select("name", F.lit("duplicate-name").alias("problem"))
    bad = index.where(~is_semver(F.col("version"))).select("name", F.lit("bad-version").alias("problem"))
    bare = index.where(F.trim("license") == "").select("name", F.lit("no-license").alias("problem"))
    return twice.unionByName(bad).unionByName(bare)


def verified(fetched: DataFrame, lock: DataFrame) -> DataFrame:
    """(name, ok): whether the content of each fetched dictionary has its locked hash."""
    return fetched.join(lock.select("name", "sha256"), "name").select("name", (F.sha2("content", 256) == F.col("sha256")).alias("ok"))


def append_words(lines: DataFrame, words: DataFrame) -> DataFrame:
    """(section, n, value): a word file (n, value) with ``words`` (word) added.  Section 0 is the file's head of
    comments and blank lines as it was; section 1 its distinct words, to be ordered by value.  Later comments go."""
    blank = F.trim("value").startswith("#") | (F.trim("value") == "")
    first = lines.where(~blank).agg(F.min("n").alias("first"))
    head = lines.join(F.broadcast(first)).where("first is null or n < first").select(F.lit(0).alias("section"), F.col("n").cast("long").alias("n"), "value")
    every = lines.where(~blank).select(F.trim("value").alias("value")).unionByName(words.select(F.trim("word").alias("value"))).where("value <> ''").distinct()
    return head.unionByName(every.select(F.lit(1).alias("section"), F.lit(None).cast("long").alias("n"), "value"))

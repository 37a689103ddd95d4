"""File trees, word lists, correction tables, dictionary registries and result caches as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import byte_view, trimmed
from .rules import is_ignored

# Files that machines write.
DEFAULT_EXCLUDES = ("*.lock", "*.sum", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "*.min.js", "*.min.css")


def glob_regex(glob: str) -> str:
    """A regular expression for paths; ``*`` also crosses ``/`` and a glob without ``/`` matches file names."""
    import re

    body = "".join(".*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in glob.replace("**", "*"))
    return f"^{body}$" if "/" in glob else f"(^|/){body}$"


def guarded(files: DataFrame, most_bytes: int = 0) -> DataFrame:
    """Adds skipped_large (over ``most_bytes``, if that is set) and skipped_binary (a zero byte in the first 8192)."""
    large = F.lit(False) if most_bytes <= 0 else F.col("length") > most_bytes
    zero = F.instr(F.decode(F.substring(F.col("content"), 1, 8192), "ISO-8859-1"), F.lit("\x00")) > 0
    return files.withColumn("skipped_large", large).withColumn("skipped_binary", ~F.col("skipped_large") & zero)


ALWAYS_SKIPPED = ("**/.git/**", ".git/**")


def read_tree(spark: SparkSession, paths: str | list[str], excludes: tuple[str, ...] = (), most_bytes: int = 0, ignores: list[tuple[str, bool]] | None = None, skipped: tuple[str, ...] = ()) -> DataFrame:
    """(path, length, modified, text, skipped_large, skipped_binary) of the files of one or several folders.

    Hidden and excluded files are left out, those that the rules of an ignore file (``ignores``, for paths below the
    folder) name, and ``skipped``: names of the baseline file and the cache folder.  A folder that is missing is an error."""
    roots = [paths] if isinstance(paths, str) else paths
    files = None
    for root in roots:
        part = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        below = root.rstrip("/") + "/"
        below = below if "://" in below or below.startswith("file:") else "file:" + below
        part = part.withColumn("below", F.when(F.col("path").startswith(below), F.substring("path", F.lit(len(below) + 1), F.length("path"))).otherwise(F.regexp_extract("path", "[^/]*$", 0)))
        files = part if files is None else files.unionByName(part)
    files = files.dropDuplicates(["path"]) if len(roots) > 1 else files
    files = files.where(~F.col("below").rlike(r"(^|/)\.[^/]+(/|$)"))
    for glob in (*DEFAULT_EXCLUDES, *ALWAYS_SKIPPED, *excludes, *(g for name in skipped for g in (name, name + "/**"))):
        files = files.where(~F.col("below").rlike(glob_regex(glob)))
    if ignores:
        files = files.where(~is_ignored(F.col("below"), ignores))
    checked = guarded(files, most_bytes)
    text = F.when(~F.col("skipped_large") & ~F.col("skipped_binary"), F.make_valid_utf8(F.col("content").cast("string")))
    return checked.select("path", "length", F.col("modificationTime").alias("modified"), text.alias("text"), "skipped_large", "skipped_binary")


def one_text(spark: SparkSession, text: str, name: str = "stdin") -> DataFrame:
    """(doc_id, path, text) of a text that is at hand; ``name`` chooses its profile and overrides."""
    return spark.createDataFrame([(0, name, text)], "doc_id long, path string, text string")


def spread(df: DataFrame) -> DataFrame:
    """Deals out rows that come from fewer files than there are cores: a file of one row group is one task,
    however it is split.  Larger inputs are left as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def word_list(lines: DataFrame) -> DataFrame:
    """(word) from rows ``value``: one a line, trimmed, lower-cased, distinct; lines that start with ``#`` are comments."""
    w = trimmed(F.col("value"))
    return lines.select(w.alias("word")).where("word <> '' and not startswith(word, '#')").select(F.lower("word").alias("word")).distinct()


def read_word_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(word): the union of word files, as an allow set or a word list."""
    return word_list(spark.read.text(paths))


def overlap(words: DataFrame, base: DataFrame) -> DataFrame:
    """(word): entries of a list that a base list has already."""
    return words.join(base.select("word").distinct(), "word", "left_semi")


def correction_lines(lines: DataFrame) -> DataFrame:
    """(typo, fixes) from rows ``value``: ``typo<TAB>fix[,fix]``; lines without a tab or a fix are skipped."""
    parts = F.split("value", "\t", 2)
    fixes = F.filter(F.transform(F.split(parts[1], ","), trimmed), lambda x: x != "")
    rows = lines.where(F.col("value").contains("\t") & ~trimmed(F.col("value")).startswith("#")).select(F.lower(trimmed(parts[0])).alias("typo"), fixes.alias("fixes"))
    return rows.where("typo <> '' and size(fixes) > 0")


def lint_word_list(lines: DataFrame) -> DataFrame:
    """(value, problem) of a list that should be sorted and distinct; rows have value and n, its number in the file."""
    before = lines.select((F.col("n") + 1).alias("n"), F.col("value").alias("before"))
    return lines.join(before, "n").where("before >= value").select("value", F.when(F.col("before") == F.col("value"), "duplicate").otherwise("unsorted").alias("problem"))


CACHE_VERSION = 1
CACHE_KEYS = ["path", "version", "engine", "size", "modified_ns", "content_sha256", "config_sha256"]


def cached_findings(current: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings that hold, files to check again).

    ``current`` has ``CACHE_KEYS`` and text; ``cache`` the same keys and findings, an array of structs with offset and word.
    An entry holds if all keys agree and all its spans lie in the text as they say."""
    joined = current.join(cache.select(*CACHE_KEYS, "findings").dropDuplicates(CACHE_KEYS), CACHE_KEYS, "left")
    b = byte_view(F.col("text"))
    stands = lambda f: F.substring(b, (f["offset"] + 1).cast("int"), F.octet_length(f["word"])) == byte_view(f["word"])
    holds = F.coalesce(F.forall("findings", stands), F.lit(False))
    marked = joined.withColumn("holds", holds)
    kept = marked.where("holds").select("path", F.explode("findings").alias("f")).select("path", "f.*")
    return kept, marked.where("not holds").select(*current.columns)


def cache_rows(checked: DataFrame, found: DataFrame) -> DataFrame:
    """Cache entries of checked files (``CACHE_KEYS``): their findings, none for clean ones."""
    fields = [c for c in found.columns if c != "path"]
    own = found.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("findings"))
    empty = F.array().cast(own.schema["findings"].dataType)
    return checked.select(*CACHE_KEYS).join(own, "path", "left").withColumn("findings", F.coalesce("findings", empty))


def reusable(current: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files whose cached result holds, files to check again) by path, content hash and configuration hash."""
    keys = ["path", "content_sha256", "config_sha256"]
    return current.join(cache.select(*keys), keys, "left_semi"), current.join(cache.select(*keys), keys, "left_anti")


def registry_status(index: DataFrame, lock: DataFrame) -> DataFrame:
    """(name, version, locked, state) of a dictionary index against a lock: installed, outdated or absent."""
    own = lock.select("name", F.col("version").alias("locked"), F.col("sha256").alias("locked_sha"))
    state = F.when(F.col("locked").isNull(), "absent").when((F.col("locked") == F.col("version")) & (F.col("locked_sha") == F.col("sha256")), "installed").otherwise("outdated")
    return index.join(own, "name", "left").select("name", "version", "locked", state.alias("state"))

"""File trees as a whole: ignore files of every folder, checks that reuse earlier results, fixes written back.

What a rule file says holds for the paths below its folder.  Paths are matched as DataFrames: every path is taken apart into itself
and its folders, these meet the rule files of their own folders in a join, and of all rules that match the strongest decides."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

# Names of rule files, the stronger first.
RULE_FILES = (".ignore", ".gitignore", ".git/info/exclude")


def ignore_rule(line: str) -> tuple[str, bool, bool] | None:
    """(regular expression for a path below the rule's folder, whether it takes back, whether it is for folders only) of a line of an
    ignore file; None for comments and empty lines.

    A slash at the start or within ties a pattern to its folder; ``**`` crosses folders, ``*`` and ``?`` do not."""
    line = re.sub(r"(?<!\\)[ \t\r]+$", "", line.rstrip("\n"))
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    glob = line[1:] if back else line
    folder, glob = glob.endswith("/"), glob.rstrip("/")
    if not glob:
        return None
    tied = "/" in glob
    glob = glob.lstrip("/")
    out = "" if tied else "(?:.*/)?"
    for m in re.finditer(r"(?P<all>^\*\*/|/\*\*/|/\*\*$)|(?P<some>\*+)|(?P<one>\?)|(?P<set>\[[!^]?\]?[^\]]*\])|\\(?P<plain>.)|(?P<char>.)", glob, re.DOTALL):
        kind, text = m.lastgroup, m[0]
        if kind == "all":
            out += {"/": "(?:.*/)?"}.get(text[-1], "/.+") if text[0] != "/" else "/(?:.*/)?" if text[-1] == "/" else "/.+"
        elif kind == "set":
            body = text[1:-1].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "(?!/)[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
        else:
            out += {"some": "[^/]*", "one": "[^/]"}.get(kind) or re.escape(m["plain"] or m["char"])
    return f"^{out}$", back, folder


def ignore_rules(rule_files: DataFrame) -> DataFrame:
    """(folder, strength, depth, n, pattern, back, folders_only): the rules of files (folder, name, text), in the order of their lines.

    ``folder`` is relative to the root and empty for it; ``strength`` follows the file's name, so that of two that match the larger decides."""
    import pandas as pd

    strength = F.element_at(F.array(*[F.lit(len(RULE_FILES) - i) for i in range(len(RULE_FILES))]), F.array_position(F.array(*[F.lit(n) for n in RULE_FILES]), F.col("name")).cast("int"))
    rows = rule_files.where(F.col("name").isin(*RULE_FILES)).select("folder", strength.alias("strength"), F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))

    def parsed(batches):
        for rows in batches:
            found = [(f, s, n, rule) for f, s, n, x in rows.itertuples(index=False) if (rule := ignore_rule(x))]
            yield pd.DataFrame([(f, s, f.count("/") + (f != ""), n, *rule) for f, s, n, rule in found], columns=["folder", "strength", "depth", "n", "pattern", "back", "folders_only"])

    return rows.mapInPandas(parsed, "folder string, strength int, depth int, n int, pattern string, back boolean, folders_only boolean")


def _folders(path: Column) -> Column:
    """The folders above a relative path, the root (empty) among them."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def not_ignored(paths: DataFrame, rules: DataFrame, below: str = "below") -> DataFrame:
    """The rows of ``paths`` that no rule (of ``ignore_rules``) leaves out; ``below`` is the path relative to the root.

    A path or folder is left out if the strongest rule that matches it does not take it back: that of the stronger kind of file, then
    of the deepest folder, then of the last line.  What lies in a folder that is left out is left out with it."""
    name = F.col(below)
    own = paths.select(name.alias("path")).distinct()
    upper = own.select("path", F.explode(_folders(F.col("path"))).alias("target")).where("target <> ''")
    targets = own.select(F.col("path").alias("target"), F.lit(False).alias("is_folder")).unionByName(upper.select("target", F.lit(True).alias("is_folder")).distinct())
    asked = targets.select("*", F.explode(_folders(F.col("target"))).alias("folder")).join(rules, "folder")
    rest = F.when(F.col("folder") == "", F.col("target")).otherwise(F.substring("target", F.length("folder") + 2, F.length("target")))
    hits = asked.where((F.col("is_folder") | ~F.col("folders_only")) & F.regexp_like(rest, F.col("pattern")))
    out = hits.groupBy("target", "is_folder").agg(F.max(F.struct("strength", "depth", "n", "back")).alias("top")).where("not top.back")
    gone = out.where("not is_folder").select(F.col("target").alias("path")).unionByName(upper.join(out.where("is_folder").select("target"), "target").select("path")).distinct()
    return paths.join(gone, name == gone["path"], "left_anti")


def rule_files_of(spark: SparkSession, root: str, listed: DataFrame, git: bool = True) -> DataFrame:
    """(folder, name, text): the rule files of the root and of all folders of the ``listed`` files (below), read by tasks.

    Spark's own reader leaves files out whose names begin with a dot.  Without ``git`` only ``.ignore`` files count."""
    import pandas as pd
    from pyarrow import fs

    names = RULE_FILES if git else RULE_FILES[:1]

    def read(batches):
        for rows in batches:
            found = []
            for folder in rows["folder"]:
                for name in names:
                    where, path = _opened(f"{root.rstrip('/')}/{folder}/{name}" if folder else f"{root.rstrip('/')}/{name}")
                    if where.get_file_info(path).type == fs.FileType.File:
                        with where.open_input_stream(path) as f:
                            found.append((folder, name, f.read().decode("utf-8", "replace")))
            yield pd.DataFrame(found, columns=["folder", "name", "text"])

    folders = listed.select(F.explode(_folders(F.col("below"))).alias("folder")).distinct()
    return folders.mapInPandas(read, "folder string, name string, text string")


def _opened(uri: str):
    from pyarrow import fs

    if "://" in uri and not uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), "/" + re.sub(r"^file:", "", uri).lstrip("/")


def read_tree(spark: SparkSession, root: str, excludes: tuple[str, ...] = (), most_bytes: int = 0, git: bool = True, skipped: tuple[str, ...] = ()) -> DataFrame:
    """``files.read_tree`` without what the ignore files of the tree's folders leave out; adds below, the path relative to the root."""
    base = root if "://" in root or root.startswith("file:") else "file:" + root
    tree = files.read_tree(spark, root, excludes, most_bytes, skipped=skipped).withColumn("below", F.substring("path", F.lit(len(base.rstrip("/")) + 2), F.length("path")))
    return not_ignored(tree, ignore_rules(rule_files_of(spark, root, tree.select("below"), git)))


# The cache of a tree: generations of a table, of which the newest whole one counts.


def _generations(spark: SparkSession, folder: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for s in store.listStatus(path) if store.exists(path) else []:
        m = re.fullmatch(r"generation-(\d+)", s.getPath().getName())
        if m:
            found.append((int(m[1]), store.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")), s.getPath()))
    return store, sorted(found, key=lambda x: x[0])


def newest(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest generation that was written to its end, or None."""
    whole = [g for g in _generations(spark, folder)[1] if g[1]]
    return spark.read.parquet(whole[-1][2].toString()) if whole else None


def replace(df: DataFrame, folder: str, keep: int = 2) -> None:
    """Writes a new generation.  Readers take it when its last file is there, and until then the one before; a writer that
    dies leaves a part that nobody reads.  All but the ``keep`` newest whole ones are removed then."""
    spark = df.sparkSession
    store, found = _generations(spark, folder)
    df.write.mode("error").parquet(f"{folder.rstrip('/')}/generation-{found[-1][0] + 1 if found else 0}")
    whole = [g for g in _generations(spark, folder)[1] if g[1]]
    for number, _, path in found:
        if number < whole[-keep:][0][0]:
            store.delete(path, True)


FINDING = "line int, col long, offset long, len long, word string, kind string, suggestions array<string>, phase int"


def check_tree(tree: DataFrame, check: Callable[[DataFrame], DataFrame], cache: str, settings: str, engine: str = "1") -> tuple[DataFrame, DataFrame]:
    """(findings with path, (path, checked) of every file): files whose cached result holds are not checked again.

    ``tree`` are rows of ``read_tree``, ``check`` makes findings of (doc_id, path, text), ``settings`` is a fingerprint of all that it
    depends on, and ``cache`` the folder of the results, which is brought up to date: files that are gone leave it.  Empty files are not listed."""
    from .staging import staged

    spark = tree.sparkSession
    text = F.col("text")
    keys = [F.col("path"), F.lit(files.CACHE_VERSION).alias("version"), F.lit(engine).alias("engine"), F.col("length").alias("size"), F.unix_micros("modified") * 1000, F.sha2(text, 256), F.lit(settings)]
    now = tree.where("text is not null").select(*[k.alias(n) for k, n in zip(keys, files.CACHE_KEYS)], "text")
    old = newest(spark, cache)
    if old is None:
        old = spark.createDataFrame([], f"path string, version int, engine string, size long, modified_ns long, content_sha256 string, config_sha256 string, findings array<struct<{FINDING.replace(' ', ':').replace(',:', ',')}>>")
    kept, again = files.cached_findings(now, old)
    docs = again.select(F.xxhash64("path").alias("doc_id"), "path", "text")
    found = check(docs).join(docs.select("doc_id", "path"), "doc_id").select("path", *[x.split()[0] for x in FINDING.split(", ")])
    found = staged(found, "findings")
    kept = staged(kept.select(*found.columns), "kept-findings")
    every = found.unionByName(kept)
    states = now.select("path").join(again.select("path", F.lit(True).alias("checked")), "path", "left")
    states = staged(states.withColumn("checked", F.coalesce("checked", F.lit(False))), "file-states")
    replace(files.cache_rows(now, every), cache)
    return every, states


def write_back(fixed: DataFrame) -> DataFrame:
    """Writes texts (path, text, before: the text's SHA-256 when it was read) and returns (path, outcome): written, or changed for files
    that are no longer as they were, or gone, which stay untouched.

    The task that writes a file reads it again, writes the new text beside it and renames that, so readers see the old text or the
    new one; a task that is run again finds its own work done.  The files must lie where all executors reach them."""
    import hashlib
    import shutil

    import pandas as pd
    from pyarrow import fs

    def outcome(path: str, text: str, before: str) -> str:
        where, name = _opened(path)
        if where.get_file_info(name).type != fs.FileType.File:
            return "gone"
        with where.open_input_stream(name) as f:
            now = f.read()
        data = text.encode("utf-8")
        if now == data:
            return "written"
        if hashlib.sha256(now).hexdigest() != before:
            return "changed"
        aside = f"{name}.{hashlib.sha256(data).hexdigest()[:12]}.new"
        with where.open_output_stream(aside) as f:
            f.write(data)
        if isinstance(where, fs.LocalFileSystem):
            shutil.copymode(name, aside)
        where.move(aside, name)
        return "written"

    def run(batches):
        for rows in batches:
            yield pd.DataFrame({"path": rows["path"], "outcome": [outcome(*r) for r in rows[["path", "text", "before"]].itertuples(index=False)]})

    return fixed.select("path", "text", "before").mapInPandas(run, "path string, outcome string")


def fix_tree(tree: DataFrame, findings: DataFrame) -> DataFrame:
    """(path, outcome, fixed): applies the safe fixes of ``findings`` (with path) to the files of ``tree`` and tells what became of each
    file that has any.  It is run by writing or collecting the result; files whose bytes are no valid text are left out."""
    from ..operators.findings import apply_fixes
    from .staging import staged

    docs = tree.where("text is not null").select(F.col("path").alias("doc_id"), "text", F.col("length"))
    whole = docs.where(F.octet_length("text") == F.col("length")).select("doc_id", "text")
    fixed = apply_fixes(whole, findings.withColumn("doc_id", F.col("path")))
    before = whole.select("doc_id", F.sha2("text", 256).alias("before"))
    rows = staged(fixed.join(before, "doc_id").select(F.col("doc_id").alias("path"), "text", "before", "fixed"), "fixed-texts")
    return write_back(rows).join(rows.select("path", "fixed"), "path")


def fixed_run(tree: DataFrame, check: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings that are left, with path; outcomes of ``fix_tree``; one row of counters for ``summary_record``): checks the files of ``tree``
    (rows of ``read_tree``), writes their safe fixes back and counts on the way.

    The files are read once and checked once: each step is written as a table, and the counters of the scan and of the fixes are
    observed while that is done.  Fixes of files that have changed since, or are gone, do not count, and their findings are left.
    Empty trees have no rows and zeros."""
    from ..operators.findings import Counted, remaining
    from .staging import staged

    spark = tree.sparkSession
    clean = ~F.col("skipped_binary") & ~F.col("skipped_large")
    scan = Counted(tree, files_checked=F.count_if(clean), skipped_binary=F.count_if("skipped_binary"), skipped_large=F.count_if("skipped_large"))
    rows = staged(scan.rows, "scanned-tree")
    docs = rows.where("text is not null").select(F.xxhash64("path").alias("doc_id"), "path", "text")
    found = staged(check(docs).join(docs.select("doc_id", "path"), "doc_id"), "findings")
    fixes = Counted(fix_tree(rows, found), fixed=F.sum(F.when(F.col("outcome") == "written", F.col("fixed"))))
    outcomes = staged(fixes.rows, "fix-outcomes")
    written = outcomes.where("outcome = 'written'").select("path")
    left = remaining(found).join(written, "path", "left_semi").unionByName(found.join(written, "path", "left_anti"))
    left = staged(left, "left-findings")
    of_files = left.agg(F.count("*").alias("issues"), F.count_distinct("path").alias("files_with_issues"))
    seen = scan.get() | fixes.get()
    counts = spark.createDataFrame([tuple(seen.values())], ", ".join(f"{n} long" for n in seen))
    return left, outcomes, of_files.join(F.broadcast(counts))  # one row each

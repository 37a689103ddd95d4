"""What is done with findings: union and order, summaries, word collection, baselines, fixes, reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import byte_view, display_column, from_bytes, github_escape, message, safe_fix, snippet, trimmed

COLUMNS = ("doc_id", "line", "col", "offset", "len", "word", "kind", "suggestions")
COLLECTED = ("typo", "unknown-word", "en-variant", "ja-variant")


def union(parts: list[DataFrame], allow: DataFrame | None = None) -> DataFrame:
    """All findings with the phase that made them; words of the allow set are dropped from every kind."""
    return united(parts[0].sparkSession, list(enumerate(parts)), allow)


def united(spark: SparkSession, parts: list[tuple[int | None, DataFrame]], allow: DataFrame | None = None) -> DataFrame:
    """``union`` of findings with a phase for each part, or with phases of their own (None)."""
    out = None
    for phase, p in parts:
        p = p.select(*COLUMNS, (F.col("phase") if phase is None else F.lit(phase)).cast("int").alias("phase"))
        out = p if out is None else out.unionByName(p)
    if out is None:
        return spark.createDataFrame([], "doc_id long, line int, col long, offset long, len long, word string, kind string, suggestions array<string>, phase int")
    if allow is not None:
        keys = allow.select(F.lower("word").alias("k")).distinct()
        out = out.join(keys, F.lower(out["word"]) == keys["k"], "left_anti")
    return out


def with_line_text(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds the unmasked text of the finding's line.  A document's findings meet its lines once, together.

    Here and below, joins of findings are told to sort: the planner goes by the size of compressed files, and a broadcast of findings is many times that."""
    cols = [c for c in findings.columns if c != "doc_id"]
    own = findings.groupBy("doc_id").agg(F.collect_list(F.struct(*cols)).alias("own"))
    joined = docs.select("doc_id", F.split("text", "\n", -1).alias("lines")).join(own.hint("merge"), "doc_id")
    text = lambda f: F.rtrim(F.try_element_at("lines", f["line"]), F.lit("\r"))
    each = F.transform("own", lambda f: F.struct(f.alias("f"), text(f).alias("line_text")))
    return joined.select("doc_id", F.explode(each).alias("z")).select("doc_id", "z.f.*", "z.line_text")


def summary(findings: DataFrame, files: DataFrame) -> DataFrame:
    """One row of counters; ``files`` has doc_id, skipped_binary, skipped_large."""
    f = findings.agg(F.count("*").alias("issues"), F.count_distinct("doc_id").alias("files_with_issues"))
    c = files.agg(F.count_if(~F.col("skipped_binary") & ~F.col("skipped_large")).alias("files_checked"), F.count_if("skipped_binary").alias("skipped_binary"), F.count_if("skipped_large").alias("skipped_large"))
    return f.join(F.broadcast(c))  # one row each


def collect_words(findings: DataFrame) -> DataFrame:
    """(word, count, kind, example, suggestions): kind and example (``path:line: text``) of the first occurrence,
    suggestions in order of first sight.  ``findings`` has path and line_text.

    Occurrences are first counted by word and suggestions, of which a word has few, and these are then brought together."""
    key = F.when(F.col("word").rlike("^[\\x00-\\x7F]*$"), F.lower("word")).otherwise(F.col("word"))
    example = F.concat("path", F.lit(":"), F.col("line"), F.lit(": "), snippet(F.col("line_text")))
    rows = findings.where(F.col("kind").isin(*COLLECTED)).select(key.alias("word"), F.struct(F.struct("path", "offset", "phase").alias("pos"), "kind", example.alias("example")).alias("at"), "suggestions")
    few = rows.groupBy("word", "suggestions").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    seen = F.array_sort(F.collect_list(F.struct("at", "suggestions")))
    every = F.array_distinct(F.flatten(F.transform(seen, lambda x: x["suggestions"])))
    return few.groupBy("word").agg(F.sum("n").alias("count"), F.min("at").alias("at"), every.alias("suggestions")).select("word", "count", "at.kind", "at.example", "suggestions")


def fingerprint(path: Column, kind: Column, word: Column, line_text: Column) -> Column:
    """Free of line numbers: path, kind, word and a hash of the trimmed line."""
    zero = F.lit("\x00")
    return F.sha2(F.concat(path, zero, kind, zero, F.lower(word), zero, F.sha2(trimmed(line_text), 256)), 256)


def baseline(findings: DataFrame) -> DataFrame:
    """(fingerprint, path, kind, word, count)."""
    return findings.groupBy("fingerprint").agg(F.min("path").alias("path"), F.min("kind").alias("kind"), F.min("word").alias("word"), F.count("*").alias("count"))


def suppress(findings: DataFrame, known: DataFrame) -> DataFrame:
    """Findings beyond the counts of a baseline, used up in order of path and position."""
    w = Window.partitionBy("fingerprint").orderBy("path", "offset", "phase")
    return findings.withColumn("k", F.row_number().over(w)).join(known.select("fingerprint", F.col("count").alias("budget")).hint("merge"), "fingerprint", "left").where("k > coalesce(budget, 0)").drop("k", "budget")


def prune(known: DataFrame, current: DataFrame) -> DataFrame:
    """The baseline with counts no larger than now and ``removed``, by how much each fell; entries that are gone have
    count 0 and are to be dropped."""
    now = known.join(current.select("fingerprint", F.col("count").alias("now")).hint("merge"), "fingerprint", "left")
    left = F.least("count", F.coalesce("now", F.lit(0)))
    return now.withColumn("removed", F.col("count") - left).withColumn("count", left).drop("now")


CHUNK = 256  # fixes; a fold that appends to an array copies it each time


def chosen_fixes(findings: DataFrame) -> DataFrame:
    """(doc_id, fixes): safe fixes in order of position, of overlapping ones the first."""
    rows = findings.withColumn("fix", safe_fix(F.col("kind"), F.col("suggestions"))).where("fix is not null")
    all_ = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("offset", "phase", "len", "fix"))).alias("all"))
    kind = "struct<offset:bigint,phase:int,len:bigint,fix:string>"
    state = lambda out, end: F.struct(out.alias("out"), end.alias("end"))
    take = lambda a, x: F.when(x["offset"] >= a["end"], state(F.concat(a["out"], F.array(x)), x["offset"] + x["len"])).otherwise(a)

    def chunk(a: Column, c: Column) -> Column:
        part = F.aggregate(F.slice("all", c * CHUNK + 1, F.lit(CHUNK)), state(F.array().cast(f"array<{kind}>"), a["end"]), take)
        return state(F.concat(a["out"], F.array(part["out"])), part["end"])

    chunks = F.sequence(F.lit(0), F.floor((F.size("all") - 1) / CHUNK).cast("int"))
    zero = state(F.array().cast(f"array<array<{kind}>>"), F.lit(0).cast("long"))
    return all_.select("doc_id", F.aggregate(chunks, zero, chunk, lambda a: F.flatten(a["out"])).alias("fixes"))


def apply_fixes(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, text, fixed): the documents with their safe fixes applied."""
    joined = docs.join(chosen_fixes(findings).hint("merge"), "doc_id").select("doc_id", byte_view(F.col("text")).alias("b"), "fixes")
    ends = F.transform("fixes", lambda x: x["offset"] + x["len"])
    starts = F.concat(F.array(F.lit(0).cast("long")), F.slice(ends, F.lit(1), F.size("fixes") - 1))
    part = lambda x, at: F.concat(F.substring(F.col("b"), (at + 1).cast("int"), (x["offset"] - at).cast("int")), byte_view(x["fix"]))
    rest = F.substring(F.col("b"), (F.element_at(ends, -1) + 1).cast("int"), F.lit(2**31 - 1))
    return joined.select("doc_id", from_bytes(F.concat(F.array_join(F.zip_with("fixes", starts, part), ""), rest)).alias("text"), F.size("fixes").cast("long").alias("fixed"))


def remaining(findings: DataFrame) -> DataFrame:
    """The findings that ``apply_fixes`` leaves: without a safe fix, or overlapping one that came before."""
    taken = chosen_fixes(findings).select("doc_id", F.explode("fixes").alias("x")).select("doc_id", "x.offset", "x.phase", "x.len")
    return findings.join(taken.hint("merge"), ["doc_id", "offset", "phase", "len"], "left_anti").select(*findings.columns)


class Counted:
    """Rows that count themselves while they are written: ``rows`` is to be written once, ``get`` waits for that and gives the counts.

    ``counts`` are aggregates by name.  No second pass is made for them; a table without rows has all counts 0."""

    def __init__(self, rows: DataFrame, **counts: Column):
        self.names, self.seen = list(counts), Observation()
        self.rows = rows.observe(self.seen, *[F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in counts.items()])

    def get(self) -> dict[str, int]:
        seen = self.seen.get
        return {n: int(seen.get(n) or 0) for n in self.names}


def dry_run(findings: DataFrame) -> DataFrame:
    """Per document: what fixing would do, what has several candidates, what has none."""
    fix = safe_fix(F.col("kind"), F.col("suggestions"))
    none = F.size("suggestions") == 0
    return findings.groupBy("doc_id").agg(F.count_if(fix.isNotNull()).alias("fixed"), F.count_if(fix.isNull() & ~none).alias("skipped"), F.count_if(none).alias("unfixable"))


def brief(findings: DataFrame) -> Column:
    column = display_column(F.col("line_text"), F.col("col"))
    return F.concat(F.col("path"), F.lit(":"), F.col("line"), F.lit(":"), column, F.lit(": "), F.col("word"), F.lit(" -> "), F.array_join("suggestions", ","))


def json_record() -> Column:
    column = display_column(F.col("line_text"), F.col("col"))
    return F.to_json(
        F.struct(F.lit(1).alias("version"), F.lit("issue").alias("type"), "path", "line", column.alias("column"), "offset", F.col("len").alias("length"), "word", "kind", "suggestions", safe_fix(F.col("kind"), F.col("suggestions")).alias("fix"), message(F.col("kind"), F.col("word"), F.col("suggestions")).alias("message")),
        {"ignoreNullFields": "false"},
    )


def github(title: str = "glyphmill") -> Column:
    column = display_column(F.col("line_text"), F.col("col"))
    kind = F.concat(F.lit(f"{title} ["), F.col("kind"), F.lit("]"))
    return F.concat(F.lit("::warning file="), github_escape(F.col("path"), True), F.lit(",line="), F.col("line"), F.lit(",col="), column, F.lit(",title="), github_escape(kind, True), F.lit("::"), github_escape(message(F.col("kind"), F.col("word"), F.col("suggestions")), False))


def summary_record(counts: DataFrame) -> DataFrame:
    """(record): the JSON record that ends a report; counts that are missing are 0."""
    names = ["issues", "files_with_issues", "files_checked", "fixed", "skipped_binary", "skipped_large"]
    fields = [(F.coalesce(F.col(n), F.lit(0)) if n in counts.columns else F.lit(0)).cast("long").alias(n) for n in names]
    return counts.select(F.to_json(F.struct(F.lit(1).alias("version"), F.lit("summary").alias("type"), *fields)).alias("record"))


def sarif(findings: DataFrame) -> DataFrame:
    """(path, offset, phase, result): one JSON result per finding in the shape of SARIF's ``results``."""
    column = display_column(F.col("line_text"), F.col("col"))
    region = F.struct(F.col("line").alias("startLine"), column.alias("startColumn"), F.col("line").alias("endLine"), (column + F.char_length("word")).alias("endColumn"))
    where = F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    text = F.struct(message(F.col("kind"), F.col("word"), F.col("suggestions")).alias("text"))
    return findings.select("path", "offset", "phase", F.to_json(F.struct(F.col("kind").alias("ruleId"), F.lit("warning").alias("level"), text.alias("message"), where.alias("locations"), F.struct("word", "suggestions").alias("properties"))).alias("result"))


# What each kind of finding is about.
ABOUT = {
    "typo": "a known misspelling",
    "unknown-word": "a word of no active word list",
    "en-variant": "a spelling of the other region",
    "ja-variant": "a Japanese spelling that is not the chosen or prevailing one",
    "fullwidth-alnum": "full-width letters or digits",
    "halfwidth-kana": "half-width katakana",
    "fullwidth-space": "an ideographic space where it is not wanted",
    "ja-compatibility": "a compatibility character with a standard form",
    "ja-number-style": "a number written in two styles",
    "ja-punctuation": "two styles of punctuation in one document",
}


def sarif_lines(findings: DataFrame, name: str = "glyphmill", version: str = "1") -> DataFrame:
    """(part, path, offset, phase, line): a SARIF document line by line, to be written in order of the first four columns.

    Part 0 opens it with the tool and all its rules, part 1 has a result a line, part 2 closes it; no task holds it whole."""
    spark = findings.sparkSession
    driver = {"name": name, "version": version, "rules": [{"id": k, "shortDescription": {"text": v}, "properties": {"tags": ["spelling", k]}} for k, v in ABOUT.items()]}
    head = '{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":' + json.dumps(driver, ensure_ascii=False) + '},"results":['
    ends = spark.createDataFrame([(0, "", 0, 0, head), (2, "", 0, 0, "]}]}")], "part int, path string, offset long, phase int, line string")
    rows = sarif(findings).select(F.lit(1).alias("part"), "path", "offset", "phase", F.col("result").alias("line"))
    first = rows.agg(F.min(F.struct("path", "offset", "phase", "line")).alias("first"))
    mine = F.struct("path", "offset", "phase", "line")
    rows = rows.join(F.broadcast(first)).withColumn("line", F.when(mine == F.col("first"), F.col("line")).otherwise(F.concat(F.lit(","), F.col("line")))).drop("first")
    return ends.unionByName(rows)


def write_lines(lines: DataFrame, order: list[str], path: str) -> None:
    """Writes ``line`` as text files whose names follow ``order``; the order is global over all files."""
    lines.orderBy(*order).select(F.col("line").alias("value")).write.mode("error").text(path)

"""What people do with findings: reading reports, triage, decisions, previews of fixes, editor limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import byte_view, display_column, safe_fix


def human(findings: DataFrame) -> DataFrame:
    """Adds report_line; locations are padded to the longest one, whose width is one row."""
    column = display_column(F.col("line_text"), F.col("col"))
    rows = findings.withColumn("location", F.concat(F.col("path"), F.lit(":"), F.col("line"), F.lit(":"), column))
    width = rows.agg(F.max(F.char_length("location")).alias("width"))
    to = F.when(F.size("suggestions") > 0, F.concat(F.lit(" → "), F.array_join("suggestions", ", "))).otherwise("")
    text = F.concat(F.rpad("location", F.col("width"), F.lit(" ")), F.lit(": "), F.col("word"), to, F.lit(" ["), F.col("kind"), F.lit("]"))
    return rows.join(F.broadcast(width)).withColumn("report_line", text).drop("location", "width")


def hints(findings: DataFrame) -> DataFrame:
    """(kind, doc_id, offset, hint): the first finding of each kind, after which its hint is printed."""
    at = F.min(F.struct("doc_id", "offset")).alias("at")
    hint = F.concat(F.lit("see the description of rule "), F.col("kind"))
    return findings.groupBy("kind").agg(at).select("kind", "at.doc_id", "at.offset", hint.alias("hint"))


def triage(collected: DataFrame, kind: str | None = None, least: int = 1, most: int | None = None) -> DataFrame:
    """Collected words of a kind that occur at least ``least`` times, the most frequent first."""
    rows = collected.where(F.col("count") >= least)
    rows = rows if kind is None else rows.where(F.col("kind") == kind)
    rows = rows.orderBy(F.desc("count"), "word")
    return rows if most is None else rows.limit(most)


def decide(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Adds action (fix, allow or open) and choice from a table (word, kind, action, choice) of decisions, of
    which each (word, kind) has one."""
    own = decisions.select(F.lower("word").alias("k"), F.col("kind").alias("k_kind"), "action", "choice")
    joined = findings.join(own, (F.lower(findings["word"]) == own["k"]) & (findings["kind"] == own["k_kind"]), "left")
    return joined.drop("k", "k_kind").withColumn("action", F.coalesce("action", F.lit("open")))


def capped(findings: DataFrame, most: int = 1000) -> DataFrame:
    """An editor's diagnostics: the first ``most`` findings of each document."""
    w = Window.partitionBy("doc_id").orderBy("offset", "phase")
    return findings.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k")


def same_target(findings: DataFrame) -> DataFrame:
    """(doc_id, kind, word, target, n, first_offset): what one "normalise every" action would change."""
    rows = findings.where(F.size("suggestions") > 0).withColumn("target", F.col("suggestions")[0])
    return rows.groupBy("doc_id", "kind", "word", "target").agg(F.count("*").alias("n"), F.min("offset").alias("first_offset"))


BIN = 4096  # bytes of a document whose findings meet the ranges that are asked there


def in_ranges(findings: DataFrame, ranges: DataFrame, most: int = 3, size: int = BIN) -> DataFrame:
    """(request_id, place, the findings' columns): the first ``most`` findings of a document that touch a range of it, for ranges
    (request_id, doc_id, start, end) in bytes, both ends included; place counts from 1 in order of position, then phase.

    Documents are cut into bins of ``size`` bytes, and rows meet by document and bin.  In a range's first bin it meets all findings
    that reach into the bin; in each later one findings that begin there touch it if they begin before its end, so it meets the first
    ``most`` of them only.  No pair is met twice, and a range over a whole document meets a few findings a bin.  Ranges are clipped to the end of the
    document's findings.  Null bounds and ranges that end before they start touch nothing; equal ranges have rows of their own if their
    ids differ."""
    order = ("offset", "phase", "len", "word")
    first = F.floor(F.col("offset") / size)
    last = F.floor((F.col("offset") + F.col("len")) / size)
    begins = Window.partitionBy("doc_id", "bin").orderBy(F.col("bin") != F.col("own"), *order)
    rows = findings.withColumn("own", first).withColumn("bin", F.explode(F.sequence(first, last))).withColumn("k", F.row_number().over(begins))
    till = findings.groupBy("doc_id").agg(F.max(F.col("offset") + F.col("len")).alias("till"))
    asked = ranges.where("start <= end").select("request_id", "doc_id", F.greatest("start", F.lit(0)).alias("start"), "end").join(till.hint("merge"), "doc_id").where("start <= till")
    asked = asked.withColumn("from_bin", F.floor(F.col("start") / size))
    asked = asked.withColumn("bin", F.explode(F.sequence("from_bin", F.greatest("from_bin", F.floor(F.least("end", "till") / size)))))
    here = F.when(F.col("bin") == F.col("from_bin"), F.col("offset") + F.col("len") >= F.col("start")).otherwise((F.col("bin") == F.col("own")) & (F.col("k") <= most))
    met = rows.join(asked.hint("merge"), ["doc_id", "bin"]).where(here & (F.col("offset") <= F.col("end")))
    w = Window.partitionBy("request_id").orderBy(*order)
    return met.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("request_id", "place", *findings.columns)


def range_actions(findings: DataFrame, ranges: DataFrame, most: int = 3, suggestions: int = 5) -> DataFrame:
    """(request_id, place, doc_id, offset, len, action, n, word, new_text, preferred, edits): what an editor offers for ranges of documents.

    For each finding of ``in_ranges``: change to each of its first ``suggestions`` (n counts them; the only one is preferred), normalise
    all equal variants of the document (``edits`` tells how many), add the word to the project's or all projects' words or ignore it,
    add it as a correction, and switch its line or file off.  fix-all (place 0) is offered where the document of a range has a safe fix,
    whether a finding touches the range or not."""
    safe = findings.where(safe_fix(F.col("kind"), F.col("suggestions")).isNotNull()).groupBy("doc_id").agg(F.count("*").alias("edits"))
    same = same_target(findings.where("kind = 'ja-variant'")).select("doc_id", "kind", "word", F.col("target").alias("to"), F.col("n").alias("same"))
    found = in_ranges(findings, ranges, most).withColumn("to", F.try_element_at("suggestions", F.lit(1)))
    found = found.join(same.hint("merge"), ["doc_id", "kind", "word", "to"], "left")
    none = F.lit(None).cast("string")

    def action(name: str, to: Column = none, n: Column | int = 1, preferred: Column | bool = False, edits: Column | int = 1) -> Column:
        as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(F.lit(name).alias("action"), as_column(n).cast("int").alias("n"), to.alias("new_text"), as_column(preferred).alias("preferred"), as_column(edits).cast("long").alias("edits"))

    only = F.size("suggestions") == 1
    changes = F.transform(F.slice("suggestions", F.lit(1), F.lit(suggestions)), lambda x, i: action("change", x, i + 1, only & (i == 0)))
    named = F.col("kind").isin("typo", "unknown-word", "ja-variant")
    some = [
        F.when(F.col("same").isNotNull(), action("normalise", F.col("to"), edits=F.col("same"))),
        *[F.when(named, action(name, edits=0)) for name in ("add-project", "add-global", "ignore")],
        F.when(F.col("to").isNotNull(), action("add-correction", F.col("to"), edits=0)),
        action("ignore-file"),
        action("ignore-line"),
    ]
    offered = F.concat(changes, F.filter(F.array(*some), lambda x: x.isNotNull()))
    rows = found.select("request_id", "place", "doc_id", "offset", "len", "word", F.explode(offered).alias("a"))
    rows = rows.select("request_id", "place", "doc_id", "offset", "len", "a.action", "a.n", "word", "a.new_text", "a.preferred", "a.edits")
    whole = ranges.join(safe.hint("merge"), "doc_id").select("request_id", F.lit(0).alias("place"), "doc_id", F.lit(None).cast("long").alias("offset"), F.lit(None).cast("long").alias("len"), F.lit("fix-all").alias("action"), F.lit(1).alias("n"), none.alias("word"), none.alias("new_text"), F.lit(False).alias("preferred"), "edits")
    return rows.unionByName(whole)


def span_valid(text: Column, offset: Column, word: Column) -> Column:
    """Whether ``word`` stands at byte ``offset`` of the text, within its bounds and between characters."""
    w = byte_view(word)
    return (offset >= 0) & (F.substring(byte_view(text), (offset + 1).cast("int"), F.length(w)) == w)


def position(text: Column, offset: Column) -> Column:
    """struct(line, col): 1-based line and 0-based byte column of a byte offset."""
    before = F.split(F.substring(byte_view(text), F.lit(1), offset.cast("int")), "\n", -1)
    return F.struct(F.size(before).alias("line"), F.length(F.element_at(before, -1)).cast("long").alias("col"))


def _lines(text: Column) -> Column:
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return breaks + F.when((text == "") | F.endswith(text, F.lit("\n")), 0).otherwise(1)


def _marked(text: Column, mark: str) -> Column:
    whole = F.endswith(text, F.lit("\n"))
    body = F.when(whole, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    end = F.when(whole, "\n").otherwise("\n\\ No newline at end of file\n")
    return F.when(text == "", "").otherwise(F.concat(F.lit(mark), F.replace(body, F.lit("\n"), F.lit("\n" + mark)), end))


def unified_diff(path: Column, old: Column, new: Column) -> Column:
    """The whole file as one hunk."""
    head = F.concat(F.lit("--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -1,"), _lines(old), F.lit(" +1,"), _lines(new), F.lit(" @@\n"))
    return F.concat(head, _marked(old, "-"), _marked(new, "+"))


def writable(proposed: DataFrame, current: DataFrame) -> DataFrame:
    """Proposed texts (path, seen_sha256, ..) whose file still has the content that was checked."""
    return proposed.join(current.select("path", F.col("content_sha256").alias("seen_sha256")), ["path", "seen_sha256"], "left_semi")

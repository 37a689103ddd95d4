"""Lines with byte offsets, and the directives that switch checks off."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import byte_view

DIRECTIVE = "glyphmill:"


CHUNK = 256  # elements


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often and in whatever lambdas ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running(parts: Column, size: Callable[[Column], Column]) -> Column:
    """For each element of an array the sum of the sizes before it: in chunks of ``CHUNK`` (or of the root of the number of
    elements, if that is more), each from its chunk's start, as a fold that appends to an array copies it each time."""
    return bound(parts, lambda p: _running(p, F.greatest(F.lit(CHUNK), F.ceil(F.sqrt(F.size(p))).cast("int")), size))


def _running(parts: Column, chunk: Column, size: Callable[[Column], Column]) -> Column:
    first = lambda n: F.array(n.cast("long"))
    add = lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / chunk).cast("int")), lambda c: F.slice(parts, c * chunk + 1, chunk))
    within = lambda c, start: F.slice(F.aggregate(c, first(start), lambda acc, x: add(acc, size(x))), F.lit(1), F.size(c))

    def summed(chunks: Column) -> Column:
        sizes = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + size(x)))
        return F.flatten(F.zip_with(chunks, F.slice(F.aggregate(sizes, first(F.lit(0)), add), F.lit(1), F.size(chunks)), within))

    return bound(cut, summed)


def line_starts(parts: Column) -> Column:
    """The byte offset of each line of an array of lines in byte view."""
    return running(parts, lambda x: F.length(x) + 1)


def lines(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, line, line_offset, b): lines in byte view with their offset; no shuffle.

    Null text has no lines."""
    b = byte_view(F.col(text))
    parts = docs.select("doc_id", *keep, F.split(b, "\n", -1).alias("parts"))
    zipped = parts.select("doc_id", *keep, F.posexplode(F.arrays_zip(F.col("parts").alias("b"), line_starts(F.col("parts")).alias("o"))).alias("k", "z"))
    return zipped.select("doc_id", *keep, (F.col("k") + 1).cast("int").alias("line"), F.col("z.o").alias("line_offset"), F.rtrim(F.col("z.b"), F.lit("\r")).alias("b"))


def directive(line: Column, prefix: str = DIRECTIVE) -> Column:
    """The first directive of a line: 'next', 'line' or null; only the first prefix on a line counts."""
    rest = F.when(F.instr(line, prefix) > 0, F.substring(line, F.instr(line, F.lit(prefix)) + len(prefix), F.lit(64)))
    return F.when(rest.startswith("ignore-next-line"), "next").when(rest.startswith("ignore-line"), "line")


def skipped_of(b: Column, prefix: str = DIRECTIVE) -> Column:
    """The numbers of a text's lines without checks.  A line with next is skipped with the one after it, whose own
    directive is then inert: in a run of consecutive next lines every other one is live."""
    cut = F.transform(F.split(b, "\n", -1), lambda x, i: F.when(F.contains(x, F.lit(prefix)), F.struct((i + 1).alias("line"), directive(F.rtrim(x, F.lit("\r")), prefix).alias("d"))))
    first = F.array().cast("array<int>")

    def skips(marked: Column) -> Column:
        of = lambda kind: F.transform(F.filter(marked, lambda m: m["d"] == kind), lambda m: m["line"])
        live = F.aggregate(of("next"), first, lambda acc, i: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) == i - 1), acc).otherwise(F.concat(acc, F.array(i))))
        return bound(live, lambda x: F.array_distinct(F.concat(x, F.transform(x, lambda i: i + 1), of("line"))))

    return F.when(F.contains(b, F.lit(prefix)), bound(F.filter(cut, lambda m: m.isNotNull()), skips)).otherwise(first)


def skipped_lines(some_lines: DataFrame, prefix: str = DIRECTIVE) -> DataFrame:
    """(doc_id, line) of lines without checks.  A line with next is skipped with the one after it, whose own
    directive is then inert: in a run of consecutive next lines every other one is live."""
    marked = some_lines.select("doc_id", "line", directive(F.col("b"), prefix).alias("d"))
    own = marked.where("d is not null")
    w = Window.partitionBy("doc_id").orderBy("line")
    ends = own.where("d = 'next'").withColumn("run", F.col("line") - F.row_number().over(w))
    live = ends.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("line"))).where("k % 2 = 1")
    return live.select("doc_id", F.explode(F.array("line", F.col("line") + 1)).alias("line")).unionByName(own.select("doc_id", "line")).distinct()


def without_ignored_files(docs: DataFrame, prefix: str = DIRECTIVE) -> DataFrame:
    return docs.where(~F.coalesce(F.col("text").contains(prefix + "ignore-file"), F.lit(False)))

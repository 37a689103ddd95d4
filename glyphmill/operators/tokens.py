"""Identifier-aware words: delimited tokens, token filters, letter runs, run filters, case parts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import byte_view
from .lines import running

DELIMITERS = " \\t\\n\\f\\r\"`()\\[\\]{}<>,;\\x80-\\xFF"
TOKEN_PARTS = f"[^{DELIMITERS}]+|[{DELIMITERS}]+"
RUN_PARTS = "\\\\?[A-Za-z][A-Za-z']*|[^A-Za-z\\\\]+|\\\\"
CASE_CUT = "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
SEGMENT = 2048  # bytes; what is found in a line looks for its column in a part of about that size


@dataclass(frozen=True)
class Options:
    min_word_length: int = 3
    max_token_length: int = 40


def is_link(token: Column) -> Column:
    """URLs and mail addresses."""
    return token.contains("://") | (token.contains("@") & token.rlike("[0-9A-Za-z].*@.*\\."))


def is_junk(token: Column, longest: int = 40) -> Column:
    """Long tokens with digits, hexadecimal numbers and digests, base64-like strings."""
    alnum = F.regexp_replace(token, "[^0-9A-Za-z]", "")
    digits = F.length(F.regexp_replace(token, "[^0-9]", ""))
    flips = F.regexp_count(token, F.lit("(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"))
    # each of the four cases has a digit, which spares most tokens the rest
    return token.rlike("[0-9]") & (
        ((F.length(token) > longest) & (digits > 0))
        | token.rlike("^0[xX][0-9A-Fa-f_ui]+$")
        | ((F.length(alnum) >= 12) & (digits > 0) & alnum.rlike("^[0-9A-Fa-f]*$"))
        | ((F.length(alnum) >= 16) & (digits >= 3) & (flips >= 4))
    )


def is_plural_acronym(run: Column) -> Column:
    return run.rlike("^[A-Z]{2,}s$")


def bare(run: Column) -> Column:
    """Without quotes and a possessive at its end."""
    return F.when(run.contains("'"), F.regexp_replace(F.regexp_replace(run, "'+$", ""), "(?<=.)'[sS]$", "")).otherwise(run)


def _placed(parts: Column) -> Column:
    """Parts of a text with the position of each."""
    return F.arrays_zip(parts.alias("text"), running(parts, F.length).alias("at"))


def _unplaced(parts: Column) -> Column:
    """Parts of a short text, whose positions are looked up when they are needed."""
    return F.transform(parts, lambda x: F.struct(x.alias("text"), F.lit(None).cast("long").alias("at")))


def _alone(text: Column) -> Column:
    return F.array(F.struct(text.alias("text"), F.lit(0).cast("long").alias("at")))


def segments(lines: DataFrame) -> DataFrame:
    """The lines with ``at``, long ones as several rows: parts of ``SEGMENT`` bytes and the rest of the token at their end, so
    that no row of a token carries more of its line than that."""
    rest = [c for c in lines.columns if c != "b"]
    parts = _placed(F.regexp_extract_all("b", F.lit(f"[\\s\\S]{{1,{SEGMENT}}}[^{DELIMITERS}]*+"), F.lit(0)))
    z = F.when(F.length("b") <= SEGMENT, _alone(F.col("b"))).otherwise(parts)
    return lines.select(*rest, F.explode(z).alias("z")).select(*rest, F.col("z.text").alias("b"), F.col("z.at").alias("at"))


def token_rows(lines: DataFrame) -> DataFrame:
    """(.., at, t, token) for each delimited token; t is its index among the parts of ``b``, which begins at ``at`` in its line."""
    cut = segments(lines)
    keep = cut.columns
    # delimiters alternate with tokens; one in front of all tokens leaves an empty token before it.  It is asked for once for all tokens of a row
    cut = cut.select("*", F.when(F.col("b").rlike(f"^[{DELIMITERS}]"), 1).otherwise(0).alias("lead"))
    parts = cut.select(*keep, "lead", F.posexplode(F.split("b", f"[{DELIMITERS}]+")).alias("k", "token")).where("token <> ''")
    return parts.select(*keep, (2 * F.col("k") - F.col("lead")).alias("t"), "token")


def words_of(token: Column, options: Options = Options()) -> Column:
    """The words of a token as an array, without positions: what ``words`` finds in it."""
    none = F.array().cast("array<string>")
    runs = F.filter(F.regexp_extract_all(token, F.lit(RUN_PARTS), F.lit(0)), lambda x: x.rlike("^[A-Za-z]"))
    runs = F.filter(F.transform(runs, bare), lambda x: ~is_plural_acronym(x))
    # most tokens are one word, perhaps with marks around it, which make no link and no number
    marks = "[^A-Za-z0-9'\\\\@/]*+"
    one = f"^{marks}([A-Za-z][a-z]{{{max(0, options.min_word_length - 1)},}}+){marks}$"
    some = F.filter(F.flatten(F.transform(runs, lambda x: F.split(x, CASE_CUT))), lambda x: F.length(x) >= options.min_word_length)
    return (
        F.when(F.length(token) < options.min_word_length, none)
        .when(token.rlike("^[A-Za-z][a-z]*+$"), F.array(token))
        .when(token.rlike(one), F.array(F.regexp_extract(token, one, 1)))
        .when(token.rlike("[A-Za-z]") & ~is_link(token) & ~is_junk(token, options.max_token_length), some)
        .otherwise(none)
    )


def document_words(docs: DataFrame, text: str = "text", options: Options = Options()) -> DataFrame:
    """(doc_id, word): the distinct lower-case words of each document, without a shuffle where no id occurs twice.

    A token is delimited by line ends too, so texts are not cut into lines; each of a text's distinct tokens is cut into words once."""
    distinct = F.array_distinct(F.split(byte_view(F.col(text)), f"[{DELIMITERS}]+"))
    every = F.array_distinct(F.transform(F.flatten(F.transform(distinct, lambda x: words_of(x, options))), F.lower))
    rows = docs.select("doc_id", F.explode(every).alias("word"))
    return rows if docs.groupBy("doc_id").count().where("count > 1").isEmpty() else rows.distinct()


def words(lines: DataFrame, options: Options = Options()) -> DataFrame:
    """(lines' columns, at, t, token, r, r_at, run, c, c_at, word): the words that are looked up.

    Positions within long tokens and runs are carried with their parts, and the token itself is not."""
    return cut(token_rows(lines), options)


def cut(tokens: DataFrame, options: Options = Options()) -> DataFrame:
    """``words`` of rows of ``token_rows``."""
    long = F.length("token") > SEGMENT
    own = [c for c in tokens.columns if c not in ("at", "b", "token")]
    start = _before(F.regexp_extract_all("b", F.lit(TOKEN_PARTS), F.lit(0)), F.col("t"))
    tokens = tokens.select(*own, F.when(long, F.col("at") + start).otherwise(F.col("at")).alias("at"), F.when(~long, F.col("b")).alias("b"), "token")
    # most tokens are one run of lower-case letters, which nothing below changes
    # and tokens that are left out have no runs: a filter on them would be asked before what the rows were filtered by
    out = ~F.col("token").rlike("[A-Za-z]") | is_link(F.col("token")) | is_junk(F.col("token"), options.max_token_length)
    parts = F.regexp_extract_all("token", F.lit(RUN_PARTS), F.lit(0))
    none = F.array().cast("array<struct<text:string,at:bigint>>")
    parts = F.when(F.col("token").rlike("^[a-z]++$"), _alone(F.col("token"))).when(out, none).when(long, _placed(parts)).otherwise(_unplaced(parts))
    runs = tokens.select(*own, "at", "b", F.when(~long, F.col("token")).alias("short_token"), F.posexplode(parts).alias("r", "z"))
    runs = runs.select(*own, "at", "b", F.col("short_token").alias("token"), "r", F.col("z.at").alias("r_at"), F.col("z.text").alias("run")).where(F.col("run").rlike("^[A-Za-z]"))
    run = bare(F.col("run"))
    lower = F.col("run").rlike("^[a-z]++$")
    runs = runs.withColumn("run", F.when(lower, F.col("run")).otherwise(run)).where(lower | ~is_plural_acronym(F.col("run")))
    long_run = F.length("run") > SEGMENT
    cased = F.split("run", CASE_CUT)
    cased = F.when(~F.col("run").rlike("[a-z][A-Z]|[A-Z][A-Z][a-z]"), _alone(F.col("run"))).when(long_run, _placed(cased)).otherwise(_unplaced(cased))
    keep = [*own, "at", "b", "token", "r", "r_at"]
    cased_rows = runs.select(*keep, F.when(~long_run, F.col("run")).alias("short_run"), F.posexplode(cased).alias("c", "z"))
    return cased_rows.select(*keep, F.col("short_run").alias("run"), "c", F.col("z.at").alias("c_at"), F.col("z.text").alias("word")).where(F.length("word") >= options.min_word_length)


def _before(parts: Column, n: Column) -> Column:
    return F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0).cast("long"), lambda a, x: a + F.length(x))


def word_column() -> Column:
    """Byte column of a row of ``words`` in its line; evaluate it only on rows that are findings.

    It looks at the word's part of the line, token and run, each of about ``SEGMENT`` bytes at most."""
    in_line = F.when(F.col("b").isNull(), 0).otherwise(_before(F.regexp_extract_all("b", F.lit(TOKEN_PARTS), F.lit(0)), F.col("t")))
    in_token = F.coalesce("r_at", _before(F.regexp_extract_all("token", F.lit(RUN_PARTS), F.lit(0)), F.col("r")))
    in_run = F.coalesce("c_at", _before(F.split("run", CASE_CUT), F.col("c")))
    return F.col("at") + in_line + in_token + in_run

"""One check of documents: masks, directives, overrides by path, every kind of finding, the allow set, order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import byte_view
from ..sources.files import glob_regex
from ..sources.staging import staged
from . import english, findings, japanese, lines, masking
from .tokens import Options


@dataclass(frozen=True)
class Override:
    """Settings for paths that match a glob; None leaves a setting as it is."""

    glob: str
    mode: str | None = None
    profile: str | None = None
    japanese: bool | None = None


@dataclass(frozen=True)
class Config:
    mode: str = "corrections"  # off, corrections or dictionary
    profile: str = "all"  # auto, prose, source or all
    japanese: bool = True
    locale: str | None = None  # en-US or en-GB
    katakana: str = "consistency"  # of one document; or long, short, off
    space: str = "code"  # always, never or code
    fullwidth: bool = True  # the switches of single Japanese checks
    halfwidth: bool = True
    compatibility: bool = True
    kanji: bool = True
    numbers: bool = True
    punctuation: bool = True
    variants: tuple[tuple[str, str], ...] = ()  # (katakana word, preferred)
    rules: tuple[tuple[str, str], ...] = ()  # (regular expression, replacement)
    overrides: tuple[Override, ...] = ()
    options: Options = Options()
    prefix: str = lines.DIRECTIVE


def effective(docs: DataFrame, config: Config) -> DataFrame:
    """Adds mode, profile, ja and prose.  The last override that sets a field decides; none can switch Japanese checks
    on where they are off for all."""

    def pick(field: str, base: Column) -> Column:
        some = [(o.glob, getattr(o, field)) for o in reversed(config.overrides) if getattr(o, field) is not None]
        return F.coalesce(*[F.when(F.col("path").rlike(glob_regex(g)), F.lit(v)) for g, v in some], base)

    ja = pick("japanese", F.lit(True)) if config.japanese else F.lit(False)
    return docs.select("*", pick("mode", F.lit(config.mode)).alias("mode"), pick("profile", F.lit(config.profile)).alias("profile"), ja.alias("ja"), masking.is_prose(F.col("path")).alias("prose"))


def switched_off(config: Config) -> tuple[str, ...]:
    """The names of Japanese checks that the settings leave out."""
    return tuple(n for n in ("fullwidth", "halfwidth", "compatibility", "kanji", "numbers", "punctuation") if not getattr(config, n))


def checked_lines(docs: DataFrame, config: Config) -> DataFrame:
    """(doc_id, mode, ja, prose, skip, line, line_offset, b): lines of the masked texts that are checked at all.

    ``skip`` is for lines that a directive takes out; checks of a whole document still see them."""
    d = effective(docs, config).where("text is not null and (mode <> 'off' or ja)")
    d = lines.without_ignored_files(d, config.prefix)
    fixed = config.profile == "all" and not any(o.profile for o in config.overrides)
    text = F.col("text") if fixed else masking.mask(F.col("text"), F.col("path"), F.col("profile"))
    d = d.select("doc_id", "mode", "ja", "prose", text.alias("masked"))
    d = d.withColumn("skips", lines.skipped_of(byte_view(F.col("masked")), config.prefix))
    rows = lines.lines(d, "masked", ("mode", "ja", "prose", "skips"))
    # with a default, as the planner would ask all that makes ``skips`` whether it is null, in filters of their own
    skip = F.coalesce(F.array_contains("skips", F.col("line")), F.lit(False))
    return rows.select("doc_id", "mode", "ja", "prose", skip.alias("skip"), "line", "line_offset", "b")


def check(docs: DataFrame, config: Config, fixes: DataFrame, allow: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Findings (doc_id, line, col, offset, len, word, kind, suggestions, phase) of documents (doc_id, path, text).

    ``fixes`` (typo, fixes, allow) are the corrections, ``allow`` (word) is never reported in any kind, ``known`` (word) is the
    word list of dictionary mode.  Null texts have no findings.  In a document findings are in order of offset, then
    phase: English words 0, rules 1, characters and variants of a line 2, then what differs within the document:
    katakana 3 (in the style consistency only), kanji 4, numbers 5, punctuation 6.  In dictionary mode the lines are written when
    this is called, then the distinct unknown words are worked out, in jobs of their own, and then the findings of each pass over the lines, in others:
    what is done with findings reads them, however often, and the driver never plans all passes in one job, nor what makes the lines more than once.
    """
    spark = docs.sparkSession
    rows = checked_lines(docs, config)
    if known is not None:
        rows = staged(rows, "checked-lines")
    parts = []
    if config.mode != "off" or any(o.mode not in (None, "off") for o in config.overrides):
        locale = english.locale_table(spark, config.locale) if config.locale else None
        english_rows = rows.where("mode <> 'off' and not skip")
        parts.append((0, english.english(english_rows, fixes, allow, locale, known, config.options, F.col("mode") == "dictionary")))
    if config.japanese:
        table = dict([*japanese.katakana_pairs(config.katakana), *config.variants])
        many = len(config.rules) > japanese.IN_PLAN
        if many:
            parts.append((1, japanese.indexed_rules(rows.where("ja and not skip"), list(config.rules))))
        parts.append((None, japanese.document_findings(rows.where("ja"), table, config.space, () if many else config.rules, config.katakana == "consistency", switched_off(config))))
    if known is not None:
        parts = [(phase, staged(p.select(*findings.COLUMNS, *(["phase"] if phase is None else [])), "findings")) for phase, p in parts]
    return findings.united(spark, parts, allow)


def ordered(found: DataFrame) -> DataFrame:
    """Findings in the order in which they are reported."""
    return found.orderBy("doc_id", "offset", "phase", "len", "word")

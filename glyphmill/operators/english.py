"""English verdicts: allow set, corrections, regional spellings, unknown words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import match_case
from ..sources.staging import staged
from .suggest import suggestion_lists
from .tokens import Options, cut, token_rows, word_column, words, words_of

# Words that a built-in correction table must not touch.
BUILTIN_ALLOW = ("ser", "flate", "referer")

# American and British spellings.
LOCALE_PAIRS = [
    ("analyze", "analyse"),
    ("analyzed", "analysed"),
    ("analyzing", "analysing"),
    ("apologize", "apologise"),
    ("behavior", "behaviour"),
    ("catalog", "catalogue"),
    ("center", "centre"),
    ("color", "colour"),
    ("defense", "defence"),
    ("dialog", "dialogue"),
    ("favor", "favour"),
    ("favorite", "favourite"),
    ("fiber", "fibre"),
    ("fulfill", "fulfil"),
    ("gray", "grey"),
    ("honor", "honour"),
    ("initialize", "initialise"),
    ("initialized", "initialised"),
    ("initializing", "initialising"),
    ("liter", "litre"),
    ("modeling", "modelling"),
    ("neighbor", "neighbour"),
    ("organization", "organisation"),
    ("organize", "organise"),
    ("organized", "organised"),
    ("organizing", "organising"),
    ("paralyze", "paralyse"),
    ("realize", "realise"),
    ("realized", "realised"),
    ("recognize", "recognise"),
    ("theater", "theatre"),
    ("traveled", "travelled"),
    ("traveler", "traveller"),
]


def corrections(spark: SparkSession, rows: list[tuple[str, str, int]]) -> DataFrame:
    """(typo, fixes, allow) from (typo, comma-separated fixes, priority): the highest priority, then the last
    row of a typo wins; a single fix that is the typo itself means the word is allowed."""
    df = spark.createDataFrame([(t, f, p, i) for i, (t, f, p) in enumerate(rows)], "typo string, fix string, priority int, seq int")
    return layered(df)


def layered(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("typo").orderBy(F.desc("priority"), F.desc("seq"))
    fixes = F.filter(F.transform(F.split("fix", ","), lambda x: F.trim(x)), lambda x: x != "")
    top = df.withColumn("typo", F.lower(F.trim("typo"))).withColumn("k", F.row_number().over(w)).where("k = 1")
    top = top.select("typo", fixes.alias("fixes"))
    return top.select("typo", "fixes", ((F.size("fixes") == 1) & (F.lower(F.col("fixes")[0]) == F.col("typo"))).alias("allow"))


def locale_table(spark: SparkSession, locale: str, pairs: list[tuple[str, str]] = LOCALE_PAIRS) -> DataFrame:
    """(variant, preferred) for en-US or en-GB; any other locale has no variants."""
    rows = {"en-US": [(gb, us) for us, gb in pairs], "en-GB": pairs}.get(locale, [])
    return spark.createDataFrame(rows, "variant string, preferred string")


def verdicts(fixes: DataFrame, allow: DataFrame, locale: DataFrame | None = None) -> DataFrame:
    """(key, kind, suggestions): what the rule tables say of each lower-case word; rules go before regional spellings, and
    words that are allowed by either table are never reported."""
    none = allow.select(F.lower("word").alias("key"))
    out = fixes.where("not allow").select(F.col("typo").alias("key"), F.lit("typo").alias("kind"), F.col("fixes").alias("suggestions"))
    if locale is not None:
        own = locale.select(F.col("variant").alias("key"), F.lit("en-variant").alias("kind"), F.array("preferred").alias("suggestions"))
        out = out.unionByName(own.join(fixes.select(F.col("typo").alias("key")), "key", "left_anti"))
    return out.join(none, "key", "left_anti")


def unknown(keys: DataFrame, known: DataFrame, fixes: DataFrame, allow: DataFrame, locale: DataFrame | None = None, most: int = 4) -> DataFrame:
    """(key, kind, suggestions) of the distinct ``keys`` (key) that no list and no rule has, with the nearest known words.

    It is worked out once for each word and not for each occurrence, and written, as are the known words, which are asked twice.  The known
    words grow with the corpus and are sorted: by the size of their compressed file the planner would broadcast some ten times as much."""
    known = staged(known.select("word"), "known-words")
    for table, name in ((known, "word"), (allow, "word"), (fixes, "typo"), *([(locale, "variant")] if locale is not None else [])):
        listed = table.select((F.lower(name) if table is allow else F.col(name)).alias("key"))
        keys = keys.join(listed.hint("merge") if table is known else listed, "key", "left_anti")
    keys = staged(keys, "unknown-words")
    lists = suggestion_lists(keys.select(F.col("key").alias("word")), known, most)
    return staged(lists.select(F.col("word").alias("key"), F.lit("unknown-word").alias("kind"), "suggestions"), "suggestions")


SLOT = 1 << 10  # longs of 64 bits in a row of a filter


def may_have(rows: DataFrame, keys: DataFrame, most: int = 1 << 26, name: str = "key") -> DataFrame:
    """The rows whose ``name`` may be one of ``keys``: all that are, and few others.

    Each of the keys sets two bits by its hash, both in one row of the filter.  They get 16 bits each, but no more than ``most`` (8 MB) in all, so what is
    broadcast does not grow with a long list; only more of the other rows stay."""
    slots = 1 << (min(most, max(1, 16 * keys.count())) - 1).bit_length()
    slots = max(1, slots // (64 * SLOT))
    h = F.xxhash64(name)
    part = lambda shift, size: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(size - 1).cast("long"))
    slot, places = part(32, slots), [(part(6 + 16 * i, SLOT), part(16 * i, 64).cast("int")) for i in (0, 1)]
    places_of = F.explode(F.array(*[F.struct(at.alias("at"), bit.alias("bit")) for at, bit in places]))
    some = keys.select(F.col(name)).select(slot.alias("slot"), places_of.alias("p")).select("slot", "p.at", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p.bit")).alias("long"))
    none = keys.sparkSession.range(slots * SLOT).select(F.shiftright("id", SLOT.bit_length() - 1).alias("slot"), F.col("id").bitwiseAND(F.lit(SLOT - 1).cast("long")).alias("at"), F.lit(0).cast("long").alias("long"))
    longs = some.unionByName(none).groupBy("slot", "at").agg(F.bit_or("long").alias("long"))
    table = longs.groupBy("slot").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "long"))), lambda x: x["long"]).alias("bits"))
    table = staged(table, "filter")  # else each of its steps has the plan of the rows made anew
    is_set = lambda at, bit: F.call_function("shiftrightunsigned", F.get("bits", at.cast("int")), bit).bitwiseAND(F.lit(1).cast("long")) == 1
    return rows.join(F.broadcast(table), (slot == F.col("slot")) & is_set(*places[0]) & is_set(*places[1]), "left_semi")


def english(lines: DataFrame, fixes: DataFrame, allow: DataFrame, locale: DataFrame | None = None, known: DataFrame | None = None, options: Options = Options(), dictionary: Column | None = None) -> DataFrame:
    """Findings (doc_id, line, col, offset, len, word, kind, suggestions) of English words.

    The first that applies decides: allow set, allowed or corrected by a rule, regional spelling, and with
    ``known`` (dictionary mode) not in any word list (four letters or more, not all capitals); ``dictionary`` says of which lines that is
    asked.  Unknown words carry up to four known ones that are near, in their letter case.

    Verdicts are made for distinct words and joined with the occurrences once.  Without ``known`` the planner broadcasts them by their size.  With it
    they may be many.  Then the distinct tokens are written first and cut into words once each; the lines are gone over once more, and only tokens that
    may have a word with a verdict are cut there and get their columns, before they are dealt out, so that no text of lines is.  The driver plans a job anew
    whenever a step of it ends, so all this is written before it is joined."""
    table = verdicts(fixes, allow, locale)
    own = ["doc_id", "line", "line_offset", "word", "key"]
    if known is not None:
        dictionary = F.lit(True) if dictionary is None else dictionary
        asked = (F.length("word") >= 4) & ~F.col("word").rlike("^[A-Z]+$")
        tokens = token_rows(lines).groupBy("token").agg(F.max(dictionary).alias("dictionary"))
        heard = tokens.select("token", "dictionary", F.explode(words_of(F.col("token"), options)).alias("word")).select("token", F.lower("word").alias("key"), (F.col("dictionary") & asked).alias("asked"))
        heard = staged(heard, "asked-words")
        table = table.unionByName(unknown(heard.where("asked").select("key").distinct(), known, fixes, allow, locale))
        marked = staged(heard.join(table.select("key").hint("merge"), "key", "left_semi").select("token").distinct(), "marked-tokens")
        some = cut(may_have(token_rows(lines), marked, name="token"), options).withColumn("key", F.lower("word"))
        some = staged(some.select(*own, (dictionary & asked).alias("asked"), word_column().alias("col")), "occurrences")
        found = some.join(table.hint("merge"), "key").where("kind <> 'unknown-word' or asked")
    else:
        rows = words(lines, options).withColumn("key", F.lower("word"))
        found = rows.join(table, "key").select(*own, "kind", "suggestions", word_column().alias("col"))
    cased = F.transform("suggestions", lambda x: match_case(F.col("word"), x))
    return found.select("doc_id", "line", "col", (F.col("line_offset") + F.col("col")).alias("offset"), F.length("word").cast("long").alias("len"), "word", "kind", cased.alias("suggestions"))

"""Spelling suggestions: nearest words of a list by edit distance.

Words are blocked by their deletion neighbourhoods (what is left after deleting up to d letters): two
words within distance d share one, so an equi-join of their hashes finds all pairs; the distance then verifies them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import byte_view


def _deleted(word: Column, depth: Column) -> Column:
    """Hashes of the distinct strings that deleting up to ``depth`` (one or two) characters leaves, the word itself among them."""
    n = F.length(word)
    cut = lambda a, b: F.substring(word, a, b - a)  # noqa: E731 - characters a to b - 1
    end = n + 1
    one = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(cut(F.lit(1), i), cut(i + 1, end)))
    two = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.sequence(i + 1, n), lambda j: F.concat(cut(F.lit(1), i), cut(i + 1, j), cut(j + 1, end)))))
    some = F.when((depth > 1) & (n > 1), F.concat(F.array(word), one, two)).when(n > 0, F.concat(F.array(word), one)).otherwise(F.array(word))
    return F.array_distinct(F.transform(some, lambda x: F.xxhash64(x)))


def suggest(queries: DataFrame, known: DataFrame, most: int = 4, longest: int = 24) -> DataFrame:
    """(word, rank, suggestion, distance): none for words over ``longest`` bytes; distance 1 up to six bytes, else 2;
    ranked by byte distance, difference of lengths, then alphabetically.

    Neighbourhoods are made in place and dealt out by their hashes.  The planner takes them to be as small as the words that they come
    from, some 50 times less than they are, so the join is told to sort: a broadcast of that of a large list does not fit the driver."""
    q = queries.select(F.lower("word").alias("word")).distinct().where(F.octet_length("word") <= longest)
    d = F.when(F.octet_length("word") <= 6, 1).otherwise(2)
    left = q.select("word", F.explode(_deleted(F.col("word"), d)).alias("left"))
    own = known.select(F.col("word").alias("suggestion")).distinct().where(F.length("suggestion") <= longest + 2)
    # a word at distance 2 is asked for by words of seven bytes or more
    depth = F.when(F.octet_length("suggestion") >= 5, 2).otherwise(1)
    right = own.select("suggestion", F.explode(_deleted(F.col("suggestion"), depth)).alias("left"))
    pairs = left.join(right.hint("merge"), "left").where(F.levenshtein("word", "suggestion", 2).between(0, d)).select("word", "suggestion").distinct()
    pairs = pairs.withColumn("distance", F.levenshtein(byte_view(F.col("word")), byte_view(F.col("suggestion"))))
    w = Window.partitionBy("word").orderBy("distance", F.abs(F.octet_length("word") - F.octet_length("suggestion")), "suggestion")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("word", "rank", "suggestion", "distance")


def suggestion_lists(queries: DataFrame, known: DataFrame, most: int = 4) -> DataFrame:
    """(word, suggestions) for every distinct word, the best first; an empty list where there is none."""
    ranked = suggest(queries, known, most).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("rank", "suggestion"))).alias("r"))
    each = queries.select(F.lower("word").alias("word")).distinct().join(ranked, "word", "left")
    return each.select("word", F.coalesce(F.transform("r", lambda x: x["suggestion"]), F.array().cast("array<string>")).alias("suggestions"))

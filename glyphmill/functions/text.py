"""Scalar functions over text columns; all are built-in Spark expressions.

Positions are bytes.  ``byte_view`` turns every UTF-8 byte of a string into one character, so that the
regular expressions and lengths of Spark work on bytes; ``from_bytes`` goes back."""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("typo", "unknown-word", "en-variant", "ja-variant", "fullwidth-alnum", "halfwidth-kana", "fullwidth-space", "ja-compatibility", "ja-number-style", "ja-punctuation")


def byte_view(text: Column) -> Column:
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def from_bytes(view: Column) -> Column:
    return F.decode(F.encode(view, "ISO-8859-1"), "UTF-8")


def mapping(table: dict[str, str]) -> Column:
    """A map of strings as one constant, however large it is."""
    return F.from_json(F.lit(json.dumps(table, ensure_ascii=False)), "map<string,string>")


def match_case(pattern: Column, word: Column) -> Column:
    """``word`` in the letter case of ``pattern``: all lower, ALL UPPER (two letters or more) or Capitalised."""
    letters = F.regexp_replace(pattern, "[^A-Za-z]", "")
    up = lambda c: F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return (
        F.when(letters.rlike("^[a-z]*$"), word)
        .when(letters.rlike("^[A-Z]{2,}$"), up(word))
        .when(letters.rlike("^[A-Z][a-z]*$"), F.concat(up(F.substring(word, 1, 1)), F.substring(word, 2, 2**31 - 1)))
        .otherwise(word)
    )


def safe_fix(kind: Column, suggestions: Column) -> Column:
    """The replacement that can be applied without asking, or null."""
    first = F.try_element_at(suggestions, F.lit(1))
    return F.when(kind == "unknown-word", F.lit(None)).when(kind == "typo", F.when(F.size(suggestions) == 1, first)).otherwise(first)


# Fixed value: white space by the Unicode property, as a class for regular expressions.
BLANK = "\\t-\\r \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(BLANKS))


# The templates of messages.
def message(kind: Column, word: Column, suggestions: Column) -> Column:
    first = F.coalesce(F.try_element_at(suggestions, F.lit(1)), F.lit("?"))
    w = F.concat(F.lit("`"), word, F.lit("`"))
    to = F.concat(F.lit("`"), first, F.lit("`"))
    return (
        F.when((kind == "typo") & (F.size(suggestions) == 1), F.concat(w, F.lit(" should be "), to))
        .when(kind == "typo", F.concat(w, F.lit(" should be one of: "), F.array_join(F.transform(suggestions, lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", ")))
        .when(kind == "unknown-word", F.concat(w, F.lit(" is not a known word")))
        .when(kind == "en-variant", F.concat(F.lit("regional spelling "), w, F.lit(" → "), to))
        .when(kind == "ja-variant", F.concat(w, F.lit(" は "), to, F.lit(" に統一 (表記ゆれ)")))
        .when(kind == "fullwidth-alnum", F.concat(F.lit("fullwidth alphanumerics "), w, F.lit(" → "), to))
        .when(kind == "halfwidth-kana", F.concat(F.lit("halfwidth katakana "), w, F.lit(" → "), to))
        .when(kind == "fullwidth-space", F.lit("fullwidth space (U+3000)"))
        .when(kind == "ja-compatibility", F.concat(F.lit("compatibility character "), w, F.lit(" → "), to))
        .when(kind == "ja-number-style", F.concat(w, F.lit(" は "), to, F.lit(" に統一 (数字表記)")))
        .when(kind == "ja-punctuation", F.concat(w, F.lit(" は "), to, F.lit(" に統一 (句読点)")))
    )


FULL_ALNUM = "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"
HALF_ALNUM = "".join(chr(ord(c) - 0xFEE0) for c in FULL_ALNUM)


def ascii_of_fullwidth(run: Column) -> Column:
    return F.translate(run, FULL_ALNUM, HALF_ALNUM)


# Halfwidth forms follow from compatibility normalisation; a sound mark alone becomes its spacing form, and
# marks compose only with kana that have a letter of their own in the standard katakana rows.
HALF_KANA = "".join(chr(c) for c in range(0xFF61, 0xFFA0))
FULL_KANA = "".join({"ﾞ": "゛", "ﾟ": "゜"}.get(c) or unicodedata.normalize("NFKC", c) for c in HALF_KANA)
KANA_PAIRS = [(c + m, p) for m in "ﾞﾟ" for c in HALF_KANA[:-2] if c not in "ﾜｦ" and len(p := unicodedata.normalize("NFKC", c + m)) == 1]


def full_of_halfwidth(run: Column) -> Column:
    for pair, one in KANA_PAIRS:
        run = F.replace(run, F.lit(pair), F.lit(one))
    return F.translate(run, HALF_KANA, FULL_KANA)


COMPATIBILITY = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in (*range(0x2100, 0x2150), *range(0x3300, 0x3400)) if unicodedata.normalize("NFKC", chr(c)) != chr(c)}


def compatibility_form(char: Column) -> Column:
    """The compatibility normal form of letter-like and squared characters, null for others."""
    return mapping(COMPATIBILITY)[char]


def display_column(line: Column, col: Column) -> Column:
    """1-based code point column of byte ``col`` of a line."""
    return F.char_length(from_bytes(F.substring(byte_view(line), F.lit(1), col.cast("int")))) + 1


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("long")


def github_escape(value: Column, prop: bool) -> Column:
    for a, b in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), *(((":", "%3A"), (",", "%2C")) if prop else ())):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def snippet(line: Column, most: int = 96) -> Column:
    t = trimmed(line)
    return F.when(F.char_length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t)

"""Length-preserving masks: what is not prose, or not comment and string, becomes blanks of the same
byte length.  Everything runs on the byte view."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import byte_view, from_bytes
from .lines import bound

# Extensions of markup, source code, languages with hash comments, and prose.
MARKUP = ("md", "markdown", "mdx")
SOURCE = ("c", "cc", "cpp", "cs", "css", "go", "h", "hpp", "java", "js", "jsx", "kt", "kts", "lua", "php", "py", "rb", "rs", "scala", "sh", "swift", "ts", "tsx", "vue")
HASHES = ("py", "rb", "sh", "php", "yaml", "yml", "toml")
PROSE = ("md", "markdown", "txt", "text", "rst", "adoc", "asciidoc", "tex", "org", "typ")


CHUNK = 256  # lines


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def profile(path: Column) -> Column:
    """'prose', 'source' or 'all'."""
    e = extension(path)
    return F.when(e.isin(*MARKUP), "prose").when(e.isin(*SOURCE), "source").otherwise("all")


def is_prose(path: Column) -> Column:
    return extension(path).isin(*PROSE)


def blanked(b: Column) -> Column:
    """Blanks of the same byte lengths: space, U+00A0, U+2003, U+10000 for characters of one to four bytes."""
    for lead, to in (("[\\xC2-\\xDF][\\x80-\\xBF]", " "), ("[\\xE0-\\xEF][\\x80-\\xBF]{2}", " "), ("[\\xF0-\\xF4][\\x80-\\xBF]{3}", "\U00010000")):
        b = F.regexp_replace(b, lead, "\x01" + to.encode().decode("latin-1"))
    b = F.regexp_replace(b, "(?<!\\x01)(?<!\\x01[\\xC2\\xE2\\xF0])(?<!\\x01[\\xE2\\xF0][\\x80-\\xBF])[\\x02-\\x09\\x0B\\x0C\\x0E-\\x7F]", " ")
    return F.replace(b, F.lit("\x01"), F.lit(""))


def mask_source_view(b: Column, hashes: Column) -> Column:
    """Keeps comments and strings of source code."""
    quotes = [f"{q}[^{q}\\\\]*+(?:\\\\.[^{q}\\\\]*+)*+(?:{q}|\\\\?\\z)" for q in "\"'`"]
    body = '|"""[\\s\\S]*?(?:"""|\\z)|\'\'\'[\\s\\S]*?(?:\'\'\'|\\z)|' + "|".join(quotes)

    def cut(with_hash: bool) -> Column:
        lead = "/\\*[\\s\\S]*?(?:\\*/|\\z)|//[^\\n]*" + ("|#[^\\n]*" if with_hash else "")
        return F.regexp_extract_all(b, F.lit(f"(?s)({lead}{body}|[^/#\"'`]+|.)"), F.lit(0))

    kept = lambda p, h: p.rlike("^(?:[\"'`]|//|/\\*" + ("|#" if h else "") + ")")
    done = lambda h: F.array_join(F.transform(cut(h), lambda p: F.when(kept(p, h), p).otherwise(blanked(p))), "")
    return F.when(hashes, done(True)).otherwise(done(False))


def mask_markdown_view(b: Column) -> Column:
    """Masks front matter keys and delimiters, code fences, inline code and link targets."""
    return bound(F.split(b, "\n", -1), _mask_markdown_lines)


def _mask_markdown_lines(lines: Column) -> Column:
    state = lambda out, k, fence, front: F.struct(out.alias("out"), k.alias("k"), fence.alias("fence"), front.alias("front"))
    none = F.array().cast("array<string>")

    def step(acc: Column, line: Column) -> Column:
        t = F.trim(line)
        marker = F.regexp_extract(t, "^(`{3,}|~{3,})", 1)
        opens_front = (acc["k"] == 0) & (t == "---")
        closes_front = acc["front"] & (acc["k"] > 0) & t.isin("---", "...")
        in_fence = acc["fence"] != ""
        closes = in_fence & (F.substring(marker, 1, 1) == F.substring(acc["fence"], 1, 1)) & (F.length(marker) >= F.length(acc["fence"]))
        front_value = F.concat(blanked(F.regexp_extract(line, "^([^:]*:?)", 1)), F.regexp_extract(line, "^[^:]*:?([\\s\\S]*)$", 1))
        prose = F.regexp_replace(line, "(?<!\\\\)(`++)[^\\n]*?\\1", "\x00$0\x00")
        prose = F.array_join(F.transform(F.split(prose, "\x00", -1), lambda p: F.when(p.rlike("^`"), blanked(p)).otherwise(p)), "")
        prose = F.regexp_replace(prose, "\\]\\([^)]*\\)", "]\x00$0\x00")
        prose = F.array_join(F.transform(F.split(prose, "\x00", -1), lambda p: F.when(p.rlike("^\\]\\("), blanked(F.substring(p, 2, 2**31 - 1))).otherwise(p)), "")
        new = (
            F.when(opens_front | closes_front, blanked(line))
            .when(acc["front"], front_value)
            .when(in_fence | (marker != ""), blanked(line))
            .otherwise(prose)
        )
        front = opens_front | (acc["front"] & ~closes_front)
        fence = F.when(acc["front"] | opens_front, acc["fence"]).when(closes, "").when(in_fence, acc["fence"]).otherwise(marker)
        return state(F.concat(acc["out"], F.array(new)), acc["k"] + 1, fence, front)

    def chunk(acc: Column, c: Column) -> Column:  # a fold that appends to an array copies it each time
        part = F.aggregate(F.slice(lines, c * CHUNK + 1, F.lit(CHUNK)), state(none, acc["k"], acc["fence"], acc["front"]), step, lambda a: state(F.array(F.array_join(a["out"], "\n")), a["k"], a["fence"], a["front"]))
        return F.struct(F.concat(acc["out"], part["out"]).alias("out"), part["k"].alias("k"), part["fence"].alias("fence"), part["front"].alias("front"))

    chunks = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / CHUNK).cast("int"))
    return F.aggregate(chunks, state(none, F.lit(0), F.lit(""), F.lit(False)), chunk, lambda acc: F.array_join(acc["out"], "\n"))


def mask(text: Column, path: Column, chosen: Column | None = None) -> Column:
    """The text with everything blanked that the profile of its path does not check."""
    p, e, b = profile(path) if chosen is None else F.when(chosen == "auto", profile(path)).otherwise(chosen), extension(path), byte_view(text)
    return F.when((p == "prose") & e.isin(*MARKUP), from_bytes(mask_markdown_view(b))).when(p == "source", from_bytes(mask_source_view(b, e.isin(*HASHES)))).otherwise(text)

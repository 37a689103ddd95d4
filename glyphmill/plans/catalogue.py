"""Named queries over the driver's tables, and the SQL that each must agree with.

The tables hold no Japanese, no links and no directives, so most queries append one of a few fixed strings
to each text, chosen by doc_id, in the same way in both engines; every row of the table takes part."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import github_escape, match_case, message, safe_fix
from ..operators import check, english, findings, japanese, lines, masking, suggest, tokens
from ..sources import files, lists, tree
from ..sources.staging import staged

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

ENGLISH = [
    "\nread ftp://mirror.test/pub?x=1 or write to jo.lee@mirror.test today",
    "\nmask 0xC0FFEE12 sum 9f86d081884c7d659a2feaa0c55ad015 key QWxhZGRpbjpPcGVuU2VzYW1lMTIzNDU2 stop",
    "\necho \\rhello or \\vworld, maker's URLs and PDFs won't 'cited'",
    "\nloadFileIndex XMLParserState read_csv_row out-of-date md5digest the favour of Favor GREY",
    "\nYou Wierd adn ADN Adn organise ser flate wierd definately qqvvx",
]
JAPANESE = [
    "\nモデル４５６ＸＹＺを更新 ｶﾞｲﾄﾞﾌﾞｯｸ参照 ﾋﾟﾞｱ",
    "\n長さは3㎝、容量は7㍑。var　y = 2;　完 ℃",
    "\n取り扱いは2,500円から。取り扱いの窓口、受付。\n取扱いは二五〇〇円から．\n",
    "\nユーザーを登録する。\nユーザを消す。スライダーと古いスライダ、スライダー。Webページ と Web ページ",
    "\n料金は3,200円、在庫は15件。前回は三二〇〇円，一五件。引続き、引き続き",
]
DIRECTIVES = [
    "\nadn\nadn # glyphmill:ignore-line\n# glyphmill:ignore-next-line\nadn\nadn",
    "\nglyphmill:ignore-next-line\nglyphmill:ignore-next-line\nadn ＡＢ",
    "\nadn glyphmill:other glyphmill:ignore-line\nadn",
    "\nadn\n# glyphmill:ignore-file",
    "",
]
CODE = [
    "\n---\nauthor: me\n",
    "\n`run wierd` and [there](http://q.test/wierd) ``x ` y`` done",
    "\n```\nwierd\n```\nbelow",
    "\nvar wierd = 2; // wierd remark\n\"wierd text\" /* ü */ w",
    "",
]
# What the composed check is run on: every tail of English and Japanese with every directive.
CHECKED = [ENGLISH[i % 5] + JAPANESE[i % 5] + DIRECTIVES[i // 5] for i in range(25)]


def query(f):
    QUERIES[f.__name__] = f
    return f


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def appended(spark: SparkSession, sf_dir: str, tails: list[str]) -> DataFrame:
    """The documents with one of ``tails`` each.  It is looked up in an array: plans repeat this text wherever a filter asks about it."""
    tail = F.coalesce(F.get(F.array(*map(F.lit, tails)), (F.col("doc_id") % len(tails)).cast("int")), F.lit(""))
    return documents(spark, sf_dir).select("doc_id", F.concat("text", tail).alias("text"))


def docs_sql(tails: list[str] | None = None) -> str:
    if not tails:
        return "docs AS (SELECT doc_id, text FROM documents)"
    cases = " ".join(f"WHEN {k} THEN {quoted(t)}" for k, t in enumerate(tails))
    return f"docs AS (SELECT doc_id, text || CASE doc_id % {len(tails)} {cases} ELSE '' END AS text FROM documents)"


DELIMS = r""" \t\n\f\r"`()\[\]{}<>,;\x{80}-\x{10FFFF}"""
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
LINES = f"""
raw AS (SELECT doc_id, unnest(p) AS raw, generate_subscripts(p, 1) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM docs)),
lines AS (SELECT doc_id, CAST(line AS INTEGER) AS line, rtrim(raw, chr(13)) AS b,
  CAST(coalesce(sum(strlen(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line {BEFORE}), 0) AS BIGINT) AS line_offset FROM raw)"""
JUNK = r"""((strlen(token) > 40 AND regexp_matches(token, '[0-9]')) OR regexp_matches(token, '^0[xX][0-9A-Fa-f_ui]+$')
  OR (strlen(regexp_replace(token, '[^0-9A-Za-z]', '', 'g')) >= 12 AND regexp_matches(token, '[0-9]') AND regexp_matches(regexp_replace(token, '[^0-9A-Za-z]', '', 'g'), '^[0-9A-Fa-f]*$'))
  OR (strlen(regexp_replace(token, '[^0-9A-Za-z]', '', 'g')) >= 16 AND strlen(regexp_replace(token, '[^0-9]', '', 'g')) >= 3
      AND len(regexp_extract_all(token, '[a-z][A-Z]')) + len(regexp_extract_all(token, '[A-Za-z][0-9]')) + len(regexp_extract_all(token, '[0-9][A-Za-z]')) >= 4))"""
LINK = r"(contains(token, '://') OR regexp_matches(token, '[0-9A-Za-z].*@.*\.'))"
TOKENS = f"""
parts AS (SELECT doc_id, line, line_offset, unnest(p) AS token, generate_subscripts(p, 1) AS t FROM (SELECT *, regexp_extract_all(b, '[^{DELIMS}]+|[{DELIMS}]+') AS p FROM lines)),
placed AS (SELECT *, coalesce(sum(strlen(token)) OVER (PARTITION BY doc_id, line ORDER BY t {BEFORE}), 0) AS tcol FROM parts),
tokens AS (SELECT * FROM placed WHERE regexp_matches(token, '^[^{DELIMS}]'))"""
WORDS = f"""{LINES},{TOKENS},
runs0 AS (SELECT doc_id, line, line_offset, t, tcol, unnest(p) AS run, generate_subscripts(p, 1) AS r FROM
  (SELECT *, regexp_extract_all(token, '\\\\?[A-Za-z][A-Za-z'']*|[^A-Za-z\\\\]+|\\\\') AS p FROM tokens WHERE NOT {LINK} AND NOT {JUNK})),
runs1 AS (SELECT *, tcol + coalesce(sum(strlen(run)) OVER (PARTITION BY doc_id, line, t ORDER BY r {BEFORE}), 0) AS rcol FROM runs0),
runs2 AS (SELECT *, regexp_replace(regexp_replace(run, '''+$', ''), '(.)''[sS]$', '\\1') AS w FROM runs1 WHERE regexp_matches(run, '^[A-Za-z]')),
cases AS (SELECT doc_id, line, line_offset, t, r, rcol, unnest(p) AS word, generate_subscripts(p, 1) AS c FROM (SELECT *,
  string_split(regexp_replace(regexp_replace(w, '([a-z])([A-Z])', '\\1' || chr(1) || '\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS p
  FROM runs2 WHERE NOT regexp_matches(w, '^[A-Z]{{2,}}s$'))),
words0 AS (SELECT doc_id, line, line_offset, word, CAST(rcol + coalesce(sum(strlen(word)) OVER (PARTITION BY doc_id, line, t, r ORDER BY c {BEFORE}), 0) AS BIGINT) AS col FROM cases),
words AS (SELECT *, lower(word) AS key, line_offset + col AS "offset" FROM words0 WHERE strlen(word) >= 3)"""
MATCH = """CASE WHEN regexp_matches({w}, '^[^A-Z]*$') THEN {s} WHEN regexp_matches(regexp_replace({w}, '[^A-Za-z]', '', 'g'), '^[A-Z]{{2,}}$') THEN upper({s})
 WHEN regexp_matches(regexp_replace({w}, '[^A-Za-z]', '', 'g'), '^[A-Z][a-z]*$') THEN upper({s}[1]) || {s}[2:] ELSE {s} END"""


@query
def line_offsets(spark, sf_dir):
    return lines.lines(appended(spark, sf_dir, DIRECTIVES)).select("doc_id", "line", "line_offset", F.length("b").cast("long").alias("n_bytes"))


oracle("line_offsets", f"WITH {docs_sql(DIRECTIVES)},{LINES} SELECT doc_id, line, line_offset, CAST(strlen(b) AS BIGINT) AS n_bytes FROM lines")


def english_lines(spark, sf_dir):
    return lines.lines(appended(spark, sf_dir, ENGLISH))


@query
def tokens_count(spark, sf_dir):
    return tokens.words(english_lines(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n_words"))


oracle("tokens_count", f"WITH {docs_sql(ENGLISH)},{WORDS} SELECT doc_id, count(*) AS n_words FROM words GROUP BY doc_id")


@query
def word_frequency_topk(spark, sf_dir):
    w = tokens.words(english_lines(spark, sf_dir)).groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"))
    return w.orderBy(F.desc("n"), "word").limit(100)


oracle("word_frequency_topk", f"WITH {docs_sql(ENGLISH)},{WORDS} SELECT key AS word, count(*) AS n FROM words GROUP BY key ORDER BY n DESC, word LIMIT 100")


def _tokens_where(name, condition, sql):
    def run(spark, sf_dir):
        t = tokens.token_rows(english_lines(spark, sf_dir)).where(condition())
        return t.groupBy("doc_id", "line").agg(F.count("*").alias("n"), F.max("token").alias("largest"))

    QUERIES[name] = run
    oracle(name, f"WITH {docs_sql(ENGLISH)},{LINES},{TOKENS} SELECT doc_id, line, count(*) AS n, max(token) AS largest FROM tokens WHERE {sql} GROUP BY doc_id, line")


_tokens_where("junk_token_filter", lambda: tokens.is_junk(F.col("token")), JUNK)
_tokens_where("email_url_skip", lambda: tokens.is_link(F.col("token")), LINK)


@query
def plural_acronym_skip(spark, sf_dir):
    w = tokens.token_rows(english_lines(spark, sf_dir)).where(tokens.is_plural_acronym(F.col("token")))
    return w.groupBy("token").agg(F.count("*").alias("n"))


oracle("plural_acronym_skip", f"WITH {docs_sql(ENGLISH)},{LINES},{TOKENS} SELECT token, count(*) AS n FROM tokens WHERE regexp_matches(token, '^[A-Z]{{2,}}s$') GROUP BY token")


@query
def escape_skip(spark, sf_dir):
    w = tokens.words(english_lines(spark, sf_dir))
    return w.groupBy("word").agg(F.count("*").alias("n"))


oracle("escape_skip", f"WITH {docs_sql(ENGLISH)},{WORDS} SELECT word, count(*) AS n FROM words GROUP BY word")

# Rule tables of the queries: invented corrections for words that the texts have.
RULES = [("adn", "and", 1), ("wierd", "weird", 1), ("definately", "definitely", 1), ("thnt", "that,than", 1), ("erth", "earth", 1), ("erth", "berth", 2), ("ednt", "ednt", 1), ("ononly", "only", 1)]
ALLOW = ["qqvvx", "thnd"]
FIXES_SQL = "fixes(key, fix, allowed) AS (VALUES ('adn', ['and'], false), ('wierd', ['weird'], false), ('definately', ['definitely'], false), ('thnt', ['that', 'than'], false), ('erth', ['berth'], false), ('ednt', ['ednt'], true), ('ononly', ['only'], false)), allow(key) AS (VALUES ('qqvvx'), ('thnd'))"


def rules(spark):
    return english.corrections(spark, RULES), spark.createDataFrame([(w,) for w in ALLOW], "word string")


def flat(df: DataFrame) -> DataFrame:
    return df.withColumn("suggestions", F.array_join("suggestions", ","))


@query
def typo_findings(spark, sf_dir):
    fixes, allow = rules(spark)
    found = english.english(english_lines(spark, sf_dir), fixes, allow)
    return flat(found.withColumn("fix", safe_fix(F.col("kind"), F.col("suggestions"))))


TYPO_ROWS = f"typos AS (SELECT doc_id, line, col, \"offset\", CAST(strlen(word) AS BIGINT) AS len, word, 'typo' AS kind, list_transform(fix, lambda s: {MATCH.format(w='word', s='s')}) AS s FROM words JOIN fixes USING (key) WHERE NOT allowed AND key NOT IN (SELECT key FROM allow))"
oracle("typo_findings", f"WITH {docs_sql(ENGLISH)},{WORDS},{FIXES_SQL},{TYPO_ROWS} SELECT doc_id, line, col, \"offset\", len, word, kind, array_to_string(s, ',') AS suggestions, CASE WHEN len(s) = 1 THEN s[1] END AS fix FROM typos")


@query
def correction_layering(spark, sf_dir):
    """Documents as rows of correction tables in three layers, of which the highest and then the last row of a typo holds."""
    typo = F.concat(F.lit("W"), F.col("doc_id") % 97)
    fix = F.when(F.col("doc_id") % 13 == 0, F.lower(typo)).otherwise(F.concat(F.lit("f"), F.col("doc_id") % 11, F.lit(" ,, g")))
    rows = documents(spark, sf_dir).select(typo.alias("typo"), fix.alias("fix"), (F.col("doc_id") % 3).alias("priority"), F.col("doc_id").alias("seq"))
    return english.layered(rows).select("typo", F.array_join("fixes", ",").alias("fixes"), "allow")


oracle("correction_layering", """WITH r AS (SELECT 'w' || (doc_id % 97) AS typo, doc_id, row_number() OVER (PARTITION BY doc_id % 97 ORDER BY doc_id % 3 DESC, doc_id DESC) AS k FROM documents)
SELECT typo, CASE WHEN doc_id % 13 = 0 THEN typo ELSE 'f' || (doc_id % 11) || ',g' END AS fixes, doc_id % 13 = 0 AS allow FROM r WHERE k = 1""")


@query
def locale_findings(spark, sf_dir):
    _, allow = rules(spark)
    none = spark.createDataFrame([], "typo string, fixes array<string>, allow boolean")
    return flat(english.english(english_lines(spark, sf_dir), none, allow, locale=english.locale_table(spark, "en-US")))


PAIRS_SQL = "pairs(us, gb) AS (VALUES " + ", ".join(f"('{us}', '{gb}')" for us, gb in english.LOCALE_PAIRS) + ")"
oracle("locale_findings", f"WITH {docs_sql(ENGLISH)},{WORDS},{PAIRS_SQL} SELECT doc_id, line, col, \"offset\", CAST(strlen(word) AS BIGINT) AS len, word, 'en-variant' AS kind, {MATCH.format(w='word', s='us')} AS suggestions FROM words JOIN pairs ON key = gb")


def known_words(spark, sf_dir):
    """Words of at least five documents, as a word list."""
    return tokens.document_words(documents(spark, sf_dir)).groupBy("word").count().where("count >= 5").select("word")


KNOWN_SQL = f"known AS (SELECT key FROM (WITH {docs_sql()},{WORDS} SELECT DISTINCT doc_id, key FROM words) GROUP BY key HAVING count(*) >= 5)"


@query
def unknown_words(spark, sf_dir):
    fixes, allow = rules(spark)
    found = english.english(english_lines(spark, sf_dir), fixes, allow, known=known_words(spark, sf_dir))
    return flat(found.where("kind = 'unknown-word'")).groupBy("word", "suggestions").agg(F.count("*").alias("n"), F.min("offset").alias("first"))


def suggested(unknown: str) -> str:
    """The nearest known words of each of the ``unknown`` (key), as lists."""
    near = "levenshtein(u.key, k.key)"
    return f"""nearest AS (SELECT u.key, list(k.key ORDER BY {near}, abs(strlen(k.key) - strlen(u.key)), k.key)[1:4] AS near FROM (SELECT DISTINCT key FROM {unknown}) u JOIN known k
 ON abs(strlen(k.key) - strlen(u.key)) <= 2 AND strlen(u.key) <= 24 AND {near} <= CASE WHEN strlen(u.key) <= 6 THEN 1 ELSE 2 END GROUP BY u.key)"""


NEAR = f"list_transform(coalesce(near, CAST([] AS VARCHAR[])), lambda s: {MATCH.format(w='word', s='s')})"
oracle("unknown_words", f"""WITH {docs_sql(ENGLISH)},{WORDS},{FIXES_SQL},{KNOWN_SQL}, strange AS (SELECT * FROM words
 WHERE key NOT IN (SELECT key FROM allow) AND key NOT IN (SELECT key FROM fixes) AND key NOT IN (SELECT key FROM known) AND strlen(word) >= 4 AND NOT regexp_matches(word, '^[A-Z]+$')),{suggested("strange")}
 SELECT word, array_to_string({NEAR}, ',') AS suggestions, count(*) AS n, min("offset") AS first FROM strange LEFT JOIN nearest USING (key) GROUP BY word, near""")


@query
def suggest_topk(spark, sf_dir):
    """Suggestions for every word that is not in the list of known ones; the documents are cut into words once for both."""
    w = tokens.words(lines.lines(documents(spark, sf_dir))).select("doc_id", F.lower("word").alias("word")).distinct()
    counted = staged(w.groupBy("word").agg(F.count("*").alias("n")), "counted-words")
    return suggest.suggest(counted.where("n < 5").select("word"), counted.where("n >= 5").select("word"))


@query
def match_case_forms(spark, sf_dir):
    w = tokens.words(english_lines(spark, sf_dir)).select("word").distinct()
    return w.select("word", match_case(F.col("word"), F.lit("example")).alias("cased"))


oracle("match_case_forms", f"WITH {docs_sql(ENGLISH)},{WORDS} SELECT DISTINCT word, {MATCH.format(w='word', s=chr(39) + 'example' + chr(39))} AS cased FROM words".replace("'example'[1]", "'e'").replace("'example'[2:]", "'xample'"))


@query
def issue_message(spark, sf_dir):
    fixes, allow = rules(spark)
    found = english.english(english_lines(spark, sf_dir), fixes, allow)
    return found.select("doc_id", "offset", message(F.col("kind"), F.col("word"), F.col("suggestions")).alias("message"))


MESSAGE = "CASE WHEN len(s) = 1 THEN '`' || word || '` should be `' || s[1] || '`' ELSE '`' || word || '` should be one of: ' || array_to_string(list_transform(s, lambda x: '`' || x || '`'), ', ') END"
oracle("issue_message", f"WITH {docs_sql(ENGLISH)},{WORDS},{FIXES_SQL},{TYPO_ROWS} SELECT doc_id, \"offset\", {MESSAGE} AS message FROM typos")


def japanese_docs(spark, sf_dir):
    return appended(spark, sf_dir, JAPANESE)


def occurrence_sql(run: str, other: str, keep: str) -> str:
    return f"""occ0 AS (SELECT doc_id, unnest(p) AS word, generate_subscripts(p, 1) AS k FROM (SELECT doc_id, regexp_extract_all(text, '{run}|{other}') AS p FROM docs)),
occ1 AS (SELECT *, CAST(coalesce(sum(strlen(word)) OVER (PARTITION BY doc_id ORDER BY k {BEFORE}), 0) AS BIGINT) AS "offset" FROM occ0), occ AS (SELECT * FROM occ1 WHERE regexp_matches(word, '{keep}'))"""


def _ja(name, make, occ, select):
    def run(spark, sf_dir):
        return flat(make(spark, japanese_docs(spark, sf_dir))).select("doc_id", "offset", "len", "word", "kind", "suggestions")

    QUERIES[name] = run
    oracle(name, f"WITH {docs_sql(JAPANESE)},{occ} {select}")


BASIC = "SELECT doc_id, \"offset\", CAST(strlen(word) AS BIGINT) AS len, word, '{kind}' AS kind, {to} AS suggestions FROM occ"
from ..functions.text import COMPATIBILITY, FULL_ALNUM, FULL_KANA, HALF_ALNUM, HALF_KANA, KANA_PAIRS  # noqa: E402

_ja("fullwidth_alnum", lambda s, d: japanese.fullwidth_alnum(d), occurrence_sql(f"[{japanese.FULL_ALNUM}]+", f"[^{japanese.FULL_ALNUM}]+", f"^[{japanese.FULL_ALNUM}]"), BASIC.format(kind="fullwidth-alnum", to=f"translate(word, '{FULL_ALNUM}', '{HALF_ALNUM}')"))
_kana = "word"
for _a, _b in KANA_PAIRS:
    _kana = f"replace({_kana}, '{_a}', '{_b}')"
_ja("halfwidth_kana", lambda s, d: japanese.halfwidth_kana(d), occurrence_sql("[｡-ﾟ]+", "[^｡-ﾟ]+", "^[｡-ﾟ]"), BASIC.format(kind="halfwidth-kana", to=f"translate({_kana}, '{HALF_KANA}', '{FULL_KANA}')"))
_ja("fullwidth_space", lambda s, d: japanese.fullwidth_space(d, "always"), occurrence_sql("　", "[^　]+", "^　"), BASIC.format(kind="fullwidth-space", to="' '"))
_map = "CASE word " + " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in COMPATIBILITY.items()) + " END"
_ja("compat_chars", lambda s, d: japanese.compatibility(d), occurrence_sql(f"[{japanese.COMPATIBLE}]", f"[^{japanese.COMPATIBLE}]+", f"^[{japanese.COMPATIBLE}]"), f"SELECT * FROM ({BASIC.format(kind='ja-compatibility', to=_map)}) WHERE suggestions IS NOT NULL")
_KATA = occurrence_sql(f"[{japanese.KATAKANA}]+", f"[^{japanese.KATAKANA}]+", f"^[{japanese.KATAKANA}]")
_long = "[" + ", ".join(quoted(w) for w, _ in japanese.KATAKANA_PAIRS) + "]"
_ja("katakana_variants", lambda s, d: japanese.variants(d, japanese.katakana_table(s, "long")), _KATA, BASIC.format(kind="ja-variant", to="word || 'ー'") + f" WHERE list_contains({_long}, word)")
_ja(
    "katakana_consistency",
    lambda s, d: japanese.katakana_consistency(d),
    _KATA + ", f AS (SELECT *, regexp_replace(word, 'ー+$', '') AS key FROM occ WHERE length(word) >= 3), n AS (SELECT doc_id, key, word, count(*) AS n FROM f WHERE length(key) >= 2 GROUP BY ALL), g AS (SELECT doc_id, key, arg_max(word, (n, ends_with(word, 'ー'), strlen(word), word)) AS winner FROM n GROUP BY doc_id, key HAVING count(*) > 1)",
    "SELECT doc_id, \"offset\", CAST(strlen(word) AS BIGINT) AS len, word, 'ja-variant' AS kind, winner AS suggestions FROM f JOIN g USING (doc_id, key) WHERE word <> winner",
)
_ja(
    "punctuation_style",
    lambda s, d: japanese.punctuation_style(d),
    occurrence_sql("[、。，．]", "[^、。，．]+", "^[、。，．]") + ", c AS (SELECT doc_id, count(*) FILTER (word IN ('、', '。')) AS ja, count(*) FILTER (word IN ('，', '．')) AS we FROM occ GROUP BY doc_id)",
    "SELECT doc_id, \"offset\", CAST(strlen(word) AS BIGINT) AS len, word, 'ja-punctuation' AS kind, CASE WHEN ja >= we THEN translate(word, '，．', '、。') ELSE translate(word, '、。', '，．') END AS suggestions FROM occ JOIN c USING (doc_id) WHERE ja > 0 AND we > 0 AND (word IN ('，', '．')) = (ja >= we)",
)
_DIG = f"0-9,{japanese.KANJI_DIGITS}"
_NUM = occurrence_sql(f"(?:[0-9][0-9,]*|[{japanese.KANJI_DIGITS}]+)[{japanese.UNITS}]", f"[0-9][0-9,]*|[{japanese.KANJI_DIGITS}]+|[^{_DIG}]+|,", f"^(?:[0-9][0-9,]*|[{japanese.KANJI_DIGITS}]+)[{japanese.UNITS}]$")
_ja(
    "number_style",
    lambda s, d: japanese.number_style(d),
    _NUM + f", f AS (SELECT *, translate(replace(word, ',', ''), '{japanese.KANJI_DIGITS}', '00123456789') AS key, regexp_matches(word, '^[{japanese.KANJI_DIGITS}]') AS kanji FROM occ), g AS (SELECT doc_id, key, count(*) FILTER (kanji) AS nk, count(*) FILTER (NOT kanji) AS na, arg_min(word, \"offset\") FILTER (kanji) AS fk, arg_min(word, \"offset\") FILTER (NOT kanji) AS fa FROM f GROUP BY doc_id, key)",
    "SELECT doc_id, \"offset\", CAST(strlen(word) AS BIGINT) AS len, word, 'ja-number-style' AS kind, CASE WHEN na >= nk THEN fa ELSE fk END AS suggestions FROM f JOIN g USING (doc_id, key) WHERE nk > 0 AND na > 0 AND kanji = (na >= nk)",
)
_ja("kanji_consistency", lambda s, d: japanese.kanji_consistency(d), "pairs(bad, good) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in japanese.KANJI_PAIRS) + ")", """, n AS (SELECT doc_id, text, bad, good, len(string_split(text, bad)) - 1 AS a, len(string_split(text, good)) - 1 AS b FROM docs, pairs WHERE contains(text, bad) AND contains(text, good)),
m AS (SELECT doc_id, text, CASE WHEN a > b THEN good ELSE bad END AS word, CASE WHEN a > b THEN bad ELSE good END AS suggestions FROM n),
u AS (SELECT doc_id, word, suggestions, unnest(string_split(text, word)) AS part, generate_subscripts(string_split(text, word), 1) AS k, len(string_split(text, word)) AS parts FROM m),
o AS (SELECT *, CAST(sum(strlen(part)) OVER (PARTITION BY doc_id, word ORDER BY k) + (k - 1) * strlen(word) AS BIGINT) AS "offset" FROM u)
SELECT doc_id, "offset", CAST(strlen(word) AS BIGINT) AS len, word, 'ja-variant' AS kind, suggestions FROM o WHERE k < parts""")
ORACLES["kanji_consistency"] = ORACLES["kanji_consistency"].replace(") , n AS", "), n AS")
_ja("regex_rules", lambda s, d: japanese.regex_rules(d, [("Web ?ページ", "ウェブページ")]), "occ0 AS (SELECT doc_id, unnest(regexp_extract_all(text, 'Web ?ページ')) AS word, text FROM docs)", "SELECT doc_id, CAST(strlen(text[:strpos(text, word) - 1]) AS BIGINT) AS \"offset\", CAST(strlen(word) AS BIGINT) AS len, word, 'ja-variant' AS kind, 'ウェブページ' AS suggestions FROM occ0")


# A letter that comes again after one other letter, and a letter after it: a rule for each two letters.
MANY_RULES = [(f"{a}{b}{a}[a-z]", f"<{a}{b}{a}>") for a in string.ascii_lowercase for b in string.ascii_lowercase if a != b]


@query
def many_rules(spark, sf_dir):
    found = japanese.indexed_rules(documents(spark, sf_dir), MANY_RULES)
    return found.groupBy("doc_id", "word", F.col("suggestions")[0].alias("to")).agg(F.count("*").alias("n"))


oracle("many_rules", f"""WITH r(a, b) AS (SELECT x, y FROM unnest(string_split('{string.ascii_lowercase}', '')) AS u(x), unnest(string_split('{string.ascii_lowercase}', '')) AS v(y) WHERE x <> y),
hits AS (SELECT doc_id, unnest(regexp_extract_all(text, a || b || a || '[a-z]')) AS word, '<' || a || b || a || '>' AS "to" FROM documents JOIN r ON contains(text, a || b || a))
SELECT doc_id, word, "to", count(*) AS n FROM hits GROUP BY ALL""")


@query
def ignore_file(spark, sf_dir):
    return lines.without_ignored_files(appended(spark, sf_dir, DIRECTIVES)).select("doc_id")


oracle("ignore_file", f"WITH {docs_sql(DIRECTIVES)} SELECT doc_id FROM docs WHERE NOT contains(text, 'glyphmill:ignore-file')")


@query
def ignore_lines(spark, sf_dir):
    return lines.skipped_lines(lines.lines(appended(spark, sf_dir, DIRECTIVES)))


oracle("ignore_lines", f"""WITH {docs_sql(DIRECTIVES)},{LINES},
d AS (SELECT doc_id, line, regexp_extract(b, '^.*?glyphmill:(ignore-next-line|ignore-line|)', 1) AS d FROM lines WHERE contains(b, 'glyphmill:')),
n AS (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS run FROM d WHERE d = 'ignore-next-line'),
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, run ORDER BY line) AS k FROM n)
SELECT doc_id, CAST(line AS INTEGER) AS line FROM (SELECT doc_id, line FROM d WHERE d <> '' UNION SELECT doc_id, line FROM l WHERE k % 2 = 1 UNION SELECT doc_id, line + 1 FROM l WHERE k % 2 = 1)""")

EXTENSIONS = ["md", "py", "txt", "rs", "RST", "x"]


def with_path(df: DataFrame) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))
    return df.withColumn("path", F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit("."), ext))


PATH_SQL = "'docs/' || doc_id || '.' || [" + ", ".join(quoted(e) for e in EXTENSIONS) + f"][doc_id % {len(EXTENSIONS)} + 1]"


@query
def profile_choice(spark, sf_dir):
    d = with_path(documents(spark, sf_dir))
    return d.select("doc_id", "path", masking.profile(F.col("path")).alias("profile"), masking.is_prose(F.col("path")).alias("prose"))


oracle("profile_choice", f"SELECT doc_id, {PATH_SQL} AS path, CASE doc_id % 6 WHEN 0 THEN 'prose' WHEN 1 THEN 'source' WHEN 3 THEN 'source' ELSE 'all' END AS profile, doc_id % 6 IN (0, 2, 4) AS prose FROM documents")


OVERRIDES = (check.Override("src1/**", mode="dictionary", japanese=True), check.Override("*.md", mode="off"), check.Override("src3/*", japanese=False, profile="all"))
CONFIG = check.Config(locale="en-US", rules=(("Web ?ページ", "ウェブページ"),), overrides=OVERRIDES)
CHECK_PATH = "'src' || doc_id % 7 || '/' || " + PATH_SQL


def check_docs(spark, sf_dir, tails: list[str]) -> DataFrame:
    d = with_path(appended(spark, sf_dir, tails))
    return d.withColumn("path", F.concat(F.lit("src"), F.col("doc_id") % 7, F.lit("/"), F.col("path")))


EFFECTIVE = "CASE WHEN doc_id % 6 = 0 THEN 'off' WHEN doc_id % 7 = 1 THEN 'dictionary' ELSE 'corrections' END AS mode, doc_id % 7 <> 3 AS ja, doc_id % 6 IN (0, 2, 4) AS prose"


@query
def path_overrides(spark, sf_dir):
    return check.effective(check_docs(spark, sf_dir, [""]), CONFIG).select("doc_id", "mode", "ja", "prose", "profile")


oracle("path_overrides", f"SELECT doc_id, {EFFECTIVE}, 'all' AS profile FROM documents")


@query
def markdown_mask(spark, sf_dir):
    d = appended(spark, sf_dir, CODE).withColumn("path", F.format_string("docs/%s.md", "doc_id"))  # every document as this kind
    m = masking.mask(F.col("text"), F.col("path"))
    return d.select("doc_id", m.alias("masked"), (F.octet_length(m) == F.octet_length("text")).alias("same_length"))


@query
def source_mask(spark, sf_dir):
    d = appended(spark, sf_dir, CODE).withColumn("path", F.explode(F.array(*[F.format_string(f"docs/%s.{e}", "doc_id") for e in ("py", "rs")])))  # with hash comments and without
    m = masking.mask(F.col("text"), F.col("path"))
    return d.select("doc_id", "path", m.alias("masked"), (F.octet_length(m) == F.octet_length("text")).alias("same_length"))


def all_findings(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = check_docs(spark, sf_dir, CHECKED)
    fixes, allow = rules(spark)
    return docs, check.check(docs, CONFIG, fixes, allow, known_words(spark, sf_dir))


WORDS_OF_LINES = WORDS[len(LINES) + 1 :]
SKIPS = """
dir AS (SELECT doc_id, line, regexp_extract(b, '^.*?glyphmill:(ignore-next-line|ignore-line|)', 1) AS d FROM alllines WHERE contains(b, 'glyphmill:')),
nextlines AS (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS run FROM dir WHERE d = 'ignore-next-line'),
livelines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, run ORDER BY line) AS k FROM nextlines),
skips AS (SELECT doc_id, line FROM dir WHERE d <> '' UNION SELECT doc_id, line FROM livelines WHERE k % 2 = 1 UNION SELECT doc_id, line + 1 FROM livelines WHERE k % 2 = 1)"""
_EVERY = japanese.KATAKANA + japanese.FULL_ALNUM + japanese.HALF_KANA + japanese.COMPATIBLE + "　" + japanese.MARKS
_RUNS = f"[{japanese.KATAKANA}]+|[{japanese.FULL_ALNUM}]+|[{japanese.HALF_KANA}]+|[{japanese.COMPATIBLE}　{japanese.MARKS}]|[^{_EVERY}]+"
_NUMBER = f"(?:[0-9][0-9,]*|[{japanese.KANJI_DIGITS}]+)[{japanese.UNITS}]"


def line_occurrences(name: str, pattern: str, keep: str) -> str:
    """Matches in the lines of documents with Japanese checks: (doc_id, line, word, offset, prose, skip)."""
    return f"""{name}0 AS (SELECT doc_id, line, line_offset, prose, unnest(p) AS word, generate_subscripts(p, 1) AS k FROM (SELECT alllines.*, prose, regexp_extract_all(b, '{pattern}') AS p FROM alllines JOIN docs USING (doc_id) WHERE ja)),
{name}1 AS (SELECT *, CAST(line_offset + coalesce(sum(strlen(word)) OVER (PARTITION BY doc_id, line ORDER BY k {BEFORE}), 0) AS BIGINT) AS "offset" FROM {name}0),
{name} AS (SELECT {name}1.*, skips.line IS NOT NULL AS skip FROM {name}1 LEFT JOIN skips USING (doc_id, line) WHERE regexp_matches(word, '{keep}'))"""


NO_WORDS = "CAST([] AS VARCHAR[])"
STYLED_SQL = f"""base AS (SELECT doc_id, {CHECK_PATH} AS path, text FROM (WITH {docs_sql(CHECKED)} SELECT * FROM docs)),
docs AS (SELECT *, {EFFECTIVE} FROM base WHERE text IS NOT NULL AND NOT contains(text, 'glyphmill:ignore-file') AND NOT (doc_id % 6 = 0 AND doc_id % 7 = 3)),
{LINES.replace("lines AS", "alllines AS")},{SKIPS},
lines AS (SELECT alllines.*, mode FROM alllines JOIN docs USING (doc_id) LEFT JOIN skips USING (doc_id, line) WHERE skips.line IS NULL AND mode <> 'off'),
{WORDS_OF_LINES},{FIXES_SQL},{PAIRS_SQL},{KNOWN_SQL},{TYPO_ROWS},
{line_occurrences("pc", _RUNS, f"^[{_EVERY}]")},
{line_occurrences("nu", f"{_NUMBER}|[0-9][0-9,]*|[{japanese.KANJI_DIGITS}]+|[^{_DIG}]+|,", f"^{_NUMBER}$")},
{line_occurrences("ru", "Web ?ページ|.", "^Web ?ページ$")},
kc AS (SELECT *, regexp_replace(word, 'ー+$', '') AS key FROM pc WHERE NOT skip AND regexp_matches(word, '^[{japanese.KATAKANA}]') AND NOT list_contains({_long}, word) AND length(word) >= 3),
kn AS (SELECT doc_id, key, word, count(*) AS n FROM kc WHERE length(key) >= 2 GROUP BY ALL),
kg AS (SELECT doc_id, key, arg_max(word, (n, ends_with(word, 'ー'), strlen(word), word)) AS winner FROM kn GROUP BY doc_id, key HAVING count(*) > 1),
pu AS (SELECT *, count(*) FILTER (word IN ('、', '。')) OVER (PARTITION BY doc_id) AS njp, count(*) FILTER (word IN ('，', '．')) OVER (PARTITION BY doc_id) AS nwe FROM pc WHERE regexp_matches(word, '^[{japanese.MARKS}]')),
nf AS (SELECT *, translate(replace(word, ',', ''), '{japanese.KANJI_DIGITS}', '00123456789') AS key, regexp_matches(word, '^[{japanese.KANJI_DIGITS}]') AS kanji FROM nu),
ng AS (SELECT doc_id, key, count(*) FILTER (kanji) AS nk, count(*) FILTER (NOT kanji) AS na, arg_min(word, "offset") FILTER (kanji) AS fk, arg_min(word, "offset") FILTER (NOT kanji) AS fa FROM nf GROUP BY doc_id, key),
kpairs(bad, good) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in japanese.KANJI_PAIRS)}),
kp AS (SELECT doc_id, text, CASE WHEN a > b THEN good ELSE bad END AS word, CASE WHEN a > b THEN bad ELSE good END AS good FROM (SELECT doc_id, text, bad, good, len(string_split(text, bad)) - 1 AS a, len(string_split(text, good)) - 1 AS b FROM docs, kpairs WHERE ja AND contains(text, bad) AND contains(text, good))),
ku AS (SELECT doc_id, word, good, unnest(string_split(text, word)) AS part, generate_subscripts(string_split(text, word), 1) AS k, len(string_split(text, word)) AS parts FROM kp),
ko AS (SELECT *, CAST(sum(strlen(part)) OVER (PARTITION BY doc_id, word ORDER BY k) + (k - 1) * strlen(word) AS BIGINT) AS "offset" FROM ku),
strange AS (SELECT words.* FROM words JOIN docs USING (doc_id) WHERE mode = 'dictionary' AND key NOT IN (SELECT key FROM allow) AND key NOT IN (SELECT key FROM fixes) AND key NOT IN (SELECT gb FROM pairs) AND key NOT IN (SELECT key FROM known) AND strlen(word) >= 4 AND NOT regexp_matches(word, '^[A-Z]+$')),
{suggested("strange")},
found0 AS (
 SELECT doc_id, "offset", word, kind, s, 0 AS phase FROM typos
 UNION ALL SELECT doc_id, "offset", word, 'en-variant', [{MATCH.format(w='word', s='us')}], 0 FROM words JOIN pairs ON key = gb WHERE key NOT IN (SELECT key FROM allow) AND key NOT IN (SELECT key FROM fixes)
 UNION ALL SELECT doc_id, "offset", word, 'unknown-word', {NEAR}, 0 FROM strange LEFT JOIN nearest USING (key)
 UNION ALL SELECT doc_id, "offset", word, 'ja-variant', ['ウェブページ'], 1 FROM ru WHERE NOT skip
 UNION ALL SELECT doc_id, "offset", word, 'ja-variant', [word || 'ー'], 2 FROM pc WHERE NOT skip AND list_contains({_long}, word)
 UNION ALL SELECT doc_id, "offset", word, 'fullwidth-alnum', [translate(word, '{FULL_ALNUM}', '{HALF_ALNUM}')], 2 FROM pc WHERE NOT skip AND regexp_matches(word, '^[{japanese.FULL_ALNUM}]')
 UNION ALL SELECT doc_id, "offset", word, 'halfwidth-kana', [translate({_kana}, '{HALF_KANA}', '{FULL_KANA}')], 2 FROM pc WHERE NOT skip AND regexp_matches(word, '^[{japanese.HALF_KANA}]')
 UNION ALL SELECT doc_id, "offset", word, 'fullwidth-space', [' '], 2 FROM pc WHERE NOT skip AND word = '　' AND NOT prose
 UNION ALL SELECT doc_id, "offset", word, 'ja-compatibility', [w], 2 FROM (SELECT *, {_map} AS w FROM pc WHERE NOT skip AND regexp_matches(word, '^[{japanese.COMPATIBLE}]')) WHERE w IS NOT NULL
 UNION ALL SELECT doc_id, "offset", word, 'ja-variant', [winner], 3 FROM kc JOIN kg USING (doc_id, key) WHERE word <> winner
 UNION ALL SELECT doc_id, "offset", word, 'ja-variant', [good], 4 FROM ko WHERE k < parts
 UNION ALL SELECT doc_id, "offset", word, 'ja-number-style', [CASE WHEN na >= nk THEN fa ELSE fk END], 5 FROM nf JOIN ng USING (doc_id, key) WHERE nk > 0 AND na > 0 AND kanji = (na >= nk)
 UNION ALL SELECT doc_id, "offset", word, 'ja-punctuation', [CASE WHEN njp >= nwe THEN translate(word, '，．', '、。') ELSE translate(word, '、。', '，．') END], 6 FROM pu WHERE njp > 0 AND nwe > 0 AND (word IN ('，', '．')) = (njp >= nwe)),
found AS (SELECT * FROM found0 WHERE lower(word) NOT IN (SELECT key FROM allow)),
placedf AS (SELECT *, len(string_split(before, chr(10))) AS line, string_split(before, chr(10))[-1] AS inline FROM (SELECT found.*, path, decode(encode(text)[1:"offset"]) AS before, text FROM found JOIN docs USING (doc_id))),
lined AS (SELECT *, CAST(strlen(inline) AS BIGINT) AS col, length(inline) + 1 AS "column", rtrim(string_split(text, chr(10))[line], chr(13)) AS line_text FROM placedf)"""


# The style consistency has no list of variants; the styles long and short do not compare forms.
ALL_SQL = STYLED_SQL.replace(_long, NO_WORDS)


@query
def findings_all(spark, sf_dir):
    _, found = all_findings(spark, sf_dir)
    return flat(found).select("doc_id", "line", "col", "offset", "word", "kind", "suggestions", "phase")


@query
def check_defaults(spark, sf_dir):
    """The composed check without overrides: corrections, regional spellings, listed katakana variants, a rule and all Japanese notation."""
    fixes, allow = rules(spark)
    config = check.Config(locale="en-US", rules=CONFIG.rules, variants=tuple(japanese.KATAKANA_PAIRS))
    return flat(check.check(check_docs(spark, sf_dir, CHECKED), config, fixes, allow)).select("doc_id", "line", "col", "offset", "word", "kind", "suggestions", "phase")


def settings_sql(sql: str) -> str:
    """For all documents in mode corrections with Japanese checks."""
    return sql.replace(EFFECTIVE, "'corrections' AS mode, true AS ja, doc_id % 6 IN (0, 2, 4) AS prose").replace(" AND NOT (doc_id % 6 = 0 AND doc_id % 7 = 3)", "")


REPORTED = "SELECT doc_id, CAST(line AS INTEGER) AS line, col, \"offset\", word, kind, array_to_string(s, ',') AS suggestions, phase FROM lined"
oracle("check_defaults", f"WITH {settings_sql(STYLED_SQL)} {REPORTED}")


@query
def check_styles(spark, sf_dir):
    """The composed check with long katakana, American spelling and single Japanese checks switched off."""
    fixes, allow = rules(spark)
    config = check.Config(locale="en-US", katakana="long", rules=CONFIG.rules, space="never", halfwidth=False, kanji=False, punctuation=False)
    return flat(check.check(check_docs(spark, sf_dir, CHECKED), config, fixes, allow)).select("doc_id", "line", "col", "offset", "word", "kind", "suggestions", "phase")


oracle("check_styles", f"WITH {settings_sql(STYLED_SQL)} {REPORTED} WHERE kind NOT IN ('halfwidth-kana', 'fullwidth-space', 'ja-punctuation') AND phase NOT IN (3, 4)")


@query
def check_masked(spark, sf_dir):
    """The composed check on texts whose masks depend on their paths."""
    fixes, allow = rules(spark)
    docs = check_docs(spark, sf_dir, [c + e for c, e in zip(CODE, ENGLISH)])
    return flat(check.check(docs, check.Config(profile="auto", locale="en-US"), fixes, allow)).select("doc_id", "line", "col", "offset", "word", "kind", "suggestions", "phase")


oracle("findings_all", f"WITH {ALL_SQL} SELECT doc_id, CAST(line AS INTEGER) AS line, col, \"offset\", word, kind, array_to_string(s, ',') AS suggestions, phase FROM lined")


def _files(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("content", F.encode(F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("a\x00"), F.col("text"))).otherwise(F.col("text")), "UTF-8"))
    return files.guarded(d.withColumn("length", F.octet_length("content").cast("long")), 10_000)


@query
def scan_guards(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", "length", "skipped_large", "skipped_binary")


GUARDS = "gl AS (SELECT doc_id, strlen(text) + CASE WHEN doc_id % 11 = 0 THEN 2 ELSE 0 END AS length FROM documents), guards AS (SELECT doc_id, CAST(length AS BIGINT) AS length, length > 10000 AS skipped_large, length <= 10000 AND doc_id % 11 = 0 AS skipped_binary FROM gl)"
oracle("scan_guards", f"WITH {GUARDS} SELECT * FROM guards")


@query
def run_summary(spark, sf_dir):
    _, found = all_findings(spark, sf_dir)
    return findings.summary(found, _files(spark, sf_dir))


oracle("run_summary", f"WITH {ALL_SQL},{GUARDS} SELECT (SELECT count(*) FROM found) AS issues, (SELECT count(DISTINCT doc_id) FROM found) AS files_with_issues, count(*) FILTER (NOT skipped_large AND NOT skipped_binary) AS files_checked, count(*) FILTER (skipped_binary) AS skipped_binary, count(*) FILTER (skipped_large) AS skipped_large FROM guards")


def lined(spark, sf_dir) -> DataFrame:
    docs, found = all_findings(spark, sf_dir)
    return findings.with_line_text(found, docs).join(docs.select("doc_id", "path").hint("merge"), "doc_id")


@query
def words_collect(spark, sf_dir):
    return flat(findings.collect_words(lined(spark, sf_dir)))


BLANK_SQL = "[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def trim_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{BLANK_SQL}+', ''), '{BLANK_SQL}+$', '')"


oracle("words_collect", f"""WITH {ALL_SQL}, k AS (SELECT CASE WHEN regexp_matches(word, '^[\\x00-\\x7F]*$') THEN lower(word) ELSE word END AS w, *, {trim_sql("line_text")} AS x FROM lined WHERE kind IN ('typo', 'unknown-word', 'en-variant', 'ja-variant')),
e AS (SELECT w, count(*) AS count, arg_min(kind, (path, "offset", phase)) AS kind, arg_min(path || ':' || line || ': ' || CASE WHEN length(x) > 96 THEN x[:96] || '…' ELSE x END, (path, "offset", phase)) AS example FROM k GROUP BY w),
u AS (SELECT w, path, "offset", phase, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM k), m AS (SELECT w, s, min((path, "offset", phase, i)) AS pos FROM u GROUP BY w, s)
SELECT w AS word, count, kind, example, coalesce((SELECT string_agg(s, ',' ORDER BY pos) FROM m WHERE m.w = e.w), '') AS suggestions FROM e""")


def printed(spark, sf_dir):
    f = lined(spark, sf_dir)
    return f.withColumn("fingerprint", findings.fingerprint(F.col("path"), F.col("kind"), F.col("word"), F.col("line_text")))


FP = f"fp AS (SELECT *, sha256(path || chr(0) || kind || chr(0) || lower(word) || chr(0) || sha256({trim_sql('line_text')})) AS fingerprint FROM lined)"


@query
def baseline_build(spark, sf_dir):
    return findings.baseline(printed(spark, sf_dir))


oracle("baseline_build", f"WITH {ALL_SQL},{FP} SELECT fingerprint, min(path) AS path, min(kind) AS kind, min(word) AS word, count(*) AS count FROM fp GROUP BY fingerprint")


@query
def baseline_suppress(spark, sf_dir):
    f = printed(spark, sf_dir)
    known = findings.baseline(f.where("doc_id % 2 = 0 and offset % 3 <> 0"))
    return findings.suppress(f, known).select("doc_id", "offset", "phase", "fingerprint")


oracle("baseline_suppress", f"""WITH {ALL_SQL},{FP}, b AS (SELECT fingerprint, count(*) AS budget FROM fp WHERE doc_id % 2 = 0 AND "offset" % 3 <> 0 GROUP BY fingerprint),
r AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY path, "offset", phase) AS k FROM fp) SELECT doc_id, "offset", phase, fingerprint FROM r LEFT JOIN b USING (fingerprint) WHERE k > coalesce(budget, 0)""")


@query
def baseline_prune(spark, sf_dir):
    f = printed(spark, sf_dir)
    return findings.prune(findings.baseline(f), findings.baseline(f.where("offset % 3 <> 0"))).select("fingerprint", "count", "removed")


oracle("baseline_prune", f"WITH {ALL_SQL},{FP} SELECT fingerprint, count(*) FILTER (\"offset\" % 3 <> 0) AS count, count(*) FILTER (\"offset\" % 3 = 0) AS removed FROM fp GROUP BY fingerprint")


@query
def fix_apply(spark, sf_dir):
    docs, found = all_findings(spark, sf_dir)
    return findings.apply_fixes(docs, found)


@query
def fix_dry_run(spark, sf_dir):
    return findings.dry_run(all_findings(spark, sf_dir)[1])


oracle("fix_dry_run", f"WITH {ALL_SQL} SELECT doc_id, count(*) FILTER (len(s) > 0 AND kind <> 'unknown-word' AND (kind <> 'typo' OR len(s) = 1)) AS fixed, count(*) FILTER (len(s) > 0 AND (kind = 'unknown-word' OR (kind = 'typo' AND len(s) > 1))) AS skipped, count(*) FILTER (len(s) = 0) AS unfixable FROM found GROUP BY doc_id")


@query
def format_brief(spark, sf_dir):
    f = lined(spark, sf_dir)
    return f.select("doc_id", "offset", findings.brief(f).alias("line"))


oracle("format_brief", f"WITH {ALL_SQL} SELECT doc_id, \"offset\", path || ':' || line || ':' || \"column\" || ': ' || word || ' -> ' || array_to_string(s, ',') AS line FROM lined")


@query
def format_json(spark, sf_dir):
    r = findings.json_record()
    names = ("column", "fix", "kind", "length", "message", "path", "type")
    return lined(spark, sf_dir).select("doc_id", "offset", "phase", *[F.get_json_object(r, f"$.{n}").alias(n) for n in names])


MESSAGES = "CASE kind WHEN 'typo' THEN " + MESSAGE + """ WHEN 'unknown-word' THEN '`' || word || '` is not a known word' WHEN 'en-variant' THEN 'regional spelling `' || word || '` → `' || s[1] || '`'
 WHEN 'ja-variant' THEN '`' || word || '` は `' || s[1] || '` に統一 (表記ゆれ)' WHEN 'fullwidth-alnum' THEN 'fullwidth alphanumerics `' || word || '` → `' || s[1] || '`' WHEN 'halfwidth-kana' THEN 'halfwidth katakana `' || word || '` → `' || s[1] || '`'
 WHEN 'fullwidth-space' THEN 'fullwidth space (U+3000)' WHEN 'ja-compatibility' THEN 'compatibility character `' || word || '` → `' || s[1] || '`' WHEN 'ja-number-style' THEN '`' || word || '` は `' || s[1] || '` に統一 (数字表記)' ELSE '`' || word || '` は `' || s[1] || '` に統一 (句読点)' END"""
FIX = "CASE WHEN kind <> 'unknown-word' AND (kind <> 'typo' OR len(s) = 1) THEN s[1] END"
oracle("format_json", f"WITH {ALL_SQL} SELECT doc_id, \"offset\", phase, CAST(\"column\" AS VARCHAR) AS \"column\", {FIX} AS fix, kind, CAST(strlen(word) AS VARCHAR) AS length, {MESSAGES} AS message, path, 'issue' AS type FROM lined")


@query
def json_summary(spark, sf_dir):
    _, found = all_findings(spark, sf_dir)
    return findings.summary_record(findings.summary(found, _files(spark, sf_dir)))


oracle("json_summary", f"""WITH {ALL_SQL},{GUARDS} SELECT '{{"version":1,"type":"summary","issues":' || (SELECT count(*) FROM found) || ',"files_with_issues":' || (SELECT count(DISTINCT doc_id) FROM found) || ',"files_checked":' || count(*) FILTER (NOT skipped_large AND NOT skipped_binary) || ',"fixed":0,"skipped_binary":' || count(*) FILTER (skipped_binary) || ',"skipped_large":' || count(*) FILTER (skipped_large) || '}}' AS record FROM guards""")


@query
def format_github(spark, sf_dir):
    return lined(spark, sf_dir).select("doc_id", "offset", "phase", findings.github().alias("line"))


oracle("format_github", f"WITH {ALL_SQL} SELECT doc_id, \"offset\", phase, '::warning file=' || path || ',line=' || line || ',col=' || \"column\" || ',title=glyphmill [' || kind || ']::' || {MESSAGES} AS line FROM lined")


@query
def format_sarif(spark, sf_dir):
    return findings.sarif_lines(lined(spark, sf_dir))


@query
def github_escapes(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(github_escape(F.col("text"), True)).alias("prop"), F.md5(github_escape(F.col("text"), False)).alias("body"))


_E = "replace(replace(replace(text, '%', '%25'), chr(13), '%0D'), chr(10), '%0A')"
oracle("github_escapes", f"SELECT doc_id, md5(replace(replace({_E}, ':', '%3A'), ',', '%2C')) AS prop, md5({_E}) AS body FROM documents")


@query
def incremental_reuse(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("content_sha256"), F.lit("c1").alias("config_sha256"))
    cache = d.where("cast(path as bigint) % 3 <> 0").withColumn("content_sha256", F.when(F.col("path").cast("long") % 5 == 0, "stale").otherwise(F.col("content_sha256")))
    reuse, again = files.reusable(d, cache)
    return reuse.select("path", F.lit("reuse").alias("action")).unionByName(again.select("path", F.lit("check").alias("action")))


oracle("incremental_reuse", "SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 3 <> 0 AND doc_id % 5 <> 0 THEN 'reuse' ELSE 'check' END AS action FROM documents")


@query
def wordlist_parse(spark, sf_dir):
    tail = F.lit("\nc#\r\n\t# note\nTab\t\n　wide　\nmid # dle")
    v = documents(spark, sf_dir).select(F.explode(F.split(F.concat("text", tail), "\n")).alias("value"))
    return files.word_list(v)


oracle("wordlist_parse", "WITH v AS (SELECT unnest(string_split(text || chr(10) || 'c#' || chr(13) || chr(10) || chr(9) || '# note' || chr(10) || 'Tab' || chr(9) || chr(10) || '　wide　' || chr(10) || 'mid # dle', chr(10))) AS value FROM documents) SELECT DISTINCT lower(w) AS word FROM (SELECT " + trim_sql("value") + " AS w FROM v) WHERE w <> '' AND NOT starts_with(w, '#')")


@query
def corrections_parse(spark, sf_dir):
    v = documents(spark, sf_dir).select(F.concat(F.lit("w"), F.col("doc_id"), F.when(F.col("doc_id") % 4 == 0, " ").otherwise("\t"), F.lit("a"), F.col("doc_id") % 9, F.lit(" ,, b")).alias("value"))
    return files.correction_lines(v).select("typo", F.array_join("fixes", ",").alias("fixes"))


oracle("corrections_parse", "SELECT 'w' || doc_id AS typo, 'a' || (doc_id % 9) || ',b' AS fixes FROM documents WHERE doc_id % 4 <> 0")


@query
def wordlist_lint(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("value"))
    return files.lint_word_list(v)


oracle("wordlist_lint", "SELECT value, CASE WHEN b = value THEN 'duplicate' ELSE 'unsorted' END AS problem FROM (SELECT n_name AS value, lag(n_name) OVER (ORDER BY n_nationkey) AS b FROM nation) WHERE b >= value")


@query
def registry_states(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("name"), F.lit("1.0").alias("version"), F.md5("n_name").alias("sha256"), "n_nationkey")
    lock = n.where("n_nationkey % 3 <> 0").withColumn("version", F.when(F.col("n_nationkey") % 2 == 0, "0.9").otherwise("1.0"))
    return files.registry_status(n.drop("n_nationkey"), lock.drop("n_nationkey"))


oracle("registry_states", "SELECT n_name AS name, '1.0' AS version, CASE WHEN n_nationkey % 3 <> 0 THEN CASE WHEN n_nationkey % 2 = 0 THEN '0.9' ELSE '1.0' END END AS locked, CASE WHEN n_nationkey % 3 = 0 THEN 'absent' WHEN n_nationkey % 2 = 0 THEN 'outdated' ELSE 'installed' END AS state FROM nation")


# Rule files of three levels, with a folder, a rule taken back and a stronger kind of file.
TREE_RULES = [("", ".gitignore", "*.log\n/a1/b2/\n# f*\nf1?.md"), ("a0", ".gitignore", "!f3*.log\nb3/*.md"), ("a2/b1", ".ignore", "!*.log\n"), ("a1/b2", ".gitignore", "!*"), ("a1", "notes", "*")]


@query
def ignore_tree(spark, sf_dir):
    ext = F.element_at(F.array(*[F.lit(e) for e in ("md", "log", "txt", "tmp", "py")]), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat(F.lit("a"), F.col("doc_id") % 3, F.lit("/b"), F.col("doc_id") % 4, F.lit("/f"), "doc_id", F.lit("."), ext)
    rules = tree.ignore_rules(spark.createDataFrame(TREE_RULES, "folder string, name string, text string"))
    return tree.not_ignored(documents(spark, sf_dir).select("doc_id", path.alias("below")), rules)


oracle("ignore_tree", """WITH p AS (SELECT doc_id, doc_id % 3 AS a, doc_id % 4 AS b, ['md', 'log', 'txt', 'tmp', 'py'][doc_id % 5 + 1] AS ext FROM documents)
SELECT doc_id, 'a' || a || '/b' || b || '/f' || doc_id || '.' || ext AS below FROM p
WHERE NOT (a = 1 AND b = 2) AND NOT (ext = 'md' AND ((a = 0 AND b = 3) OR doc_id BETWEEN 10 AND 19))
 AND NOT (ext = 'log' AND NOT (a = 0 AND starts_with(CAST(doc_id AS VARCHAR), '3')) AND NOT (a = 2 AND b = 1))""")


@query
def list_lint(spark, sf_dir):
    """Every document as a dictionary file, a word a line: word lists, correction tables and variant tables, with faults by line."""
    word = F.posexplode(F.split("text", "[ \t\n\r]+")).alias("n", "w")
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("file"), word).withColumn("n", F.col("n").cast("long"))
    kind = F.when(F.col("file") % 3 == 0, "wordlist").when(F.col("file") % 3 == 1, "corrections").otherwise("variants")
    fix = F.concat("w", F.when(F.col("n") % 7 == 0, " ").otherwise("\t"), F.when(F.col("n") % 5 == 0, " , ").otherwise("x, y"))
    variant = F.concat("w", F.lit("\t"), F.when(F.col("n") % 4 == 0, F.col("w")).otherwise("v"))
    value = F.when(kind == "wordlist", F.col("w")).when(kind == "corrections", fix).otherwise(variant)
    base = rows.where("file % 10 = 9 and n < 5").select(F.col("w").alias("word"))
    return lists.lint_lists(rows.select("file", kind.alias("kind"), "n", value.alias("value")), base)


oracle("list_lint", f"""WITH p AS (SELECT doc_id AS file, string_split_regex(text, '[ \\t\\n\\r]+') AS p FROM documents),
r AS (SELECT file, unnest(p) AS w, generate_subscripts(p, 1) - 1 AS n FROM p),
l AS (SELECT file, n, w, {trim_sql("w || CASE file % 3 WHEN 0 THEN '' WHEN 1 THEN CASE WHEN n % 7 = 0 THEN ' ' ELSE chr(9) END || CASE WHEN n % 5 = 0 THEN ' , ' ELSE 'x, y' END ELSE chr(9) || CASE WHEN n % 4 = 0 THEN w ELSE 'v' END END")} AS e FROM r),
k AS (SELECT * FROM l WHERE e <> '' AND NOT starts_with(e, '#')),
lowered AS (SELECT *, translate(e, '{lists.UPPER}', '{lists.LOWER}') AS low FROM k),
o AS (SELECT file, n, low, lag(low) OVER (PARTITION BY file ORDER BY n) AS b FROM lowered WHERE file % 3 = 0),
c AS (SELECT file, n, contains(e, chr(9)) AS tab, {trim_sql("string_split(low, chr(9))[1]")} AS typo, {trim_sql("w")} AS own, e FROM lowered WHERE file % 3 = 1),
g AS (SELECT *, min(n) OVER (PARTITION BY file, typo) AS first FROM c WHERE tab AND typo <> '' AND n % 5 <> 0)
SELECT file, n, CASE WHEN b = low THEN 'repeated' ELSE 'unsorted' END AS problem FROM o WHERE b >= low
UNION ALL SELECT file, n, 'in-base' FROM o WHERE low IN (SELECT translate(w, '{lists.UPPER}', '{lists.LOWER}') FROM r WHERE file % 10 = 9 AND n < 5)
UNION ALL SELECT file, n, 'no-tab' FROM c WHERE NOT tab
UNION ALL SELECT file, n, 'empty' FROM c WHERE tab AND (typo = '' OR n % 5 = 0)
UNION ALL SELECT file, n, 'repeated' FROM g WHERE n > first
UNION ALL SELECT doc_id, NULL, 'no-entries' FROM documents WHERE doc_id % 3 = 1 AND text IS NOT NULL AND doc_id NOT IN (SELECT file FROM g)
UNION ALL SELECT file, n, 'bad-variant' FROM k WHERE file % 3 = 2 AND ({trim_sql("w")} = '' OR n % 4 = 0)""")


from . import review  # noqa: E402, F401 - registers its queries here

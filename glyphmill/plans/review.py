"""Named queries over findings, registries, rule files and positions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import utf16_length
from ..operators import findings, review
from ..sources import files, registry, rules
from .catalogue import ALL_SQL, ORACLES, all_findings, documents, flat, lined, oracle, query, quoted


@query
def words_triage(spark, sf_dir):
    return flat(review.triage(findings.collect_words(lined(spark, sf_dir)), "typo", 2, 20)).select("word", "count", "kind")


oracle("words_triage", f"SELECT word, count, kind FROM ({ORACLES['words_collect']}) WHERE kind = 'typo' AND count >= 2 ORDER BY count DESC, word LIMIT 20")


@query
def format_human(spark, sf_dir):
    return review.human(lined(spark, sf_dir)).select("doc_id", "offset", F.col("report_line").alias("line"))


oracle("format_human", f"""WITH {ALL_SQL}, loc AS (SELECT *, path || ':' || line || ':' || "column" AS location FROM lined)
SELECT doc_id, "offset", rpad(location, CAST((SELECT max(length(location)) FROM loc) AS INTEGER), ' ') || ': ' || word || CASE WHEN len(s) > 0 THEN ' → ' || array_to_string(s, ', ') ELSE '' END || ' [' || kind || ']' AS line FROM loc""")


@query
def first_hints(spark, sf_dir):
    return review.hints(all_findings(spark, sf_dir)[1])


oracle("first_hints", f"""WITH {ALL_SQL} SELECT kind, p.doc_id AS doc_id, p.o AS "offset", 'see the description of rule ' || kind AS hint FROM (SELECT kind, min({{'doc_id': doc_id, 'o': "offset"}}) AS p FROM found GROUP BY kind)""")


@query
def diagnostics_cap(spark, sf_dir):
    return review.capped(all_findings(spark, sf_dir)[1], 3).select("doc_id", "offset", "phase", "word")


oracle("diagnostics_cap", f"""WITH {ALL_SQL} SELECT doc_id, "offset", phase, word FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "offset", phase) AS k FROM found) WHERE k <= 3""")


@query
def normalise_every(spark, sf_dir):
    return review.same_target(all_findings(spark, sf_dir)[1])


oracle("normalise_every", f"""WITH {ALL_SQL} SELECT doc_id, kind, word, s[1] AS target, count(*) AS n, min("offset") AS first_offset FROM found WHERE len(s) > 0 GROUP BY ALL""")

@query
def range_actions(spark, sf_dir):
    """Three requests for each document: all of it, a selection and a cursor."""
    docs, found = all_findings(spark, sf_dir)
    size = F.octet_length("text").cast("long")
    spans = [(F.lit(0).cast("long"), size), (F.floor(size / 3), F.floor(size / 2)), (size - 20, size - 20)]
    wanted = F.array(*[F.struct((F.col("doc_id") * 3 + i).alias("request_id"), a.alias("start"), b.alias("end")) for i, (a, b) in enumerate(spans)])
    return review.range_actions(found, docs.select("doc_id", F.explode(wanted).alias("r")).select("doc_id", "r.*"))


oracle("range_actions", f"""WITH {ALL_SQL}, sizes AS (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size FROM docs WHERE text IS NOT NULL),
asked AS (SELECT doc_id, doc_id * 3 AS request_id, 0 AS a, size AS b FROM sizes UNION ALL SELECT doc_id, doc_id * 3 + 1, size // 3, size // 2 FROM sizes UNION ALL SELECT doc_id, doc_id * 3 + 2, size - 20, size - 20 FROM sizes),
near AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY "offset", phase, strlen(word), word) AS place, count(*) OVER () AS every FROM found JOIN asked USING (doc_id) WHERE "offset" <= b AND "offset" + strlen(word) >= a),
top AS (SELECT *, CASE WHEN kind = 'ja-variant' THEN (SELECT count(*) FROM found f WHERE f.doc_id = near.doc_id AND f.kind = near.kind AND f.word = near.word AND f.s[1] = near.s[1]) END AS same FROM near WHERE place <= 3),
acts AS (SELECT request_id, place, doc_id, "offset", word, 'change' AS action, n, s[n] AS new_text, len(s) = 1 AS preferred, 1 AS edits FROM (SELECT *, unnest(range(1, least(len(s), 5) + 1)) AS n FROM top)
 UNION ALL SELECT request_id, place, doc_id, "offset", word, 'normalise', 1, s[1], false, same FROM top WHERE kind = 'ja-variant' AND len(s) > 0
 UNION ALL SELECT request_id, place, doc_id, "offset", word, unnest(['add-project', 'add-global', 'ignore']), 1, NULL, false, 0 FROM top WHERE kind IN ('typo', 'unknown-word', 'ja-variant')
 UNION ALL SELECT request_id, place, doc_id, "offset", word, 'add-correction', 1, s[1], false, 0 FROM top WHERE len(s) > 0
 UNION ALL SELECT request_id, place, doc_id, "offset", word, unnest(['ignore-file', 'ignore-line']), 1, NULL, false, 1 FROM top)
SELECT request_id, CAST(place AS INTEGER) AS place, doc_id, "offset", CAST(strlen(word) AS BIGINT) AS len, action, CAST(n AS INTEGER) AS n, word, new_text, preferred, CAST(edits AS BIGINT) AS edits FROM acts
UNION ALL SELECT request_id, 0, doc_id, NULL, NULL, 'fix-all', 1, NULL, NULL, false, edits FROM asked JOIN (SELECT doc_id, count(*) AS edits FROM found WHERE len(s) > 0 AND kind <> 'unknown-word' AND (kind <> 'typo' OR len(s) = 1) GROUP BY doc_id) USING (doc_id)""")

@query
def findings_left(spark, sf_dir):
    """What a run that writes safe fixes reports."""
    return findings.remaining(all_findings(spark, sf_dir)[1]).select("doc_id", "offset", "phase", "word", "kind")


# Of the safe fixes of a document the next one that is taken begins no earlier than the last one ended.
oracle("findings_left", f"""WITH RECURSIVE {ALL_SQL}, every AS MATERIALIZED (SELECT doc_id, "offset", phase, word, kind, s, CAST(strlen(word) AS BIGINT) AS size FROM found),
safe AS MATERIALIZED (SELECT doc_id, {{'o': "offset", 'p': phase, 'l': size}} AS x FROM every WHERE len(s) > 0 AND kind <> 'unknown-word' AND (kind <> 'typo' OR len(s) = 1)),
taken AS (SELECT doc_id, min(x) AS x FROM safe GROUP BY doc_id UNION ALL SELECT safe.doc_id, min(safe.x) FROM taken JOIN safe ON safe.doc_id = taken.doc_id AND safe.x.o >= taken.x.o + taken.x.l GROUP BY safe.doc_id)
SELECT doc_id, "offset", phase, word, kind FROM every WHERE NOT EXISTS (SELECT 1 FROM taken WHERE taken.doc_id = every.doc_id AND taken.x.o = every."offset" AND taken.x.p = every.phase AND taken.x.l = every.size)""")


DECISIONS = [("wierd", "typo", "fix", "weird"), ("ADN", "typo", "allow", None), ("favour", "en-variant", "fix", "favor")]


@query
def decisions_apply(spark, sf_dir):
    table = spark.createDataFrame(DECISIONS, "word string, kind string, action string, choice string")
    return review.decide(all_findings(spark, sf_dir)[1], table).select("doc_id", "offset", "phase", "action", "choice")


_D = ", ".join("(" + ", ".join("NULL" if x is None else quoted(x.lower() if i == 0 else x) for i, x in enumerate(d)) + ")" for d in DECISIONS)
oracle("decisions_apply", f"""WITH {ALL_SQL}, d(w, k, action, choice) AS (VALUES {_D}) SELECT doc_id, "offset", phase, coalesce(action, 'open') AS action, choice FROM found LEFT JOIN d ON lower(word) = w AND kind = k""")


@query
def span_validity(spark, sf_dir):
    docs, found = all_findings(spark, sf_dir)
    moved = found.withColumn("at", F.col("offset") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0))
    return moved.join(docs.select("doc_id", "text").hint("merge"), "doc_id").select("doc_id", "offset", "phase", review.span_valid(F.col("text"), F.col("at"), F.col("word")).alias("valid"))


oracle("span_validity", f"""WITH {ALL_SQL}, moved AS (SELECT *, "offset" + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS a FROM lined) SELECT doc_id, "offset", phase, hex(encode(text)[a + 1:a + strlen(word)]) = hex(encode(word)) AS valid FROM moved""")


@query
def offset_positions(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("offset", F.octet_length(F.substring("text", F.lit(1), F.floor(F.char_length("text") / 2).cast("int"))).cast("long"))
    at = review.position(F.col("text"), F.col("offset"))
    return d.select("doc_id", "offset", at["line"].alias("line"), at["col"].alias("col"))


oracle("offset_positions", """WITH h AS (SELECT doc_id, text[1:length(text) // 2] AS b FROM documents) SELECT doc_id, CAST(strlen(b) AS BIGINT) AS "offset", CAST(len(string_split(b, chr(10))) AS INTEGER) AS line, CAST(strlen(string_split(b, chr(10))[-1]) AS BIGINT) AS col FROM h""")


@query
def utf16_columns(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", utf16_length(F.concat("text", F.lit("😀é𝒳"))).alias("units"))


oracle("utf16_columns", r"SELECT doc_id, CAST(length(t) + len(regexp_extract_all(t, '[\x{10000}-\x{10FFFF}]')) AS BIGINT) AS units FROM (SELECT doc_id, text || '😀é𝒳' AS t FROM documents)")


@query
def unified_diff(spark, sf_dir):
    new = F.replace("text", F.lit("e"), F.lit("E\n"))
    return documents(spark, sf_dir).select("doc_id", review.unified_diff(F.col("doc_id").cast("string"), F.col("text"), new).alias("diff"))


def _marked(x: str, mark: str) -> str:
    return f"CASE WHEN {x} = '' THEN '' WHEN ends_with({x}, chr(10)) THEN '{mark}' || replace(left({x}, length({x}) - 1), chr(10), chr(10) || '{mark}') || chr(10) ELSE '{mark}' || replace({x}, chr(10), chr(10) || '{mark}') || chr(10) || '\\ No newline at end of file' || chr(10) END"


def _lines(x: str) -> str:
    return f"(len(string_split({x}, chr(10))) - CASE WHEN {x} = '' OR ends_with({x}, chr(10)) THEN 1 ELSE 0 END)"


oracle("unified_diff", f"SELECT doc_id, '--- a/' || doc_id || chr(10) || '+++ b/' || doc_id || chr(10) || '@@ -1,' || {_lines('text')} || ' +1,' || {_lines('n')} || ' @@' || chr(10) || {_marked('text', '-')} || {_marked('n', '+')} AS diff FROM (SELECT doc_id, text, replace(text, 'e', 'E' || chr(10)) AS n FROM documents)")


@query
def fix_refused(spark, sf_dir):
    now = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("content_sha256"), "doc_id")
    seen = now.select("path", F.when(F.col("doc_id") % 4 == 1, "changed").otherwise(F.col("content_sha256")).alias("seen_sha256"))
    return seen.join(review.writable(seen, now), ["path", "seen_sha256"], "left_anti").select("path")


oracle("fix_refused", "SELECT CAST(doc_id AS VARCHAR) AS path FROM documents WHERE doc_id % 4 = 1")

IGNORE = "# built\nbuild/\n*.log\n!keep.log\n/top.txt\ndocs/**/draft.md\n"
PATHS = ["build/a.txt", "src/build/b.txt", "x/run.log", "x/keep.log", "top.txt", "src/top.txt", "docs/a/b/draft.md", "docs/draft.md", "src/buildx.txt"]


@query
def scan_ignored(spark, sf_dir):
    path = F.array(*map(F.lit, PATHS))[(F.col("doc_id") % len(PATHS)).cast("int")]
    return documents(spark, sf_dir).select("doc_id", path.alias("path")).select("doc_id", "path", rules.is_ignored(F.col("path"), rules.ignore_rules(IGNORE)).alias("ignored"))


oracle("scan_ignored", f"SELECT doc_id, [{', '.join(map(quoted, PATHS))}][doc_id % {len(PATHS)} + 1] AS path, doc_id % {len(PATHS)} IN (0, 1, 2, 4, 6, 7) AS ignored FROM documents")

DEFAULTS = ["Cargo.lock", "a/go.sum", "js/x.min.js", "js/min.js", "package-lock.json", "css/a.min.css", "yarn.lockx"]


@query
def scan_excludes(spark, sf_dir):
    path = F.array(*map(F.lit, DEFAULTS))[(F.col("doc_id") % len(DEFAULTS)).cast("int")]
    d = documents(spark, sf_dir).select("doc_id", path.alias("path"))
    for glob in files.DEFAULT_EXCLUDES:
        d = d.where(~F.col("path").rlike(files.glob_regex(glob)))
    return d


oracle("scan_excludes", f"SELECT doc_id, [{', '.join(map(quoted, DEFAULTS))}][doc_id % {len(DEFAULTS)} + 1] AS path FROM documents WHERE doc_id % {len(DEFAULTS)} IN (3, 6)")

KEYS = ["mode", "locale", "words", "exclude", "katakana-style", "max-file-size", "min-word-length", "overrides"]


@query
def key_suggestion(spark, sf_dir):
    key = F.array(*map(F.lit, KEYS))[(F.col("doc_id") % len(KEYS)).cast("int")]
    typed = F.concat(F.substring(key, F.lit(1), (F.col("doc_id") % 5).cast("int")), F.lit("x"), F.expr("substring(key, int(doc_id % 5) + 2)"))
    return documents(spark, sf_dir).select("doc_id", key.alias("key")).select("doc_id", "key", typed.alias("typed")).select("doc_id", "typed", rules.nearest_key(F.col("typed"), KEYS).alias("nearest"))


_K = ", ".join(f"({i}, {quoted(k)})" for i, k in enumerate(KEYS))
oracle("key_suggestion", f"""WITH k(i, key) AS (VALUES {_K}), t AS (SELECT doc_id, key[1:doc_id % 5] || 'x' || key[doc_id % 5 + 2:] AS typed FROM documents JOIN k ON i = doc_id % {len(KEYS)}),
b AS (SELECT doc_id, typed, arg_min(key, (levenshtein(typed, key), i)) AS key FROM t, k GROUP BY doc_id, typed) SELECT doc_id, typed, CASE WHEN levenshtein(typed, key) <= greatest(3, length(typed) // 3) THEN key END AS nearest FROM b""")

VERSIONS = ["1.0.0", "1.0", "01.2.3", "1.2.3-rc.1", "1.2.3-01", "1.2.3+b.7", "1.2.3-a..b", "v1.2.3", "10.20.30-x-y+z"]


@query
def semver_valid(spark, sf_dir):
    v = F.array(*map(F.lit, VERSIONS))[(F.col("doc_id") % len(VERSIONS)).cast("int")]
    return documents(spark, sf_dir).select("doc_id", v.alias("version")).select("doc_id", "version", registry.is_semver(F.col("version")).alias("valid"))


oracle("semver_valid", f"SELECT doc_id, [{', '.join(map(quoted, VERSIONS))}][doc_id % {len(VERSIONS)} + 1] AS version, doc_id % {len(VERSIONS)} IN (0, 3, 5, 8) AS valid FROM documents")


def _index(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    k = F.col("n_nationkey")
    return n.select(
        F.col("n_name").alias("name"),
        F.concat(F.lit("Region "), "n_regionkey").alias("description"),
        F.when(k % 2 == 0, "en").otherwise("ja").alias("language"),
        F.when(k % 3 == 0, "words").when(k % 3 == 1, "corrections").otherwise("variants").alias("kind"),
        F.when(k % 5 == 0, "1.10").otherwise("1.10.0").alias("version"),
        F.array(F.lit("1.2.0"), F.lit("1.9.0")).alias("versions"),
        F.when(k % 7 == 0, " ").otherwise("MIT").alias("license"),
        (k * 10).cast("long").alias("entries"),
    )


_I = "i AS (SELECT n_name AS name, 'Region ' || n_regionkey AS description, CASE WHEN n_nationkey % 2 = 0 THEN 'en' ELSE 'ja' END AS language, CASE n_nationkey % 3 WHEN 0 THEN 'words' WHEN 1 THEN 'corrections' ELSE 'variants' END AS kind, CASE WHEN n_nationkey % 5 = 0 THEN '1.10' ELSE '1.10.0' END AS version, ['1.2.0', '1.9.0'] AS versions, CASE WHEN n_nationkey % 7 = 0 THEN ' ' ELSE 'MIT' END AS license, n_nationkey * 10 AS entries FROM nation)"


@query
def registry_search(spark, sf_dir):
    return registry.search(_index(spark, sf_dir), "REGION 1", "en").select("name", "language", "kind")


oracle("registry_search", f"WITH {_I} SELECT name, language, kind FROM i WHERE language = 'en' AND (contains(lower(name), 'region 1') OR contains(lower(description), 'region 1'))")


@query
def registry_totals(spark, sf_dir):
    return registry.totals(_index(spark, sf_dir))


oracle("registry_totals", f"WITH {_I} SELECT kind, count(*) AS dictionaries, CAST(sum(entries) AS BIGINT) AS entries FROM i GROUP BY kind")


@query
def registry_releases(spark, sf_dir):
    return registry.releases(_index(spark, sf_dir))


oracle("registry_releases", f"WITH {_I}, e AS (SELECT name, version AS now, unnest(list_distinct(list_prepend(version, versions))) AS version FROM i) SELECT name, version, version = now AS current, CAST(row_number() OVER (PARTITION BY name ORDER BY version DESC) AS INTEGER) AS place FROM e")


@query
def release_select(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    k = F.col("n_nationkey") % 4
    wanted = n.select(F.when(k == 0, F.col("n_name")).when(k == 1, F.concat("n_name", F.lit("@1.9.0"))).when(k == 2, F.concat("n_name", F.lit("@2.0.0"))).otherwise(F.concat(F.lit("no-"), "n_name")).alias("reference"))
    return registry.select_release(_index(spark, sf_dir), wanted)


oracle("release_select", f"""WITH {_I} SELECT CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN n_name || '@1.9.0' WHEN 2 THEN n_name || '@2.0.0' ELSE 'no-' || n_name END AS reference, CASE WHEN n_nationkey % 4 = 3 THEN 'no-' || n_name ELSE n_name END AS name,
CASE n_nationkey % 4 WHEN 0 THEN version WHEN 1 THEN '1.9.0' END AS version, CASE n_nationkey % 4 WHEN 2 THEN 'no-version' WHEN 3 THEN 'no-entry' ELSE 'found' END AS state FROM nation JOIN i ON n_name = name""")


@query
def registry_lint(spark, sf_dir):
    i = _index(spark, sf_dir)
    return registry.lint(i.unionByName(i.where("kind = 'words' and language = 'en'")))


oracle("registry_lint", f"WITH {_I}, two AS (SELECT * FROM i UNION ALL SELECT * FROM i WHERE kind = 'words' AND language = 'en') SELECT name, 'duplicate-name' AS problem FROM two GROUP BY name HAVING count(*) > 1 UNION ALL SELECT name, 'bad-version' FROM two WHERE version = '1.10' UNION ALL SELECT name, 'no-license' FROM two WHERE license = ' '")


@query
def registry_verify(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("name"), F.encode("n_name", "UTF-8").alias("content"), "n_nationkey")
    lock = n.select("name", F.when(F.col("n_nationkey") % 3 == 0, "0").otherwise(F.sha2("content", 256)).alias("sha256"))
    return registry.verified(n, lock)


oracle("registry_verify", "SELECT n_name AS name, n_nationkey % 3 <> 0 AS ok FROM nation")


@query
def word_file_append(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    k = F.col("n_nationkey")
    lines = n.select(k.alias("n"), F.when(k < 2, F.concat(F.lit("# "), "n_name")).when(k == 5, "# later").otherwise(F.lower("n_name")).alias("value"))
    return registry.append_words(lines, n.where(k % 2 == 0).select(F.concat(F.lit(" "), "n_name").alias("word"))).withColumn("n", F.coalesce("n", F.lit(-1)))


oracle("word_file_append", "SELECT 0 AS section, CAST(n_nationkey AS BIGINT) AS n, '# ' || n_name AS value FROM nation WHERE n_nationkey < 2 UNION ALL SELECT 1, -1, v FROM (SELECT lower(n_name) AS v FROM nation WHERE n_nationkey >= 2 AND n_nationkey <> 5 UNION SELECT n_name FROM nation WHERE n_nationkey % 2 = 0)")

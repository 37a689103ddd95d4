"""Whole jobs of queries, and steps that must stay small on the driver."""

from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import check, english, findings, japanese, lines, suggest, tokens
from glyphmill.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_check_defaults_does_all_that_it_did(spark):
    """Regional spellings, a rule and listed katakana variants are part of the job, in code and SQL."""
    got = {(r.kind, r.phase) for r in catalogue.QUERIES["check_defaults"](spark, SF).select("kind", "phase").distinct().collect()}
    assert {("en-variant", 0), ("ja-variant", 1), ("ja-variant", 2), ("ja-variant", 3)} <= got
    assert "false" not in catalogue.ORACLES["check_defaults"].split("words JOIN pairs")[1][:40]


def test_neighbourhoods_are_not_broadcast(spark):
    """They are some 50 times as large as the words that the planner goes by."""
    frame = lambda words: spark.createDataFrame([(w,) for w in words], "word string")
    found = suggest.suggest(frame(["seperate", "cart"]), frame(["separate", "card"]))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [left" in plan and "BroadcastHashJoin" not in plan


def test_known_words_are_not_broadcast(spark, monkeypatch):
    """They grow with the corpus; lists that are handed in may be broadcast by their size."""
    plans, staged = {}, english.staged

    def watched(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return staged(df, label)

    monkeypatch.setattr(english, "staged", watched)
    frame = lambda words, name: spark.createDataFrame([(w,) for w in words], f"{name} string")
    fixes = english.corrections(spark, [("adn", "and", 1)])
    got = english.unknown(frame(["card", "carx", "qqvvx", "adn"], "key"), frame(["card"], "word"), fixes, frame(["QQVVX"], "word")).collect()
    assert [(r.key, r.kind, r.suggestions) for r in got] == [("carx", "unknown-word", ["card"])]
    assert "BroadcastHashJoin" not in plans["unknown-words"]


def test_filter_of_keys_loses_none(spark):
    frame = lambda n: spark.range(n).select(F.concat(F.lit("w"), "id").alias("key"))
    for keys, most in ((0, 1 << 26), (1, 1 << 26), (20_000, 1 << 26), (20_000, 1 << 16)):
        kept = english.may_have(frame(100_000), frame(keys), most)
        assert frame(keys).join(kept, "key", "left_anti").count() == 0
        others = kept.join(frame(keys), "key", "left_anti").count()
        assert others <= (100_000 - keys) * (0.1 if most > 1 << 16 else 0.3)


def test_rules_are_looked_up_by_whole_short_factors(spark):
    """A line is asked for the rules whose first characters it has, not for all that share two letters with it."""
    rows = spark.createDataFrame([(0, "xabcq abyabd abc")], "doc_id long, text string")
    rules = [(f"ab{c}[a-z]?", "<$0>") for c in "cdefghijklmn"] + [("(?:z|y)*", "-")]
    found = japanese.indexed_rules(rows, rules)
    got = sorted((r.offset, r.word) for r in found.collect())
    assert got == [(1, "abcq"), (8, "y"), (9, "abd"), (13, "abc")]
    assert japanese.GRAM == 3 and "(?s)(?=(...))" in found._jdf.queryExecution().optimizedPlan().toString()


def test_trimming_takes_no_regular_expression(spark):
    """It is asked several times for each line of dictionary files; all white space of Unicode goes, at the ends only."""
    blanks = "".join(c for c in map(chr, range(0x10000)) if c.isspace() and not 0x1C <= ord(c) <= 0x1F)
    rows = spark.createDataFrame([(blanks + "a" + blanks + "b" + blanks,), (blanks,), ("",), (None,), ("​x\x1c",)], "v string").select(T.trimmed(F.col("v")).alias("v"))
    assert [r.v for r in rows.collect()] == ["a" + blanks + "b", "", "", None, "​x\x1c"]
    assert "regexp" not in rows._jdf.queryExecution().optimizedPlan().toString().lower()


def test_documents_are_cut_into_words_once_for_suggestions(spark):
    """Known and unknown words come from one table of counted words."""
    files = catalogue.QUERIES["suggest_topk"](spark, SF).inputFiles()
    assert files and all("/counted-words-" in f for f in files)


def test_driver_plans_each_pass_of_a_check_alone(spark):
    """In dictionary mode what is done with findings reads them; the lines are not planned, nor checked, once more for it."""
    found = catalogue.all_findings(spark, SF)[1]
    files = found.inputFiles()
    assert files and all("/findings-" in f for f in files)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_made_once_and_cut_in_jobs_without_other_steps(spark, monkeypatch):
    """The driver plans a job anew whenever a step of it ends, and the plans that make lines and cut them into words are its largest."""
    jobs, staged = [], english.staged

    def watched(df, label):
        jobs.append((label, set(df.inputFiles()), df._jdf.queryExecution().optimizedPlan().toString()))
        return staged(df, label)

    monkeypatch.setattr(english, "staged", watched)
    monkeypatch.setattr(check, "staged", watched)
    catalogue.all_findings(spark, SF)
    of = {label: (files, plan) for label, files, plan in jobs if label != "findings"}
    words, marks = [(files, plan) for label, files, plan in jobs if label == "findings"]
    assert any("documents" in f for f in of["checked-lines"][0])
    for files, plan in (of["asked-words"], of["occurrences"], marks):
        assert "Generate" in plan and any("/checked-lines-" in f for f in files) and not any("documents" in f for f in files)
    assert "Join" not in of["asked-words"][1]
    assert of["occurrences"][1].count("Join ") == 1 and "Aggregate" not in of["occurrences"][1]
    assert "Generate" not in words[1] and "Generate" not in of["unknown-words"][1]


def test_plans_repeat_texts_and_directives_seldom(spark):
    """Where the filter on skipped lines asked whether their list is null, it brought 16 more copies of the text and all that is done to it."""
    rows = check.checked_lines(catalogue.check_docs(spark, SF, catalogue.CHECKED), catalogue.CONFIG)
    plan = tokens.words(rows.where("mode <> 'off' and not skip"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 100_000


def test_tails_are_looked_up(spark, tmp_path):
    """Rows without a number, or with one below 0, get none."""
    some = [(None, "a"), (-1, "b"), (0, "c"), (4, "d"), (7, None)]
    spark.createDataFrame(some, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = catalogue.appended(spark, str(tmp_path), ["0", "1", "2"])
    assert {(r.doc_id, r.text) for r in out.collect()} == {(None, "a"), (-1, "b"), (0, "c0"), (4, "d1"), (7, None)}
    assert "CASE WHEN" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_joins_of_findings_are_not_broadcast(spark):
    """By the size of its compressed file the planner took a table of findings for small."""
    found = spark.createDataFrame([(1, 1, 0, 0, 3, "adn", "typo", ["and"], 0)], "doc_id long, line int, col long, offset long, len long, word string, kind string, suggestions array<string>, phase int")
    docs = spark.createDataFrame([(1, "adn b")], "doc_id long, text string")
    known = spark.createDataFrame([("f", 1)], "fingerprint string, count long")
    outs = [findings.with_line_text(found, docs), findings.apply_fixes(docs, found), findings.remaining(found), findings.prune(known, known)]
    assert [len(out.collect()) for out in outs] == [1, 1, 0, 1]
    assert not any("BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString() for out in outs)


def test_words_of_a_document_are_cut_from_its_distinct_tokens(spark):
    """They are those of its lines, one row each, also where an id occurs twice or is null."""
    texts = ["don't XMLParserState read_csv_row PDFs URLs maker's 'cited' \\rhello it's0 a'' 9f86d081884c7d659a2feaa0c55ad015 x@y.z ftp://a/b out-of-date md5digest end. End: -the- //no/ up/down @at", "\u00c9t\u00e9 na\u00efve (A.B.C.) ABCs ABCDs fooBAR''s b''S '' ab. \\", None, "", "\u65e5\u672cabc\u8a9edef\r\nghi" + "q" * 5000 + " " + "aB" * 3000]
    cut = lambda d: tokens.words(lines.lines(d)).select("doc_id", F.lower("word").alias("word")).distinct()
    key = lambda rows: sorted(rows, key=str)
    for more in ([], [(0, "more don't words"), (None, "null id")]):
        d = spark.createDataFrame([*enumerate(texts), *more], "doc_id long, text string")
        got = tokens.document_words(d)
        assert key(got.collect()) == key(cut(d).collect())
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert ("Aggregate" in plan) == bool(more)
    real = spark.read.parquet(f"{SF}/documents.parquet")
    assert tokens.document_words(real).exceptAll(cut(real)).isEmpty() and cut(real).exceptAll(tokens.document_words(real)).isEmpty()


def test_tokens_without_verdicts_are_not_cut_in_lines(spark, monkeypatch):
    """The scan of the lines asks the filter first; each distinct token is cut into words once, after it was dealt out."""
    plans, staged = {}, english.staged

    def watched(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return staged(df, label)

    monkeypatch.setattr(english, "staged", watched)
    fixes, none = english.corrections(spark, [("adn", "and", 1)]), spark.createDataFrame([], "word string")
    text = spark.createDataFrame([(1, "the Adn, card. carxCard\n'adn' 12adn ADN")], "doc_id long, text string")
    got = english.english(lines.lines(text), fixes, none, known=spark.createDataFrame([("the",), ("card",)], "word string"))
    assert sorted((r.offset, r.word, r.kind) for r in got.collect()) == [(4, "Adn", "typo"), (15, "carx", "unknown-word"), (25, "adn", "typo"), (32, "adn", "typo"), (36, "ADN", "typo")]
    scan = plans["occurrences"].split("LeftSemi", 1)[1]
    assert "RLIKE(token" not in scan and "regexp_extract_all(token" not in scan
    assert "RLIKE(token" not in plans["asked-words"].split("Exchange", 1)[1]


def test_directives_are_looked_for_once_in_lines_that_have_one(spark):
    """The list of a text's directives was made four times, with all of its lines each time."""
    texts = ["a\nx glyphmill:ignore-next-line\nglyphmill:ignore-next-line\nb\nglyphmill:ignore-line\r\nglyphmill:other glyphmill:ignore-line", "glyphmill:ignore-next-line\r\n" * 3, "none\nhere", "", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = d.select("doc_id", F.sort_array(lines.skipped_of(F.col("text"))).alias("s"))
    want = {0: [2, 3, 5], 1: [1, 2, 3, 4], 2: [], 3: [], 4: []}
    assert {r.doc_id: r.s for r in got.collect()} == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(text") == 1

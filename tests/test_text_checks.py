"""Golden rows of the text checks."""

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import check, english, findings, japanese, lines, masking, suggest, tokens
from glyphmill.sources import files, rules
from glyphmill.streaming import documents as stream


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


WORDS = {
    "to be or not": "not",
    "loadFileIndex": "load File Index",
    "XMLParserState": "XML Parser State",
    "read_csv_row": "read csv row",
    "try ftp://mirror.test/pub?x=1 soon": "try soon",
    "write jo.lee@mirror.test today": "write today",
    "mask 0xC0FFEE12 fine": "mask fine",
    "sum 9f86d081884c7d659a2feaa0c55ad015 fine": "sum fine",
    "key QWxhZGRpbjpPcGVuU2VzYW1lMTIzNDU2 stop": "key stop",
    "echo \\rhello or \\vworld": "echo",
    "won't do": "won't",
    "'cited' lines": "cited lines",
    "maker's URLs and PDFs": "maker and",
    "out-of-date map": "out date map",
    "md5digest latin1word": "digest latin word",
    "漢字とwordです": "word",
}


def test_words(spark):
    got = tokens.words(lines.lines(docs(spark, *WORDS))).withColumn("col", tokens.word_column()).orderBy("doc_id", "col").collect()
    for i, (text, want) in enumerate(WORDS.items()):
        own = [r for r in got if r["doc_id"] == i]
        assert " ".join(r["word"] for r in own) == want
        assert all(text.encode()[r["col"] : r["col"] + len(r["word"])].decode() == r["word"] for r in own)


@pytest.mark.parametrize("pattern,word,want", [("adn", "and", "and"), ("Adn", "and", "And"), ("ADN", "and", "AND"), ("aDn", "and", "and"), ("語x", "été", "été")])
def test_match_case(spark, pattern, word, want):
    assert spark.range(1).select(T.match_case(F.lit(pattern), F.lit(word))).first()[0] == want


def check_words(spark, *texts, **how):
    fixes = english.corrections(spark, [("adn", "and", 1), ("wierd", "weird", 1), ("flate", "flate", 1)])
    allow = spark.createDataFrame([("mylib",)], "word string")
    return english.english(lines.lines(docs(spark, *texts)), fixes, allow, **how)


def test_english(spark):
    r = check_words(spark, "A wierd case,\nuse flate Adn.\n").orderBy("offset").collect()
    assert [(x["line"], x["col"], x["offset"], x["word"], x["suggestions"]) for x in r] == [(1, 2, 2, "wierd", ["weird"]), (2, 10, 24, "Adn", ["And"])]
    gb = check_words(spark, "the center, the centre", locale=english.locale_table(spark, "en-GB")).collect()
    assert [(x["word"], x["suggestions"]) for x in gb] == [("center", ["centre"])]
    known = spark.createDataFrame([("green",), ("field",)], "word string")
    assert [x["word"] for x in check_words(spark, "green qqvvx ABCD mylib", known=known).collect()] == ["qqvvx"]


def test_directives(spark):
    d = docs(spark, "adn\ny # glyphmill:ignore-line\nglyphmill:ignore-next-line\nadn\nadn", "glyphmill:ignore-next-line\nglyphmill:ignore-next-line\nadn", "adn glyphmill:ignore-file")
    got = {(r[0], r[1]) for r in lines.skipped_lines(lines.lines(d)).collect()}
    assert got == {(0, 2), (0, 3), (0, 4), (1, 1), (1, 2)}
    own = d.select("doc_id", F.explode(lines.skipped_of(T.byte_view(F.col("text")))).alias("line")).collect()
    assert {(r[0], r[1]) for r in own} == got and len(own) == len(got)
    assert [r[0] for r in lines.without_ignored_files(d).select("doc_id").orderBy("doc_id").collect()] == [0, 1]


def test_suggest(spark):
    known = ["grape", "gripe", "lemon", "melon", "orange", "cherries", "a"]
    asked = ["grap", "lemno", "orangge", "cherrys", "meon", "zzz", "y" * 30]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
            row = new
        return row[-1]

    want = []
    for w in asked:
        near = sorted((d, abs(len(w) - len(k)), k) for k in known if len(w) <= 24 and (d := distance(w, k)) <= (1 if len(w) <= 6 else 2))
        want += [(w, i + 1, k, d) for i, (d, _, k) in enumerate(near[:4])]
    frame = lambda x: spark.createDataFrame([(w,) for w in x], "word string")
    got = suggest.suggest(frame(asked), frame(known)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) >= 4


def ja(df):
    return sorted((r["doc_id"], r["line"], r["word"], r["suggestions"][0]) for r in df.collect())


def test_japanese(spark):
    d = docs(spark, "モデル４５６ＸＹＺを更新", "ｶﾞｲﾄﾞﾌﾞｯｸ参照", "長さは3㎝、容量は7㍑。", "ユーザーを登録する。\nユーザーを見る。\n新しいユーザを消す。")
    assert ja(japanese.fullwidth_alnum(d)) == [(0, 1, "４５６ＸＹＺ", "456XYZ")]
    assert ja(japanese.halfwidth_kana(d)) == [(1, 1, "ｶﾞｲﾄﾞﾌﾞｯｸ", "ガイドブック")]
    assert ja(japanese.compatibility(d)) == [(2, 1, "㍑", "リットル"), (2, 1, "㎝", "cm")]
    assert ja(japanese.katakana_consistency(d)) == [(3, 3, "ユーザ", "ユーザー")]
    assert ja(japanese.variants(d, japanese.katakana_table(spark, "long"))) == [(3, 3, "ユーザ", "ユーザー")]
    e = docs(spark, "取り扱いは2,500円から。取り扱いの窓口、受付。\n取扱いは二五〇〇円から．\n", "取扱いだけ。2,500円だけ。")
    assert ja(japanese.kanji_consistency(e)) == [(0, 2, "取扱い", "取り扱い")]
    assert ja(japanese.number_style(e)) == [(0, 2, "二五〇〇円", "2,500円")]
    assert ja(japanese.punctuation_style(e)) == [(0, 2, "．", "。")]
    n = japanese.numbers(docs(spark, "料金は3,200円、在庫は15件。前回は三二〇〇円。")).orderBy("offset").collect()
    assert [(r["word"], r["canonical"]) for r in n] == [("3,200円", "3200円"), ("15件", "15件"), ("三二〇〇円", "3200円")]
    assert ja(japanese.regex_rules(docs(spark, "Web ページを見る"), [("Web ?ページ", "ウェブページ")])) == [(0, 1, "Web ページ", "ウェブページ")]


def full_check(spark, rows, config):
    d = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string")
    fixes = english.corrections(spark, [("adn", "and", 1), ("wierd", "weird,wired", 1)])
    found = check.check(d, config, fixes, spark.createDataFrame([("okkk",), ("ＡＢ",)], "word string"), spark.createDataFrame([("green",)], "word string"))
    return [(r["doc_id"], r["line"], r["word"], r["kind"], r["phase"]) for r in check.ordered(found).collect()]


def test_check_masks_directives_overrides(spark):
    rows = [
        ("a.md", "`adn` adn [x](http://adn.test)\n```\nadn\n```\nadn"),
        ("b.py", "adn = 1  # adn\nx = 'adn'"),
        ("c.txt", "adn\nglyphmill:ignore-next-line\nadn\nadn glyphmill:ignore-line\nadn ＣＤ\nadn ＣＤ glyphmill:ignore-line"),
        ("d.txt", "adn glyphmill:ignore-file"),
        ("off/e.txt", "adn qqvv ＣＤ"),
        ("dict/f.txt", "green adn okkk qqvv ＣＤ ＡＢ"),
        ("off/none/g.txt", "adn ＣＤ"),
        ("h.txt", None),
        ("i.txt", ""),
    ]
    over = (check.Override("off/**", mode="off"), check.Override("dict/*", mode="dictionary"), check.Override("off/none/*", japanese=False), check.Override("b.py", profile="auto"))
    want = [
        (0, 1, "adn", "typo", 0), (0, 5, "adn", "typo", 0),
        (1, 1, "adn", "typo", 0), (1, 2, "adn", "typo", 0),
        (2, 1, "adn", "typo", 0), (2, 5, "adn", "typo", 0), (2, 5, "ＣＤ", "fullwidth-alnum", 2),
        (4, 1, "ＣＤ", "fullwidth-alnum", 2),
        (5, 1, "adn", "typo", 0), (5, 1, "qqvv", "unknown-word", 0), (5, 1, "ＣＤ", "fullwidth-alnum", 2),
    ]
    assert full_check(spark, rows, check.Config(profile="auto", overrides=over)) == want
    assert full_check(spark, rows[:2], check.Config(mode="off", japanese=False)) == []
    assert full_check(spark, [], check.Config()) == []


def test_check_of_whole_documents(spark):
    text = "ユーザー、ユーザー。\nユーザ glyphmill:ignore-line\nスライダ と スライダー と スライダー\n2,500円 と 二五〇〇円\n取扱い と 取り扱い，\n　Web ページ ㎝ ｱﾞ"
    rules = (("Web ?ページ", "ウェブページ"),)
    got = full_check(spark, [("a.txt", text), ("b.py", "'　'")], check.Config(profile="all", rules=rules))
    assert got == [
        (0, 3, "スライダ", "ja-variant", 3), (0, 4, "二五〇〇円", "ja-number-style", 5), (0, 5, "取扱い", "ja-variant", 4), (0, 5, "，", "ja-punctuation", 6),
        (0, 6, "Web ページ", "ja-variant", 1), (0, 6, "㎝", "ja-compatibility", 2), (0, 6, "ｱﾞ", "halfwidth-kana", 2), (1, 1, "　", "fullwidth-space", 2),
    ]


def test_messages_and_trimming(spark):
    m = spark.range(1).select(T.message(F.lit("typo"), F.lit("wierd"), F.array(F.lit("weird"), F.lit("wired")))).first()[0]
    assert m == "`wierd` should be one of: `weird`, `wired`"
    assert spark.range(1).select(T.trimmed(F.lit("\t\u3000 a b\r\n\xa0"))).first()[0] == "a b"
    v = spark.createDataFrame([("c#\r",), ("\t# no",), (" Tab\t",), ("tab",), ("",)], "value string")
    assert sorted(r[0] for r in files.word_list(v).collect()) == ["c#", "tab"]
    lint = spark.createDataFrame([(1, "a"), (2, "c"), (3, "b"), (4, "b"), (5, "d")], "n long, value string")
    assert sorted(map(tuple, files.lint_word_list(lint).collect())) == [("b", "duplicate"), ("b", "unsorted")]
    assert [r[0] for r in files.overlap(v.selectExpr("value as word"), spark.createDataFrame([("tab",)], "word string")).collect()] == ["tab"]


def test_collected_words(spark):
    f = spark.createDataFrame(
        [(0, 1, 5, "p/b", "Adn", "typo", ["x", "y"], 0, " later\t"), (1, 3, 9, "p/a", "adn", "typo", ["y", "z"], 0, "\tfirst " + "w" * 100), (1, 4, 12, "p/a", "adn", "typo", ["x", "y"], 0, "second"), (2, 1, 1, "p/c", "ユーザ", "ja-variant", [], 3, "c")],
        "doc_id long, line int, offset long, path string, word string, kind string, suggestions array<string>, phase int, line_text string",
    )
    got = {r["word"]: tuple(r)[1:] for r in findings.collect_words(f).collect()}
    assert got == {"adn": (3, "typo", "p/a:3: first " + "w" * 90 + "…", ["y", "z", "x"]), "ユーザ": (1, "ja-variant", "p/c:1: c", [])}


def test_result_cache(spark):
    keys = files.CACHE_KEYS
    rows = [("a", 1, "e1", 5, 10, "h", "c", "an adn"), ("b", 1, "e1", 5, 11, "h", "c", "an adn"), ("c", 1, "e1", 5, 10, "h", "c", "and ad"), ("d", 1, "e1", 5, 10, "h", "c", "clean")]
    current = spark.createDataFrame(rows, "path string, version int, engine string, size long, modified_ns long, content_sha256 string, config_sha256 string, text string")
    found = spark.createDataFrame([(p, 3, "adn") for p in "abc"], "path string, offset long, word string")
    cache = files.cache_rows(current, found).withColumn("modified_ns", F.lit(10).cast("long"))
    assert {r["path"]: len(r["findings"]) for r in cache.collect()} == {"a": 1, "b": 1, "c": 1, "d": 0}
    kept, again = files.cached_findings(current, cache)
    assert [tuple(r) for r in kept.collect()] == [("a", 3, "adn")]  # the time of b differs, the span of c does not stand
    assert sorted(r["path"] for r in again.collect()) == ["b", "c"] and again.columns == [*keys, "text"]


def test_sarif_and_summary(spark, tmp_path):
    import json

    f = spark.createDataFrame([(0, 2, 2, 10, "é.txt", "adn", "typo", ["and"], 0, "éadn"), (0, 1, 0, 0, "é.txt", "ＣＤ", "fullwidth-alnum", ["CD"], 2, "ＣＤ")], "doc_id long, line int, col long, offset long, path string, word string, kind string, suggestions array<string>, phase int, line_text string")
    findings.write_lines(findings.sarif_lines(f), ["part", "path", "offset", "phase"], str(tmp_path / "s"))
    whole = json.loads("\n".join(r[0] for r in spark.read.text(str(tmp_path / "s")).collect()))
    run = whole["runs"][0]
    assert whole["version"] == "2.1.0" and len(run["tool"]["driver"]["rules"]) == 10
    assert [(r["ruleId"], r["properties"]["word"]) for r in run["results"]] == [("fullwidth-alnum", "ＣＤ"), ("typo", "adn")]
    assert run["results"][0]["locations"][0]["physicalLocation"]["region"] == {"startLine": 1, "startColumn": 1, "endLine": 1, "endColumn": 3}
    assert json.loads("".join(r["line"] for r in findings.sarif_lines(f.limit(0)).orderBy("part").collect()))["runs"][0]["results"] == []
    counts = spark.createDataFrame([(2, 1)], "issues long, files_with_issues long")
    assert json.loads(findings.summary_record(counts).first()[0]) == {"version": 1, "type": "summary", "issues": 2, "files_with_issues": 1, "files_checked": 0, "fixed": 0, "skipped_binary": 0, "skipped_large": 0}


def test_long_documents_in_linear_time(spark):
    import time

    text = "\n".join(f"line `x{i}` [a](b)" if i % 3 else "```" for i in range(60_000))
    began = time.time()
    out = masked(spark, text, "a.md")
    assert len(out) == len(text) and out.count("\n") == 59_999 and time.time() - began < 20
    many = docs(spark, "adn " * 3000)
    fixed = findings.apply_fixes(many, findings.union([check_words(spark, "adn " * 3000)])).first()
    assert fixed["text"] == "and " * 3000 and fixed["fixed"] == 3000


def masked(spark, text, path):
    d = docs(spark, text).withColumn("path", F.lit(path))
    return d.select(masking.mask(F.col("text"), F.col("path"))).first()[0]


def test_masks(spark):
    rs = masked(spark, 'var wierd = 2; // wierd remark ü\n"say \\" y" /* 語 */ w', "a.rs")
    assert rs.strip().startswith("// wierd remark ü") and '"say \\" y"' in rs and "/* 語 */" in rs and "var" not in rs and not rs.endswith("w")
    md = "---\nauthor: Adn\n---\nText. `run wierd` and [there](http://q.t) 語\n```\ninside\n```\nbelow"
    out = masked(spark, md, "a.md")
    assert len(out.encode()) == len(md.encode()) and out.count("\n") == md.count("\n")
    assert "Adn" in out and "there" in out and "below" in out and "語" in out
    assert not any(x in out for x in ("author", "run", "http", "inside"))
    assert masked(spark, "# wierd", "a.txt") == "# wierd"


def test_fixes_are_idempotent(spark):
    d = docs(spark, "adn ４５６ＸＹＺ é adn\n", "fine")
    find = lambda x: findings.union([english.english(lines.lines(x), english.corrections(spark, [("adn", "and", 1)]), spark.createDataFrame([], "word string")), japanese.fullwidth_alnum(x)])
    once = findings.apply_fixes(d, find(d)).collect()
    assert [(r["doc_id"], r["text"], r["fixed"]) for r in once] == [(0, "and 456XYZ é and\n", 3)]
    assert find(docs(spark, once[0]["text"])).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("adn\n")
    (tmp_path / "b.bin").write_bytes(b"x\0y")
    (tmp_path / "c.lock").write_text("x")
    (tmp_path / "d.txt").write_bytes(b"bad \xff byte")
    (tmp_path / "big.txt").write_text("z" * 200)
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.read_tree(spark, str(tmp_path), most_bytes=100).collect()}
    assert set(got) == {"a.txt", "b.bin", "d.txt", "big.txt"}
    assert got["b.bin"]["skipped_binary"] and got["big.txt"]["skipped_large"] and "�" in got["d.txt"]["text"]


def test_tree_of_several_roots(spark, tmp_path):
    for name in ("one/a.txt", "one/.git/x.txt", "one/build/b.txt", "one/sub/c.log", "two/d.txt", "two/base.json", "two/cache/e.txt", "two/sub/c.log"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    ignores = rules.ignore_rules("build/\n/sub/*.log\n")
    roots = [str(tmp_path / "one"), str(tmp_path / "two")]
    got = files.read_tree(spark, roots, ignores=ignores, skipped=("base.json", "cache")).collect()
    assert sorted(r["path"].rsplit("/", 2)[1:] for r in got) == [["one", "a.txt"], ["two", "d.txt"]]
    with pytest.raises(Exception):
        files.read_tree(spark, [*roots, str(tmp_path / "none")]).collect()
    assert files.one_text(spark, "adn", "x.md").first()["path"] == "x.md"


def test_edits():
    assert stream.spliced("a😀b\nc", (0, 3), (1, 0), "X") == "a😀Xc"
    with pytest.raises(ValueError):
        stream.spliced("ab", (0, 1), (3, 0), "")


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    events = [("u1", 1, "open", "adn"), ("u1", 2, "change", "and adn adn"), ("u2", 1, "open", "adn"), ("u2", 2, "close", None)]
    spark.createDataFrame(events, "uri string, version int, event string, text string").write.json(str(src))
    seen = []
    fixes, none = english.corrections(spark, [("adn", "and", 1)]), spark.createDataFrame([], "word string")
    q = stream.watch(spark.readStream.schema("uri string, version int, event string, text string").json(str(src)), lambda d: english.english(lines.lines(d), fixes, none), lambda d, f, n: seen.extend((r["doc_id"], r["offset"]) for r in f.collect()))
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == [("u1", 4), ("u1", 8)]


def test_edited_documents_keep_their_state(spark, tmp_path):
    src, seen, rules_now = tmp_path / "in", [], [("adn", "and", 1)]
    frame = lambda rows: spark.createDataFrame(rows, stream.EVENTS).coalesce(1).write.mode("append").json(str(src))
    frame([("u1", 1, "open", "an adn\nhere", None), ("u2", 1, "change", None, [(0, 0, 0, 1, "x")])])
    none = spark.createDataFrame([], "word string")
    load = lambda: lambda d: english.english(lines.lines(d), english.corrections(spark, rules_now), none)
    sink = lambda d, f, n: seen.append(({r["doc_id"]: (r["version"], r["text"], r["problem"]) for r in d.collect()}, sorted((r["doc_id"], r["word"]) for r in f.collect())))
    q = stream.watch_edits(spark.readStream.schema(stream.EVENTS).json(str(src)), load, sink, "0 seconds")
    try:
        q.processAllAvailable()
        rules_now.append(("wierd", "weird", 1))
        frame([("u1", 3, "change", None, [(0, 0, 0, 2, "wierd"), (9, 0, 9, 0, "y")]), ("u1", 2, "change", None, [(1, 0, 1, 4, "adn")]), ("u1", 1, "change", "late", None)])
        q.processAllAvailable()
        frame([("u1", 4, "close", None, None)])
        q.processAllAvailable()
    finally:
        q.stop()
    seen = [x for x in seen if x[0]]
    assert seen[0] == ({"u1": (1, "an adn\nhere", None), "u2": (1, None, "not open")}, [("u1", "adn")])
    assert seen[1] == ({"u1": (3, "wierd adn\nadn", "line out of range")}, [("u1", "adn"), ("u1", "adn"), ("u1", "wierd")])
    assert seen[2] == ({"u1": (4, None, None)}, [])


def test_mask_queries_cover_all_documents(spark):
    from glyphmill.plans import catalogue

    sf = "/root/testdata/sf0.001"
    ids = {r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    for name, times in (("markdown_mask", 1), ("source_mask", 2)):
        got = catalogue.QUERIES[name](spark, sf).collect()
        assert {r["doc_id"] for r in got} == ids and len(got) == times * len(ids) and all(r["same_length"] for r in got)

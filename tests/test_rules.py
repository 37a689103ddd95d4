"""Rule files, settings and stream edits, by example."""

import pytest

from glyphmill.operators import lines, review
from glyphmill.sources import rules


def test_variant_rules():
    variants, found = rules.variant_rules('[variants]\n"サーバ" = "サーバー"\n[[rules]]\npattern = "a+"\nreplace = "b"\n')
    assert variants == {"サーバ": "サーバー"} and found == [("a+", "b")]
    with pytest.raises(ValueError):
        rules.variant_rules('[[rules]]\npattern = "("\nreplace = "b"\n')


def test_slashed_pattern():
    assert rules.slashed_pattern("/Web ?サイト/i") == "(?i)Web ?サイト"
    assert rules.slashed_pattern("C++") == r"C\+\+" and rules.slashed_pattern("/a/b/") == "a/b"
    with pytest.raises(ValueError):
        rules.slashed_pattern("/word/g")


def test_importers():
    assert rules.import_typos('[default.extend-words]\nteh = "the"\n[files]\nx = 1\n[default]\nlocale = "en"\n') == ({"teh": "the"}, ["default.locale", "files"])
    assert rules.import_word_settings({"version": "0.2", "words": ["a"], "ignoreWords": ["b"], "ignorePaths": ["*.x"], "flagWords": []}) == (["a", "b"], ["*.x"], ["flagWords"])


def test_empty_tables(spark):
    rows = "doc_id long, offset long, line int, col long, word string, kind string, suggestions array<string>, phase int, path string, line_text string"
    none = spark.createDataFrame([], rows)
    assert [f(none).count() for f in (review.human, review.hints, review.capped, review.same_target)] == [0, 0, 0, 0]
    decisions = spark.createDataFrame([], "word string, kind string, action string, choice string")
    one = spark.createDataFrame([(1, 0, 1, 0, "teh", "typo", [], 0, "p", "teh")], rows)
    assert review.decide(one, decisions).first()["action"] == "open"
    assert review.human(one).first()["report_line"] == "p:1:1: teh [typo]"


def test_line_starts_across_chunks(spark):
    texts = ["", "\n", "a", "\n".join("x" * (i % 7) for i in range(256)), "é\n".join("y" * (i % 5) for i in range(1500)) + "\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got: dict = {}
    for r in lines.lines(rows).orderBy("doc_id", "line").collect():
        got.setdefault(r["doc_id"], []).append(r["line_offset"])
    for i, text in enumerate(texts):
        want = [0]
        for part in text.encode().split(b"\n")[:-1]:
            want.append(want[-1] + len(part) + 1)
        assert got[i] == want


def test_factors_are_in_every_match():
    from glyphmill.operators.japanese import factor

    cases = {"Web ?ページ": "Web", "ab+c": "ab", "ab*c": "a", "(ab|cd)ef": "ef", "ab|cd": "", "[abc]d": "d", "a\\.b": "a.b", "\\bfoo\\b": "foo", "(?i)abc": "", "\\x41bc": "", "a{2,3}bc": "bc", "[(]x": "x", "(a[)]b)cd": "cd", "\\Qa|b\\E": "", "": "", "ab??c": "a", "[^]x]y": "", "(?:x(?:y)z)w": "w", "a.b": "a", "(a)\\1b": "", "日本(?=語)": "日本"}
    assert {p: factor(p) for p in cases} == cases


def test_a_thousand_rules_equal_the_loop(spark):
    import random
    import re
    import time

    from glyphmill.operators import check, japanese

    rng = random.Random(3)
    letters = "abcdあいう日本 "
    rules = [("".join(rng.choice(letters[:-1]) for _ in range(4)) + rng.choice(["", "+", "?", "[ab]", ".", "(?:本|日)"]), rng.choice(["X", "YY"])) for _ in range(990)]
    rules += [("a", "e"), ("日|本", "Z"), ("[い]う", "W"), ("(?i)AB", "v"), ("c*", "q"), ("本", "本"), ("\\.", "。"), ("う ?う", "うう"), ("😀", "x"), ("😀a", "y")]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(120))) for _ in range(60)] + ["", None, "a.b\n😀a😀b a\r\n", "ab" * 4000]
    docs = spark.createDataFrame([(i, f"{i}.txt", x) for i, x in enumerate(texts)], "doc_id long, path string, text string")
    want = []
    for i, x in enumerate(texts):
        at = 0
        for n, line in enumerate((x or "").split("\n"), 1):
            own = line.rstrip("\r")
            for p, to in rules:
                for m in re.finditer(p, own):
                    if m[0] and m[0] != re.sub(p, to, m[0]):
                        start = len(own[: m.start()].encode())
                        want.append((i, n, start, at + start, m[0], to if p != "c*" else re.sub(p, to, m[0])))
            at += len(line.encode()) + 1
    begun = time.time()
    found = japanese.indexed_rules(docs, rules)
    found._jdf.queryExecution().executedPlan()
    planned = time.time() - begun
    row = lambda r: (r.doc_id, r.line, r.col, r.offset, r.word, r.suggestions[0])
    got = sorted(map(row, found.collect()))
    assert got == sorted(want) and planned < 10
    none = spark.createDataFrame([], "typo string, fixes array<string>, allow boolean"), spark.createDataFrame([], "word string")
    some = [r for r in rules if r[0] not in ("c*",)][-12:]
    whole = check.check(docs, check.Config(mode="off", rules=tuple(some)), *none).where("phase = 1").collect()
    few = check.check(docs, check.Config(mode="off", rules=tuple(some[:6])), *none).where("phase = 1").collect() + check.check(docs, check.Config(mode="off", rules=tuple(some[6:])), *none).where("phase = 1").collect()
    assert sorted(map(row, whole)) == sorted(map(row, few)) and whole

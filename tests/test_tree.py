"""Trees with ignore files on several levels, checks that reuse results, guarded writes."""

import itertools
import os
import re

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import check, english, suggest
from glyphmill.sources import tree

RULES = {
    ("", ".gitignore"): "*.log\n!top.log\nbuild/\n/only.txt\n**/deep/*.md\nlib/**\n\\#odd\nda?a[0-2].csv\n",
    ("src", ".gitignore"): "!*.log\nsecret.txt\n!build\nsub/x.txt\n",
    ("src/sub", ".ignore"): "*.txt\n!y.txt\n",
    ("src/sub", ".gitignore"): "!x.txt\n",
    ("", ".git/info/exclude"): "*.bak\n",
}
NAMES = ["top.log", "z.log", "only.txt", "secret.txt", "x.txt", "y.txt", "a.md", "#odd", "data1.csv", "data3.csv", "n.bak"]
FOLDERS = ["", "src", "src/sub", "src/build", "build", "src/deep", "deep", "lib", "lib/in", "src/sub/build/more"]


def spoken(path):
    """What the rules say of a path, folder by folder and file by file."""

    def verdict(target, is_folder):
        for name in tree.RULE_FILES:
            for k in range(target.count("/"), -1, -1):
                folder = "/".join(target.split("/")[:k])
                for line in reversed(RULES.get((folder, name), "").split("\n")):
                    rule = tree.ignore_rule(line)
                    if rule and (is_folder or not rule[2]) and re.search(rule[0], target[len(folder) + 1 if folder else 0 :]):
                        return not rule[1]
        return False

    parts = path.split("/")
    return any(verdict("/".join(parts[:k]), True) for k in range(1, len(parts))) or verdict(path, False)


def test_nested_ignore_files(spark, tmp_path):
    paths = [f"{f}/{n}" if f else n for f, n in itertools.product(FOLDERS, NAMES)]
    kept = sorted(p for p in paths if not spoken(p))
    # by hand
    assert spoken("z.log") and not spoken("top.log") and not spoken("src/z.log") and spoken("build/a.md") and not spoken("src/build/a.md")
    assert spoken("only.txt") and not spoken("src/only.txt") and spoken("src/deep/a.md") and spoken("lib/in/a.md") and spoken("#odd") and spoken("src/data1.csv") and not spoken("data3.csv")
    assert spoken("src/sub/x.txt") and not spoken("src/sub/y.txt") and spoken("src/n.bak")
    for p in paths:
        os.makedirs(tmp_path / os.path.dirname(p), exist_ok=True)
        (tmp_path / p).write_text("text")
    for (folder, name), text in RULES.items():
        os.makedirs((tmp_path / folder / name).parent, exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    assert sorted(r.below for r in tree.read_tree(spark, str(tmp_path)).select("below").collect()) == kept
    only = sorted(r.below for r in tree.read_tree(spark, str(tmp_path), git=False).select("below").collect())
    assert "z.log" in only and "src/sub/x.txt" not in only
    rules = tree.ignore_rules(spark.createDataFrame([(f, n, t) for (f, n), t in RULES.items()], "folder string, name string, text string"))
    frame = spark.createDataFrame([(p,) for p in paths], "below string")
    assert sorted(r.below for r in tree.not_ignored(frame, rules).collect()) == kept
    assert tree.not_ignored(frame.limit(0), rules).count() == 0 and tree.not_ignored(frame, rules.limit(0)).count() == len(paths)


def tables(spark):
    return english.corrections(spark, [("wierd", "weird", 1), ("adn", "and", 1)]), spark.createDataFrame([("ok",)], "word string")


def test_tree_is_checked_once(spark, tmp_path):
    folder, cache = tmp_path / "files", str(tmp_path / "cache")
    os.makedirs(folder / "in")
    for name, text in (("a.txt", "a wierd one\nadn"), ("in/b.txt", "fine"), ("in/c.txt", "Wierd")):
        (folder / name).write_text(text)
    fixes, allow = tables(spark)
    asked = []

    def run(docs):
        asked.append(sorted(r.path.rsplit("/", 1)[1] for r in docs.select("path").collect()))
        return check.check(docs, check.Config(), fixes, allow)

    def go(settings="s1"):
        found, files = tree.check_tree(tree.read_tree(spark, str(folder)), run, cache, settings)
        return sorted((r.path.rsplit("/", 1)[1], r.offset, r.word, tuple(r.suggestions)) for r in found.collect()), sum(r.checked for r in files.collect())

    first = go()
    assert first == ([("a.txt", 2, "wierd", ("weird",)), ("a.txt", 12, "adn", ("and",)), ("c.txt", 0, "Wierd", ("Weird",))], 3)
    assert go() == (first[0], 0) and asked[-1] == []
    (folder / "in/b.txt").write_text("adn more")
    os.remove(folder / "in/c.txt")
    (folder / "d.txt").write_text("ok")
    found, checked = go()
    assert found == [("a.txt", 2, "wierd", ("weird",)), ("a.txt", 12, "adn", ("and",)), ("b.txt", 0, "adn", ("and",))]
    assert checked == 2 and asked[-1] == ["b.txt", "d.txt"]
    assert go("s2") == (found, 3)
    # a writer that died leaves a part without its last file, which nobody reads
    os.makedirs(os.path.join(cache, "generation-99"))
    assert go("s2") == (found, 0)
    assert tree.newest(spark, cache).count() == 3 and len([g for g in os.listdir(cache) if os.path.exists(os.path.join(cache, g, "_SUCCESS"))]) == 2


def test_guarded_writes(spark, tmp_path):
    for name, text in (("a.txt", "a wierd 日本 one\nadn"), ("b.txt", "adn"), ("c.txt", "adn"), ("d.txt", "fine")):
        (tmp_path / name).write_text(text)
    os.chmod(tmp_path / "a.txt", 0o640)
    fixes, allow = tables(spark)
    rows = spark.createDataFrame(tree.read_tree(spark, str(tmp_path)).collect(), tree.read_tree(spark, str(tmp_path)).schema)
    docs = rows.select(F.xxhash64("path").alias("doc_id"), "path", "text")
    found = check.check(docs, check.Config(), fixes, allow).join(docs.select("doc_id", "path"), "doc_id")
    (tmp_path / "b.txt").write_text("adn, changed")
    os.remove(tmp_path / "c.txt")
    got = {r.path.rsplit("/", 1)[1]: (r.outcome, r.fixed) for r in tree.fix_tree(rows, found).collect()}
    assert got == {"a.txt": ("written", 2), "b.txt": ("changed", 1), "c.txt": ("gone", 1)}
    assert (tmp_path / "a.txt").read_text() == "a weird 日本 one\nand" and (tmp_path / "b.txt").read_text() == "adn, changed"
    assert os.stat(tmp_path / "a.txt").st_mode & 0o777 == 0o640 and sorted(os.listdir(tmp_path)) == ["a.txt", "b.txt", "d.txt"]
    assert tree.fix_tree(rows.limit(0), found.limit(0)).count() == 0


def test_a_run_with_fixes_counts_them_in_one_scan(spark, tmp_path):
    import json

    from glyphmill.operators import findings

    root = tmp_path / "in"
    root.mkdir()
    texts = {"a.txt": "a wierd Ｗｅｂ one\nadn adn", "b.txt": "teh", "c.txt": "adn", "d.txt": "fine", "e.bin": "x\0adn", "f.txt": "adn " * 100}
    for name, text in texts.items():
        (root / name).write_text(text)
    fixes = spark.createDataFrame([("wierd", ["weird"], False), ("adn", ["and"], False), ("teh", ["the", "ten"], False)], "typo string, fixes array<string>, allow boolean")
    allow = spark.createDataFrame([], "word string")
    rows = tree.read_tree(spark, f"file://{root}", most_bytes=300)
    passes = spark.sparkContext.accumulator(0)

    def once(d):
        passes.add(1)
        (root / "c.txt").write_text("adn, changed since")
        return check.check(d, check.Config(), fixes, allow)

    left, outcomes, counts = tree.fixed_run(rows, once)
    assert {(r.path.rsplit("/", 1)[1], r.outcome) for r in outcomes.collect()} == {("a.txt", "written"), ("c.txt", "changed")}
    assert sorted((r.path.rsplit("/", 1)[1], r.word) for r in left.collect()) == [("b.txt", "teh"), ("c.txt", "adn")]
    record = json.loads(findings.summary_record(counts).collect()[0].record)
    assert record == {"version": 1, "type": "summary", "issues": 2, "files_with_issues": 2, "files_checked": 4, "fixed": 4, "skipped_binary": 1, "skipped_large": 1}
    assert (root / "a.txt").read_text() == "a weird Web one\nand and" and passes.value == 1
    left, outcomes, counts = tree.fixed_run(rows.limit(0), lambda d: check.check(d, check.Config(), fixes, allow))
    assert left.count() == 0 and outcomes.count() == 0 and set(counts.collect()[0]) == {0}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def nearest(word, known):
    if len(word) > 24:
        return []
    d = 1 if len(word) <= 6 else 2
    near = sorted({(distance(word, k), abs(len(word) - len(k)), k) for k in known if abs(len(word) - len(k)) <= d})
    return [k for n, _, k in near if n <= d][:4]


def test_unknown_words_carry_suggestions(spark):
    known = ["cart", "card", "care", "cars", "scar", "separate", "separated", "operate", "seperator", "it's", "ab", "abc", "abcde", "abcdf"]
    text = "Carx carx\nSeperate seperate unlike ABCD abce abcdeff it's cart " + "x" * 25
    fixes, allow = tables(spark)
    docs = spark.createDataFrame([(1, "a.txt", text), (2, "b.md", "carx"), (3, "c.txt", None)], "doc_id long, path string, text string")
    config = check.Config(mode="dictionary", overrides=(check.Override("*.md", mode="corrections"),))
    found = check.check(docs, config, fixes, allow, spark.createDataFrame([(w,) for w in known], "word string"))
    got = [(r.word, list(r.suggestions)) for r in check.ordered(found).collect()]
    assert {r.doc_id for r in found.collect()} == {1} and {r.kind for r in found.collect()} == {"unknown-word"}

    def cased(word):
        names = nearest(word.lower(), known)
        return [n.capitalize() for n in names] if word.istitle() else names

    assert got == [(w, cased(w)) for w in ("Carx", "carx", "Seperate", "seperate", "unlike", "abce", "abcdeff", "x" * 25)]


def test_suggestions_against_brute_force(spark):
    import random

    r = random.Random(5)
    known = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 10))) for _ in range(400)})
    asked = sorted({"".join(r.choice("abcd") for _ in range(r.randint(1, 11))) for _ in range(300)} | {"a" * 26})
    frame = lambda words: spark.createDataFrame([(w,) for w in words], "word string")
    got = {x.word: list(x.suggestions) for x in suggest.suggestion_lists(frame(asked), frame(known)).collect()}
    assert got == {w: nearest(w, known) for w in asked}


@pytest.mark.parametrize("style,want", [("consistency", 3), ("off", None), ("long", 2), ("short", 2)])
def test_katakana_forms_are_compared_in_their_style_only(spark, style, want):
    fixes, allow = tables(spark)
    docs = spark.createDataFrame([(0, "a.txt", "ユーザーとユーザとユーザー")], "doc_id long, path string, text string")
    got = check.check(docs, check.Config(katakana=style), fixes, allow).collect()
    assert {r.phase for r in got} == ({want} if want else set())


def test_switches(spark):
    fixes, allow = tables(spark)
    docs = spark.createDataFrame([(0, "a.txt", "４５ ｶﾞ ㎝ 取扱い取り扱い 1件と一件 、，")], "doc_id long, path string, text string")
    of = {"fullwidth": 2, "halfwidth": 2, "compatibility": 2, "kanji": 4, "numbers": 5, "punctuation": 6}
    every = check.check(docs, check.Config(), fixes, allow).count()
    for name in of:
        assert check.check(docs, check.Config(**{name: False}), fixes, allow).count() == every - 1
    assert check.check(docs, check.Config(**dict.fromkeys(of, False)), fixes, allow).count() == 0


def test_long_lines_like_short_ones(spark):
    import time

    fixes, allow = tables(spark)
    body = "You wierd 日 adn/Wierd_text it's, ｶﾞ モデル４５. "
    n = 500_000 // len(body.encode())

    def timed(text):
        docs = spark.createDataFrame([(0, "a.txt", text)], "doc_id long, path string, text string")
        began = time.time()
        found = check.check(docs, check.Config(), fixes, allow).select("offset", "word", "kind").collect()
        return sorted(map(tuple, found)), time.time() - began

    timed(body)
    many, short = timed((body + "\n") * n)
    one, long = timed((body + " ") * n)
    assert one == many and len(one) == 5 * n and long < 2 * short + 5
    # a token and a run without an end
    text = "wierd." * 3000 + " " + "AdnWierd" * 2000 + " adn"
    found, _ = timed(text)
    want = [(m.start(), m[0], "typo") for m in re.finditer("(?i)wierd|adn", text)]
    assert found == sorted(want)

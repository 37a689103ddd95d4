"""Lint of dictionary files by hand and over the borders of chunks."""

import random

import pytest

from glyphmill.sources import lists

SHAPE = "file string, kind string, n long, value string"


def lint(spark, files, base=()):
    rows = [(f, k, n, v) for f, (k, values) in files.items() for n, v in enumerate(values)]
    frame = spark.createDataFrame(rows, SHAPE).repartition(3)
    return sorted((r.file, -1 if r.n is None else r.n, r.problem) for r in lists.lint_lists(frame, spark.createDataFrame([(w,) for w in base], "word string")).collect())


def test_faults_of_each_kind(spark):
    files = {
        "w": ("wordlist", ["# head", "apple", " Bear ", "", None, "bear", "ant", "cat"]),
        "c": ("corrections", ["adn\tand", "#x", "no tab", "\tand", "teh\t , ", " ADN \tand, an", "thnt\tthat"]),
        "empty": ("corrections", ["# nothing", ""]),
        "v": ("variants", ["a\tb", "same\tsame", "Same\tsame", "alone", "# c\tc"]),
    }
    want = [("c", 2, "no-tab"), ("c", 3, "no-tab"), ("c", 4, "empty"), ("c", 5, "repeated"), ("empty", -1, "no-entries")]
    want += [("v", 1, "bad-variant"), ("v", 3, "bad-variant"), ("w", 5, "repeated"), ("w", 6, "unsorted"), ("w", 7, "in-base")]
    assert lint(spark, files, ["Cat", "dog"]) == sorted(want)
    assert lint(spark, {}) == []


@pytest.mark.parametrize("chunk", [1, 3, 1 << 16])
def test_order_over_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(lists, "CHUNK", chunk)
    r = random.Random(1)
    files = {f"f{k}": ("wordlist", [r.choice(["", "# c"]) if r.random() < 0.3 else r.choice("abcdef") for _ in range(20)]) for k in range(6)}
    want = []
    for f, (_, values) in files.items():
        before = None
        for n, v in enumerate(values):
            if v in ("", "# c"):
                continue
            if before is not None and before >= v:
                want.append((f, n, "repeated" if before == v else "unsorted"))
            before = v
    assert lint(spark, files) == sorted(want)

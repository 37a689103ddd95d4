"""Findings and actions of ranges against a loop over all pairs."""

import random

from glyphmill.operators import review

FOUND = "doc_id long, line int, col long, offset long, len long, word string, kind string, suggestions array<string>, phase int"


def test_ranges_against_all_pairs(spark):
    rng = random.Random(5)
    found, ranges = [], []
    for d in range(6):
        for _ in range([0, 1, 40, 200, 200, 400][d]):
            n = rng.choice([1, 5, 5, 90])  # long ones reach over bins
            found.append((d, 1, 0, rng.randrange(2000), n, f"w{rng.randrange(9):0{n}d}"[-n:], rng.choice(["typo", "ja-variant", "unknown-word"]), rng.choice([["a"], ["a", "b"], [], list("abcdefg")]), rng.randrange(3)))
    found = list({(f[0], f[3], f[8], f[4], f[5]): f for f in found}.values())  # the order of findings is total
    for i in range(300):
        a = rng.randrange(-50, 2300)
        ranges.append((i, rng.randrange(8), a, a + rng.choice([-1, 0, 0, 10, 300, 10**12])))
    ranges += [(300, 3, None, 9), (301, 3, 9, None), (302, 3, 0, 5000), (303, 3, 0, 5000)]
    got = review.range_actions(spark.createDataFrame(found, FOUND), spark.createDataFrame(ranges, "request_id long, doc_id long, start long, end long")).collect()
    near = review.in_ranges(spark.createDataFrame(found, FOUND), spark.createDataFrame(ranges, "request_id long, doc_id long, start long, end long"), size=64).collect()
    place, want = set(), set()
    for rid, d, a, b in ranges:
        own = sorted((f for f in found if f[0] == d), key=lambda f: (f[3], f[8], f[4], f[5]))
        safe = sum(bool(f[7]) and f[6] != "unknown-word" and (f[6] != "typo" or len(f[7]) == 1) for f in own)
        if safe:
            want.add((rid, 0, None, None, "fix-all", 1, None, None, False, safe))
        if a is None or b is None or a > b:
            continue
        for k, f in enumerate([f for f in own if f[3] <= b and f[3] + f[4] >= max(a, 0)][:3], 1):
            place.add((rid, k, d, f[3], f[8], f[4], f[5]))
            acts = [("change", n + 1, s, len(f[7]) == 1, 1) for n, s in enumerate(f[7][:5])]
            if f[6] == "ja-variant" and f[7]:
                acts.append(("normalise", 1, f[7][0], False, sum(g[5:7] == f[5:7] and g[7][:1] == f[7][:1] for g in own)))
            acts += [(x, 1, None, False, 0) for x in ("add-project", "add-global", "ignore")]
            acts += [("add-correction", 1, f[7][0], False, 0)] if f[7] else []
            acts += [("ignore-file", 1, None, False, 1), ("ignore-line", 1, None, False, 1)]
            want |= {(rid, k, f[3], f[4], x[0], x[1], f[5], *x[2:]) for x in acts}
    assert {(r.request_id, r.place, r.doc_id, r.offset, r.phase, r.len, r.word) for r in near} == place and len(near) == len(place)
    assert {(r.request_id, r.place, r.offset, r.len, r.action, r.n, r.word, r.new_text, r.preferred, r.edits) for r in got} == want and len(got) == len(want)

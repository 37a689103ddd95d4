"""Streams of edits: checks of silent documents after a rule change, warnings once, closed documents that leave the state."""

import os

from glyphmill.operators import english, lines
from glyphmill.streaming import documents as stream


def test_changed_rules_reach_silent_documents(spark, tmp_path):
    src, folder, seen, rules = tmp_path / "in", f"file://{tmp_path}/open", [], [("adn", "and", 1)]
    none = spark.createDataFrame([], "word string")
    put = lambda rows: spark.createDataFrame(rows, stream.EVENTS).coalesce(1).write.mode("append").json(str(src))
    load = lambda: lambda d: english.english(lines.lines(d), english.corrections(spark, rules), none)

    def sink(docs, found, number):
        rows = docs.collect()
        if rows:
            seen.append(({r.doc_id: r.problem for r in rows}, sorted((r.doc_id, r.word) for r in found.collect())))

    put([("u1", 1, "open", "wierd adn", None), ("u2", 1, "open", "Wierd", None), ("u3", 1, "open", "wierd", None), ("big", 1, "open", "adn " * 20, None)])
    q = stream.watch_edits(spark.readStream.schema(stream.EVENTS).json(str(src)), load, sink, "0 seconds", largest=40, folder=folder)
    try:
        q.processAllAvailable()
        put([("u3", 2, "close", None, None), ("big", 2, "change", "adn " * 30, None)])
        q.processAllAvailable()
        rules.append(("wierd", "weird", 1))
        put([(stream.RULES, 1, "rules", None, None)])  # nobody writes
        q.processAllAvailable()
        put([("u1", 2, "change", "fine", None), (stream.RULES, 2, "rules", None, None)])
        q.processAllAvailable()
    finally:
        q.stop()
    seen = [x for x in seen if x[0]]
    assert seen[0] == ({"u1": None, "u2": None, "u3": None, "big": "too large to check"}, [("u1", "adn")])
    assert seen[1] == ({"u3": None, "big": None}, [])  # warned once
    assert seen[2][0].keys() == {"u1", "u2", "big"} and seen[2][1] == [("u1", "adn"), ("u1", "wierd"), ("u2", "Wierd")]
    assert seen[3][0].keys() == {"u1", "u2", "big"} and seen[3][1] == [("u2", "Wierd")]
    assert sorted((r.doc_id, r.text[:4]) for r in stream.open_documents(spark, folder).collect()) == [("big", "adn "), ("u1", "fine"), ("u2", "Wier")]
    assert len(os.listdir(tmp_path / "open")) == 2


def test_closed_documents_leave_the_state(spark, tmp_path):
    import time

    src, seen = tmp_path / "in", []
    put = lambda rows: spark.createDataFrame(rows, stream.EVENTS).coalesce(1).write.mode("append").json(str(src))
    put([("u1", 5, "open", "text", None), ("u1", 6, "close", None, None), ("u2", 5, "open", "text", None)])
    rows = stream.edited(spark.readStream.schema(stream.EVENTS).json(str(src)), keep_closed="1 second")
    q = rows.writeStream.outputMode("update").foreachBatch(lambda b, n: seen.extend((r.uri, r.version, r.text) for r in b.collect())).trigger(processingTime="1 second").start()

    def until(row):
        end = time.time() + 60
        while row not in seen and time.time() < end:
            time.sleep(0.5)
        return row in seen

    try:
        assert until(("u1", 6, None)) and until(("u2", 5, "text"))
        time.sleep(8)
        put([("u1", 1, "open", "new", None), ("u2", 1, "change", "late", None)])
        assert until(("u1", 1, "new"))  # its version was forgotten, that of the open document was not
        assert ("u2", 1, "late") not in seen
    finally:
        q.stop()


def rows_until(q, seen, wanted, seconds=60):
    import time

    end = time.time() + seconds
    while not wanted(seen) and time.time() < end and q.isActive:
        time.sleep(0.2)
    return wanted(seen)


def edit_stream(spark, src, seen, **settings):
    rows = stream.edited(spark.readStream.schema(stream.EVENTS).option("maxFilesPerTrigger", 1).json(str(src)), **settings)
    return rows.writeStream.outputMode("update").foreachBatch(lambda b, n: seen.extend((r.uri, r.version, r.text, r.problem) for r in b.collect())).trigger(processingTime="200 milliseconds").start()


def test_a_burst_of_edits_gives_one_row(spark, tmp_path):
    src, seen = tmp_path / "in", []
    put = lambda rows: spark.createDataFrame(rows, stream.EVENTS).coalesce(1).write.mode("append").json(str(src))
    edit = lambda new, line=0: [(line, 0, line, 0, new)]
    put([("u", 1, "open", "text", None), ("v", 1, "open", "other", None)])
    q = edit_stream(spark, src, seen, quiet="5 seconds", longest="1 hour")
    try:
        assert rows_until(q, seen, lambda s: len(s) == 2) and sorted(x[:3] for x in seen) == [("u", 1, "text"), ("v", 1, "other")]
        for version in range(2, 6):  # each in a batch of its own
            put([("u", version, "change", None, edit(str(version)))])
        put([("u", 6, "change", None, edit("no", 9)), ("u", 3, "change", "late", None)])
        put([("v", 2, "change", None, edit("an"))])
        put([("v", 3, "save", None, None)])  # is not waited for, and takes along what waited
        assert rows_until(q, seen, lambda s: len(s) == 4)
        assert seen[2] == ("v", 3, "another", None)
        assert seen[3] == ("u", 6, "5432text", "line out of range")
        put([("u", 7, "change", "unseen", None)])
        put([("u", 8, "close", None, None)])
        assert rows_until(q, seen, lambda s: len(s) == 5) and seen[4] == ("u", 8, None, None)
    finally:
        q.stop()
    assert len(seen) == 5


def test_edits_without_end_are_not_put_off_for_ever(spark, tmp_path):
    src, seen = tmp_path / "in", []
    put = lambda rows: spark.createDataFrame(rows, stream.EVENTS).coalesce(1).write.mode("append").json(str(src))
    put([("u", 1, "open", "0", None)])
    q = edit_stream(spark, src, seen, quiet="5 seconds", longest="2 seconds", keep_closed="1 second")
    try:
        assert rows_until(q, seen, lambda s: len(s) == 1)
        version = 1
        while len(seen) < 3 and version < 60:
            version += 1
            put([("u", version, "change", str(version), None)])
        assert len(seen) >= 3 and len(seen) < version and all(str(v) == t for _, v, t, _ in seen[1:])
        put([("u", 99, "close", None, None)])
        assert rows_until(q, seen, lambda s: s[-1][:3] == ("u", 99, None))
    finally:
        q.stop()

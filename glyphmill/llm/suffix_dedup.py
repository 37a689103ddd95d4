"""Operator 1, removal of repeated byte strings by suffix arrays of candidate segments.

1. Every ``span``-byte window of a text belongs to an anchor: the leftmost of its 32-byte strings with the
   least hash.  Equal windows have equal anchors at equal places, so a window can repeat only where
   its anchor's hash occurs twice.  Consecutive windows with one anchor make a segment; it is known by
   the anchor's hash and a hash of all its bytes.
2. Segments meet by anchor hash.  Of identical segments all but the first repeat whole (those found in
   one task never leave it); of an anchor with one distinct segment nothing more can repeat, since no
   window occurs twice in a segment.  Only anchors whose distinct segments differ need comparison.
3. An anchor whose distinct segments are larger than a shard is split: its segments are cut again, by
   64-byte strings, and meet once more as in 2.
4. The bytes of the segments left go to shards by anchor hash.  A shard's segments make one string in a
   file, which external induced sorting turns into its suffix array with common-prefix values; suffixes
   that share at least ``span`` bytes are one window each, and all but the earliest occurrence repeat.
5. Repeated windows of a document are merged into the runs of bytes that go.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, bytes_of, grouped, key_runs, mix64, partitions, staged, table
from .induced_sort import mapped, spans, suffix_array
from .words import powers

ANCHORS = (32, 64)  # bytes; the second splits the anchors that are too frequent
PIECE = 1 << 16  # window starts handled at once; longer texts are cut, with overlap
SEGMENT = np.dtype([("h", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("st", "<u4"), ("n", "<u4")])
SHARD_BYTES = 2 << 20  # on average; a shard of any size is sorted within SORT_BYTES and its files
SORT_BYTES = 1 << 20  # of queued tuples in memory, beyond which they go to a file
_CODES = mix64(np.arange(1, 257, dtype=U64) * U64(0xA24BAED4963EE407))


def segments(raw: bytes, span: int, anchor: int = ANCHORS[0]) -> np.ndarray:
    """Segments of one text: anchor hash, content hash, first window, number of windows."""
    out = []
    for a in range(0, len(raw) - span + 1, PIECE):
        buf = np.frombuffer(raw, np.uint8)[a : a + PIECE + span - 1]
        up, down = powers(len(buf) + 1)
        total = np.zeros(len(buf) + 1, U64)
        np.cumsum(_CODES[buf] * up[: len(buf)], out=total[1:])
        h = mix64((total[anchor:] - total[:-anchor]) * down[: len(buf) - anchor + 1])
        m = (h & ~U64(0xFFFFF)) | np.arange(len(h), dtype=U64)
        width, s = span - anchor + 1, 1
        while 2 * s <= width:
            m = np.minimum(m[:-s], m[s:])
            s *= 2
        if width > s:
            m = np.minimum(m[: s - width], m[width - s :])
        at = (m & U64(0xFFFFF)).astype(np.int64)
        cut = np.flatnonzero(at[1:] != at[:-1]) + 1
        first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(at)]))
        end = last + span - 1
        part = np.zeros(len(first), SEGMENT)
        part["h"] = h[at[first]]
        part["c"] = mix64((total[end] - total[first]) * down[first] + (end - first).astype(U64))
        part["st"], part["n"] = first + a, last - first
        out.append(part)
    return np.concatenate(out) if out else np.zeros(0, SEGMENT)


def joined(part: np.ndarray) -> np.ndarray:
    """Window runs (doc, st, n) with those that touch made one."""
    if not len(part):
        return part
    part = part[np.lexsort((part["st"], part["doc"]))]
    new = np.ones(len(part), bool)
    new[1:] = (part["doc"][1:] != part["doc"][:-1]) | (part["st"][1:] != part["st"][:-1] + part["n"][:-1])
    first = np.flatnonzero(new)
    out = part[first].copy()
    out["n"] = np.add.reduceat(part["n"].astype(np.int64), first)
    return out


def first_of_each(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first of identical segments, the others), sorted by anchor."""
    part = part[np.lexsort((part["st"], part["doc"], part["c"], part["h"]))]
    new = np.ones(len(part), bool)
    new[1:] = (part["h"][1:] != part["h"][:-1]) | (part["c"][1:] != part["c"][:-1])
    return part[new], part[~new]


STRETCH = 4096  # window starts
FETCHED = ["shard", "place", "text", "doc", "st", "h", "n"]
ROWS = "kind int, bucket long, doc long, st long, n long, h long, blob binary"


def rows(kind: int, part: np.ndarray) -> pa.RecordBatch:
    k = len(part)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(k, kind, np.int32)), pa.array((part["doc"] * 31 + part["st"]).astype(np.int64) & 0x3FF), pa.array(part["doc"].astype(np.int64)), pa.array(part["st"].astype(np.int64)), pa.array(part["n"].astype(np.int64)), pa.array(part["h"].astype(U64).view(np.int64)), pa.nulls(k, pa.binary())],
        [x.split()[0] for x in ROWS.split(", ")],
    )


def packed(part: np.ndarray) -> bytes:
    """Columns one after another, which compress better than records."""
    return b"".join(np.ascontiguousarray(part[f]).tobytes() for f in SEGMENT.names)


def unpacked(raw: bytes) -> np.ndarray:
    k, at = len(raw) // SEGMENT.itemsize, 0
    out = np.empty(k, SEGMENT)
    for f in SEGMENT.names:
        out[f] = np.frombuffer(raw, SEGMENT[f], k, at)
        at += k * SEGMENT[f].itemsize
    return out


class Shard:
    """A shard's segments as one string in a file: bytes plus 2, 1 after each segment, 0 at the end."""

    def __init__(self):
        self.string, self.places = tempfile.TemporaryFile(), tempfile.TemporaryFile()

    def add(self, place: np.ndarray, text: bytes, span: int) -> None:
        """Segments of n + span - 1 bytes each; ``place`` has rows of document, first window and n."""
        size = place[2] + span - 1
        out = np.ones(len(text) + len(size), "<i2")
        out[np.arange(len(text)) + np.repeat(np.arange(len(size)), size)] = np.frombuffer(text, np.uint8).astype("<i2") + 2
        self.string.write(out.tobytes())
        self.places.write(np.ascontiguousarray(place.T, "<i8").tobytes())

    def repeated(self, span: int, budget: int = SORT_BYTES):
        """Runs of windows that repeat an earlier window, in parts."""
        self.string.write(b"\0\0")
        for f in (self.string, self.places):
            f.flush()
        string = np.asarray(np.memmap(self.string, "<i2", "r"))
        place = np.asarray(np.memmap(self.places, "<i8", "r")).reshape(-1, 3)
        at = np.cumsum(place[:, 2] + span) - (place[:, 2] + span)
        sa, lcp, _ = suffix_array(string, span, budget)
        block, marked = max(256, budget // 64), mapped(len(string), "?")
        groups, least = 0, np.zeros((0, 4), np.int64)  # the last group's first window so far
        for a, b in spans(len(sa), block):
            group = groups + np.cumsum(lcp[a:b] < span)
            groups = int(group[-1])
            own = np.searchsorted(at, sa[a:b], "right") - 1
            off = sa[a:b] - at[own]
            ok = off < place[own, 2]
            rows = np.concatenate((least, np.stack((group[ok], place[own[ok], 0], place[own[ok], 1] + off[ok], sa[a:b][ok]), 1)))
            rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
            first = np.ones(len(rows), bool)
            first[1:] = rows[1:, 0] != rows[:-1, 0]
            least = rows[first & (rows[:, 0] == groups)]
            marked[rows[~first, 3]] = True
        for a, b in spans(len(marked), 1 << 20):
            again = np.flatnonzero(marked[a:b]) + a
            own = np.searchsorted(at, again, "right") - 1
            out = np.zeros(len(again), SEGMENT)
            out["doc"], out["st"], out["n"] = place[own, 0], place[own, 1] + again - at[own], 1
            yield joined(out)

    def close(self) -> None:
        self.string.close()
        self.places.close()


def numbered(docs: DataFrame) -> DataFrame:
    """(id, doc_id, text) with distinct ids in order of doc_id; doc_id itself where it is distinct."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if own.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return own.select(F.col("doc_id").alias("id"), "doc_id", "text")
    ordered = own.orderBy("doc_id", "text")
    return staged(ordered.select(F.monotonically_increasing_id().alias("id"), "doc_id", "text"), "numbered")


def suffix_dedup(docs: DataFrame, span: int = 100, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, binary).

    A byte goes when a string of ``span`` bytes that covers it also starts earlier: in a smaller doc_id, or before
    in the same document; strings may overlap, do not cross documents and are judged on the input.
    Null text counts as empty; texts shorter than ``span`` bytes stay whole.  Rows with the same doc_id, and
    rows without one (which come first), count as documents in order of their text.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    own = numbered(docs)
    parts = partitions(spark)
    buckets = 16 * parts

    def dealt(held):
        if not held:
            return
        reps, again = first_of_each(np.concatenate(held))
        held.clear()
        again = joined(again)
        for a in range(0, len(again), 1 << 16):
            yield rows(1, again[a : a + (1 << 16)])
        bucket = (mix64(reps["h"]) % U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        reps, bucket = reps[order], bucket[order]
        cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        each = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
        for k in range(0, len(each), 256):
            some = each[k : k + 256]
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(some), np.int32)), pa.array([int(bucket[a]) for a, _ in some], pa.int64()), none, none, none, none, pa.array([packed(reps[a:b]) for a, b in some], pa.binary())],
                [x.split()[0] for x in ROWS.split(", ")],
            )

    def anchored(batches):
        held = []
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1))):
                part = segments(raw, span)
                part["doc"] = i
                held.append(part)
        yield from dealt(held)

    def anchored_again(batches):
        held = []
        for batch in batches:
            doc, st, h = (batch.column(k).to_pylist() for k in range(3))
            for i, p, x, raw in zip(doc, st, h, batch.column(3).to_pylist()):
                part = segments(raw, span, min(ANCHORS[1], span))
                part["doc"], part["st"] = i, part["st"] + np.uint32(p)
                part["h"] = mix64(part["h"] ^ U64(x & (2**64 - 1)))
                held.append(part)
        yield from dealt(held)

    def met(batches):
        for _, t in grouped(batches, "bucket"):
            kind = t.column("kind").to_numpy()
            if (kind == 1).any():
                yield from t.filter(pa.array(kind == 1)).combine_chunks().to_batches()
            raw = t.filter(pa.array(kind == 0)).column("blob").to_pylist()
            if not raw:
                continue
            reps, again = first_of_each(np.concatenate([unpacked(x) for x in raw]))
            if len(again):
                yield rows(1, again)
            new = np.concatenate(([True], reps["h"][1:] != reps["h"][:-1]))
            group = np.cumsum(new) - 1
            many = np.bincount(group)[group] > 1
            hot = many & (np.bincount(group, reps["n"] + float(span - 1))[group] > SHARD_BYTES)
            for k, some in ((2, many & ~hot), (3, hot)):
                if some.any():
                    yield rows(k, reps[some])

    def meet(pieces: DataFrame, label: str) -> DataFrame:
        dealt_out = pieces.repartition(parts, "bucket").sortWithinPartitions("bucket")
        return staged(dealt_out.mapInArrow(met, ROWS).drop("bucket", "blob"), label)

    def shards_of(asked: DataFrame) -> int:
        return max(1, (asked.agg(F.sum(F.col("n") + span - 1)).first()[0] or 0) // SHARD_BYTES)

    def to_shards(cols: dict[int, list]):
        for shard, (doc, st, n, text) in cols.items():
            yield pa.RecordBatch.from_pydict({"shard": [shard], "place": [np.array([doc, st, n], "<i8").tobytes()], "text": [b"".join(text)]})

    found = meet(own.select("id", "text").mapInArrow(anchored, ROWS), "segments")
    asked = found.where("kind > 1")
    hot, shards = not found.where("kind = 3").isEmpty(), shards_of(found.where("kind = 2"))

    def fetched(batches):
        for batch in batches:
            cols: dict[int, list] = {}
            apart: list[tuple] = []
            for i, raw, want in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1)), batch.column(2).to_pylist()):
                for w in want:
                    text = raw[w["st"] : w["st"] + w["n"] + span - 1]
                    if w["kind"] == 3:
                        apart.append((i, w["st"], w["h"], w["n"], text))
                        continue
                    held = cols.setdefault(int(w["h"] & (2**63 - 1)) % shards, [[], [], [], []])
                    for k, x in enumerate((i, w["st"], w["n"], text)):
                        held[k].append(x)
            for b in to_shards(cols):
                none = pa.nulls(b.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*b.columns, none, none, none, none], FETCHED)
            if apart:
                doc, st, h, n, text = zip(*apart)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(doc), pa.int64()), pa.nulls(len(doc), pa.binary()), pa.array(text, pa.binary()), *(pa.array(x, pa.int64()) for x in (doc, st, h, n))], FETCHED)

    want = asked.groupBy(F.col("doc").alias("id")).agg(F.collect_list(F.struct("st", "n", "h", "kind")).alias("want"))
    pieces = own.select("id", "text").join(want, "id").mapInArrow(fetched, "shard long, place binary, text binary, doc long, st long, h long, n long")
    if hot:  # the texts of these segments are at hand from here on
        pieces = staged(pieces, "pieces")
        apart = pieces.where("shard is null").select("doc", "st", "h", "text", "n")
        split = meet(apart.mapInArrow(anchored_again, ROWS), "split-segments")
        found = found.unionByName(split)
        again = split.where("kind > 1").select("doc", "st", "n", "h")
        more = shards_of(again)

        def cut(batches):
            for batch in batches:
                cols: dict[int, list] = {}
                for i, p, n, h, base, text in zip(*(c.to_pylist() for c in batch.columns)):
                    held = cols.setdefault(shards + int(h & (2**63 - 1)) % more, [[], [], [], []])
                    for k, x in enumerate((i, p, n, text[p - base : p - base + n + span - 1])):
                        held[k].append(x)
                yield from to_shards(cols)

        # a segment lies in one piece, found by the stretches of the document that the piece covers
        stretch = F.explode(F.sequence(F.floor(F.col("st") / STRETCH), F.floor((F.col("st") + F.col("n") - 1) / STRETCH))).alias("stretch")
        whole = apart.select("doc", F.col("st").alias("base"), (F.col("st") + F.col("n")).alias("end"), "text", stretch)
        inner = again.withColumn("stretch", F.floor(F.col("st") / STRETCH)).join(whole, ["doc", "stretch"]).where("st >= base and st < end")
        inner = inner.select("doc", "st", "n", "h", "base", "text").mapInArrow(cut, "shard long, place binary, text binary")
        pieces = pieces.where("shard is not null").select("shard", "place", "text").unionByName(inner)
        shards += more

    def sorted_(batches):
        def repeats(one: Shard):
            for again in one.repeated(span):
                for a in range(0, len(again), 1 << 16):
                    part = again[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(part["doc"].astype(np.int64)), pa.array(part["st"].astype(np.int64)), pa.array(part["n"].astype(np.int64))], ["doc", "st", "n"])
            one.close()

        at, one = None, None
        for shard, t in key_runs(batches, "shard"):
            if one is not None and shard != at:
                yield from repeats(one)
                one = None
            at, one = shard, one or Shard()
            for place, text in zip(t.column("place").to_pylist(), t.column("text").to_pylist()):
                one.add(np.frombuffer(place, "<i8").reshape(3, -1), text, span)
        if one is not None:
            yield from repeats(one)

    compared = pieces.select("shard", "place", "text").repartition(min(parts, shards), "shard").sortWithinPartitions("shard").mapInArrow(sorted_, "doc long, st long, n long")
    marks = found.where("kind = 1").select("doc", "st", "n").unionByName(compared)
    marks = marks.groupBy(F.col("doc").alias("id")).agg(F.collect_list(F.struct("st", "n")).alias("marks"))

    def cleaned(batches):
        for batch in batches:
            out = []
            for i, raw, got in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1)), batch.column(2).to_pylist()):
                ranges = sorted((m["st"], m["st"] + m["n"] - 1 + span) for m in got or ())
                kept, at, end, removed, runs = [], 0, -1, 0, 0
                for a, b in ranges:
                    if a > end:
                        kept.append(raw[at:a])
                        runs += 1
                        removed += b - a
                        at = end = b
                    elif b > end:
                        removed += b - end
                        at = end = b
                kept.append(raw[at:])
                rest = b"".join(kept)
                out.append((i, len(raw), removed, runs, hashlib.sha256(rest).hexdigest(), rest if with_text else None))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    whole = own.join(marks, "id", "left").select("doc_id", "text", "marks").mapInArrow(cleaned, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return whole if with_text else whole.drop("kept")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))

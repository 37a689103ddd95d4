"""Operator 10, benchmark decontamination under edit distance.

An item of m words is found in a document when a passage differs from it by at most ``1 - similarity``
of m word edits.  Items and item-sized windows of the documents are embedded by CGK random walks: a
string of symbols becomes one of three times its length, in which each step repeats the current symbol or goes
on to the next as a random function of step and symbol says; edit distance becomes Hamming distance.
Bit-sampling LSH deals the embedded items into buckets: each table looks at a few sampled positions of one
walk, and a bucket is what is found there.  Windows look their buckets up in every table, and the
items that they meet there are their candidates; nothing else is.  The number of tables is raised until
simulated passages at the threshold reach the target recall.  Candidates are verified by exact edit distance.

Not every window is embedded.  If a passage matches an item, some run of the item's words is unchanged, by
the pigeonhole rule one of at least ``ceil((m - k) / (k + 1))`` words; and k edits spoil at most k * n of its n-grams.  So
a window is embedded only if at least m - n + 1 - k * n of its n-grams (of that length, three words at
most) occur in items of its size, in whatever of them.  This loses nothing and does not say which item it may be.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, mix64, numbered, shared_dir, store, table, texts_of
from .words import combined, hashed, in_blocks

SAMPLED = 3
SIMULATED_WORDS = 512  # passages of longer items are simulated with this length
SHAPE = "doc_id long, item_id long, edit_distance long, item_words long, similarity double, word_at long, row_number long"
PAD = U64(0)
CELLS = 1 << 20  # of a matrix of windows
HELD_BYTES = 64 << 20  # of texts that meet a block of items at once


def allowed(m: np.ndarray | int, similarity: float):
    return np.floor((1 - similarity) * np.asarray(m) + 1e-9).astype(np.int64)


def embed(words: np.ndarray, lens: np.ndarray, walk: int, steps: int) -> np.ndarray:
    """CGK embeddings: ``words`` is (strings x width), padded with PAD beyond ``lens``."""
    n = len(words)
    wide = np.concatenate((words, np.full((n, 1), PAD, U64)), 1)
    rows, at = np.arange(n), np.zeros(n, np.int64)
    out = np.empty((steps, n), U64)
    for t in range(steps):
        x = wide[rows, np.minimum(at, lens)]
        out[t] = x
        salt = U64((0x9E3779B97F4A7C15 * (walk * 100_003 + t + 1)) & (2**64 - 1))
        at += (mix64(x ^ salt) >> U64(63)).astype(np.int64)
    return out.T


class Tables:
    """Sampled positions of each table, as fractions of the embedding's length, and the walk that it looks at."""

    def __init__(self, tables: int, seed: int = 11):
        self.n, self.walks = tables, max(4, tables // 32)
        self.draws = np.random.default_rng(seed).random((tables, SAMPLED))
        self.salt = mix64(np.arange(1, tables + 1, dtype=U64) * U64(0xA24BAED4963EE407))

    def buckets(self, words: np.ndarray) -> np.ndarray:
        """(strings x tables) keys of the buckets of strings of one length."""
        n, m = words.shape
        at, out = (self.draws * (3 * m)).astype(np.int64), np.empty((n, self.n), U64)
        for w in range(self.walks):
            own = embed(words, np.full(n, m), w, 3 * m)
            for t in range(w, self.n, self.walks):
                key = np.full(n, self.salt[t], U64)
                for p in at[t]:
                    key = mix64(key * U64(0xD1342543DE82EF95) + own[:, p])
                out[:, t] = key
        return out


def tables_for(recall: float, similarity: float, lengths: list[int]) -> Tables:
    """The fewest tables (by doubling) whose recall on random edits at the threshold is ``recall``, at each length."""
    rng = np.random.default_rng(17)
    trials = []
    for m in sorted({min(int(x), SIMULATED_WORDS) for x in lengths}):
        k = int(allowed(m, similarity))
        a, b = np.empty((150, m), U64), np.empty((150, m), U64)
        for i in range(150):
            x = rng.integers(1, 2**62, m).astype(U64)
            y = x.copy()
            for _ in range(k):  # substitutions, insertions and deletions
                p, kind = rng.integers(0, max(1, len(y))), rng.integers(0, 3)
                new = rng.integers(1, 2**62, 1).astype(U64)
                y = np.concatenate((y[:p], new if kind < 2 else y[:0], y[p + (kind != 1) :]))
            a[i], b[i] = x, np.concatenate((y, rng.integers(1, 2**62, k).astype(U64)))[:m]  # a window has the item's size
        trials.append((a, b))
    n = 8
    while True:  # each walk and table has a chance of its own to meet, so this ends
        tables = Tables(n)
        if all((tables.buckets(a) == tables.buckets(b)).any(1).mean() >= recall for a, b in trials):
            return tables
        n *= 2


def edit_distances(items: np.ndarray, m: int, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least word edits that turn the item (rows of m words) into some substring of the region, and
    the end of that substring.  Rows of regions are padded with PAD, which equals no word."""
    n, width = regions.shape
    ramp = np.arange(width + 1)
    row = np.zeros((n, width + 1), np.int64)
    for i in range(m):
        diff = (regions != items[:, i : i + 1]) | (regions == PAD)
        nxt = np.empty_like(row)
        nxt[:, 0] = i + 1
        nxt[:, 1:] = np.minimum(row[:, :-1] + diff, row[:, 1:] + 1)
        row = np.minimum.accumulate(nxt - ramp, axis=1) + ramp
    return row.min(1), row.argmin(1)


class Benchmark:
    """The n-grams of the items and, for each length, their buckets."""

    def __init__(self, ids: list[int], texts: list[str], similarity: float, tables: Tables):
        h, bounds = hashed(texts)
        keep = [i for i in range(len(ids)) if bounds[i + 1] > bounds[i]]
        self.tables = tables
        self.ids = np.array([ids[i] for i in keep], np.int64)
        self.words = [np.where(h[bounds[i] : bounds[i + 1]] == PAD, U64(1), h[bounds[i] : bounds[i + 1]]) for i in keep]
        self.m = np.array([len(w) for w in self.words], np.int64)
        self.k = allowed(self.m, similarity)
        self.grams: dict[int, tuple] = {}
        self.buckets: dict[int, tuple] = {}
        size = np.minimum(3, np.maximum(1, -(-(self.m - self.k) // (self.k + 1))))
        for n in sorted(set(size.tolist())):
            lengths = sorted({(int(m), int(k)) for m, k in zip(self.m[size == n], self.k[size == n])})
            which = {m: i for i, (m, _) in enumerate(lengths)}
            own = [(combined(self.words[i], n), which[int(self.m[i])]) for i in np.flatnonzero(size == n)]
            pairs = np.unique(np.array(list(zip(np.concatenate([g for g, _ in own]), np.concatenate([np.full(len(g), i, U64) for g, i in own])))), axis=0)
            g, first = np.unique(pairs[:, 0], return_index=True)
            near = np.zeros(1 << 22, bool)
            near[(g >> U64(42)).astype(np.int64)] = True
            self.grams[n] = (g, np.append(first, len(pairs)), pairs[:, 1].astype(np.int64), near, lengths)
        for m in sorted(set(self.m.tolist())):
            own = np.flatnonzero(self.m == m)
            words = np.stack([self.words[i] for i in own])
            rows = max(1, CELLS // (3 * m))
            keys = np.concatenate([tables.buckets(words[a : a + rows]) for a in range(0, len(own), rows)]).ravel()
            order = np.argsort(keys, kind="stable")
            self.buckets[m] = (keys[order], np.repeat(own, tables.n)[order])

    def windows(self, h: np.ndarray, bounds: np.ndarray):
        """(m, k, first words of windows) of the windows that are looked up."""
        for n, (grams, first, length, near, lengths) in self.grams.items():
            g = combined(h, n)
            p = np.flatnonzero(near[(g >> U64(42)).astype(np.int64)]) if len(g) else np.zeros(0, np.int64)
            at = np.minimum(np.searchsorted(grams, g[p]), len(grams) - 1)
            doc = np.searchsorted(bounds, p, "right") - 1
            ok = (grams[at] == g[p]) & (p + n <= bounds[doc + 1])
            p, at = p[ok], at[ok]
            times = first[at + 1] - first[at]
            which = length[np.repeat(first[at] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
            hits = np.repeat(p, times)
            order = np.argsort(which, kind="stable")
            cuts = np.searchsorted(which[order], np.arange(len(lengths) + 1))
            for (m, k), x, y in zip(lengths, cuts[:-1], cuts[1:]):
                c = m - n + 1 - k * n
                q = hits[order[x:y]]
                if len(q) < c:
                    continue
                # windows with the hits i to i + c - 1: they begin after the last one less what follows it, and not after the first
                doc = np.searchsorted(bounds, q, "right") - 1
                head, tail = q[: len(q) - c + 1], q[c - 1 :]
                ok = (doc[: len(q) - c + 1] == doc[c - 1 :]) & (tail - head <= m - n)
                low, high = bounds[doc[c - 1 :][ok]], bounds[doc[c - 1 :][ok] + 1]
                begin, end = np.maximum(tail[ok] - (m - n), low), np.minimum(head[ok], high - (m - k)) + 1
                begin = np.maximum(begin, np.concatenate(([0], np.maximum.accumulate(end)[:-1]))[: len(end)])
                size = np.maximum(end - begin, 0)
                if size.any():
                    yield m, k, np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())

    def search(self, h: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, words of the item, first word of the passage), the best for each pair."""
        h, best = np.where(h == PAD, U64(1), h), {}
        for m, k, all_ in self.windows(h, bounds):
            keys, items = self.buckets[m]
            met = []
            rows = max(1, CELLS // (3 * m))
            for a in range(0, len(all_), rows):
                at = all_[a : a + rows]
                doc = np.searchsorted(bounds, at, "right") - 1
                place = at[:, None] + np.arange(m)
                asked = self.tables.buckets(np.where(place < bounds[doc + 1][:, None], h[np.minimum(place, len(h) - 1)], PAD))
                low, high = np.searchsorted(keys, asked.ravel(), "left"), np.searchsorted(keys, asked.ravel(), "right")
                times = high - low
                which = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
                row = np.repeat(np.repeat(np.arange(len(at)), self.tables.n), times)
                # windows of one item that begin within k words of each other are verified as one
                met.append(np.stack([doc[row], items[which], at[row] // (k + 1)], 1))
            met = np.unique(np.concatenate(met), axis=0) if met else np.zeros((0, 3), np.int64)
            wide = m + 4 * k + 1
            rows = max(1, CELLS // wide)
            for a in range(0, len(met), rows):
                doc, item, first = met[a : a + rows, 0], met[a : a + rows, 1], met[a : a + rows, 2] * (k + 1) - k
                place = first[:, None] + np.arange(wide)
                inside = (place >= bounds[doc][:, None]) & (place < bounds[doc + 1][:, None])
                region = np.where(inside, h[np.clip(place, 0, len(h) - 1)], PAD)
                d, end = edit_distances(np.stack([self.words[i] for i in item]), m, region)
                for r in np.flatnonzero(d <= k):
                    key = (int(doc[r]), int(item[r]))
                    got = (int(d[r]), max(0, int(first[r] + end[r] - m - bounds[doc[r]])))
                    if key not in best or got < best[key]:
                        best[key] = got
        return [(doc, int(item), d, int(self.m[item]), first) for (doc, item), (d, first) in sorted(best.items())]


_HELD: dict[tuple, Benchmark] = {}


def held(uri: str, block: int, similarity: float, tables: Tables) -> Benchmark:
    """A block of items, read from the shared folder; a Python worker holds one at a time."""
    if (uri, block) not in _HELD:
        _HELD.clear()
        files, path = store(f"{uri}/block={block}")
        found = files.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        rows = []
        for f in sorted((f.path for f in found if f.path.endswith(".parquet"))):
            t = pq.read_table(files.open_input_file(f), columns=["item_id", "text"])
            rows += zip(t.column("item_id").to_pylist(), t.column("text").to_pylist())
        rows.sort()
        _HELD[uri, block] = Benchmark([i for i, _ in rows], [t for _, t in rows], similarity, tables)
    return _HELD[uri, block]


def decontaminate(docs: DataFrame, items: DataFrame, similarity: float = 0.8, recall: float = 0.995, block_bytes: int = 16 << 20, row: str | None = None) -> DataFrame:
    """(document, item) pairs: doc_id, item_id, edit_distance, item_words, similarity, word_at, row_number.

    Whole documents are searched for every item; a pair appears once with its best passage.  Words compare
    lower-cased and without punctuation.  Null and empty texts, and items without a word, match nothing.
    Items of fewer than five words must occur unchanged.  Repeated rows give repeated pairs; null ids stay null
    for documents, and items without an id are not used.  ``row`` names a column that numbers the rows, which comes
    back as row_number (else null).  Other columns are not read; an empty table on either side gives no pairs.

    The driver holds no items: they are written to the shared folder in blocks of about ``block_bytes`` of text, and tasks read
    them block by block, each for ``HELD_BYTES`` of texts at a time, whatever the size of the benchmark.
    """
    spark = docs.sparkSession
    own = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    words = F.size(F.filter(F.split(F.lower("text"), r"[\x00-/:-`{-\x7f]+"), lambda w: w != ""))
    got = own.select(words.alias("m"), F.octet_length("text").alias("b")).where("m > 0").agg(F.sum(F.col("b") + 64), F.min("m"), F.percentile_approx("m", 0.5), F.max("m")).first()
    if got[0] is None:
        return spark.createDataFrame([], SHAPE)
    blocks, tables = -(-got[0] // block_bytes), tables_for(recall, similarity, got[1:])
    uri = shared_dir(spark, "benchmark-items")
    own.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))).repartition(blocks, "block").write.partitionBy("block").parquet(uri)

    def search(batches):
        def found(some):
            rows, ids, texts = ([x for part in some for x in part[c]] for c in range(3))
            for block in range(blocks):
                bench = held(uri, block, similarity, tables)
                for a, z in in_blocks(texts):
                    h, bounds = hashed(texts[a:z])
                    hits = [(ids[a + d], int(bench.ids[i]), e, m, 1 - e / m, first, rows[a + d]) for d, i, e, m, first in bench.search(h, bounds)]
                    if hits:
                        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hits), kinds)], [x.split()[0] for x in SHAPE.split(", ")])

        some, size = [], 0
        for batch in batches:
            some.append((batch.column(2).to_pylist(), batch.column(0).to_pylist(), texts_of(batch.column(1))))
            size += batch.column(1).nbytes
            if blocks == 1 or size > HELD_BYTES:
                yield from found(some)
                some, size = [], 0
        if some:
            yield from found(some)

    number = F.lit(None).cast("long") if row is None else F.col(row)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", number.alias("row_number")).mapInArrow(search, SHAPE)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_number")


def keep_uncontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pipeline stage: the rows in which no item was found.  Rows go by number and never by doc_id, which can be null
    or repeated; rows with empty or null texts stay.  All columns are returned as they are; an empty table stays
    empty, and with an empty benchmark all rows stay."""
    own, row = numbered(docs)
    hits = decontaminate(own.select("doc_id", "text", row), items, row=row).select(F.col("row_number").alias(row)).distinct()
    return own.join(hits, row, "left_anti").select(*docs.columns)

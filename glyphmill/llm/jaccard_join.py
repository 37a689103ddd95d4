"""Operator 2, n-gram Jaccard join with Bayesian candidate pruning.

Texts become sets of hashed word shingles; equal sets are one class from there on.  Each class has a key
for every band of its MinHash values, and a key that several classes share is a bucket.  Buckets with the
same members are one.  A bucket of up to ``BLOCK`` classes is one unit of work, a larger one is cut into blocks of which
each pair is a unit, so neither links nor pairs are ever rows, and no task holds more than two blocks.  A
pair is compared in the bucket of the first band that it shares and in no other, which counts it once.  The
chance that all bands miss a pair at the threshold is 3.2e-6.

In a unit the MinHash values of all its pairs are compared 16 at a time.  After n values of which m agree
the posterior of the similarity is Beta(m + 1, n - m + 1); pairs for which the probability of
reaching the threshold falls below ``tolerance`` are dropped.  The rest are verified exactly on
their shingle sets.  A unit returns the number of links of each class and a spanning forest of
them; the forests' components are the near-duplicate classes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, grouped, mix64, numbered, partitions, staged, table, texts_of
from .components import SALTS, components, with_least
from .words import combined, hashed, in_blocks

BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
STEP = 16
BLOCK = 256  # classes of a block
BLOCK_SHINGLES = 1 << 18
MOST_BLOCKS = 64  # of a bucket, which bounds how often a set is copied; blocks are larger beyond
PART = 512  # classes compared at once
_A = mix64(np.arange(1, HASHES + 1, dtype=U64) * U64(0xC2B2AE3D27D4EB4F)) | U64(1)
_B = mix64(np.arange(1, HASHES + 1, dtype=U64) * U64(0x165667B19E3779F9))


def shingle_sets(texts: list[str], n: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer than n words is one shingle."""
    out = []
    for a, b in in_blocks(texts):
        h, bounds = hashed(texts[a:b])
        g = combined(h, n)
        for i in range(b - a):
            lo, hi = int(bounds[i]), int(bounds[i + 1])
            if hi - lo >= n:
                out.append(np.unique(g[lo : hi - n + 1]))
            else:
                out.append(combined(h[lo:hi] + U64(hi - lo), hi - lo) if hi > lo else np.zeros(0, U64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (sets x HASHES, 32 bits); an empty set has only ones."""
    out = np.full((len(sets), HASHES), 0xFFFFFFFF, np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    a = 0
    while a < len(full):
        b, size = a, 0
        while b < len(full) and (b == a or size + len(sets[full[b]]) < 1 << 17):
            size += len(sets[full[b]])
            b += 1
        x = np.concatenate([sets[i] for i in full[a:b]])
        starts = np.concatenate(([0], np.cumsum([len(sets[i]) for i in full[a:b]])[:-1]))
        rows = full[a:b]
        for k in range(HASHES):
            out[rows, k] = np.minimum.reduceat(((x ^ _B[k]) * _A[k]) >> U64(32), starts).astype(np.uint32)
        a = b
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    out = np.empty((len(sig), BANDS), U64)
    for b in range(BANDS):
        h = np.full(len(sig), b + 1, U64)
        for r in range(ROWS):
            h = mix64(h * U64(0x9E3779B97F4A7C15) + sig[:, b * ROWS + r])
        out[:, b] = h
    return out.view(np.int64)


def least_matches(similarity: float, tolerance: float) -> dict[int, int]:
    """For n compared values the fewest agreeing ones at which a pair stays."""
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, 0
        while m <= n:  # P(J >= t | m of n) = P(Binomial(n + 1, t) <= m)
            below += math.comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        out[n] = m
    return out


def linked(sets_a: list, sig_a: np.ndarray, sets_b: list, sig_b: np.ndarray, similarity: float, limits: dict[int, int], band: int = 0) -> np.ndarray:
    """Which pairs reach the similarity: pruned by the posterior, then verified exactly.  Pairs that share a
    band before ``band`` are left out."""
    na, nb = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    open_ = np.minimum(na[:, None], nb) + 1e-9 >= similarity * np.maximum(na[:, None], nb)
    for k in range(band):
        same = open_.copy()
        for r in range(k * ROWS, (k + 1) * ROWS):
            same &= sig_a[:, r, None] == sig_b[None, :, r]
        open_ &= ~same
    agree = np.zeros(open_.shape, np.int16)
    for n, least in limits.items():
        if not open_.any():
            return open_
        for k in range(n - STEP, n):
            agree += sig_a[:, k, None] == sig_b[None, :, k]
        open_ &= agree >= least
    i, j = np.nonzero(open_)
    if len(i) <= 48:
        both = np.array([len(np.intersect1d(sets_a[x], sets_b[y], assume_unique=True)) for x, y in zip(i, j)], np.int64)
        open_[i, j] = both * (1 + similarity) + 1e-6 >= similarity * (na[i] + nb[j])
        return open_
    values, inverse = np.unique(np.concatenate([*sets_a, *sets_b]), return_inverse=True)
    row_a, row_b = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    col_a, col_b = inverse[: na.sum()], inverse[na.sum() :]
    both = np.zeros(open_.shape, np.float64)
    for c in range(0, len(values), 8192):
        in_a, in_b = (col_a >= c) & (col_a < c + 8192), (col_b >= c) & (col_b < c + 8192)
        x, y = np.zeros((len(na), 8192), np.float32), np.zeros((len(nb), 8192), np.float32)
        x[row_a[in_a], col_a[in_a] - c] = 1
        y[row_b[in_b], col_b[in_b] - c] = 1
        both += x @ y.T
    return open_ & (both * (1 + similarity) + 1e-6 >= similarity * (na[:, None] + nb))


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """(node, least node of its component) for the nodes of a symmetric link matrix that have a smaller one."""
    n = len(links)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(links, label[None, :], n).min(1, initial=n))
        new = new[new]
        if (new == label).all():
            return [(int(i), int(x)) for i, x in enumerate(label) if x != i]
        label = new


def buckets(sets: DataFrame) -> DataFrame:
    """(rep, key, band, blocks) for every class and bucket that it is in, of buckets with the same members the
    one of the lowest band.

    Keys of one class only go first; the rows of a key are dealt over ``SALTS`` parts of the join, of which an
    aggregate says in a bit mask which the key has."""
    keyed = sets.select("rep", "n_shingles", F.posexplode("bands").alias("band", "key")).withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("mask")).where("n > 1")
    parts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.getbit("mask", k) == 1)
    members = staged(keyed.join(shared.select("key", F.explode(parts).alias("salt")), ["key", "salt"]), "bucket-members")
    same = [F.count("*").alias("n"), F.min("rep").alias("m"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y")]
    rest = [F.sum("n_shingles").alias("size"), F.min("band").alias("b"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("mask")]
    each = members.groupBy("key").agg(*same, *rest)
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / BLOCK_SHINGLES))
    each = each.groupBy("n", "m", "x", "y").agg(F.min(F.struct("b", "key", "mask", "size")).alias("z")).select("n", "z.*")
    each = each.select("key", F.least(blocks, F.col("n"), F.lit(MOST_BLOCKS)).cast("int").alias("blocks"), F.explode(parts).alias("salt"))
    return members.join(each, ["key", "salt"]).select("rep", "key", "band", "blocks")


def jaccard_join(docs: DataFrame, similarity: float = 0.8, n: int = 5, tolerance: float = 1e-6, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, text_class, n_shingles, kept, row_number.

    ``text_class`` is the smallest doc_id with the same shingle set, ``n_links`` the number of other text classes
    whose similarity to it is at least ``similarity``, ``class_id`` the smallest doc_id of its component of
    links; both are null where no row of the class has a doc_id.  A text of fewer than n words has one shingle of
    all its words.  Null and empty texts, and texts without a word, have no shingle: each such row is its own class,
    links to nothing and is kept.  Rows are told apart by number and not by doc_id, so null and repeated ids take
    part like any other; repeated rows are returned each and share a class.  ``kept`` marks one row of each class: that
    of the smallest doc_id, of equal ones the first by number.  ``row`` names a column that numbers the rows in
    order of doc_id (as ``numbered`` does); without it they are numbered here.  An empty table gives no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    if row is None:
        docs, row = numbered(docs.select("doc_id", "text"))
    own = docs.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def signed(batches):
        for batch in batches:
            rows, ids, texts = batch.column(0), batch.column(1), texts_of(batch.column(2))
            for a in range(0, len(texts), 512):
                sets = shingle_sets(texts[a : a + 512], n)
                keys = band_keys(signatures(sets))
                size = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [rows[a : a + 512], ids[a : a + 512], *set_hashes(sets), pa.array(size), pa.array([k.tolist() if m else [] for k, m in zip(keys, size)], pa.list_(pa.int64()))],
                    ["row", "doc_id", "set_a", "set_b", "n_shingles", "bands"],
                )

    rows = staged(own.mapInArrow(signed, "row long, doc_id long, set_a long, set_b long, n_shingles long, bands array<long>"), "shingle-sets")
    least = F.min(F.struct("row", "doc_id")).alias("least")
    # the copies of one text can be many: they are dealt over SALTS parts of the last join, a bit mask says which
    salt = F.when(F.col("n_shingles") > 0, F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    mask = F.bit_or(F.expr("shiftleft(1L, salt)")).alias("mask")
    sets = rows.withColumn("salt", salt).where("n_shingles > 0").groupBy("set_a", "set_b").agg(least, F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), mask)
    sets = staged(sets.select("set_a", "set_b", F.col("least.row").alias("rep"), F.col("least.doc_id").alias("rep_id"), "n_shingles", "bands", "mask"), "text-classes")
    members = buckets(sets).groupBy("rep").agg(F.collect_list(F.struct("key", "band", "blocks")).alias("buckets"))  # one a band at most

    def shingled(batches):
        for batch in batches:
            texts = texts_of(batch.column(2))
            for k in range(0, len(texts), 512):
                sets = shingle_sets(texts[k : k + 512], n)
                sig = signatures(sets)
                part = batch.slice(k, len(sets))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())],
                    ["node", "buckets", "shingles", "signature"],
                )

    kind = "buckets array<struct<key:bigint,band:int,blocks:int>>"
    texts = own.join(members, own["row"] == members["rep"]).select(F.col("row").alias("node"), "buckets", "text")
    units = texts.mapInArrow(shingled, f"node long, {kind}, shingles binary, signature binary")
    units = units.select("node", "shingles", "signature", F.explode("buckets").alias("z")).select("node", "shingles", "signature", "z.*")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    units = units.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select(
        F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("unit"),
        "key",
        "band",
        "node",
        F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"),
        "shingles",
        "signature",
    )
    limits = least_matches(similarity, tolerance)

    def compared(batches):
        held: list[tuple] = []

        def out():
            kinds, u, v = zip(*held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["kind", "u", "v"])

        for _, t in grouped(batches, "unit"):
            nodes, side, band = t.column("node").to_numpy(), t.column("side").to_numpy(), int(t.column("band")[0].as_py())
            alone = not side.any()
            if len(nodes) < 2 or (not alone and (side == side[0]).all()):
                continue
            sets = [np.frombuffer(x, U64) for x in t.column("shingles").to_pylist()]
            sig = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint32).reshape(len(sets), HASHES)
            count = np.zeros(len(nodes), np.int64)
            left, right = (np.arange(len(nodes)),) * 2 if alone else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
            for i in range(0, len(left), PART):
                for j in range(i if alone else 0, len(right), PART):
                    a, b = left[i : i + PART], right[j : j + PART]
                    links = linked([sets[x] for x in a], sig[a], [sets[x] for x in b], sig[b], similarity, limits, band)
                    if alone and i == j:
                        np.fill_diagonal(links, False)
                        count[a] += links.sum(1)
                        held += [(1, int(nodes[a[x]]), int(nodes[a[y]])) for x, y in forest(links)]
                        continue
                    count[a] += links.sum(1)
                    count[b] += links.sum(0)
                    if links.any():
                        both, square = np.concatenate((a, b)), np.zeros((len(a) + len(b),) * 2, bool)
                        square[: len(a), len(a) :] = links
                        square[len(a) :, : len(a)] = links.T
                        held += [(1, int(nodes[both[x]]), int(nodes[both[y]])) for x, y in forest(square)]
            held += [(0, int(nodes[x]), int(count[x])) for x in np.flatnonzero(count)]
            if len(held) > 8192:
                yield out()
        if held:
            yield out()

    verified = staged(units.repartition(partitions(spark), "unit").sortWithinPartitions("unit").mapInArrow(compared, "kind int, u long, v long"), "links")
    links = verified.where("kind = 0").groupBy(F.col("u").alias("rep")).agg(F.sum("v").alias("n_links"))
    roots = components(verified.where("kind = 1").select("u", "v")).select(F.col("node").alias("rep"), "root")
    # rows are numbered in order of doc_id, so the root has the smallest one of its class
    named = with_least(roots.join(sets.select("rep", "rep_id"), "rep").select("rep", "root", F.struct("rep", "rep_id").alias("own")), "root", "own", spread=True)
    classes = named.select("rep", "root", F.col("m.rep_id").alias("class_id"))
    parts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.getbit("mask", k) == 1)
    of_set = sets.select("set_a", "set_b", "rep", "rep_id", "mask").join(links, "rep", "left").join(classes, "rep", "left").withColumn("salt", F.explode(parts)).drop("mask")
    some = F.col("n_shingles") > 0
    return rows.drop("bands").withColumn("salt", salt).join(of_set, ["set_a", "set_b", "salt"], "left").select(
        "doc_id",
        F.when(some, F.when(F.col("root").isNull(), F.col("rep_id")).otherwise(F.col("class_id"))).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(some, F.col("rep_id")).otherwise(F.col("doc_id")).alias("text_class"),
        "n_shingles",
        (~some | (F.coalesce("root", "rep") == F.col("row"))).alias("kept"),
        F.col("row").alias("row_number"),
    )


def set_hashes(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Two independent 64-bit hashes of each set."""
    with np.errstate(over="ignore"):
        a = np.array([int(mix64(s + U64(77)).sum(dtype=U64)) & (2**64 - 1) for s in sets], U64).view(np.int64)
        b = np.array([int(np.bitwise_xor.reduce(mix64(s * U64(0xD6E8FEB86659FD93)))) if len(s) else 0 for s in sets], U64).view(np.int64)
    return pa.array(a), pa.array(b)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).drop("kept", "row_number")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """Pipeline stage: of each near-duplicate class one row stays, that of the smallest doc_id (rows without one come
    last, of equal ids the first by number).  Rows go by number and never by doc_id, which can be null or
    repeated: another row of a dropped row's id stays.  Rows without a word all stay.  All columns are returned as
    they are; an empty table stays empty."""
    own, row = numbered(docs)
    gone = jaccard_join(own.select("doc_id", "text", row), row=row).where("not kept").select(F.col("row_number").alias(row))
    return own.join(gone, row, "left_anti").select(*docs.columns)

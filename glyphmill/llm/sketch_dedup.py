"""Operator 13, near-duplicate classes from bottom-k sketches of one hash function.

Texts become sets of hashed word shingles; equal sets are one class from there on.  The sketch of a set is its ``KEPT``
smallest hashes.  Inverted lists hold, for a retained value, the sets that retain it.  A value that more than ``COMMON``
sets retain is common: a passage that many texts share gives such values, and most sets on their lists are no
duplicates.  So a set is listed under its first ``LISTED`` values that are not common, and only a set of which more
than three eighths of the sketch are common is also listed under its first ``LISTED`` values of any kind.  A pair at the
threshold shares a listed value but for a chance of 1.3e-10 if nothing is common in its texts and 4e-6 at worst
(see ``listed``).  Lists under common values are divided by the sizes of their sets, and lists of the same sets are one.

A list of up to ``BLOCK`` sets is a unit of work.  A longer one is cut into blocks, which first meet a few sets that
retain the most common values: what others are copies of.  That joins most of a group of copies, and then the sets
that are not in the list's largest component meet the whole list, in units of up to ``WIDE`` sets of either.  In a unit the overlaps of sketches count for all pairs at once, and pairs with enough of them are estimated
on the sketch of their union.  What such pairs connect is a group; only groups get full sets, and pairs in them are
verified exactly.  Pairs that are connected already are not compared, so n copies cost about n verifications."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, bytes_of, grouped, mix64, numbered, partitions, staged, table
from .components import SALTS, components, with_least
from .jaccard_join import set_hashes
from .words import BLACK, combined, hashed_runs, in_blocks

KEPT = 48
LISTED = 12
COMMON = 256
BLOCK = 256  # sets of a block
WIDE = 4 * BLOCK  # sets on a side of a unit where the rest of a long list meets all of it
TOLERANCE = 1e-9  # chance to drop a pair at the threshold by its sketch


def shingle_sets(raw: list[bytes], n: int = 3) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text; one of all its words if these are fewer."""
    out = []
    for a, b in in_blocks(raw):
        h, bounds = hashed_runs(raw[a:b], BLACK)
        g = combined(h, n)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if hi - lo >= n:
                out.append(np.unique(g[lo : hi - n + 1]))
            else:
                out.append(combined(h[lo:hi] + U64(hi - lo), hi - lo) if hi > lo else np.zeros(0, U64))
    return out


def fewest(percent: int) -> np.ndarray:
    """For a union sketch of n values the least number of shared ones at which a pair stays."""
    t, out = percent / 100, [0]
    for n in range(1, KEPT + 1):
        below, m = 0.0, 0
        while m <= n:
            below += math.comb(n, m) * t**m * (1 - t) ** (n - m)
            if below >= TOLERANCE:
                break
            m += 1
        out.append(m)
    return np.array(out)


class Unions:
    """Connected components of a few sets, from those that are known."""

    def __init__(self, roots: np.ndarray):
        _, first, which = np.unique(roots, return_index=True, return_inverse=True)
        self.up = first[which].tolist()

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        x, y = self.root(i), self.root(j)
        self.up[max(x, y)] = min(x, y)


def union_overlaps(a: np.ndarray, others: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shared values, values) of the bottom-k sketch of the union of ``a`` with each of ``others``, all in order of their hashes.

    A row of ``others`` begins with the ``kept`` values of a sketch, -1 follows."""
    same = others[:, :, None] == a
    in_a, in_b = same.any(1), same.any(2)
    k = np.minimum(KEPT, len(a) + kept - in_a.sum(1))
    # shared values are in the same order in both, so the n-th of one is the n-th of the other
    most = min(same.shape[1:])
    i, j = (np.sort(np.where(x, np.arange(x.shape[1]), 4 * KEPT), 1)[:, :most] for x in (in_a, in_b))
    rank = i + j - np.arange(most) + 1  # of each shared value in the union
    return (rank <= k[:, None]).sum(1), k


def union_overlap(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """``union_overlaps`` of one pair."""
    both, k = union_overlaps(a, b[None, :], np.array([len(b)]))
    return int(both[0]), int(k[0])


def open_pairs(sketches: list[np.ndarray], size: np.ndarray, percent: int, least: np.ndarray, sides: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, which pairs of them overlap enough): the shared values of a union's sketch are no more than those of both sketches.

    Rows and columns are all sets, each pair once, or with ``sides`` those of one side and of the other."""
    n = len(sketches)
    here = np.arange(n)
    rows, columns = (here, here) if sides is None else (np.flatnonzero(sides == sides.min()), np.flatnonzero(sides != sides.min()))
    kept = np.minimum(size, KEPT)
    ok = 100 * np.minimum(size[rows][:, None], size[columns]) >= percent * np.maximum(size[rows][:, None], size[columns])
    if sides is None:
        ok &= np.triu(np.ones((n, n), bool), 1)
    if not ok.any():
        return rows, columns, ok
    overlap = intersections([sketches[k] for k in rows], [sketches[k] for k in columns])
    union = np.minimum(kept[rows][:, None] + kept[columns] - overlap, KEPT).astype(np.int64)
    return rows, columns, ok & (overlap >= np.maximum(least[union], 1))


def estimated(sketches: list[np.ndarray], size: np.ndarray, roots: np.ndarray, percent: int, sides: np.ndarray | None) -> list[list[int]]:
    """Groups of two sets or more that pairs connect whose similarity can reach ``percent`` by the sketch of their union."""
    least = fewest(percent)
    rows, columns, open_ = open_pairs(sketches, size, percent, least, sides)
    open_ &= roots[rows][:, None] != roots[columns]
    kept = np.minimum(size, KEPT)
    padded = np.full((len(size), KEPT), -1, np.int64)
    padded[np.arange(KEPT) < kept[:, None]] = np.concatenate(sketches)
    label = np.arange(len(size))  # the smallest set that each is connected with
    for row in np.flatnonzero(open_.any(1)).tolist():
        i = int(rows[row])
        rest = columns[open_[row]]
        rest, n = rest[label[rest] != label[i]], 4
        while len(rest):
            some, rest, n = rest[:n], rest[n:], min(2 * n, BLOCK)
            both, k = union_overlaps(padded[i, : kept[i]], padded[some], kept[some])
            joined = np.unique(label[np.append(some[both >= least[k]], i)])
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
                rest = rest[label[rest] != label[i]]
    groups: dict[int, list[int]] = {}
    for i in range(len(size)):
        groups.setdefault(int(label[i]), []).append(i)
    return [g for g in groups.values() if len(g) > 1]


FEW = 1024  # pairs of sets
COLUMNS = 1024  # of a matrix of incidence


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all sets of ``a`` with all of ``b``.

    Values that up to ``FEW`` pairs share are counted pair by pair, as most are; only the others get columns in products of incidence matrices."""
    values, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    cut = sum(len(s) for s in a)
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
    places = [at[:cut], at[cut:]]
    n = [np.bincount(x, minlength=len(values)) for x in places]
    pairs = n[0] * n[1]
    out = np.zeros(len(a) * len(b), np.int64)
    own = np.flatnonzero((pairs[places[0]] > 0) & (pairs[places[0]] <= FEW))
    if len(own):
        others = rows[1][np.argsort(places[1], kind="stable")]
        start = np.cumsum(n[1]) - n[1]
        ends = np.cumsum(n[1][places[0][own]])
        cuts = np.searchsorted(ends, np.arange(1 << 20, ends[-1] + (1 << 20), 1 << 20))
        for x in np.split(own, np.minimum(cuts, len(own))):
            times = n[1][places[0][x]]
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            met = others[np.repeat(start[places[0][x]], times) + nth]
            out += np.bincount(np.repeat(rows[0][x], times) * len(b) + met, minlength=len(out))
    out = out.reshape(len(a), len(b))
    many = pairs > FEW
    column = np.cumsum(many) - 1
    for c in range(0, int(many.sum()), COLUMNS):
        x, y = (np.zeros((len(s), COLUMNS), np.float32) for s in (a, b))
        for m, row, place in ((x, rows[0], places[0]), (y, rows[1], places[1])):
            keep = many[place] & (column[place] >= c) & (column[place] < c + COLUMNS)
            m[row[keep], column[place[keep]] - c] = 1
        out += (x @ y.T).astype(np.int64)
    return out


def verified(sets: list[np.ndarray], roots: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links of the pairs at ``percent`` between components, as a forest of what they connect."""
    size = np.array([len(s) for s in sets])
    open_ = open_pairs([s[:KEPT] for s in sets], size, percent, fewest(percent), None)[2] & (roots[:, None] != roots)
    i, j = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
    forest, found = Unions(roots), []
    if not len(i):
        return found
    inside = np.zeros(open_.shape, np.int64)
    if open_.sum() > 16:
        inside[np.ix_(i, j)] = intersections([sets[k] for k in i], [sets[k] for k in j])
    else:
        for x, y in zip(*np.nonzero(open_)):
            inside[x, y] = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
    for x, y in zip(*np.nonzero(open_ & (100 * inside >= percent * (size[:, None] + size - inside)))):
        if forest.root(int(x)) != forest.root(int(y)):
            found.append((int(x), int(y)))
            forest.join(int(x), int(y))
    return found


def listed(sets: DataFrame) -> DataFrame:
    """(key, rep, central, blocks): the sets of every inverted list of two or more, with the number of common values each retains.

    Let a pair have similarity 0.85.  The first values of its union are shared with chance 0.85 each, so 12 of them all fail
    with 0.15 ** 12.  Of values that are not common, a set with three eighths of common ones has at least 0.625 * 0.85 of the
    union, of which 0.15 are not shared: one is shared with chance 0.71 or more, with 0.64 if the sketch was off by two
    deviations; pairs of which both have more common ones meet on the lists of any value."""
    each = sets.select("rep", F.posexplode("sketch").alias("place", "value"))
    common = staged(each.groupBy("value").count().where(F.col("count") > COMMON).select("value"), "common-values")
    # only the common values of a set come back to it
    marked = each.join(common.withColumn("common", F.lit(True)), "value", "left")
    places = marked.groupBy("rep").agg(F.collect_set(F.when(F.col("common"), F.col("place"))).alias("places"))
    of_set = sets.select("rep", "n_shingles", "sketch").join(places, "rep")
    rare = F.slice(F.filter("sketch", lambda x, i: ~F.array_contains("places", i)), 1, LISTED)
    first = F.filter(F.slice("sketch", 1, LISTED), lambda x, i: F.array_contains("places", i))
    hot = F.when(8 * F.size("places") > 3 * F.size("sketch"), first).otherwise(F.slice("sketch", 1, 0))
    # two sets of one list and similarity 0.85 are in the same or in neighbouring classes of size
    grade = F.floor(F.log(F.col("n_shingles") + 0.5) / -math.log(0.85)).cast("long")
    keys = F.concat(rare, F.flatten(F.transform(hot, lambda x: F.array(F.xxhash64(x, grade), F.xxhash64(x, grade + 1)))))
    keyed = of_set.select("rep", "n_shingles", F.size("places").alias("central"), F.explode(keys).alias("key")).withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    mask = F.bit_or(F.expr("shiftleft(1L, salt)")).alias("mask")
    parts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.getbit("mask", k) == 1)
    same = [F.count("*").alias("n"), F.min("rep").alias("m"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y")]
    # lists of one set go; the sets of the others are joined in as many parts as a list has
    keyed = staged(keyed, "listed-values")
    several = keyed.groupBy("key").agg(F.count("*").alias("n"), mask).where("n > 1").select("key", "n", F.explode(parts).alias("salt"))
    members = keyed.join(several, ["key", "salt"])
    # in a short list a set stays if the next smaller or larger one is near enough in size
    w = Window.partitionBy("key").orderBy("n_shingles")
    size = F.col("n_shingles")
    near = (F.lag(size).over(w) >= 0.85 * size) | (0.85 * F.lead(size).over(w) <= size)
    short = members.where(F.col("n") <= COMMON).withColumn("near", near).where("near").drop("near")
    members = staged(short.unionByName(members.where(F.col("n") > COMMON)).select("key", "rep", "n_shingles", "central", "salt"), "list-members")
    # of lists with the same sets one stays
    lists = members.groupBy("key").agg(*same, F.sum("n_shingles").alias("size"), mask).where("n > 1")
    lists = lists.groupBy("n", "m", "x", "y").agg(F.min(F.struct("key", "mask")).alias("z")).select("n", "z.*")
    blocks = F.ceil(F.col("n") / BLOCK)
    lists = lists.select("key", blocks.alias("blocks"), F.explode(parts).alias("salt"))
    return staged(members.join(lists, ["key", "salt"]).select("key", "rep", "central", "blocks"), "inverted-lists")


def in_units(places: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(together, node): groups of sets that a unit's sketches connect; equal groups of several units are one.

    ``places`` (unit, node, root, side) say where a set takes part; the sets of one unit meet in one task with their sketches."""

    def run(batches):
        for _, t in grouped(batches, "unit"):
            if t.num_rows < 2:
                continue
            side, node = t.column("side").to_numpy(), t.column("node").to_numpy()
            sketches = [np.frombuffer(x, np.uint32) for x in t.column("ids").to_pylist()]
            both = None if (side == side[0]).all() else side
            for g in estimated(sketches, t.column("n_shingles").to_numpy(), t.column("root").to_numpy(), percent, both):
                members = np.unique(node[g])
                if len(members) < 2:
                    continue
                name = int(mix64((mix64(members.view(U64)) * U64(3)).sum(dtype=U64, keepdims=True) ^ np.bitwise_xor.reduce(mix64(members.view(U64) + U64(1))))[0] >> U64(1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(members), name)), pa.array(members)], ["together", "node"])

    of_node = places.groupBy("node").agg(F.first("root").alias("root"), F.collect_set(F.struct("unit", "side")).alias("units"))
    units = sets.select(F.col("rep").alias("node"), "n_shingles", "ids").join(of_node, "node").select("node", "root", "n_shingles", "ids", F.explode("units").alias("z")).select("z.unit", "z.side", "node", "root", "n_shingles", "ids")
    spread = units.repartition(partitions(units.sparkSession), "unit").sortWithinPartitions("unit", "node")
    return staged(spread.mapInArrow(run, "together long, node long").distinct(), "estimated-groups")


FILTER_BITS = 1 << 23


def thinned(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose node can be among ``wanted``: texts that nobody asks for are not shuffled.

    The nodes' hashes are marked in ``FILTER_BITS`` bits, 1 MB whatever the input, which all tasks get."""
    page = 8 * 4096  # bits of a bitmap
    place = lambda: F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS))
    bits = wanted.select(F.floor(place() / page).alias("page"), F.pmod(place(), F.lit(page)).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bit = F.pmod(place(), F.lit(page))
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    near = texts.withColumn("page", F.floor(place() / page)).join(F.broadcast(bits), "page")
    return near.where(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1).select(*texts.columns)


def compared(groups: DataFrame, texts: DataFrame, percent: int, n: int, known: DataFrame | None = None) -> DataFrame:
    """(u, v) of the verified links of ``groups`` (together, node) on the full sets of ``texts`` (node, text).  ``known`` (node, root)
    are components whose sets are not compared with each other."""

    def shingled(batches):
        for batch in batches:
            raw = bytes_of(batch.column(2))
            for a, b in in_blocks(raw, 1 << 21):
                full = pa.array([s.tobytes() for s in shingle_sets(raw[a:b], n)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], batch.column(3)[a:b], full], ["node", "groups", "root", "shingles"])

    def run(batches):
        for _, t in grouped(batches, "together"):
            node = t.column("node").to_numpy()
            found = verified([np.frombuffer(x, U64) for x in t.column("shingles").to_pylist()], t.column("root").to_numpy(), percent)
            if found:
                i, j = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], ["u", "v"])

    of_node = staged(groups.groupBy("node").agg(F.collect_list("together").alias("groups")), "groups-of-sets")
    rooted = of_node.withColumn("root", F.col("node")) if known is None else of_node.join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    full = thinned(texts, of_node).join(rooted, "node").select("node", "groups", "text", "root").mapInArrow(shingled, "node long, groups array<long>, root long, shingles binary")
    spread = full.select(F.explode("groups").alias("together"), "node", "root", "shingles").repartition(partitions(texts.sparkSession), "together").sortWithinPartitions("together", "node")
    return staged(spread.mapInArrow(run, "u long, v long"), "links")


def sketch_dedup(docs: DataFrame, percent: int = 85, n: int = 3, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, row_number.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased; a set holds the distinct shingles of ``n`` words,
    for fewer words the one of them all.  Two documents are linked if 100 times their intersection is at least ``percent``
    times their union; ``component_id`` is the smallest doc_id that links lead to.  Null and empty texts and texts without a word
    have no shingle, are linked with nothing and are kept.  Rows are told apart by number and not by doc_id: null and repeated
    ids take part like any other, repeated rows are returned each and are one component; ``kept`` is true for the rows with the
    component's smallest doc_id, and for those of components without any.  An empty table gives no rows; texts are read whole,
    other columns not at all.  Shingles are told apart by 64-bit hashes, sets by 128 bits."""
    spark = docs.sparkSession
    if row is None:
        docs, row = numbered(docs.select("doc_id", "text"))
    own = docs.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def sketched(batches):
        for batch in batches:
            raw = bytes_of(batch.column(2))
            for a, b in in_blocks(raw, 1 << 21):
                sets = shingle_sets(raw[a:b], n)
                sketch = pa.array([s[:KEPT].view(np.int64).tolist() for s in sets], pa.list_(pa.int64()))
                ids = pa.array([(mix64(s[:KEPT]) >> U64(32)).astype(np.uint32).tobytes() for s in sets], pa.binary())
                size = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], *set_hashes(sets), size, sketch, ids], ["row", "doc_id", "set_a", "set_b", "n_shingles", "sketch", "ids"])

    rows = staged(own.mapInArrow(sketched, "row long, doc_id long, set_a long, set_b long, n_shingles long, sketch array<long>, ids binary"), "sketches")
    # the copies of one text can be many: they are dealt over SALTS parts of the last join, a bit mask says which
    salt = F.when(F.col("n_shingles") > 0, F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    mask = F.bit_or(F.expr("shiftleft(1L, salt)")).alias("mask")
    classes = rows.withColumn("salt", salt).where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min(F.struct("row", "doc_id")).alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("ids").alias("ids"), mask)
    sets = staged(classes.select("set_a", "set_b", F.col("least.row").alias("rep"), F.col("least.doc_id").alias("rep_id"), "n_shingles", "sketch", "ids", "mask"), "text-classes")
    lists = listed(sets)

    texts = own.select(F.col("row").alias("node"), "text")

    lists = lists.select("key", F.col("rep").alias("node"), "central", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block"))
    long_lists = lists.where("blocks > 1")
    # the sets of a long list that have the most common values are likely what others are copies of: they meet all blocks
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(SALTS))
    pivots = long_lists.groupBy("key", "blocks", part.alias("part")).agg(F.max_by("node", F.struct("central", -F.col("node"))).alias("node"))
    pivots = pivots.select("node", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"))
    first = lists.select("node", "key", "block", F.when(F.col("blocks") > 1, 1).otherwise(0).alias("side")).unionByName(pivots)
    first = first.select("node", F.col("node").alias("root"), F.xxhash64("key", "block").alias("unit"), "side")
    linked = compared(in_units(first, sets, percent), texts, percent, n)
    if not long_lists.isEmpty():
        # sets outside of the largest component of their list meet all blocks, too
        known = components(linked)
        rooted = long_lists.join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
        most = rooted.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main"), (F.sum("count") - F.max("count")).alias("others"))
        # a list's sets are dealt over parts of this join by their block, as one list may hold a large share of all sets
        mains = long_lists.select("key", "block").distinct().join(most.where("others > 0"), "key")
        # all of the rest meets all of the list, in units that are wider than a block on both sides: a set is copied once a WIDE sets
        wide = F.ceil(F.col("blocks") * BLOCK / WIDE)
        left = staged(rooted.join(mains, ["key", "block"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), wide)), "rest")
        groups = F.ceil(F.col("others") / WIDE)
        every = F.sequence(F.lit(0).cast("long"), wide - 1)
        rest = left.where("root <> main").withColumn("group", F.pmod(F.xxhash64("node", F.lit(2)), groups)).select("node", "root", "key", "group", F.explode(every).alias("block"), F.lit(0).alias("side"))
        whole = left.select("node", "root", "key", F.explode(F.sequence(F.lit(0).cast("long"), groups - 1)).alias("group"), "block", F.lit(1).alias("side"))
        across = rest.unionByName(whole).select("node", "root", F.xxhash64("key", "group", "block").alias("unit"), "side")
        linked = linked.unionByName(compared(in_units(across, sets, percent), texts, percent, n, known))
    roots = components(linked).select(F.col("node").alias("rep"), "root")
    # rows are numbered in order of doc_id, so the root has the smallest one of its component
    named = with_least(roots.join(sets.select("rep", "rep_id"), "rep").select("rep", "root", F.struct("rep", "rep_id").alias("own")), "root", "own", spread=True)
    named = named.select("rep", F.col("m.rep_id").alias("component_id"), F.lit(True).alias("found"))
    parts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.getbit("mask", k) == 1)
    of_set = sets.select("set_a", "set_b", "rep", "rep_id", "mask").join(named, "rep", "left").withColumn("salt", F.explode(parts)).drop("mask")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("found"), F.col("component_id")).otherwise(F.col("rep_id"))
    out = rows.drop("sketch", "ids").withColumn("salt", salt).join(of_set, ["set_a", "set_b", "salt"], "left").withColumn("component_id", component)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), F.col("row").alias("row_number"))


def op13_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_dedup(table(spark, sf_dir, "documents")).drop("row_number")


OP13_SQL = r"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS p FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(p) >= 3 THEN list_transform(range(1, len(p) - 1), lambda i: p[i] || ' ' || p[i + 1] || ' ' || p[i + 2]) WHEN len(p) > 0 THEN [array_to_string(p, ' ')] ELSE [] END) AS shingle FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS inside FROM sets a JOIN sets b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM shared JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE 100 * inside >= 85 * (a.n + b.n - inside)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.v FROM reach JOIN links ON reach.other = links.u),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)"""

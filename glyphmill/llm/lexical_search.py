"""Operator 11, ranked lexical search with block-max pruning.

The forward index holds documents in blocks of consecutive ones: for each document its terms that any query has, with
their frequencies.  A first pass over the texts writes it and counts documents, terms and document frequencies.
A block's maximum of a term is the largest share the term adds to a score in it; summed over a query's terms with their
weights it bounds every score of the block.  A query takes blocks in order of that bound and scores their forward index
until the bound is below its threshold, the lowest of its best scores so far.

Two passes do so over the index, each task over its own blocks.  The first takes the best block of each query in each
part, whose scores give every query a threshold that holds for the whole table; the second starts from it, so blocks that
cannot matter anywhere are skipped everywhere.  Queries are worked on in groups of ``group_bytes`` of text at most, which
bounds what is sent to the tasks; more queries take more passes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, bytes_of, staged, table
from .words import ALNUM, hashed_runs, in_blocks

BLOCK_DOCS = 64
AT_ONCE = 64  # blocks whose bounds are sorted together
NO_ID = np.iinfo(np.int64).max  # stands for a null doc_id, behind all others
STATED = "kind int, docs binary, sizes binary, starts binary, terms binary, times binary, term long, n long"
PARTS = STATED.replace(" int", "").replace(" binary", "").replace(" long", "").split(", ")
FORWARD, TERM, DOCS, LENGTH = range(4)


class Queries:
    """A group of queries: the distinct terms of all, and each query's terms with their numbers of times."""

    def __init__(self, texts: list[bytes]):
        h, bounds = hashed_runs(texts, ALNUM)
        self.terms = np.unique(h)
        at = np.searchsorted(self.terms, h)
        each = [np.unique(at[a:b], return_counts=True) for a, b in zip(bounds[:-1], bounds[1:])]
        self.first = np.cumsum([0] + [len(t) for t, _ in each])
        self.of = np.concatenate([t for t, _ in each]).astype(np.int64) if each else np.zeros(0, np.int64)
        self.times = np.concatenate([n for _, n in each]).astype(np.int64) if each else np.zeros(0, np.int64)
        self.near = np.zeros(1 << 20, bool)  # most other words fail here
        self.near[(self.terms >> U64(44)).astype(np.int64)] = True

    def found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``h``, numbers of their terms) of the words that any query has."""
        p = np.flatnonzero(self.near[(h >> U64(44)).astype(np.int64)])
        if not len(self.terms) or not len(p):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        t = np.minimum(np.searchsorted(self.terms, h[p]), len(self.terms) - 1)
        ok = self.terms[t] == h[p]
        return p[ok], t[ok]


def row(kind: int, parts: list[np.ndarray] | None = None, term: int = 0, n: int = 0) -> list:
    return [kind, *([None] * 5 if parts is None else [x.tobytes() for x in parts]), term, n]


def batch_of(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.binary()] * 5, pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], PARTS)


def forward_index(docs: DataFrame, queries) -> DataFrame:
    """Rows of four kinds: blocks of the forward index, and of each task the documents of each term, those with any term, and
    their terms with repeats."""

    def indexed(batches):
        q: Queries = queries.value
        df, n_docs, n_terms = np.zeros(len(q.terms), np.int64), 0, 0
        held: list[tuple] = []

        def block():
            starts = np.cumsum([0] + [len(t) for _, _, t, _ in held]).astype(np.int32)
            parts = [np.array([i for i, *_ in held], np.int64), np.array([n for _, n, *_ in held], np.int64), starts]
            parts += [np.concatenate([h[k] for h in held]).astype(np.int32) for k in (2, 3)]
            held.clear()
            return batch_of([row(FORWARD, parts)])

        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            raw = bytes_of(batch.column(1))
            for a, b in in_blocks(raw):
                h, bounds = hashed_runs(raw[a:b], ALNUM)
                sizes = np.diff(bounds)
                n_docs += int((sizes > 0).sum())
                n_terms += int(sizes.sum())
                place, term = q.found(h)
                key, times = np.unique((np.searchsorted(bounds, place, "right") - 1) * max(1, len(q.terms)) + term, return_counts=True)
                doc, term = np.divmod(key, max(1, len(q.terms)))
                df += np.bincount(term, minlength=len(df))
                cuts = np.searchsorted(doc, np.arange(b - a + 1))
                for i in np.flatnonzero(np.diff(cuts)):
                    held.append((ids[a + i], sizes[i], term[cuts[i] : cuts[i + 1]], times[cuts[i] : cuts[i + 1]]))
                    if len(held) == BLOCK_DOCS:
                        yield block()
        if held:
            yield block()
        some = np.flatnonzero(df)
        for a in range(0, len(some), 8192):
            yield batch_of([row(TERM, term=int(t), n=int(df[t])) for t in some[a : a + 8192]])
        yield batch_of([row(DOCS, n=n_docs), row(LENGTH, n=n_terms)])

    return staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(indexed, STATED), "forward-index")


class Block:
    """Documents with their terms, what each term adds to a document's score before its weight, and the maxima."""

    def __init__(self, docs: bytes, sizes: bytes, starts: bytes, terms: bytes, times: bytes, n_docs: int, n_terms: int):
        self.docs = np.frombuffer(docs, np.int64)
        n, self.starts = np.frombuffer(sizes, np.int64), np.frombuffer(starts, np.int32)
        tf = np.frombuffer(times, np.int32).astype(np.int64)
        if int(n.max()) < 2**63 // (25 * n_docs):
            m = 75 + 25 * n * n_docs // n_terms
        else:
            m = np.array([75 + 25 * int(x) * n_docs // n_terms for x in n], np.int64)
        self.share = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, np.diff(self.starts)))
        own = np.frombuffer(terms, np.int32)
        self.terms, self.at = np.unique(own, return_inverse=True)
        order = np.argsort(self.at, kind="stable")
        first = np.searchsorted(self.at[order], np.arange(len(self.terms)))
        self.most = np.maximum.reduceat(self.share[order], first)

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The score of each document for a query of sorted terms."""
        own = np.zeros(len(self.terms), np.int64)
        p = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        ok = self.terms[p] == terms
        own[p[ok]] = weights[ok]
        return np.add.reduceat(own[self.at] * self.share, self.starts[:-1])


class Search:
    """The best documents of each query so far.  ``floor`` are scores that a result must reach."""

    def __init__(self, queries: Queries, weights: np.ndarray, floor: np.ndarray, most: int):
        self.q, self.most = queries, most
        self.weights = weights[queries.of] * queries.times
        self.floor = np.maximum(floor, 1)
        n = len(queries.first) - 1
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
        self.scored = self.asked = 0

    def bounds(self, blocks: list[Block]) -> np.ndarray:
        """The largest score that a block's maxima allow, for each query and block."""
        out = np.zeros((len(self.best), len(blocks)), np.int64)
        full = np.flatnonzero(np.diff(self.q.first))
        peak = np.zeros(len(self.q.terms), np.int64)
        for k, b in enumerate(blocks):
            peak[b.terms] = b.most
            if len(full):
                out[full, k] = np.add.reduceat(self.weights * peak[self.q.of], self.q.first[full])
            peak[b.terms] = 0
        return out

    def take(self, i: int, block: Block) -> None:
        terms = slice(self.q.first[i], self.q.first[i + 1])
        score = block.scores(self.q.of[terms], self.weights[terms])
        good = np.flatnonzero(score >= self.floor[i])
        self.scored += 1
        if not len(good):
            return
        score, doc = np.concatenate((self.best[i][0], score[good])), np.concatenate((self.best[i][1], block.docs[good]))
        order = np.lexsort((doc, -score))[: self.most]
        self.best[i] = score[order], doc[order]
        if len(order) == self.most:
            self.floor[i] = max(self.floor[i], score[order[-1]])

    def run(self, blocks: list[Block], first_only: bool) -> None:
        """Takes blocks in order of a query's bounds until they fall below its threshold, or just the first of each query.

        Rounds take one more block of every query that is not done, block by block."""
        bounds = self.bounds(blocks)
        order = np.argsort(-bounds, axis=1, kind="stable")
        self.asked += bounds.size
        alive = np.arange(len(self.best))
        for k in range(1 if first_only else len(blocks)):
            block = order[alive, k]
            open_ = bounds[alive, block] >= self.floor[alive]
            alive, block = alive[open_], block[open_]
            if not len(alive):
                break
            for j in np.argsort(block, kind="stable"):
                self.take(int(alive[j]), blocks[block[j]])


def ranked(index: DataFrame, queries, weights, floor, counts: tuple[int, int], most: int, first_only: bool) -> DataFrame:
    """(query, score, doc_id): the best of each task, or with ``first_only`` the best of the first block of each query."""

    def searched(batches):
        s = Search(queries.value, weights.value, floor.value.copy(), most)
        held: list[Block] = []
        for batch in batches:
            for parts in zip(*[c.to_pylist() for c in batch.columns]):
                held.append(Block(*parts, *counts))
                if len(held) == AT_ONCE:
                    s.run(held, first_only)
                    held.clear()
        if held:
            s.run(held, first_only)
        for i, (score, doc) in enumerate(s.best):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), i)), pa.array(score), pa.array(doc)], ["query", "score", "doc_id"])

    return index.where(f"kind = {FORWARD}").select(*PARTS[1:6]).mapInArrow(searched, "query long, score long, doc_id long")


def top(rows: DataFrame, most: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def groups(items: DataFrame, group_bytes: int):
    """Lists of (item_id, text in bytes) whose texts are of ``group_bytes`` together, in order of item_id; the driver holds one at a time."""
    held, n = [], 0
    rows = items.select("item_id", F.col("text").cast("binary").alias("text")).where("text is not null").orderBy("item_id", "text")
    for item, text in rows.toLocalIterator():
        if held and n + len(text) > group_bytes:
            yield held
            held, n = [], 0
        held.append((item, bytes(text)))
        n += len(text)
    if held:
        yield held


def lexical_search(docs: DataFrame, items: DataFrame, most: int = 20, group_bytes: int = 8 << 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``most`` documents with the highest score above 0 for each item, equal scores by doc_id.

    Terms are runs of ASCII letters and digits and of all other characters, with A-Z lower-cased; two terms are told apart by a 64-bit
    hash.  Null and empty texts have no term: such documents are not counted and such items find nothing.  Every row of either
    table takes part by itself: repeated documents are ranked each, a repeated item gets its ranking again, a null doc_id comes
    behind all others of its score and stays null.  Texts are read whole, whatever their length.  Without documents or items
    there are no rows; other columns are not read."""
    spark = docs.sparkSession
    schema = "item_id long, rank int, doc_id long, score long"
    out = None
    for group in groups(items, group_bytes):
        q = Queries([text for _, text in group])
        queries = spark.sparkContext.broadcast(q)
        index = forward_index(docs, queries)
        counted = index.where(f"kind <> {FORWARD}").groupBy("kind", "term").agg(F.sum("n").alias("n")).toPandas()  # a row a term at most
        n_docs, n_terms = (int(counted.n[counted.kind == k].sum()) for k in (DOCS, LENGTH))
        df = np.zeros(len(q.terms), np.int64)
        of = counted[counted.kind == TERM]
        df[of.term.to_numpy()] = of.n.to_numpy()
        weights = spark.sparkContext.broadcast(np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64))
        zero = spark.sparkContext.broadcast(np.zeros(len(group), np.int64))
        seeds = top(ranked(index, queries, weights, zero, (n_docs, n_terms), most, True), most).where(f"rank = {most}").select("query", "score").toPandas()  # a row a query
        floor = np.zeros(len(group), np.int64)
        floor[seeds["query"].to_numpy()] = seeds.score.to_numpy()
        best = top(ranked(index, queries, weights, spark.sparkContext.broadcast(floor), (n_docs, n_terms), most, False), most)
        names = spark.createDataFrame([(k, item) for k, (item, _) in enumerate(group)], "query long, item_id long")
        part = best.join(F.broadcast(names), "query").select("item_id", "rank", F.when(F.col("doc_id") != int(NO_ID), F.col("doc_id")).alias("doc_id"), "score")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


TERM_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""WITH terms AS (SELECT doc_id, unnest(p) AS term, len(p) AS n FROM (SELECT doc_id, {TERM_SQL} AS p FROM documents)),
totals AS (SELECT (SELECT count(*) FROM documents WHERE len({TERM_SQL}) > 0) AS nd, (SELECT count(*) FROM terms) AS nt),
wanted AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({TERM_SQL}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, term, n, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals),
shares AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nt))) AS share FROM tf JOIN weights USING (term), totals),
scores AS (SELECT item_id, doc_id, CAST(sum(times * share) AS BIGINT) AS score FROM wanted JOIN shares USING (term) GROUP BY ALL HAVING sum(times * share) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores) WHERE rank <= 20"""


def op11_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

"""Operator 3, packing by lexical retrieval.

Token ids are the terms.  Pass 1 encodes the documents and counts, over all of them, in how many
documents each id occurs; that table has one entry for an id of the vocabulary at most, which bounds
what is gathered.  A document's heaviest term names its neighbourhood (a term weighs more the later it was
merged into the vocabulary, which makes it rarer, and the more often it occurs; this only says which
documents meet in a shard), and neighbourhoods are laid out one after another along an axis measured in tokens; cutting the axis into
equal lengths gives shards of about ``shard_tokens`` ids.  A common term spreads over several shards.

In a shard an inverted index maps each term to (document, BM25 weight).  The seed of a window is
the next unused document; all its terms query the index, which returns unused neighbours by
descending BM25 score.  Neighbours that fit whole go in greedily; when none fits, the best one is cut
and its rest opens the next window.  So every window but a shard's last is full, and the last one is
cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import grouped, partitions, staged, table, texts_of
from .encode import encoder, forget

K1, B = 1.2, 0.75
SHAPE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, kept_whole boolean"


def narrow(ids: np.ndarray) -> np.ndarray:
    """16-bit ids where all fit: half the bytes, and sorting them takes linear time."""
    return ids.astype("<u2") if not len(ids) or int(ids.max()) < 65536 else ids.astype("<u4")


def counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and how often each occurs."""
    s = np.sort(ids, kind="stable")
    first = np.concatenate(([0], np.flatnonzero(s[1:] != s[:-1]) + 1))
    return s[first], np.diff(first, append=len(s))


def encoded(docs: DataFrame, vocabulary: str, end_id: int, blank_free: bool) -> DataFrame:
    """kind 0: a document with its ids; kind 1: a term with the number of documents in this task."""

    def run(batches):
        enc, end, df = encoder(vocabulary, blank_free), np.array([end_id], "<u4").tobytes(), np.zeros(1, np.int64)
        rank = np.log(np.arange(max(enc.model.get_vocab_size(), end_id + 1)) + 2.0) ** 3
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            for k in range(0, len(ids), 2048):
                got = [x + end for x in enc.encode(texts[k : k + 2048])]
                n, lens = len(got), np.array([len(x) // 4 for x in got])
                brief = [narrow(np.frombuffer(x, "<u4")) for x in got]
                held = [counted(x) for x in brief]
                top = [int(t[np.argmax(rank[t] * (c / (c + K1)))]) for t, c in held]
                seen = np.bincount(np.concatenate([t for t, _ in held]))
                if len(seen) > len(df):
                    df = np.concatenate((df, np.zeros(len(seen) - len(df), np.int64)))
                df[: len(seen)] += seen
                packed = [x.tobytes() for x in brief]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(n, np.int32)), pa.array(ids[k : k + 2048], pa.int64()), pa.array(lens), pa.array(top, pa.int64()), pa.array(packed, pa.binary())],
                    ["kind", "doc_id", "n", "top", "ids"],
                )
        at = np.flatnonzero(df)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), np.int32)), pa.array(at), pa.array(df[at]), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary())], ["kind", "doc_id", "n", "top", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "kind int, doc_id long, n long, top long, ids binary")


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


class Weights:
    """BM25 weights from the counts over all documents."""

    def __init__(self, df: np.ndarray, n_docs: int, mean: float):
        self.idf = np.log1p((n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)
        self.mean = max(mean, 1.0)

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        terms, tf = counted(ids)
        norm = K1 * (1 - B + B * len(ids) / self.mean)
        return terms, (self.idf[terms] * tf * (K1 + 1) / (tf + norm)).astype(np.float32)


def pack_shard(docs: list[np.ndarray], weights: Weights, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (document, first id, length)."""
    n = len(docs)
    each = [weights.of(x) for x in docs]
    counts = np.array([len(t) for t, _ in each])
    terms = np.concatenate([t for t, _ in each])
    vals = np.concatenate([v for _, v in each])
    owner = np.repeat(np.arange(n), counts)
    order = np.argsort(terms, kind="stable")
    keys, first = np.unique(terms[order], return_index=True)
    last = np.concatenate((first[1:], [len(order)]))
    post_doc, post_val = owner[order], vals[order]
    row = np.full(len(keys), -1)  # terms of over a tenth of the documents are held as rows, which add up faster
    often = np.flatnonzero((last - first) * 10 > n)
    row[often] = np.arange(len(often))
    common = np.zeros((len(often), n), np.float32)
    for r, i in enumerate(often.tolist()):
        common[r, post_doc[first[i] : last[i]]] = post_val[first[i] : last[i]]
    left = np.array([len(x) for x in docs])
    used = np.zeros(n, bool)
    unused, seqs = 0, []

    def neighbours(doc: int) -> np.ndarray:
        """Unused documents by descending score against all terms of ``doc``."""
        at = np.searchsorted(keys, each[doc][0])
        asked = np.zeros(len(often), np.float32)
        asked[row[at[row[at] >= 0]]] = 1
        score = (asked @ common).astype(np.float64)
        rare = at[row[at] < 0]
        size = last[rare] - first[rare]
        if len(rare):
            which = np.repeat(first[rare] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            score += np.bincount(post_doc[which], post_val[which], n)
        score[used] = 0
        hits = np.flatnonzero(score)
        return hits[np.argsort(-score[hits], kind="stable")]

    carry = -1  # a document of which a part is placed
    while True:
        if carry < 0:
            while unused < n and used[unused]:
                unused += 1
            if unused == n:
                break
            carry = unused
            used[carry] = True
        room, seq, seed = window, [], carry
        while room:
            if carry >= 0:  # the seed, or what is left of it, goes in first
                take = min(room, int(left[carry]))
                seq.append((carry, len(docs[carry]) - int(left[carry]), take))
                left[carry] -= take
                room -= take
                carry = -1 if left[carry] == 0 else carry
                continue
            near = neighbours(seed)
            for d in near[left[near] <= room].tolist():
                if left[d] <= room:
                    used[d] = True
                    seq.append((d, 0, int(left[d])))
                    room -= int(left[d])
                    left[d] = 0
                    if not room:
                        break
            if not room:
                break
            near = near[~used[near]]
            if len(near):
                carry = int(near[0])
            else:
                while unused < n and used[unused]:
                    unused += 1
                if unused == n:
                    break
                carry = unused
            used[carry] = True
            seed = carry
        if room:  # only the shard's last window
            rest, bits = window - room, []
            while rest:
                bits.append(1 << (rest.bit_length() - 1))
                rest -= bits[-1]
            queue = list(reversed(seq))
            for size in bits:
                part = []
                while size:
                    d, a, k = queue.pop()
                    take = min(size, k)
                    part.append((d, a, take))
                    size -= take
                    if take < k:
                        queue.append((d, a + take, k - take))
                seqs.append(part)
        else:
            seqs.append(seq)
    return seqs


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, window: int = 2048, blank_free: bool = True, shard_tokens: int = 1 << 20) -> DataFrame:
    """Packs all documents into sequences of ``window`` ids; one row for each piece.

    Null text counts as empty: such a document is its end id alone and is packed like any other.  Null
    doc_ids are allowed and stay null; repeated rows are packed once for each row.  Ties in score go
    to the document that comes first in its shard (in order of its place on the axis, then doc_id).
    An empty table gives no pieces; other columns are not read.
    """
    spark = docs.sparkSession
    parts = staged(encoded(docs, vocabulary, end_id, blank_free), "packing-ids", "lz4")  # ids hardly compress
    n_docs, total = parts.where("kind = 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return spark.createDataFrame([], SHAPE)
    counts = parts.where("kind = 1").groupBy(F.col("doc_id").alias("term")).agg(F.sum("n").alias("n")).toPandas()  # at most the vocabulary
    df = np.zeros(int(counts["term"].max()) + 1, np.int64)
    df[counts["term"].to_numpy()] = counts["n"].to_numpy()
    weights = Weights(df, n_docs, total / n_docs)

    only = parts.where("kind = 0")
    mass = only.groupBy("top").agg(F.sum("n").alias("size")).toPandas().sort_values("top")  # at most the vocabulary
    mass["before"] = mass["size"].cumsum() - mass["size"]
    axis = F.broadcast(spark.createDataFrame(mass.astype({"size": "float64", "before": "float64"}), "top long, size double, before double"))
    # by row and not by doc_id, which can be null or the same for many rows
    within = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.monotonically_increasing_id()), F.lit(1 << 32)) / F.lit(2.0**32)
    dealt = only.join(axis, "top").withColumn("place", F.col("before") + within * F.col("size"))
    dealt = dealt.select(F.floor(F.col("place") / shard_tokens).alias("shard"), "place", "doc_id", "n", "ids")

    def packed(batches):
        forget()
        for shard, t in grouped(batches, "shard"):
            ids, lens, raw = t.column("doc_id").to_pylist(), t.column("n").to_pylist(), t.column("ids").to_pylist()
            held = [unpacked(r, k) for k, r in zip(lens, raw)]
            rows = []
            for s, seq in enumerate(pack_shard(held, weights, window)):
                at = 0
                for d, a, k in seq:
                    rows.append((ids[d], a, k, zlib.crc32(held[d][a : a + k].astype("<u4").tobytes()), lens[d], (int(shard) << 32) | s, at, k == lens[d]))
                    at += k
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:7]), pa.array(cols[7])], [x.split()[0] for x in SHAPE.split(", ")])

    return dealt.repartition(partitions(spark), "shard").sortWithinPartitions("shard", "place", "doc_id").mapInArrow(packed, SHAPE)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

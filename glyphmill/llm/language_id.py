"""Operator 9, language identification by error-correcting output codes.

Each language has a codeword; for each bit a linear classifier over hashed byte n-grams (one to four
bytes of the lower-cased text) tells whether the text's codeword has a one there.  Decoding takes the
codeword of least loss, each bit's loss weighted by how well that bit was told apart in training; a
text whose two nearest codewords are close is flagged as ambiguous.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts_of

BUCKETS = 1 << 13
ORDERS = (1, 2, 3, 4)
LETTER = re.compile(r"[^\W\d_]")
CHUNK = 1 << 19


def features(raw: np.ndarray) -> list[np.ndarray]:
    """For each order the bucket of the n-gram that starts at each byte (short by order - 1 at the end)."""
    x, out, h = raw.astype(np.uint32), [], None
    for k in ORDERS:
        h = x.copy() if h is None else h[:-1] * np.uint32(0x01000193) ^ x[k - 1 :]
        g = (h + np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        out.append((g >> np.uint32(32 - 13)).astype(np.int32))
        if len(h) < 2:
            break
    return out


def profile(raw: bytes) -> np.ndarray:
    """Relative frequencies of the buckets."""
    v = np.zeros(BUCKETS, np.float32)
    b = np.frombuffer(raw, np.uint8)
    if len(b):
        for f in features(b):
            v += np.bincount(f, minlength=BUCKETS)
        v /= v.sum()
    return v


def codebook(n: int) -> np.ndarray:
    """Codewords as rows of -1 and 1: all distinct splits for up to seven classes, else fixed random
    ones of 15 log2 n bits of which no two rows agree on more than about half."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        return np.array([[1 if k == 0 or (bit >> (k - 1)) & 1 else -1 for bit in range(2 ** (n - 1) - 1)] for k in range(n)], np.int8)
    rng = np.random.default_rng(5)
    tries = [rng.choice(np.array([-1, 1], np.int8), (n, int(15 * np.log2(n)))) for _ in range(50)]
    return min(tries, key=lambda m: (m.astype(int) @ m.T.astype(int) - np.eye(n, dtype=int) * 10**6).max())


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """The value of each bit's classifier for each text, over the whole text."""
        out = np.zeros((len(texts), self.code.shape[1]), np.float32)
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
                size += len(texts[end])
                end += 1
            if end == at + 1 and size > CHUNK:
                out[at] = self._long(texts[at])
            else:
                out[at:end] = self._block(texts[at:end])
            at = end
        return out + self.bias

    def _sums(self, raw: np.ndarray) -> np.ndarray:
        hist = np.zeros(BUCKETS, np.int64)
        for f in features(raw):
            hist += np.bincount(f, minlength=BUCKETS)
        return hist

    def _long(self, text: bytes) -> np.ndarray:
        raw, hist, lap = np.frombuffer(text, np.uint8), np.zeros(BUCKETS, np.int64), len(ORDERS) - 1
        for a in range(0, len(raw), CHUNK):
            hist += self._sums(raw[a : a + CHUNK + lap])
            if a + CHUNK < len(raw):  # n-grams that lie in the overlap come again in the next part
                hist -= self._sums(raw[a + CHUNK : a + CHUNK + lap])
        return (hist @ self.weights / max(1, hist.sum())).astype(np.float32)

    def _block(self, texts: list[bytes]) -> np.ndarray:
        raw, lens = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
        out, ends = np.zeros((len(texts), self.code.shape[1]), np.float64), np.cumsum(lens)
        if not len(raw):
            return out
        for k, f in zip(ORDERS, features(raw)):
            s = np.zeros((len(raw) + 1, out.shape[1]), np.float64)
            np.cumsum(self.weights[f], axis=0, out=s[1 : len(f) + 1], dtype=np.float64)
            n = np.maximum(lens - k + 1, 0)
            a = ends - lens
            ok = n > 0
            out[ok] += s[(a + n)[ok]] - s[a[ok]]
        total = sum(np.maximum(lens - k + 1, 0) for k in ORDERS)
        return out / np.maximum(total, 1)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, ambiguous) by least weighted logistic loss."""
        loss = np.stack([(np.logaddexp(0, -margins * row) * self.trust).sum(1) for row in self.code], 1) / self.trust.sum()
        best = loss.argmin(1)
        p = np.exp(-3.0 * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        top = np.sort(p, 1)
        gap = top[:, -1] - top[:, -2] if p.shape[1] > 1 else np.ones(len(p))
        return best, p[np.arange(len(p)), best], gap < 0.2


def learn(texts: list[str], langs: list[str], steps: int = 80) -> Model:
    names = sorted(set(langs))
    if not names:
        return Model([], np.ones((0, 1), np.int8), np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32), np.ones(1))
    code = codebook(len(names))
    x = np.stack([profile(t.lower().encode("utf-8", "replace")) for t in texts])
    scale = 1.0 / np.sqrt((x**2).mean(0) + 1e-8)  # rare n-grams count as much as common ones
    x = x * scale
    y = code[[names.index(v) for v in langs]].astype(np.float32)
    share = np.array([langs.count(v) for v in names], float)
    own = (1 / share)[[names.index(v) for v in langs]].astype(np.float32)
    own /= own.sum()
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    rate = 4.0 / max(1e-6, float((x**2).sum(1).mean()))
    m, mb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):  # accelerated gradient descent on the mean logistic loss
        g = -y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) * own[:, None]
        m = 0.9 * m - rate * (x.T @ g + 1e-6 * w)
        mb = 0.9 * mb - 0.5 * g.sum(0)
        w, b = w + m, b + mb
    right = ((y * (x @ w + b) > 0) * own[:, None]).sum(0).clip(0.5, 0.995)
    return Model(names, code, w * scale[:, None], b, np.log(right / (1 - right)) + 0.05)


def labelled(docs: DataFrame, most: int) -> tuple[list[str], list[str]]:
    """A bounded sample of rows with a language outside the held-out fifth, chosen by a hash."""
    own = docs.select("doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null")
    own = own.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    keys = own.select("doc_id").dropDuplicates().orderBy(F.xxhash64("doc_id", F.lit(9))).limit(most)
    rows = sorted(own.join(F.broadcast(keys), "doc_id").collect(), key=lambda r: (r["doc_id"], r["lang"], r["text"]))
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def language_id(docs: DataFrame, most: int = 3000) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, ambiguous.

    Learns from at most ``most`` rows whose crc32 of doc_id as text mod 5 is not 0, then predicts for every
    whole text; only the text is an input.  Null texts and texts without a letter are ``und`` with score 0 and
    not ambiguous.  Without a labelled row everything is ``und``.  A null doc_id is not held out.
    """
    model = learn(*labelled(docs, most))

    def predict(batches):
        for batch in batches:
            raw = texts_of(batch.column(1))
            known = np.array([bool(LETTER.search(t)) and bool(model.langs) for t in raw], bool)
            pred, score, unsure = np.full(len(raw), "und", object), np.zeros(len(raw)), np.zeros(len(raw), bool)
            at = np.flatnonzero(known)
            if len(at):
                best, p, flag = model.decode(model.margins([raw[i].lower().encode("utf-8", "replace") for i in at]))
                pred[at] = np.array(model.langs, object)[best]
                score[at], unsure[at] = p, flag
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double, ambiguous boolean")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))

"""Operator 7, toxicity by a weighted finite-state pattern grammar.

A clause is read as a sequence of token classes: I insult, T threat verb, Y target, N negation, R verb
of reported speech, Q quotation mark, O other.  Five transducers are composed into one:

    negation   marks insults and threats within three tokens after a negation
    reported   marks those inside quotation marks or, in the clause, after a verb of speech
    target     marks insults within four tokens after a target, and pays for a target after an insult
    threat     pays for a threat verb that a target follows within three tokens
    insult     turns the marks into the kinds that have a factor of their own

A clause's score is the sum of its arcs' weights and of its insults' weights times their factors; single
words outside the grammar's reach (a threat verb without a target) score nothing.  The lexicon of
insults (words, and stems for inflected ones), the factors and the final scale are learned from
labelled rows; a text's score is a logistic function of the sum over its clauses.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, mix64, table, texts_of
from .jaccard_join import shingle_sets
from .transducer import Transducer

# Closed word classes of the four languages.
NEGATIONS = "not no never nor isn't aren't don't nicht kein keine nie pas jamais aucun ni nunca jamás tampoco".split()
SPEECH = "said says wrote called claimed quoted sagte schrieb nannte dit écrit appelé dijo escribió llamó".split()
TARGETS = "you your you're yourself du dich dir ihr euch vous toi tu te usted ustedes vosotros".split()
THREATS = "kill hurt destroy punish strangle töten umbringen verletzen tuer frapper détruire matar golpear destruir".split()

BASE = {"I": "plain", "Ic": "negated", "Ir": "reported", "Icr": "negated", "Iy": "targeted", "Icy": "negated", "Iry": "reported", "Icry": "negated"}
CLASSES = {"I", "T", "Y", "N", "R", "Q", "O"}
STEMS = (3, 4, 5, 6, 7, 8)  # letters
BREAK = re.compile(r"[.!?;:|]+(?=\s|$)|[\n\r]+")
TOKEN = re.compile(r"[^\W_][\w'’]*|[\"“”«»„]")
WORD = re.compile(r"[^\W\d_][\w'’]*")


def grammar(factors: dict[str, float]) -> tuple[Transducer, dict[str, float]]:
    """The composed transducer, and by kind of insult the factor of a token's weight."""
    negation = Transducer("n0")
    for k in (1, 2, 3):
        negation.default[f"n{k}"] = f"n{k - 1}"
        negation.on(f"n{k}", "I", "Ic", 0, f"n{k - 1}").on(f"n{k}", "T", "O", 0, f"n{k - 1}").on(f"n{k}", "N", "N", 0, "n3")
    negation.on("n0", "N", "N", 0, "n3")
    reported = Transducer("r0").on("r0", "R", "R", 0, "r1").on("r0", "Q", "Q", 0, "r2").on("r1", "Q", "Q", 0, "r2").on("r2", "Q", "Q", 0, "r0")
    for s in ("r1", "r2"):
        reported.on(s, "I", "Ir", 0, s).on(s, "Ic", "Icr", 0, s).on(s, "T", "O", 0, s)
    target = Transducer("y0").on("y0", "Y", "Y", 0, "y4")
    for k in (1, 2, 3, 4):
        target.default[f"y{k}"] = f"y{k - 1}"
        target.on(f"y{k}", "Y", "Y", 0, "y4")
        for i in ("I", "Ic", "Ir", "Icr"):
            target.on(f"y{k}", i, i + "y", 0, f"y{k - 1}")
    for i in ("I", "Ir"):  # an insult, then a target
        target.on("y0", i, i, 0, "p3")
    for k in (1, 2, 3):
        target.default[f"p{k}"] = f"p{k - 1}" if k > 1 else "y0"
        target.on(f"p{k}", "Y", "Y", 0.5, "y4")
    threat = Transducer("t0").on("t0", "T", "T", 0, "t3")
    for k in (1, 2, 3):
        threat.default[f"t{k}"] = f"t{k - 1}"
        threat.on(f"t{k}", "Y", "Y", 4.0, "t0").on(f"t{k}", "T", "T", 0, "t3")
    insult = Transducer("i0")
    for mark, kind in BASE.items():
        insult.on("i0", mark, kind, 0, "i0")
    symbols = CLASSES | set(BASE)
    whole = negation.compose(reported, symbols).compose(target, symbols).compose(threat, symbols).compose(insult, symbols)
    return whole, dict(factors)


PRIOR = {"plain": 1.0, "targeted": 1.2, "negated": 0.4, "reported": 0.5}


@dataclass
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    factors: dict[str, float]
    scale: tuple[float, float, float]

    def prepared(self) -> Model:
        import ahocorasick

        self.machine, self.by_symbol = grammar(self.factors)
        self.closed = {**dict.fromkeys(THREATS, "T"), **dict.fromkeys(TARGETS, "Y"), **dict.fromkeys(SPEECH, "R"), **dict.fromkeys(NEGATIONS, "N")}
        self.lengths = sorted({len(s) for s in self.stems})
        self.memo: dict[str, tuple[str, float]] = {}
        self.finder = ahocorasick.Automaton()
        for s in [*self.words, *self.stems, *THREATS]:
            self.finder.add_word(s, 1)
        self.finder.make_automaton()
        return self

    def weight(self, word: str) -> float:
        w = self.words.get(word, 0.0)
        for k in self.lengths:  # a stem is learned from longer words, and says nothing of a word that it is
            w = max(w, self.stems.get(word[:k], 0.0) if len(word) > k else 0.0)
        return w

    def symbol(self, word: str) -> tuple[str, float]:
        got = self.memo.get(word)
        if got is None:
            w = self.weight(word)
            got = ("I", w) if w else ("Q", 0.0) if word in '"“”«»„' else (self.closed.get(word, "O"), 0.0)
            if len(self.memo) < 200_000:
                self.memo[word] = got
        return got

    def clauses(self, text: str) -> list[tuple[float, list[str]]]:
        """(score, marks of its insults) of each clause that has one or a threat."""
        low = text.lower()
        if next(self.finder.iter(low), None) is None:
            return []
        out = []
        for clause in BREAK.split(low):
            if next(self.finder.iter(clause), None) is None:
                continue
            read = [self.symbol(w) for w in TOKEN.findall(clause)]
            marked = self.machine.run([s for s, _ in read])
            score, marks = 0.0, []
            for (o, w), (_, own) in zip(marked, read):
                score += w + own * self.by_symbol.get(o, 0.0)
                if o in self.by_symbol:
                    marks.append(o)
            if score:
                out.append((score, marks))
        return out

    def total(self, text: str) -> float:
        return sum(s for s, _ in self.clauses(text))

    def probability(self, total: float) -> float:
        a, b, c = self.scale
        z = a + b * (total > 0) + c * math.log1p(total)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def signal(k1: int, n1: int, k0: int, n0: int) -> float:
    """The likelihood ratio (G squared) of a feature found in k1 of n1 and in k0 of n0 texts."""
    p = (k1 + k0) / (n1 + n0)
    g = 0.0
    for k, n in ((k1, n1), (k0, n0)):
        for x, e in ((k, n * p), (n - k, n * (1 - p))):
            g += 2 * x * math.log(x / e) if x and e else 0.0
    return g


def first_copies(texts: list[str], tries: int = 8) -> list[int]:
    """The first of each group of (near) copies: texts that share one of ``tries`` MinHash values of their word shingles.

    The words of a text that was copied often would else look like a sign of its label."""
    seen: set[tuple[int, int]] = set()
    out = []
    for i, x in enumerate(shingle_sets(texts)):
        keys = {(k, int(mix64(x ^ U64(0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1))).min())) for k in range(tries)} if len(x) else {(-1, i)}
        if not keys & seen:
            out.append(i)
        seen |= keys
    return out


def learn(texts: list[str], toxic: list[int], least_signal: float = 14.0, least_weight: float = 2.5) -> Model:
    """Learns lexicon, factors and scale from labelled texts."""
    alone = first_copies(texts)
    pos, neg = ([set(WORD.findall(texts[i].lower())) for i in alone if bool(toxic[i]) == y] for y in (True, False))
    n1, n0 = max(1, len(pos)), max(1, len(neg))
    stems_of = lambda s: {w[:k] for w in s for k in STEMS if len(w) > k}
    words1, stems1 = Counter(w for s in pos for w in s), Counter(p for s in pos for p in stems_of(s))
    words1 = {w: k for w, k in words1.items() if k >= 3 and len(w) >= 3}
    stems1 = {p: k for p, k in stems1.items() if k >= 4}
    words0, stems0 = Counter(w for s in neg for w in s if w in words1), Counter(p for s in neg for p in stems_of(s) if p in stems1)
    weigh = lambda k1, k0: math.log((k1 + 0.5) / (n1 + 1)) - math.log((k0 + 0.5) / (n0 + 1))

    def chosen(one: dict, zero: Counter) -> dict[str, float]:
        return {f: weigh(k, zero[f]) for f, k in one.items() if weigh(k, zero[f]) >= least_weight and signal(k, n1, zero[f], n0) >= least_signal}

    words, stems = chosen(words1, words0), chosen(stems1, stems0)
    forms: dict[str, Counter] = {p: Counter() for p in stems}
    for s in pos:
        for w in s:
            for k in STEMS:
                if len(w) > k and w[:k] in forms:
                    forms[w[:k]][w] += 1
    # a stem needs several forms of which none stands for most of it; of nested stems the longest
    # with about the same support is meant
    stems = {p: w for p, w in stems.items() if len(forms[p]) >= 3 and max(forms[p].values()) <= 0.6 * sum(forms[p].values())}
    stems = {p: w for p, w in stems.items() if not any(q != p and q.startswith(p) and stems1[q] >= 0.8 * stems1[p] and stems0[q] <= stems0[p] for q in stems)}
    model = Model(words, stems, dict(PRIOR), (0.0, 0.0, 0.0)).prepared()

    seen = [model.clauses(t) for t in texts]
    tally = {k: [0, 0] for k in PRIOR}
    for found, y in zip(seen, toxic):
        kinds = {m for _, marks in found for m in marks}
        if len(kinds) == 1:
            tally[kinds.pop()][1 - y] += 1
    factors = {k: PRIOR[k] * (8 * 1 + p / max(1e-9, PRIOR[k])) / (8 + p + n) if p + n else PRIOR[k] for k, (p, n) in tally.items()}
    model = Model(words, stems, {k: min(1.2, max(0.0, v)) for k, v in factors.items()}, (0.0, 0.0, 0.0)).prepared()

    totals = np.array([model.total(t) for t in texts])
    x = np.stack([np.ones(len(totals)), totals > 0, np.log1p(totals)], 1).astype(float) if len(totals) else np.zeros((0, 3))
    y, beta, ridge = np.array(toxic, float), np.zeros(3), np.diag([0.05, 0.05, 0.05])
    for _ in range(25):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + ridge
        beta = beta + np.linalg.solve(h, x.T @ (y - p) - ridge @ beta)
    return Model(words, stems, model.factors, tuple(beta.tolist()))


def labelled(docs: DataFrame, labels: DataFrame, most_toxic: int, most_clean: int) -> tuple[list[str], list[int]]:
    """A bounded sample of labelled rows outside the held-out quarter, chosen by a hash of doc_id."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    own = own.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).dropDuplicates(["doc_id"])
    order = F.xxhash64("doc_id", F.lit(7))
    some = own.where("toxic = 1").orderBy(order).limit(most_toxic).unionByName(own.where("toxic = 0").orderBy(order).limit(most_clean))
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "text", "toxic").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["text"] or ""))
    return [r["text"] or "" for r in rows], [r["toxic"] for r in rows]


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_toxic: int = 1500, most_clean: int = 4500) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_clauses, worst_clause_score.

    Learns from at most ``most_toxic`` + ``most_clean`` labelled rows (crc32 of doc_id as text mod 4 not 2), then
    scores every whole text; only the text is an input of a score.  Null and empty texts have no clause and
    get the score of a text without any.  Repeated rows are scored each; a null doc_id is never held out.
    Without labels every score is that of an even chance.  An empty table gives an empty result.
    """
    texts, toxic = labelled(docs, labels, most_toxic, most_clean)
    learned = learn(texts, toxic)

    def score(batches):
        model = Model(learned.words, learned.stems, learned.factors, learned.scale).prepared()
        for batch in batches:
            found = [[s for s, _ in model.clauses(t)] for t in texts_of(batch.column(1))]
            p = [model.probability(sum(x)) for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array([len(x) for x in found], pa.int64()), pa.array([max(x, default=0.0) for x in found], pa.float64())],
                ["doc_id", "score", "n_clauses", "worst_clause_score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double, n_clauses long, worst_clause_score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_clauses", "worst_clause_score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_clean(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """Pipeline stage: the documents that are not predicted toxic.  ``corpus`` has the texts of the labels."""
    texts, toxic = labelled(docs if corpus is None else corpus, labels, 1500, 4500)
    learned = learn(texts, toxic)

    def keep(batches):
        model = Model(learned.words, learned.stems, learned.factors, learned.scale).prepared()
        for batch in batches:
            col = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([model.probability(model.total(t)) < 0.3 for t in texts_of(col)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)

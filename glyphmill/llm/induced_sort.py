"""Suffix arrays with common-prefix values by external induced sorting.

The text's suffixes are L (larger than the next one) or S; leftmost S suffixes (LMS) are sorted
first: their substrings are sorted by a first induction and named, and if names repeat, the string of
names is sorted by the same procedure, recursively.  From sorted LMS suffixes all L suffixes are
induced in ascending and then all S suffixes in descending order.

Text, types, names, ranks and results are files, mapped and read in blocks.  An induction is driven by a
priority queue over ranges of symbols: a range is one frequent symbol, or neighbouring ones with about a block
of suffixes.  What the queue gives for the least range is scanned in order, and each scanned suffix whose
predecessor in the text has the wanted type puts that predecessor into the queue, behind what has the
same symbol.  Beyond its memory budget the queue's contents lie in a file.  Predecessors in the range that is being scanned join
it at once: their order follows from that of the suffixes that sent them.

Tuples carry the common-prefix value with the one before them in their bucket: one more than the least value
scanned since the last tuple that went to the same symbol.  Of the names' common prefixes the recursion
makes the first part of those of the LMS suffixes.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

BUDGET = 64 << 20  # bytes of queued tuples, and of what is worked on at once
LONGEST = 2**31 - 1  # symbols of a shard: suffixes are 32-bit numbers; no value of a column is longer


def mapped(n: int, dtype: str) -> np.ndarray:
    """An array of zeros in a scratch file of this task, which goes with the array."""
    kind = np.dtype(dtype)
    if not n:
        return np.zeros(0, kind)
    with tempfile.TemporaryFile() as f:
        f.truncate(n * kind.itemsize)
        return np.frombuffer(mmap.mmap(f.fileno(), n * kind.itemsize), kind)


def spans(n: int, block: int):
    return ((a, min(a + block, n)) for a in range(0, n, block))


class BatchQueue:
    """Priority queue of (range; suffix, common prefix) tuples, first in first out for each range."""

    def __init__(self, budget: int):
        self.budget, self.held, self.spills, self.file = budget, 0, 0, None
        self.parts: dict[int, list] = {}

    def push(self, at: int, suffix: np.ndarray, prefix: np.ndarray) -> None:
        self.parts.setdefault(at, []).append((suffix.astype(np.int32), prefix.astype(np.int16)))
        self.held += 6 * len(suffix)
        if self.held > self.budget:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for at, parts in self.parts.items():
            here = [p for p in parts if not isinstance(p[0], int)]
            if here:
                a, b = (np.concatenate(x) for x in zip(*here))
                self.parts[at] = [p for p in parts if isinstance(p[0], int)] + [(self.file.tell(), len(a))]
                self.file.write(a.tobytes() + b.tobytes())
        self.held = 0
        self.spills += 1

    def chunks(self, at: int, block: int):
        """The tuples of a range in order of arrival, with those that arrive meanwhile, by about a block at once."""
        while at in self.parts:
            some, size = [], 0
            for a, b in self.parts.pop(at):
                if isinstance(a, int):
                    self.file.seek(a)
                    raw = self.file.read(6 * b)
                    a, b = np.frombuffer(raw, np.int32, b), np.frombuffer(raw, np.int16, b, 4 * b)
                else:
                    self.held -= 6 * len(a)
                some.append((a, b))
                size += len(a)
                if size >= block:
                    yield tuple(np.concatenate(x) for x in zip(*some))
                    some, size = [], 0
            if some:
                yield tuple(np.concatenate(x) for x in zip(*some))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Text:
    """A string of positive symbols with the sentinel 0 at its end: suffix types, LMS suffixes, ranges, comparisons."""

    def __init__(self, symbols: np.ndarray, cap: int, budget: int):
        if len(symbols) > LONGEST:
            raise ValueError(f"a shard has {len(symbols)} symbols, suffixes are numbered up to {LONGEST}")
        self.t, self.cap, self.n, self.budget = symbols, cap, len(symbols), budget
        self.block = max(256, min(budget // 128, max(4096, self.n // 16)))
        t, n = symbols, self.n
        self.is_s = mapped(n, "?")
        self.is_s[-1] = True
        found = 0
        for a, b in reversed(list(spans(n - 1, self.block))):
            up = np.sign(t[a + 1 : b + 1].astype(np.int64) - t[a:b])
            at = np.where(up != 0, np.arange(b - a), b - a)
            at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where symbols differ
            self.is_s[a:b] = np.where(at < b - a, up[np.minimum(at, b - a - 1)] > 0, self.is_s[b])
            found += int((self.is_s[a + 1 : b + 1] & ~self.is_s[a:b]).sum())
        self.lms, k = mapped(found, "<i4"), 0
        sigma = 1 + max((int(t[a:b].max()) for a, b in spans(n, self.block)), default=0)
        count = mapped(sigma, "<i8")
        for a, b in spans(n, self.block):
            if a < n - 1:
                z = min(b, n - 1)
                at = np.flatnonzero(self.is_s[a + 1 : z + 1] & ~self.is_s[a:z]) + a + 1
                self.lms[k : k + len(at)] = at
                k += len(at)
            symbol, times = np.unique(t[a:b], return_counts=True)
            count[symbol] += times
        # frequent symbols are ranges of their own
        self.sigma, often = sigma, count > self.block // 2
        cut = np.zeros(sigma, bool)
        cut[1:] = often[1:] | often[:-1] | (np.diff(np.cumsum(count) // self.block) > 0)
        self.range = mapped(sigma, "<i4")
        self.range[:] = np.cumsum(cut)
        self.ranges = int(self.range[-1]) + 1
        first = np.concatenate(([0], np.flatnonzero(cut)))
        self.single = np.diff(first, append=sigma) == 1
        self.words = None
        if cap > 8 and sigma <= 512:  # three symbols in one word
            self.words = mapped(n, "<i4")
            for a, b in spans(n, self.block):
                p = np.zeros(b - a + 2, np.int32)
                z = min(n, b + 2)
                p[: z - a] = t[a:z]
                self.words[a:b] = (p[:-2] << 18) | (p[1:-1] << 9) | p[2:]

    def prefix(self, a: np.ndarray, b: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """Length of the common prefix of the suffixes a and b, at most ``cap``, if it is at least ``known``."""
        n, out = self.n, np.zeros(len(a), np.int64) if known is None else np.minimum(known, self.cap)
        open_ = np.flatnonzero(out < self.cap)
        while self.words is not None and len(open_):
            x, y = a[open_] + out[open_], b[open_] + out[open_]
            ok = (np.maximum(x, y) + 3 <= n) & (self.words[np.minimum(x, n - 1)] == self.words[np.minimum(y, n - 1)])
            out[open_[ok]] += 3
            open_ = open_[ok & (out[open_] < self.cap)]
        open_ = np.flatnonzero(out < self.cap)
        while len(open_):
            x, y = a[open_] + out[open_], b[open_] + out[open_]
            ok = (np.maximum(x, y) < n) & (self.t[np.minimum(x, n - 1)] == self.t[np.minimum(y, n - 1)])
            out[open_[ok]] += 1
            open_ = open_[ok & (out[open_] < self.cap)]
        return np.minimum(out, self.cap)


class Carrier:
    """The least common prefix scanned since the last tuple that went to each symbol.

    ``stamp`` is the number of the batch that sent it and ``tail`` the least value after it in that batch; ``at`` and ``low``
    are a stack of batches, each with the least value from it on."""

    def __init__(self, sigma: int, cap: int):
        self.cap, self.now = cap, 0
        self.stamp, self.tail = mapped(sigma, "<i4"), mapped(sigma, "<i2")
        self.at: list[int] = []
        self.low: list[int] = []

    def scan(self, target: np.ndarray, send: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a scanned batch the senders, grouped by target in scan order, and their values."""
        who = np.flatnonzero(send)
        who = who[np.argsort(target[who], kind="stable")]
        self.now += 1
        if len(who):
            to = target[who]
            new = np.concatenate(([True], to[1:] != to[:-1]))
            low = np.where(new, 0, np.concatenate(([0], who[:-1] + 1)))
            table, out = [lcp], np.zeros(len(who), np.int64)
            level = np.frexp((who - low + 1).astype(float))[1] - 1
            for k in range(int(level.max()) + 1):
                if k:
                    h = 1 << (k - 1)
                    table = [np.minimum(table[0][:-h], table[0][h:])]
                at = np.flatnonzero(level == k)
                out[at] = np.minimum(table[0][low[at]], table[0][who[at] - (1 << k) + 1])
            stamp = self.stamp[to[new]]
            since = np.append(np.array(self.low, np.int64), self.cap)[np.searchsorted(np.array(self.at, np.int64), stamp + 1)]
            out[new] = np.where(stamp == 0, -1, np.minimum(out[new], np.minimum(self.tail[to[new]], since)))
            last = np.concatenate((to[1:] != to[:-1], [True]))
            tail = np.append(np.minimum.accumulate(lcp[::-1])[::-1], self.cap)
            self.stamp[to[last]], self.tail[to[last]] = self.now, tail[who[last] + 1]
        else:
            out = np.zeros(0, np.int64)
        if len(lcp):
            least = int(lcp.min())
            while self.low and self.low[-1] >= least:
                self.at.pop()
                self.low.pop()
            self.at.append(self.now)
            self.low.append(least)
        return who, np.minimum(out + 1, self.cap)


def sequence(text: Text, r: int, first: tuple, then: tuple, kind: bool, sign: int, carry: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of a range in scan order, the common prefix of each with the one before, and which were in ``then``.

    Of one symbol come the tuples of ``first``, then the predecessors that the range itself sends, in order of their
    senders, then those of ``then``."""
    t, is_s, of = text.t, text.is_s, text.range
    all_ = [np.concatenate((first[0], then[0]))]
    sender = [np.full(len(all_[0]), -1)]
    at, total = np.arange(len(all_[0])), len(all_[0])
    while len(at):
        prev = all_[-1] - 1
        ok = prev >= 0
        ok[ok] = (is_s[prev[ok]] == kind) & (of[t[prev[ok]]] == r)
        all_.append(prev[ok])
        sender.append(at[ok])
        at = np.arange(total, total + len(all_[-1]))
        total += len(at)
    suffix, nxt = np.concatenate(all_), np.concatenate(sender)
    known, a = len(all_[0]), len(first[0])
    symbol = t[suffix].astype(np.int64) * sign
    part, seq = np.ones(total, np.int64), np.zeros(total, np.int64)
    part[:a], part[a:known] = 0, 2
    seq[:known] = np.arange(known)
    order = np.lexsort((seq, part, symbol))
    x = np.stack((symbol[order], part[order], seq[order]))
    rank = np.empty(total, np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], (x[:, 1:] != x[:, :-1]).any(0))))[:total]
    while total and rank[order[-1]] < total - 1:  # ties are among what the range sent: its senders decide
        key = rank * (total + 1) + np.where(nxt >= 0, rank[nxt] + 1, 0)
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
        nxt = np.where(nxt >= 0, nxt[nxt], -1)
    suffix, part = suffix[order], part[order]
    value = np.zeros(total, np.int64)
    if carry and total:
        value[:known] = np.concatenate((first[1], then[1]))
        value, symbol = value[order], symbol[order]
        same = np.concatenate(([False], symbol[1:] == symbol[:-1]))
        open_ = np.flatnonzero(same & ((part == 1) | np.concatenate(([False], part[1:] != part[:-1]))))
        value[~same] = 0
        value[open_] = text.prefix(suffix[open_ - 1], suffix[open_])
    return suffix, value, part == 2


def induce(text: Text, lms: np.ndarray, lms_lcp: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffixes in order, (with ``lms_lcp``) the common prefix of each with the one before, and how often a queue spilled.

    ``lms`` are the LMS suffixes in order of what is known of them: their first symbol, or their rank."""
    t, is_s, n, of, block, carry = text.t, text.is_s, text.n, text.range, text.block, lms_lcp is not None
    none = (np.zeros(0, np.int64), np.zeros(0, np.int16))

    def scan(suffix: np.ndarray, value: np.ndarray, kind: bool, within: int = -1) -> None:
        prev = suffix - 1
        send = (prev >= 0) & (is_s[prev] == kind)
        target = t[prev]
        if within >= 0:  # what stays in the range is there already
            send &= of[target] != within
        if carrier is None:
            who = np.flatnonzero(send)
            who = who[np.argsort(target[who], kind="stable")]
            value = np.zeros(len(who), np.int16)
        else:
            who, value = carrier.scan(target, send, value)
        to = of[target[who]]
        cuts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1], [True]))).tolist() if len(to) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            queue.push(int(to[a]), prev[who[a:b]], value[a:b])

    def seam(a: int, b: int) -> int:
        return int(text.prefix(np.array([a]), np.array([b]))[0]) if carry and min(a, b) >= 0 else 0

    seeds = np.zeros(text.ranges + 1, np.int64)
    for a, b in spans(len(lms), block):
        seeds[1:] += np.bincount(of[t[lms[a:b]]], minlength=text.ranges)
    seeds = np.cumsum(seeds)
    queue, carrier = BatchQueue(text.budget), Carrier(text.sigma, text.cap) if carry else None
    up, up_lcp, ends = mapped(n, "<i4"), mapped(n if carry else 0, "<i2"), [0]

    def keep(suffix: np.ndarray, value: np.ndarray) -> None:
        a = ends[-1]
        ends[-1] = a + len(suffix)
        up[a : ends[-1]] = suffix
        if carry:
            up_lcp[a : ends[-1]] = value

    for r in range(text.ranges):
        ends.append(ends[-1])
        low, high = int(seeds[r]), int(seeds[r + 1])
        if text.single[r]:
            last = -1
            for suffix, value in queue.chunks(r, block):
                suffix = suffix.astype(np.int64)
                for a, b in spans(len(suffix), block):
                    keep(suffix[a:b], value[a:b])
                    scan(suffix[a:b], value[a:b], False)
                last = int(suffix[-1])
            for a, b in spans(high - low, block):
                suffix = lms[low + a : low + b].astype(np.int64)
                value = lms_lcp[low + a : low + b].copy() if carry else none[1]
                if carry and a == 0:
                    value[0] = seam(last, int(suffix[0]))
                scan(suffix, value, False)
            continue
        got = list(queue.chunks(r, block)) or [none]
        if high > low or len(got[0][0]):
            first = tuple(np.concatenate(x).astype(np.int64) for x in zip(*got))
            suffix, value, seed = sequence(text, r, first, (lms[low:high].astype(np.int64), lms_lcp[low:high] if carry else np.zeros(high - low)), False, 1, carry)
            keep(suffix[~seed], value[~seed])
            scan(suffix, value.astype(np.int16), False, r)
    spills = queue.spills
    queue.close()

    queue, carrier = BatchQueue(text.budget), Carrier(text.sigma, text.cap) if carry else None
    queue.push(int(of[0]), np.array([n - 1]), np.zeros(1, np.int64))
    sa, lcp, end = mapped(n, "<i4"), mapped(n + 1 if carry else 0, "<i2"), n

    def emit(suffix: np.ndarray, value: np.ndarray) -> int:
        # in descending order a value belongs to the pair of a suffix and the one scanned before it
        a = end - len(suffix)
        sa[a:end] = suffix[::-1]
        if carry:
            lcp[a + 1 : end + 1] = value[::-1]
        return a

    for r in range(text.ranges - 1, -1, -1):
        low, high = ends[r], ends[r + 1]
        if text.single[r]:
            last = -1
            for suffix, value in queue.chunks(r, block):
                suffix = suffix.astype(np.int64)
                for a, b in spans(len(suffix), block):
                    end = emit(suffix[a:b], value[a:b])
                    scan(suffix[a:b], value[a:b], True)
                last = int(suffix[-1])
            for a, b in spans(high - low, block):
                suffix, value = up[high - b : high - a][::-1].astype(np.int64), none[1]
                if carry:
                    value = np.zeros(b - a, np.int16)
                    value[1:] = up_lcp[high - b + 1 : high - a][::-1]
                    value[0] = up_lcp[high - a] if a else seam(int(suffix[0]), last)
                end = emit(suffix, value)
                scan(suffix, value, True)
            continue
        got = list(queue.chunks(r, block)) or [none]
        if high > low or len(got[0][0]):
            value = np.zeros(high - low, np.int64)
            if carry and high > low:
                value[1:] = up_lcp[low + 1 : high][::-1]
            suffix, value, _ = sequence(text, r, tuple(np.concatenate(x).astype(np.int64) for x in zip(*got)), (up[low:high][::-1].astype(np.int64), value), True, -1, carry)
            end = emit(suffix, value)
            scan(suffix, value.astype(np.int16), True, r)
    spills += queue.spills
    queue.close()
    return sa, lcp[:n], spills


def order_of_lms(text: Text, carry: bool) -> tuple[np.ndarray, np.ndarray | None, int]:
    """The LMS suffixes in sorted order, with ``carry`` the common prefix of each with the one before, and spills."""
    lms, t, n, block, k = text.lms, text.t, text.n, text.block, len(text.lms)
    order, spills = lms, 0
    shared = mapped(k, "<i2") if carry else None
    if k > 1:
        count = mapped(text.sigma, "<i8")
        for a, b in spans(k, block):
            symbol, times = np.unique(t[lms[a:b]], return_counts=True)
            count[symbol] += times
        place, rough = mapped(text.sigma, "<i8"), mapped(k, "<i4")
        place[1:] = np.cumsum(count)[:-1]
        number = mapped(n // 2 + 1, "<i4")  # LMS suffixes are two places apart at least
        for a, b in spans(k, block):
            at = lms[a:b]
            number[at // 2] = np.arange(a, b)
            by = np.argsort(t[at], kind="stable")
            symbol, first, times = np.unique(t[at][by], return_index=True, return_counts=True)
            rough[np.repeat(place[symbol] - first, times) + np.arange(b - a)] = at[by]
            place[symbol] += times
        sa, _, spills = induce(text, rough, None)
        order, j = rough, 0
        for a, b in spans(n, block):
            at = sa[a:b]
            at = at[(at > 0) & is_lms(text, at)]
            order[j : j + len(at)] = at
            j += len(at)
        del sa
        names, name, before = mapped(k, "<i4"), -1, None
        for a, b in spans(k, block):
            at = order[a:b].astype(np.int64)
            x = np.concatenate(([at[0] if before is None else before], at[:-1]))
            same = equal_substrings(text, number, x, at)
            if before is None:
                same[0] = False
            own = name + np.cumsum(~same)
            names[number[at // 2]] = own
            name, before = int(own[-1]), at[-1]
        if name < k - 1:
            inner, common, more = suffix_array(names, text.cap // 2 + 1 if carry else 0, text.budget)
            spills += more
            for a, b in spans(k, block):
                order[a:b] = lms[inner[a:b]]
            if carry:  # so many names are common, and what they stand for
                for a, b in spans(k, block):
                    i = inner[a:b].astype(np.int64)
                    shared[a:b] = np.minimum(lms[np.minimum(i + common[a:b], k - 1)] - lms[i], text.cap)
        if carry:
            for a, b in spans(k, block):
                x = order[max(a - 1, 0) : b].astype(np.int64)
                at = slice(max(a, 1), b)
                shared[at] = text.prefix(x[:-1], x[1:], shared[at].astype(np.int64))
            shared[0] = 0
    return order, shared, spills


def is_lms(text: Text, at: np.ndarray) -> np.ndarray:
    return text.is_s[at] & ~text.is_s[at - 1]


def equal_substrings(text: Text, number: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the LMS substrings at a and b (to the next LMS suffix, with its symbol) are equal; the sentinel's is its own."""
    k = len(text.lms)
    i, j = number[a // 2], number[b // 2]
    size = text.lms[np.minimum(i + 1, k - 1)] - a
    same = (size == text.lms[np.minimum(j + 1, k - 1)] - b) & (size > 0)
    open_, d = np.flatnonzero(same), 0
    while len(open_):
        x, y = a[open_] + d, b[open_] + d
        differ = (text.t[x] != text.t[y]) | (text.is_s[x] != text.is_s[y])
        same[open_[differ]] = False
        open_ = open_[~differ & (size[open_] > d)]
        d += 1
    return same


def suffix_array(symbols: np.ndarray, cap: int, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray, int]:
    """(suffix array, common prefix with the suffix before, at most ``cap``, spills of the queues) of a string whose last
    symbol is 0 and occurs nowhere else.  With ``cap`` 0 no common prefixes are carried."""
    text = Text(symbols, max(cap, 1), budget)
    order, shared, before = order_of_lms(text, cap > 0)
    sa, lcp, spills = induce(text, order, shared)
    return sa, lcp, spills + before

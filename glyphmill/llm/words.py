"""Words as 64-bit hashes, for many texts at once and without a Python object for each word.

A word is a maximal run of letters, digits and other non-ASCII characters of the lower-cased text; ASCII
punctuation and white space separate words."""

from __future__ import annotations

import numpy as np

from .common import U64, mix64

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BLOCK = 1 << 19  # bytes

_CODES = mix64(np.arange(1, 257, dtype=U64) * U64(0xA24BAED4963EE407))
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK + (1 << 16))
        _POWERS[:] = []
        for b in (BASE, BASE_INVERSE):
            x = np.full(size, b, U64)
            x[0] = 1
            _POWERS.append(np.multiply.accumulate(x))
    return _POWERS[0], _POWERS[1]


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, bounds): the words of text i are ``hashes[bounds[i]:bounds[i + 1]]``."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    lens = np.array([len(x) for x in raw], np.int64)
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    starts_of_text = np.concatenate(([0], np.cumsum(lens + 1)))
    if len(buf) < 2:
        return np.zeros(0, U64), np.zeros(len(texts) + 1, np.int64)
    inside = _IS_WORD[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    a, b = edge[0::2], edge[1::2]
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, U64)
    np.cumsum(_CODES[buf] * up[: len(buf)], out=total[1:])
    h = mix64((total[b] - total[a]) * down[a] + (b - a).astype(U64))
    return h, np.searchsorted(a, starts_of_text)


def in_blocks(texts: list[str], size: int = BLOCK):
    """(first, last) of runs of texts of about ``size`` characters."""
    a, n = 0, 0
    for i, t in enumerate(texts):
        if i > a and n + len(t) > size:
            yield a, i
            a, n = i, 0
        n += len(t)
    if a < len(texts):
        yield a, len(texts)


def combined(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams of the sequence; fewer than n words give none."""
    if len(h) < n:
        return np.zeros(0, U64)
    k = len(h) - n + 1
    out = np.zeros(k, U64)
    for j in range(n):
        out = out * U64(0xD1342543DE82EF95) + h[j : j + k]
    return mix64(out)


# Which bytes are part of a word: ASCII letters and digits and all of other characters, or all but white space.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
BLACK = np.ones(256, bool)
BLACK[[32, *range(9, 14)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _pieces(raw: list[bytes], inside: np.ndarray, size: int):
    """(text, part of its bytes): texts as they are, long ones cut where no word is."""
    for i, x in enumerate(raw):
        a = 0
        while len(x) - a > size:
            view = np.frombuffer(x, np.uint8, offset=a)
            gaps = np.flatnonzero(~inside[view[:size]])
            if len(gaps):
                b = int(gaps[-1]) + 1
            else:  # one word longer than a block
                more = np.flatnonzero(~inside[view[size:]])
                b = size + int(more[0]) + 1 if len(more) else len(view)
            yield i, x[a : a + b]
            a += b
        yield i, x[a:] if a else x


def hashed_runs(raw: list[bytes], inside: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """``hashed`` for bytes: words are the runs of bytes that ``inside`` has, with A-Z lower-cased.  Long texts are hashed
    in parts of about ``size`` bytes, so that working memory does not grow with them."""
    out, counts, held, n = [], np.zeros(len(raw) + 1, np.int64), [], 0

    def flush():
        buf = _LOWER[np.frombuffer(b" ".join(x for _, x in held) + b" ", np.uint8)]
        within = inside[buf]
        edge = np.flatnonzero(within[1:] != within[:-1]) + 1
        if within[0]:
            edge = np.concatenate(([0], edge))
        a, b = edge[0::2], edge[1::2]
        up, down = powers(len(buf) + 1)
        total = np.zeros(len(buf) + 1, U64)
        np.cumsum(_CODES[buf] * up[: len(buf)], out=total[1:])
        out.append(mix64((total[b] - total[a]) * down[a] + (b - a).astype(U64)))
        starts = np.cumsum([0] + [len(x) + 1 for _, x in held])
        np.add.at(counts, np.array([i for i, _ in held]) + 1, np.diff(np.searchsorted(a, starts)))
        held.clear()

    for i, x in _pieces(raw, inside, size):
        if held and n + len(x) > size:
            flush()
            n = 0
        held.append((i, x))
        n += len(x) + 1
    if held:
        flush()
    return np.concatenate(out) if out else np.zeros(0, U64), np.cumsum(counts)

"""Encoding texts with the ``tokenizers`` library, each distinct piece of text once.

Both pre-tokenisers used here never match across the start of a run of white space, so a text can be
cut there and its pieces encoded apart: the concatenated ids are those of the whole text.  Pieces are
remembered in a bounded table.  Texts with runs of white space, where that counts, and with odd
separators are encoded whole.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Characters on whose class Python, Arrow and the library may differ, and this module's own marks.
ODD = r"[\x{1c}-\x{1f}\x{85}\x{180e}\x{200b}-\x{200d}\x{2060}\x{feff}\x{e000}\x{e001}]"
BLANK = r"|[\t\r\v\f\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
FIRST, LINE = "\ue000", "\ue001"
BLOCK = 3 << 20  # characters
MARKS = "!#$%&*+,-./:;<=>?@|"
# Fixed rule of byte-level vocabularies: bytes that print stand for themselves, the others follow from U+0100.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}
LONG = 48  # characters
ROOM = 1 << 22  # ids, and characters eight times as many, of remembered pieces


class PieceEncoder:
    """``blank_free``: the vocabulary drops white space, so pieces are words without it.

    ``known`` has the remembered pieces and ``pool`` their ids, one after another; ``first`` says where a piece's
    ids begin and ``size`` how many they are.  A full table is emptied."""

    def __init__(self, path: str, blank_free: bool, room: int = 400_000):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.blank_free, self.room = blank_free, room
        # with white space kept, only single blanks and line feeds between other characters are cut at
        self.tails: dict[str, list[int]] = {}
        self.odd = ODD if blank_free else ODD + BLANK + r"|[ \n][ \n]|[ \n]\z"
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.pool, self.used = np.zeros(1 << 16, "<u4"), 0
        self.first, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _whole(self, texts: list[str]) -> list[bytes]:
        done = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in done]

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces one after another, and how many each has.

        A piece that is a run of letters, with or without a blank before and ASCII marks behind, is one
        pre-token or two; these go straight to the library's BPE model."""
        merge, blank_free, tails, cores = self.model.model.tokenize, self.blank_free, self.tails, {}
        ids, each, odd = [], [], []
        for k, p in enumerate(pieces):
            core = p if p.isalpha() else p.rstrip(MARKS)
            body = core if blank_free or core[:1] != " " else core[1:]
            if not body.isalpha() or len(body) > LONG or (blank_free and not body.isascii() and max(body) >= "\u0130"):
                odd.append((k, p))
                each.append(0)
                ids.append(())
                continue
            got = cores.get(core)
            if got is None:
                seen = core.lower() if blank_free else core
                if not seen.isascii():
                    seen = seen.encode().decode("latin-1").translate(BYTE_CHARS)
                elif core != body:
                    seen = "\u0120" + body
                got = cores[core] = [x.id for x in merge(seen)]
            tail = p[len(core) :]
            if tail:
                if tail not in tails:
                    tails[tail] = self.model.encode(tail, add_special_tokens=False).ids
                got = got + tails[tail]
            ids.append(got)
            each.append(len(got))
        for a in range(0, len(odd), 1024):
            some = odd[a : a + 1024]
            done = self.model.encode([p for _, p in some], is_pretokenized=True, add_special_tokens=False)
            flat = done.ids
            cuts = np.searchsorted(np.array(done.word_ids, np.int64), np.arange(len(some) + 1)).tolist()
            for (k, _), x, y in zip(some, cuts[:-1], cuts[1:]):
                ids[k], each[k] = flat[x:y], y - x
        return np.fromiter(chain.from_iterable(ids), "<u4", sum(each)), np.array(each, np.int64)

    def _add(self, pieces: pa.Array, ids: np.ndarray, each: np.ndarray) -> None:
        k, n = len(self.known), len(self.known) + len(pieces)
        if n > len(self.first):
            self.first, self.size = (np.concatenate((x, np.zeros(max(len(x), n), np.int64))) for x in (self.first, self.size))
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.zeros(max(self.used, len(ids)), "<u4")))
        self.pool[self.used : self.used + len(ids)] = ids
        self.size[k:n], self.first[k:n] = each, self.used + np.cumsum(each) - each
        self.used += len(ids)
        self.known = pa.concat_arrays([self.known, pieces])

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        odd = np.flatnonzero(pc.match_substring_regex(pa.array(texts, pa.large_string()), self.odd)).tolist()
        for i, ids in zip(odd, self._whole([texts[i] for i in odd])):
            out[i] = ids
        rest = sorted(set(range(len(texts))).difference(odd))
        a, size = 0, 0
        for k, i in enumerate(rest):
            size += len(texts[i])
            if size >= BLOCK or k == len(rest) - 1:
                for j, ids in zip(rest[a : k + 1], self._block([texts[j] for j in rest[a : k + 1]])):
                    out[j] = ids
                a, size = k + 1, 0
        return out

    def _block(self, texts: list[str]) -> list[bytes]:
        """Cuts the texts, looks up each distinct piece of the block once, and gathers."""
        if self.blank_free:
            # lower case as the library's, but for letters from U+0130 on, whose texts are left to it; where
            # there is no apostrophe, runs of marks are pre-tokens of their own and are set apart
            as_is = set(np.flatnonzero(pc.match_substring_regex(pa.array(texts, pa.large_string()), r"[\x{130}-\x{10FFFF}]")).tolist())
            low = pa.array([t if i in as_is else t.lower() for i, t in enumerate(texts)], pa.large_string())
            apart = pc.replace_substring_regex(low, r"([^\s\p{L}\p{N}\p{Z}]+)", r" \1 ")
            plain = [i not in as_is and "'" not in t for i, t in enumerate(texts)]
            parts = pc.utf8_split_whitespace(pc.if_else(pa.array(plain, pa.bool_()), apart, low))
        else:  # a mark tells a text's first piece, or a line feed in front of a piece, from a blank
            parts = pc.split_pattern(pa.array([FIRST + t.replace("\n", " " + LINE) for t in texts], pa.large_string()), " ")
        coded = parts.flatten().dictionary_encode()
        if len(self.known) > self.room or self.used > ROOM or self.known.nbytes > 8 * ROOM:
            self._forget()
        if len(self.tails) > 20_000:
            self.tails = {}
        # pieces are looked up in the form in which they were cut; new ones get their blank or line feed back
        at = pc.fill_null(pc.index_in(coded.dictionary, self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            raw = coded.dictionary.take(pa.array(missing))
            new = raw.to_pylist()
            if not self.blank_free:
                new = [p[1:] if p[:1] == FIRST else "\n" + p[1:] if p[:1] == LINE else " " + p for p in new]
            at[missing] = len(self.known) + np.arange(len(missing))
            self._add(raw, *self._learn(new))
        first, each = self.first[at], self.size[at]
        which = coded.indices.to_numpy(zero_copy_only=False)
        n = each[which]
        end = np.cumsum(n)
        ids = self.pool[np.repeat(first[which] - end + n, n) + np.arange(int(n.sum()))] if len(n) else self.pool[:0]
        bounds = np.concatenate(([0], end))[parts.offsets.to_numpy()] * 4
        raw = memoryview(ids.tobytes())
        return [bytes(raw[x:y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, blank_free: bool) -> PieceEncoder:
    """One encoder for each Python worker and vocabulary."""
    if (path, blank_free) not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path, blank_free] = PieceEncoder(path, blank_free)
    return _ENCODERS[path, blank_free]


def forget() -> None:
    """Frees this worker's encoders, whose tables the tasks of later stages have no use for."""
    if _ENCODERS:
        import ctypes
        import gc

        _ENCODERS.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

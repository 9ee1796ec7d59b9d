"""Vectorised text kernels shared by the Arrow-side operators.

All kernels work on the raw UTF-8 bytes of an Arrow string array, so that no Python object is made per
word.  A *word* is a maximal run of bytes other than space, tab, LF, VT, FF and CR, the byte form of
``[^\\x20\\x09-\\x0D]+``.  Null texts count as empty ones.

Word and shingle identities are 64-bit content hashes; two different shingles of one comparison collide
with a probability of about 2**-64 and the kernels treat equal hashes as equal shingles.
"""

from __future__ import annotations

import copy
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that one kernel call handles; bounds the memory of the per-byte and per-word arrays.
SLICE_BYTES = 4 << 20
_SPAN = 1 << 18
_LONG_WORD = 1 << 16
_BASE = 0x9E3779B97F4A7C15 | 5  # odd, 5 modulo 8: of full order among the odd residues


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply); works on copies."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit values that depend on the seed alone."""
    step = (np.arange(1, n + 1, dtype=np.uint64)) * U64(0x9E3779B97F4A7C15)
    return mix(step + U64(seed * 0xD1342543DE82EF95 % (1 << 64)))


@cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = _SPAN + 1
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down), stream(7, 256)


@cache
def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


@cache
def _separator() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold at most ``limit`` bytes; a longer text comes alone."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


class Texts:
    """The bytes of some texts with their words; all arrays are lazy and per byte or per word."""

    def __init__(self, array: pa.Array, lower: bool = False):
        if isinstance(array, pa.ChunkedArray):
            array = array.combine_chunks()
        if array.null_count:
            array = array.fill_null("")
        wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
        self.n = len(array)
        _, offsets, data = array.buffers()
        if self.n == 0 or data is None:
            self.bounds, self.data = np.zeros(self.n + 1, np.int64), np.zeros(0, np.uint8)
        else:
            off = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + self.n + 1].astype(np.int64)
            self.data = np.frombuffer(data, np.uint8)[off[0] : off[-1]]
            self.bounds = off - off[0]
        if lower:
            self.data = _lower()[self.data]
        self._find()

    def _find(self) -> None:
        data, size = self.data, len(self.data)
        if size == 0:
            self.starts = self.ends = np.zeros(0, np.int64)
        else:
            inside = ~_separator()[data]
            first = np.zeros(size + 1, bool)
            first[self.bounds] = True  # a text begins, so that no word spans two texts
            begins = inside.copy()
            begins[1:] &= ~inside[:-1] | first[1:size]
            last = inside.copy()
            last[:-1] &= ~inside[1:] | first[1:size]
            self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(last) + 1
        self.word_bounds = np.searchsorted(self.starts, self.bounds)
        self.n_words = np.diff(self.word_bounds)

    def lowered(self) -> Texts:
        """The same texts with A-Z in lower case."""
        other = copy.copy(self)
        other.__dict__.pop("_words", None)
        other.data = _lower()[self.data]
        return other

    @property
    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Content hashes of byte spans in order of their starts; the spans don't overlap."""
        up, down, table = _powers()
        out = np.empty(len(starts), np.uint64)
        i, n = 0, len(starts)
        while i < n:
            base = starts[i]
            j = int(np.searchsorted(ends, base + _SPAN, side="right"))
            if j > i:
                s, e = starts[i:j] - base, ends[i:j] - base
                prefix = np.zeros(int(e[-1]) + 1, np.uint64)
                np.cumsum(table[self.data[base : base + e[-1]]] * up[: e[-1]], out=prefix[1:])
                out[i:j] = mix((prefix[e] - prefix[s]) * down[s] + (e - s).astype(np.uint64) * U64(0x2545F4914F6CDD1D))
                i = j
            else:
                i += 1
        for k in np.flatnonzero(ends - starts > _LONG_WORD):
            out[k] = int.from_bytes(hashlib.blake2b(self.data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
        return out

    def words(self) -> np.ndarray:
        """One hash per word."""
        if not hasattr(self, "_words"):
            self._words = self.span_hashes(self.starts, self.ends)
        return self._words

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and texts of all n-word windows that lie within one text."""
        words = self.words()
        if len(words) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        doc = self.doc_of
        count = len(words) - n + 1
        hashed = words[:count].copy()
        for k in range(1, n):
            hashed *= U64(0xD6E8FEB86659FD93)
            hashed += words[k : k + count]
        fits = doc[:count] == doc[n - 1 :]
        return mix(hashed[fits] + U64(n)), doc[:count][fits]

    def shingles(self, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """As ``grams``; a text of 1 to n - 1 words has one shingle of all its words, a text without words none."""
        hashed, doc = self.grams(n)
        parts, docs = [hashed], [doc]
        for m in range(1, n):
            short = np.flatnonzero(self.n_words == m)
            if len(short):
                at, words = self.word_bounds[short], self.words()
                own = words[at].copy()
                for k in range(1, m):
                    own *= U64(0xD6E8FEB86659FD93)
                    own += words[at + k]
                parts.append(mix(own + U64(m)))
                docs.append(short)
        if len(parts) == 1:
            return hashed, doc
        hashed, doc = np.concatenate(parts), np.concatenate(docs)
        order = np.argsort(doc, kind="stable")
        return hashed[order], doc[order]

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a value per byte over each text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def per_word(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value per word over each text."""
        total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind in "fiu" else np.int64)
        np.cumsum(values, out=total[1:])
        return total[self.word_bounds[1:]] - total[self.word_bounds[:-1]]


def distinct_in(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, value) with counts, ordered by text and value."""
    if not len(value):
        return doc[:0], value[:0], np.zeros(0, np.int64)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return doc[at], value[at], np.diff(np.append(at, len(doc)))


def base_statistics(t: Texts, window: int = 5) -> dict[str, np.ndarray]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data, n = t.data, t.n
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    inside, lead = ~_separator()[data], (data & 0xC0) != 0x80
    out = {"n_words": t.n_words.astype(np.int64), "word_chars": t.per_text(inside & lead), "n_symbols": t.per_text(symbol[data])}

    # lines with a word: the words tell which, LF ends them
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.concatenate([t.bounds[:-1], breaks + 1])
    ends = np.concatenate([t.bounds[1:], breaks])
    starts, ends = np.sort(starts), np.sort(ends)
    worded = np.searchsorted(t.starts, ends) > np.searchsorted(t.starts, starts)
    starts, ends = starts[worded], ends[worded]
    doc = np.searchsorted(t.bounds, starts, side="right") - 1
    hashed = t.span_hashes(starts, ends)
    of, _, count = distinct_in(doc, hashed)
    out["n_dup_lines"] = np.bincount(of, weights=count - 1, minlength=n).astype(np.int64)

    grams, of = t.grams(window)
    key = mix(grams + (of.astype(np.uint64) + U64(1)) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    # the word at which each window starts, then all the words under a repeated window
    first = np.flatnonzero(t.doc_of[: max(0, len(t.starts) - window + 1)] == t.doc_of[window - 1 :]) if len(t.starts) >= window else np.zeros(0, np.int64)
    delta = np.zeros(len(t.starts) + 1, np.int64)
    delta[first[twice]] += 1
    np.subtract.at(delta, first[twice] + window, 1)
    covered = np.cumsum(delta[:-1]) > 0
    out["n_repeat_words"] = t.per_word(covered.astype(np.int64))
    return out


def gram_buckets(t: Texts, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-byte windows within each text (n up to 4): buckets in order, and where each text's begin."""
    data, size = t.data, len(t.data)
    inside = np.maximum(np.diff(t.bounds) - n + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(inside)])
    if size < n:
        return np.zeros(0, np.int32), bounds
    count = size - n + 1
    code = np.zeros(count, np.uint32)
    for k in range(n):
        code <<= np.uint32(8)
        code |= data[k : k + count]
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x9E3779B1)
    code >>= np.uint32(32 - bits)
    fits = np.ones(count, bool)
    for k in range(1, n):  # windows that would leave their text
        at = t.bounds[1:] - k
        at = at[(at >= 0) & (at < count) & (np.diff(t.bounds) >= 0)]
        fits[at] = False
    if int(fits.sum()) != int(bounds[-1]):  # texts shorter than a window: mark by text
        doc = np.searchsorted(t.bounds, np.arange(count), side="right") - 1
        fits = np.arange(count) + n <= t.bounds[1:][doc]
    return code[fits].view(np.int32), bounds

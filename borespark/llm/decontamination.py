"""Benchmark decontamination by size-partitioned MinHash containment search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borespark.llm.common import Scratch, map_slices
from borespark.llm.kernels import U64, Texts, distinct_in, stream

#: Hash functions of a signature.  An item contained to 0.8 in a text misses all of them with a
#: probability below 2e-6 (the Jaccard similarity with its window is at least 0.19).
HASHES = 64
#: Shingles of a block; windows are two adjacent blocks of BLOCK * 2**level shingles.
BLOCK = 16
#: Bytes of an index as built and broadcast at once; more items are searched in several passes over the texts.
INDEX_BYTES = 96 << 20
#: Bits of a class's first test per item and hash function.
FILTER_BITS = 32
#: Bytes per item of an index besides its shingles: minimum, position and the first test's share, per hash function.
ITEM_COST = HASHES * (8 + 4 + FILTER_BITS // 4)


class ItemIndex:
    """Distinct items by size class with sorted MinHash minima, and the exact shingle sets for verification."""

    def __init__(self, keys: np.ndarray, elements: list[np.ndarray], sizes: np.ndarray, minima: np.ndarray):
        """sizes: words of the item if fewer than a shingle has, else 0 (such items are looked up by that window)."""
        self.keys, self.elements = keys, elements
        self.factors = _factors()
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == n)
            values = np.array([elements[i][0] for i in at], np.uint64)
            order = np.argsort(values)
            self.short[int(n)] = values[order], at[order].astype(np.int32)
        level = np.array([-1 if sizes[i] else max(0, int(np.ceil(np.log2(len(x) / BLOCK)))) for i, x in enumerate(elements)], np.int64)
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for own in np.unique(level[level >= 0]):
            at, tables = np.flatnonzero(level == own).astype(np.int32), []
            for k in range(len(self.factors)):
                values = minima[at, k]
                order = np.argsort(values)
                tables.append((values[order], at[order], _filter(values)))
            self.classes[int(own)] = tables

    @property
    def nbytes(self) -> int:
        tables = [t for own in self.classes.values() for t in own] + [(*t, t[1][:0]) for t in self.short.values()]
        return sum(x.nbytes for x in self.elements) + sum(x.nbytes for t in tables for x in t)

    def candidates(self, shingle: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Distinct (text, item) pairs as rows, by equal minima of an item and a window of its size class."""
        found = [np.zeros((0, 2), np.int64)]
        if len(shingle) and self.classes:
            first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            within = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
            starts = np.flatnonzero(within % BLOCK == 0)
            owner, number = doc[starts], within[starts] // BLOCK
            for k, a in enumerate(self.factors):
                minima = np.minimum.reduceat(shingle * a, starts)
                own, no = owner, number
                for level in range(max(self.classes) + 1):
                    if level:
                        pairs = np.flatnonzero(no % 2 == 0)
                        minima = np.minimum.reduceat(minima, pairs)
                        own, no = own[pairs], no[pairs] // 2
                    if level in self.classes:
                        window = minima.copy()
                        np.minimum(window[:-1], minima[1:], out=window[:-1], where=own[:-1] == own[1:])
                        found.append(self._hits(*self.classes[level][k], window, own))
        return np.unique(np.concatenate(found), axis=0)

    @staticmethod
    def _hits(values, items, bits, window, owner):
        low = window & U64(8 * len(bits) - 1)
        maybe = np.flatnonzero((bits[(low >> U64(3)).astype(np.int64)] >> (low & U64(7)).astype(np.uint8)) & 1)
        if not len(maybe):
            return np.zeros((0, 2), np.int64)
        lo, hi = np.searchsorted(values, window[maybe]), np.searchsorted(values, window[maybe], side="right")
        n = hi - lo
        at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.unique(np.column_stack([np.repeat(owner[maybe], n), items[at]]), axis=0)

    def search(self, texts: Texts, threshold: float, shingle: int) -> list[tuple[int, int, int, int]]:
        """(text, item, shared, size) with shared >= threshold * size, verified on the exact sets."""
        gram, doc = texts.grams(shingle)
        out, pairs = [], self.candidates(gram, doc)
        if len(pairs):
            cut = np.searchsorted(doc, np.arange(texts.n + 1))
            for d in np.unique(pairs[:, 0]):
                own = np.unique(gram[cut[d] : cut[d + 1]])
                for i in pairs[pairs[:, 0] == d, 1]:
                    x = self.elements[i]
                    shared = int((own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x).sum())
                    if shared >= threshold * len(x) - 1e-9:
                        out.append((int(d), int(i), shared, len(x)))
        for n, (values, items) in self.short.items():
            gram, doc = texts.grams(n)
            hit = np.isin(gram, values)
            of, value, _ = distinct_in(doc[hit], gram[hit])
            out += [(int(d), int(items[i]), 1, 1) for d, i in zip(of, np.searchsorted(values, value), strict=True)]
        return sorted(out)


def _factors() -> np.ndarray:
    return stream(5, HASHES) | U64(1)


def _filter(values: np.ndarray) -> np.ndarray:
    """Bits by the low bits of the values: a cheap first test."""
    bits = 1 << max(10, int(np.ceil(np.log2(len(values) * FILTER_BITS))))
    table = np.zeros(bits, bool)
    table[(values & U64(bits - 1)).astype(np.int64)] = True
    return np.packbits(table, bitorder="little")


def _items(shingle: int):
    """Per item: its distinct shingles, its words if it has fewer than a shingle, and its minima."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch | None:
        texts = Texts(part.column("text"), lower=True)
        element, doc = texts.shingles(shingle)
        doc, element, _ = distinct_in(doc, element)
        if not len(doc):
            return None
        cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        minima = np.column_stack([np.minimum.reduceat(element * a, cut) for a in _factors()])
        ends, words = np.append(cut[1:], len(doc)), texts.n_words[doc[cut]]
        blobs = [[x.tobytes() for x in own] for own in ((element[i:j] for i, j in zip(cut, ends, strict=True)), minima)]
        short = np.where(words < shingle, words, 0).astype(np.int64)
        return pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array(doc[cut])), pa.array(blobs[0], pa.binary()), pa.array(short), pa.array(blobs[1], pa.binary())], ["item_id", "elements", "short", "minima"])

    return run


def _indexes(benchmark: DataFrame, shingle: int, index_bytes: int, scratch: Scratch):
    """(item_id, item) of the items with words, and a generator of broadcast indexes that together hold each set once.

    Only distinct sets reach the driver, at most about ``index_bytes`` as built at a time.
    """
    kind = benchmark.schema["item_id"].dataType.simpleString()
    items = map_slices(benchmark.select("item_id", "text"), _items(shingle), f"item_id {kind}, elements binary, short long, minima binary")
    items = scratch.keep(items.withColumn("item", F.xxhash64("elements", "short")), "items")
    sets = scratch.keep(items.groupBy("item").agg(*[F.first(c).alias(c) for c in ("elements", "short", "minima")]), "sets")
    size = sets.agg(F.coalesce(F.sum(F.octet_length("elements").cast("long") + ITEM_COST), F.lit(0))).first()[0]
    passes = max(1, -(-size // index_bytes))

    def built():
        for p in range(passes):
            rows = sets.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == p).orderBy("item").toArrow()
            elements = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("elements")]
            minima = np.frombuffer(b"".join(x.as_py() for x in rows.column("minima")), np.uint64).reshape(-1, HASHES)
            yield sets.sparkSession.sparkContext.broadcast(ItemIndex(rows.column("item").to_numpy(), elements, rows.column("short").to_numpy(), minima))

    return items.select("item_id", "item"), built()


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, shingle: int = 5, index_bytes: int = INDEX_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment): every text and item it contains.

    Containment is the share of the item's distinct ``shingle``-word windows (words with A-Z in lower
    case) that the whole text has, ``threshold`` or more.  Items are partitioned by size; each class is
    searched by MinHash among windows of twice its largest item that overlap by half, so that a short
    item isn't lost in a long text; candidates are verified on the exact sets of the whole text.  The
    texts are not shuffled: minima are made in tasks, equal items are searched once, and the index is broadcast
    in parts of at most about ``index_bytes`` as built, one pass over the texts each (a longer item alone makes
    a larger part).

    Items of 1 to 4 words are looked for as one window of all their words; items and texts without words,
    or null, match nothing and reach no index.  A pair of repeated rows is reported as often as the rows repeat.
    """
    scratch = scratch or Scratch(docs.sparkSession, "leaks")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names, indexes = _indexes(benchmark, shingle, index_bytes, scratch)
    out = None
    for index in indexes:

        def run(part: pa.RecordBatch, index=index) -> pa.RecordBatch | None:
            hits = index.value.search(Texts(part.column("text"), lower=True), threshold, shingle)
            if not hits:
                return None
            doc, item, shared, size = (np.array(x, np.int64) for x in zip(*hits, strict=True))
            return pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(index.value.keys[item]), pa.array(shared), pa.array(size), pa.array(shared / size)], ["doc_id", "item", "shared", "item_shingles", "containment"])

        found = map_slices(docs.select("doc_id", "text"), run, f"doc_id {kind}, item long, shared long, item_shingles long, containment double")
        out = found if out is None else out.union(found)
    return out.join(names, "item").select("doc_id", "item_id", "shared", "item_shingles", "containment")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, shingle: int = 5, index_bytes: int = INDEX_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs, with all their columns, that contain no item (see ``contaminated_pairs``)."""
    scratch = scratch or Scratch(docs.sparkSession, "leaks")
    for index in _indexes(benchmark, shingle, index_bytes, scratch)[1]:

        def run(part: pa.RecordBatch, index=index) -> pa.RecordBatch:
            clean = np.ones(part.num_rows, bool)
            clean[[hit[0] for hit in index.value.search(Texts(part.column("text"), lower=True), threshold, shingle)]] = False
            return part.filter(pa.array(clean))

        docs = map_slices(docs, run, docs.schema)
    return docs

"""LM scoring with a weighted backoff automaton whose n-grams stay distributed."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from borespark.llm.common import Scratch, crc_part
from borespark.llm.kernels import U64, Texts, mix, slices, stream

#: Text bytes of one block of documents; its n-grams are held by one task.
BLOCK_BYTES = 6 << 20
#: Blocks' worth of n-grams that one counting task merges.
BLOCKS_PER_SHARD = 2
#: Bits beyond the logarithm of the text bytes that tell n-grams of two and more tokens apart: one in 2**SPARE_BITS
#: n-grams at most shares its counts with another, at every size of the corpus.  Words have all 64 bits.
SPARE_BITS = 24
#: Longest n-gram: contexts are of up to ORDER - 1 tokens.
ORDER = 3
#: Pseudo-count of the lower order in the distribution of a state of 1, 2, ... tokens (see README: held-out text).
BACKOFF_MASS = (2000.0, 10.0)
_BEGIN, _END = (int(x) for x in stream(99, 2))
_ROOT, _START = 0, 1


@dataclass
class Grams:
    """The n-grams of one length that end at the tokens of a block: ``rank`` numbers them in order of hash.

    rank is -1 where no such n-gram ends; keys are the hashes by number, first is a token where each ends.
    """

    keys: np.ndarray
    rank: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, where: np.ndarray | None = None) -> Grams:
        at = np.arange(len(hashes)) if where is None else np.flatnonzero(where)
        order = at[np.argsort(hashes[at])].astype(np.int32)
        ranked = hashes[order]
        new = np.ones(len(order), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        rank = np.full(len(hashes), -1, np.int32)
        rank[order] = np.cumsum(new, dtype=np.int32) - 1
        return cls(ranked[new], rank, order[new])

    def counts(self, weight: np.ndarray) -> np.ndarray:
        """Sums of the tokens' weights per n-gram."""
        own = self.rank >= 0
        return np.bincount(self.rank[own], weights=weight[own], minlength=len(self.keys)).astype(np.int64)


def token_grams(texts: Texts, order: int, bits: int = 64) -> tuple[list[Grams], np.ndarray, np.ndarray]:
    """The n-grams of 1 to ``order`` tokens; which tokens begin a text; token bounds of the texts.

    Tokens are the words, then one end per text; before the first token stands a start mark that is no token.
    The first token's 2-gram begins with the mark, as does the second token's 3-gram, and so on; longer ones
    don't exist there.  n-grams of two and more tokens keep the upper ``bits`` of their hashes.
    """
    tokens = np.insert(texts.words(), texts.word_bounds[1:], np.full(texts.n, _END, np.uint64))
    bounds = texts.word_bounds + np.arange(texts.n + 1)
    begin = np.zeros(len(tokens), bool)
    begin[bounds[:-1]] = True
    place = np.arange(len(tokens)) - np.repeat(bounds[:-1], np.diff(bounds))
    hashes = mix(tokens + U64(1))
    out = [Grams.of(hashes)]
    for n in range(2, order + 1):
        context = np.empty(len(tokens), np.uint64)
        context[1:], context[:1] = hashes[:-1], 0
        context[begin] = _BEGIN
        hashes = mix(context * U64(0xD6E8FEB86659FD93) + tokens + U64(n))
        out.append(Grams.of(hashes >> U64(64 - bits), place >= n - 2))
    return out, begin, bounds


class Automaton:
    """The part of a weighted backoff automaton that a block of texts can reach, compiled to numbered states.

    A state is a context: number 0 the empty one, 1 the start of a text, then the block's n-grams of fewer than
    ``order`` tokens that training has, by length and hash.  A state h with the training count c(h) has an
    arc for every token w that training has after h, of probability (c(hw) + m p(w | h')) / (c(h) + m), and a
    failure arc of weight m / (c(h) + m) to h', the context without its first token; m is the mass of
    its length.  The empty context has an arc for every token: p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)).  Every
    state's probabilities add up to one over the known tokens and one unknown token.

    ``failure`` and ``back`` give each state's failure arc (target, log10 weight), ``states[n - 1]`` the state that
    an n-gram is as a context (-1: no state), ``logs[n - 1]`` the log10 probability of the arc that reads the
    last token of an n-gram from the state of the tokens before it, where ``counts[n - 1]`` is above 0.
    """

    def __init__(self, grams: list[Grams], begin: np.ndarray, counts: list[np.ndarray], tokens: int, types: int, begins: int, mass: Sequence[float]):
        self.grams, self.begin, self.counts = grams, begin, counts
        p = (counts[0] + 0.5) / (tokens + 0.5 * (types + 1))
        self.logs, self.states = [np.log10(p)], []
        self.failure, self.back = [np.array([-1, _ROOT])], [np.array([0.0, np.log10(mass[0] / (begins + mass[0])) if len(grams) > 1 else 0.0])]
        size = 2
        for n in range(2, len(grams) + 1):
            m, lower, own = mass[n - 2], grams[n - 2], grams[n - 1]
            known = counts[n - 2] > 0
            state = np.full(len(known), -1)
            state[known] = size + np.arange(int(known.sum()))
            size += int(known.sum())
            shorter = np.full(len(known), _ROOT) if n == 2 else self._context(n - 3, lower.first)
            self.states.append(state)
            self.failure.append(shorter[known])
            self.back.append(np.log10(m / (counts[n - 2][known] + m)))
            # all of the block's n-grams, so that longer ones can lean on those that training lacks
            at = own.first
            held = counts[n - 2][lower.rank[at - 1]] if n > 2 else np.where(begin[at], begins, counts[0][lower.rank[at - 1]])
            p = (counts[n - 1] + m * p[lower.rank[at]]) / (held + m)
            self.logs.append(np.log10(p))
        self.failure, self.back = np.concatenate(self.failure), np.concatenate(self.back)

    def _context(self, n: int, at: np.ndarray) -> np.ndarray:
        """The state of the longest known context of up to n + 1 tokens that ends at each token of ``at``."""
        state = np.full(len(at), -1)
        for k in range(n, -1, -1):
            rank = self.grams[k].rank[at]
            open_ = (state < 0) & (rank >= 0)
            state[open_] = self.states[k][rank[open_]]
        return np.where(state < 0, _ROOT, state)

    def length(self, state: np.ndarray) -> np.ndarray:
        """Tokens of the states' contexts, the start mark counted."""
        edges = np.cumsum([2] + [int((s >= 0).sum()) for s in self.states])
        return np.where(state == _START, 1, np.searchsorted(edges, state, side="right")) if len(self.states) else np.zeros(len(state), np.int64)

    def traverse(self) -> np.ndarray:
        """log10 p of each token, read left to right.

        The state carried into a token is the longest known context that ends before it; all tokens then
        step together: those whose state has an arc for them take it, the others follow the failure arc, add
        its weight and try again, which ends at the empty context after ``order`` steps at most.
        """
        size = len(self.begin)
        if len(self.grams) == 1:
            return self.logs[0][self.grams[0].rank]
        before = np.maximum(np.arange(size) - 1, 0)
        state = np.where(self.begin, _START, self._context(len(self.grams) - 2, before))
        total, live = np.zeros(size), np.arange(size)
        length = self.length(state)
        for n in range(len(self.grams), 0, -1):
            here = live[length[live] == n - 1]
            rank = self.grams[n - 1].rank[here]
            arc = np.ones(len(here), bool) if n == 1 else self.counts[n - 1][rank] > 0
            total[here[arc]] += self.logs[n - 1][rank[arc]]
            fails = here[~arc]
            total[fails] += self.back[state[fails]]
            state[fails] = self.failure[state[fails]]
            length[fails] = self.length(state[fails])
            length[here[arc]] = -1
        return total


def _pack(values: np.ndarray) -> bytes:
    """Compressed byte planes of 64-bit values, from the lowest up to the last one that isn't all zeros; their number first."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    return bytes([used]) + len(values).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes[:used].tobytes(), asbytes=True)


def _unpack(data) -> np.ndarray:
    data = memoryview(data)
    used, n = data[0], int.from_bytes(data[1:9], "little")
    planes = np.zeros((8, n), np.uint8)
    planes[:used] = np.frombuffer(pa.Codec("zstd").decompress(data[9:], decompressed_size=used * n), np.uint8).reshape(used, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _write_blocks(limit: int):
    """Consecutive rows of a task as blocks of about ``limit`` text bytes, each a compressed Arrow stream."""

    def pack(parts: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table.combine_chunks())
        begins = table.num_rows - pc.sum(table.column("held_out")).as_py()
        size = pc.sum(pc.binary_length(table.column("text"))).as_py()
        block = (TaskContext.get().partitionId() << 24) + number
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([size], pa.int64()), pa.array([begins], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "size", "begins", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, number = [], 0, 0
        for batch in batches:
            for part in slices(batch, limit=max(1, limit // 8)):
                own = pc.sum(pc.binary_length(part.column("text"))).as_py()
                if parts and held + own > limit:
                    yield pack(parts, number)
                    parts, held, number = [], 0, number + 1
                parts.append(part)
                held += own + part.num_rows
        if parts:
            yield pack(parts, number)

    return run


def _read_block(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _grams(table: pa.Table, order: int, bits: int):
    return token_grams(Texts(table.column("text"), lower=True), order, bits)


def _count_blocks(order: int, shards: int, bits: int):
    def edges(n):
        return np.array([(1 << (bits if n > 1 else 64)) * s // shards for s in range(1, shards)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                table = _read_block(data.as_buffer())
                grams, _, bounds = _grams(table, order, bits)
                held = np.asarray(table.column("held_out").to_numpy(), bool)
                weight = np.repeat(~held, np.diff(bounds))
                for n, own in enumerate(grams, 1):
                    counts = own.counts(weight)
                    cut = np.concatenate([[0], np.searchsorted(own.keys, edges(n)), [len(own.keys)]])
                    filled = np.flatnonzero(np.diff(cut))
                    keys = [_pack(np.diff(own.keys[cut[s] : cut[s + 1]], prepend=U64(0))) for s in filled]
                    values = [_pack(counts[cut[s] : cut[s + 1]]) for s in filled]
                    k = len(filled)
                    yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), pa.array(np.full(k, block)), pa.array(np.full(k, n, np.int32)), pa.array(keys, pa.binary()), pa.array(values, pa.binary())], ["shard", "block", "n", "keys", "counts"])

    return run


def _merge_shard(key, table):
    """Adds up the blocks' counts per n-gram and answers each block in the order of its own keys."""
    n = key[1].as_py()
    parts = [np.cumsum(_unpack(x.as_buffer()), dtype=np.uint64) for x in table.column("keys")]
    counts = np.concatenate([_unpack(x.as_buffer()) for x in table.column("counts")])
    found = Grams.of(np.concatenate(parts))
    total = found.counts(counts)  # exact below 2**53
    ends = np.cumsum([len(x) for x in parts])
    answers = [_pack(total[found.rank[e - len(x) : e]]) for x, e in zip(parts, ends, strict=True)]
    size = len(parts)
    tokens, types = (int(total.sum()), int((total > 0).sum())) if n == 1 else (0, 0)
    return pa.table(
        [pa.array([*table.column("block").to_pylist(), -1], pa.int64()), pa.array([key[0].as_py()] * (size + 1), pa.int32()), pa.array([n] * (size + 1), pa.int32()), pa.array([*answers, b""], pa.binary()), pa.array([0] * size + [tokens], pa.int64()), pa.array([0] * size + [types], pa.int64())],
        names=["block", "shard", "n", "counts", "tokens", "types"],
    )


def _score_block(order: int, bits: int, tokens: int, types: int, begins: int, mass: Sequence[float]):
    def run(key, blocks, answers):
        table = _read_block(blocks.column("data")[0].as_buffer())
        grams, begin, bounds = _grams(table, order, bits)
        counts = []
        for n, own in enumerate(grams, 1):
            got = answers.filter(pc.equal(answers.column("n"), n)).sort_by("shard")
            counts.append(np.concatenate([np.zeros(0, np.uint64), *[_unpack(x.as_buffer()) for x in got.column("counts")]]).astype(np.float64))
            if len(counts[-1]) != len(own.keys):
                raise ValueError("a block's counts don't belong to it")
        automaton = Automaton(grams, begin, counts, tokens, types, begins, mass)
        rank = grams[0].rank
        values = (counts[0][rank] > 0).astype(np.int64), automaton.logs[0][rank], automaton.traverse()
        sums = [np.add.reduceat(x, bounds[:-1]) for x in values]
        length = pa.array(np.diff(bounds).astype(np.int64))
        return pa.table([table.column("doc_id"), table.column("held_out"), length, pa.array(sums[0]), pa.array(np.full(len(length), tokens, np.int64)), pa.array(sums[1]), pa.array(sums[2])], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, held_out: Column, order: int = ORDER, mass: Sequence[float] = BACKOFF_MASS, block_bytes: int = BLOCK_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text and what ``held_out`` needs): see the contract's columns.

    Tokens are the words of the text with A-Z in lower case and one end; the model learns from the rows
    whose ``held_out`` is false or null, and scores all rows by ``Automaton``, over contexts of up to
    ``order`` - 1 tokens; ``mass`` has a number per length of context.

    No table of n-grams is ever held whole.  Consecutive rows of a task form blocks, written once, compressed,
    to the shared folder, so that no row key decides where a text goes.  Each block sends its distinct n-grams
    with their training counts, cut by hash range, to counting tasks, which add them up and answer every
    block in the order of its keys; the block then compiles its own part of the automaton, exact for its
    texts, and its texts traverse that.  Words are told apart by 64-bit hashes, longer n-grams by ``SPARE_BITS``.  Memory per task is that of one block (a longer text has a block of its
    own); what moves is proportional to the distinct n-grams of the blocks, and the texts move once, compressed.
    The messages of two blocks and hash ranges grow with the square of total / block_bytes, bounded by the
    n-grams themselves, so raise ``block_bytes`` with the executors' memory on very large corpora.

    A null text counts as empty (one end token).  Repeated rows count as often as they occur.  Without
    training rows every token has probability 1 / (V + 1) with V = 0, that is log10 p = 0.  An empty table
    gives no rows.  Columns other than those named are not returned.
    """
    if order < 1 or len(mass) < order - 1 or min([1.0, *mass]) <= 0:
        raise ValueError("one positive mass per length of context")
    scratch = scratch or Scratch(docs.sparkSession, "lm")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    written = rows.mapInArrow(_write_blocks(block_bytes), "block long, size long, begins long, data binary")
    blocks = scratch.keep(written, "blocks", **{"compression": "none", "parquet.block.row.count.limit": 4})
    size, n, begins = blocks.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*"), F.coalesce(F.sum("begins"), F.lit(0))).first()
    shards = max(1, -(-size // (block_bytes * BLOCKS_PER_SHARD)))
    bits = min(64, int(size).bit_length() + SPARE_BITS)
    parts = blocks.select("block", "data").mapInArrow(_count_blocks(order, shards, bits), "shard int, block long, n int, keys binary, counts binary")
    merged = parts.repartition(shards * order, "shard", "n").groupBy("shard", "n").applyInArrow(_merge_shard, "block long, shard int, n int, counts binary, tokens long, types long")
    merged = scratch.keep(merged, "counts")
    tokens, types = merged.where("block < 0").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    own, answers = (x.repartition(max(1, n), "block") for x in (blocks.select("block", "data"), merged.where("block >= 0").select("block", "shard", "n", "counts")))
    scored = own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score_block(order, bits, tokens, types, begins, tuple(mass)),
        f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    return scratch.keep_only(scored, "scores")


def held_out_part(key: Column, modulus: int = 5, part: int = 1) -> Column:
    return crc_part(key, modulus) == part

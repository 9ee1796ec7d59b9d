"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from borespark.llm.common import map_slices
from borespark.llm.kernels import U64, Texts, base_statistics, distinct_in

#: Labelled rows that training takes at most: those of the smallest hash of their id.
TRAINING_ROWS = 6000
#: Hash buckets of words; the dense features follow them.
BUCKETS = 1 << 14
FACTORS, EPOCHS, BATCH, RATE, DECAY = 8, 12, 64, 0.1, 1e-5
DENSE = 16


def features(texts: Texts, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value): square-rooted shares of hashed lower-case words, then ``DENSE`` numbers.

    n_chars is the declared length (metadata; NaN where unknown).  A text without words has the dense
    features alone.
    """
    word, doc = texts.lowered().words() & U64(BUCKETS - 1), texts.doc_of
    doc, word, count = distinct_in(doc, word)
    value = np.sqrt(count / np.maximum(texts.n_words[doc], 1))

    stats, data = base_statistics(texts), texts.data
    length = np.maximum(np.diff(texts.bounds), 1)
    words = np.maximum(texts.n_words, 1)
    last = data[texts.ends - 1] if len(texts.ends) else np.zeros(0, np.uint8)
    first = data[texts.starts] if len(texts.starts) else np.zeros(0, np.uint8)

    def share(flags):
        return texts.per_text(flags) / length

    def word_share(flags):
        return texts.per_word(flags.astype(np.int64)) / words

    alpha = ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122)) | (data >= 128)
    lines = texts.per_text(data == 10) + 1
    kinds = np.bincount(doc, minlength=texts.n)
    dense = np.column_stack([
        np.minimum(1, 5 * stats["n_symbols"] / words), np.minimum(1, 3 * share((data >= 65) & (data <= 90))), np.minimum(1, 5 * share((data >= 48) & (data <= 57))),
        np.minimum(1, 10 * share(data == ord("!"))), np.minimum(1, 10 * share(data == ord("|"))), share(alpha), np.minimum(1, stats["word_chars"] / words / 20),
        np.log1p(texts.n_words) / 12, (texts.n_words < 10).astype(float), stats["n_dup_lines"] / lines, stats["n_repeat_words"] / words, kinds / words,
        word_share(np.isin(last, np.frombuffer(b".,;:!?", np.uint8))), word_share((first >= 65) & (first <= 90)), np.minimum(1, np.log1p(words / lines) / 6),
        np.where(np.isfinite(n_chars), np.log1p(np.maximum(np.nan_to_num(n_chars), 0)) / 14, 0),
    ])
    rows = np.repeat(np.arange(texts.n), DENSE)
    column = np.tile(np.arange(BUCKETS, BUCKETS + DENSE, dtype=np.uint64), texts.n)
    doc, word, value = np.concatenate([doc, rows]), np.concatenate([word, column]), np.concatenate([value, dense.ravel()])
    order = np.argsort(doc, kind="stable")
    return doc[order], word[order].astype(np.int64), value[order]


@dataclass
class Machine:
    """score = logistic(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, doc: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """In linear time: the pairs' sum is half of (sum v x)^2 - sum v^2 x^2, per factor."""
        if not len(doc):
            return np.full(n, self.bias)
        at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        vx = self.factors[feature] * value[:, None]
        pairs = 0.5 * (np.add.reduceat(vx, at) ** 2 - np.add.reduceat(vx * vx, at)).sum(axis=1)
        out = np.full(n, self.bias)
        out[doc[at]] += np.add.reduceat(self.linear[feature] * value, at) + pairs
        return out

    def scores(self, doc, feature, value, n) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(doc, feature, value, n), -30, 30)))


def gradients(machine: Machine, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray):
    """The mean logistic loss of rows (feature, value) by the machine's parameters, without decay.

    (used features, d linear, d factors, d bias); each row has at least one feature.
    """
    lengths = np.array([len(f) for f, _ in rows])
    feature, value = np.concatenate([f for f, _ in rows]), np.concatenate([v for _, v in rows])
    doc, at = np.repeat(np.arange(len(rows)), lengths), np.cumsum(lengths) - lengths
    vx = machine.factors[feature] * value[:, None]
    sums = np.add.reduceat(vx, at)
    margin = machine.bias + np.add.reduceat(machine.linear[feature] * value, at) + 0.5 * (sums**2 - np.add.reduceat(vx * vx, at)).sum(axis=1)
    error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels) / len(rows)
    d = error[doc] * value
    used, back = np.unique(feature, return_inverse=True)
    by_factor = d[:, None] * (sums[doc] - vx)
    factors = np.column_stack([np.bincount(back, weights=by_factor[:, k], minlength=len(used)) for k in range(vx.shape[1])])
    return used, np.bincount(back, weights=d, minlength=len(used)), factors, error.sum()


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 1) -> Machine:
    """Logistic loss by AdaGrad over mini-batches in a seeded order; rows are (feature, value).

    Without rows all parameters are 0.
    """
    rng = np.random.default_rng(seed)
    size = BUCKETS + DENSE
    if not rows:
        return Machine(0.0, np.zeros(size), np.zeros((size, FACTORS)))
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)))
    g_linear, g_factors, g_bias = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), BATCH):
            own = order[lo : lo + BATCH]
            used, dl, dv, db = gradients(m, [rows[i] for i in own], labels[own])
            dl, dv = dl + DECAY * m.linear[used], dv + DECAY * m.factors[used]
            g_linear[used] += dl**2
            g_factors[used] += dv**2
            m.linear[used] -= RATE * dl / np.sqrt(g_linear[used])
            m.factors[used] -= RATE * dv / np.sqrt(g_factors[used])
            g_bias += db**2
            m.bias -= RATE * db / g_bias**0.5
    return Machine(m.bias, m.linear.astype(np.float32).astype(np.float64), m.factors.astype(np.float32).astype(np.float64))


def _declared(part: pa.RecordBatch) -> np.ndarray:
    if "n_chars" not in part.schema.names:
        return np.full(part.num_rows, np.nan)
    return part.column("n_chars").cast(pa.float64()).to_numpy(zero_copy_only=False)


def _inputs(docs: DataFrame) -> list[str]:
    return ["text"] + (["n_chars"] if "n_chars" in docs.columns else [])


def train(docs: DataFrame, labels: DataFrame, usable: Column, limit: int = TRAINING_ROWS) -> Machine:
    """The machine learnt from labels (doc_id, quality) for which ``usable`` holds.

    At most ``limit`` labelled ids are taken, those of the smallest hash.  An id with several labels takes
    the larger one, an id with several texts the one of the least hash; null labels and ids without a text are
    ignored.  With no label at all every score is 0.5.
    """
    chosen = labels.where(usable & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("__label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # at most ``limit`` short rows, so broadcast
    rows = docs.select("doc_id", *_inputs(docs), F.xxhash64("text").alias("__hash")).where("text is not null").join(F.broadcast(chosen), "doc_id")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts(part.column("text"))
        doc, feature, value = features(texts, _declared(part))
        cut = np.searchsorted(doc, np.arange(texts.n + 1))
        blobs = [[x[cut[i] : cut[i + 1]].astype(t).tobytes() for i in range(texts.n)] for x, t in ((feature, np.int32), (value, np.float32))]
        return pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.string()), part.column("__label").cast(pa.int64()), part.column("__hash"), pa.array(blobs[0], pa.binary()), pa.array(blobs[1], pa.binary())], ["id", "label", "hash", "feature", "value"])

    found = map_slices(rows, run, "id string, label long, hash long, feature binary, value binary")
    found = found.groupBy("id").agg(F.min(F.struct("hash", "feature", "value", "label")).alias("r")).select("id", "r.*").collect()  # a row per chosen id
    found.sort(key=lambda r: (len(r["id"]), r["id"], r["feature"]))
    return fit([(np.frombuffer(r["feature"], np.int32).astype(np.int64), np.frombuffer(r["value"], np.float32).astype(np.float64)) for r in found], np.array([min(1, max(0, r["label"])) for r in found], np.float64))


def score_quality(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score, predicted) for every row; null texts score as empty ones, whole texts are read."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts(part.column("text"))
        score = shared.value.scores(*features(texts, _declared(part)), texts.n)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_slices(docs.select("doc_id", *_inputs(docs)), run, f"doc_id {kind}, score double, predicted int")


def keep_good(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of docs, with all their columns, that the machine predicts as good."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts(part.column("text"))
        return part.filter(pa.array(shared.value.scores(*features(texts, _declared(part)), texts.n) >= 0.5))

    return map_slices(docs, run, docs.schema)

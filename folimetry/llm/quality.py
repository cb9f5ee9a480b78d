"""Quality classifier: random-indexing word vectors, pooled per document, and a calibrated two-layer network.

Every word gives two symbols: a bucket of its hash, and its shape (case, length, punctuation, repetition). Each symbol has
a sparse random index vector that follows from its number. Over all documents, a symbol's context vector is the sum of the
index vectors around it; tasks add up tables of fixed size, whatever the corpus. A document is the mean and spread of its
symbols' context vectors. A two-layer network in numpy is fitted on a bounded sample of labelled documents, and one
temperature, fitted on rows that the network hasn't seen, calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folimetry.llm.folds import held_out, training_texts
from folimetry.llm.pieces import by_bytes, trimmed, whole_texts
from folimetry.llm.scratch import by_name, by_place, written
from folimetry.llm.words import mix, word_hashes, word_spans

BUCKETS = 1 << 13
#: case 5, length 4, ending 9, repetition 3
SHAPES = 5 * 4 * 9 * 3
SYMBOLS = BUCKETS + SHAPES
DIM = 32
NONZERO = 4
WINDOW = 2
SLICE_BYTES = 1 << 18
#: Words whose contexts are held at once.
SLICE_WORDS = 1 << 17
THRESHOLD = 0.3
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 32, 40, 256, 3e-3, 1e-4, 17
CALIBRATION_SHARE = 5


def index_vectors() -> np.ndarray:
    """Ternary vectors: NONZERO places of each symbol, half of them negative, from its number alone."""
    vectors = np.zeros((SYMBOLS, DIM), np.int8)
    symbol = np.arange(SYMBOLS, dtype=np.uint64)
    for k in range(NONZERO):
        place = mix(symbol * np.uint64(NONZERO) + np.uint64(k + 1)) % np.uint64(DIM)
        vectors[np.arange(SYMBOLS), place.astype(np.int64)] += 1 - 2 * (k % 2)
    return vectors


_UPPER, _LOWER, _DIGIT, _OTHER = (np.zeros(256, np.int8) for _ in range(4))
_UPPER[65:91] = 1
_LOWER[97:123] = _LOWER[0x80:] = 1
_DIGIT[48:58] = 1
_OTHER[:] = 1 - (_UPPER + _LOWER + _DIGIT)


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, shape of each word, words before each row and in all)."""
    part, starts, ends, borders = word_spans(texts)
    hashes = word_hashes(part, starts, ends)
    counts = []
    for kind in (_UPPER, _LOWER, _OTHER):
        total = np.zeros(len(part) + 1, np.int32)
        np.cumsum(kind[part], dtype=np.int32, out=total[1:])
        counts.append(total[ends] - total[starts])
    upper, lower, other = counts
    size = ends - starts
    first_up = _UPPER[part[starts]] > 0
    case = np.select([(upper == 0) & (lower > 0), (upper == 1) & first_up, (upper > 1) & (lower <= upper), upper + lower == 0], [0, 1, 2, 3], 4)
    length = np.searchsorted([3, 7, 13], size, "right")
    last = part[ends - 1]
    before = part[np.maximum(ends - 2, starts)]
    ending = np.select(
        [other == 0, other == size, (other == 1) & (last == 0x2C), (other == 1) & (last == 0x2E), (other >= 2) & (last == 0x21) & (before == 0x21), (other >= 2) & (last == before) & (_OTHER[last] > 0), (other == 1) & (_OTHER[last] > 0), other == 1],
        [0, 1, 2, 3, 4, 5, 6, 7], 8,
    )
    rows = np.repeat(np.arange(len(borders) - 1, dtype=np.uint64), np.diff(borders))
    keys = mix(hashes + rows * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), np.int64)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    again[1:] += (keys[1:] == keys[:-1]) & (again[1:] > 0)
    shape = ((case * 4 + length) * 9 + ending) * 3 + again
    return (hashes % np.uint64(BUCKETS)).astype(np.int64), shape + BUCKETS, borders


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of index vectors around each symbol over the task's documents."""
    vectors, table, seen = index_vectors(), np.zeros((SYMBOLS, DIM), np.int64), np.zeros(SYMBOLS, np.int64)
    for batch in batches:
        for b in by_bytes(batch, "text", SLICE_BYTES):
            bucket, shape, borders = symbols(whole_texts(b.column("text")))
            # WINDOW empty places between documents: no context reaches across
            place = np.arange(len(bucket)) + WINDOW * np.repeat(np.arange(len(borders) - 1), np.diff(borders))
            for a in range(0, len(bucket), SLICE_WORDS):
                z = min(a + SLICE_WORDS, len(bucket))
                low, high = max(a - WINDOW, 0), min(z + WINDOW, len(bucket))
                at = place[low:high] - place[a] + 2 * WINDOW
                near = at >= 0  # those before may be in another document, far enough to be out of sight
                own = np.zeros((int(at[-1]) + 2 * WINDOW + 1, DIM), np.int8)
                own[at[near]] = vectors[bucket[low:high][near]] + vectors[shape[low:high][near]]
                here = at[a - low : z - low]
                around = np.zeros((z - a, DIM), np.int16)
                for step in range(1, WINDOW + 1):
                    around += own[here - step]
                    around += own[here + step]
                for ids in (bucket[a:z], shape[a:z]):
                    order = np.argsort(ids, kind="stable")
                    first = np.flatnonzero(np.append(True, np.diff(ids[order]) != 0))
                    table[ids[order][first]] += np.add.reduceat(around[order], first, axis=0, dtype=np.int64)
                    seen += np.bincount(ids, minlength=SYMBOLS)
    held = np.flatnonzero(seen)
    sums = pa.FixedSizeListArray.from_arrays(pa.array(table[held].reshape(-1)), DIM).cast(pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(seen[held]), sums], ["symbol", "seen", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, seen = np.zeros((SYMBOLS, DIM), np.int64), np.zeros(SYMBOLS, np.int64)
    for b in batches:
        at = b.column("symbol").to_numpy()
        np.add.at(table, at, b.column("sums").flatten().to_numpy().reshape(-1, DIM))
        np.add.at(seen, at, b.column("seen").to_numpy())
    held = np.flatnonzero(seen)
    sums = pa.FixedSizeListArray.from_arrays(pa.array(table[held].reshape(-1)), DIM).cast(pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(seen[held]), sums], ["symbol", "seen", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors of all symbols over all documents; SYMBOLS x DIM, whatever the corpus."""
    schema = "symbol long, seen long, sums array<long>"
    parts = docs.select("text").mapInArrow(trimmed(_contexts), schema).repartition("symbol").mapInArrow(trimmed(_added), schema)
    table, seen = np.zeros((SYMBOLS, DIM)), np.zeros(SYMBOLS)
    for row in written(parts).collect():  # SYMBOLS rows at most
        table[row.symbol], seen[row.symbol] = row.sums, row.seen
    mean = table.sum(axis=0) / max(seen.sum(), 1)
    vectors = table / np.maximum(seen, 1)[:, None] - mean
    vectors[seen == 0] = 0
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Features of each text: means of its words' and shapes' vectors, spread of the latter, log of its length."""
    bucket, shape, borders = symbols(texts)
    n = np.diff(borders)
    rows = len(n)
    each = np.maximum(n, 1)[:, None]
    words = np.zeros((rows, DIM), np.float32)
    if len(bucket) > SLICE_WORDS:  # long texts: counts of buckets are smaller than a vector a word
        for k in np.flatnonzero(n).tolist():
            words[k] = np.bincount(bucket[borders[k] : borders[k + 1]], minlength=BUCKETS) @ vectors[:BUCKETS]
    elif some := np.flatnonzero(n).tolist():
        words[some] = np.add.reduceat(vectors[bucket], borders[:-1][some], axis=0)
    shapes = np.bincount(np.repeat(np.arange(rows), n) * SHAPES + shape - BUCKETS, minlength=rows * SHAPES).reshape(rows, SHAPES) / each
    of_shapes = vectors[BUCKETS:]
    mean = shapes @ of_shapes
    spread = np.sqrt(np.maximum(shapes @ of_shapes**2 - mean**2, 0))
    return np.hstack([words / each, mean, spread, np.log1p(n)[:, None]]).astype(np.float32)


@dataclass
class Network:
    """Two layers; scores are sigmoid(output / temperature)."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def output(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(((x - self.shift) / self.scale) @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.output(x) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Network:
    """Adam on the log loss with weight decay; rows in the order given, batches by the seed. A class that is missing, or no
    rows at all, makes a network whose score is the (smoothed) share of label 1."""
    rate = (y.sum() + 1) / (len(y) + 2)
    zero = np.zeros((x.shape[1], HIDDEN))
    constant = Network(np.zeros(x.shape[1]), np.ones(x.shape[1]), zero, np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(rate / (1 - rate))))
    if len(y) < 10 or len(np.unique(y)) < 2:
        return constant
    check = np.arange(len(y)) % CALIBRATION_SHARE == 0
    fit_x, fit_y = x[~check].astype(np.float64), y[~check].astype(np.float64)
    rng = np.random.default_rng(seed)
    net = Network(fit_x.mean(axis=0), fit_x.std(axis=0) + 1e-6, rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), constant.b2)
    fit_x = (fit_x - net.shift) / net.scale
    weights = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(fit_y))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            w1, b1, w2, b2 = weights
            a, t = fit_x[rows], fit_y[rows]
            hidden = np.maximum(a @ w1 + b1, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ w2 + b2[0], -40, 40)))
            out = (p - t) / len(rows)
            back = np.outer(out, w2) * (hidden > 0)
            step += 1
            for i, g in enumerate([a.T @ back + DECAY * w1, back.sum(axis=0), hidden.T @ out + DECAY * w2, np.array([out.sum()])]):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                pace = RATE * (1 - epoch / EPOCHS)
                weights[i] = weights[i] - pace * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    net.temperature = fit_temperature(net.output(x[check].astype(np.float64)), y[check])
    return net


def fit_temperature(output: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by repeated narrowing on a log scale."""
    low, high = -3.0, 3.0
    for _ in range(6):
        grid = np.linspace(low, high, 21)
        loss = [np.logaddexp(0, np.where(y > 0, -1, 1) * output / np.exp(g)).mean() for g in grid]
        best = int(np.argmin(loss))
        low, high = grid[max(best - 1, 0)], grid[min(best + 1, 20)]
    return float(np.exp((low + high) / 2))


def _pool(vectors):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in by_bytes(batch, "text", SLICE_BYTES):
                x = pooled(whole_texts(b.column("text")), vectors.value)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("label").cast(pa.int32()), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "label", "x"])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[np.ndarray, Network]:
    """Word vectors over all of docs(doc_id, text), and the network fitted on the bounded labelled sample."""
    spark = docs.sparkSession
    vectors = word_vectors(docs)
    sample = training_texts(docs, labels, label).mapInArrow(trimmed(_pool(spark.sparkContext.broadcast(vectors))), "doc_id long, label int, x array<float>")
    rows = sorted((r.doc_id, r.label, r.x) for r in sample.collect())
    rows.sort(key=lambda r: int(mix(np.array([r[0]], np.int64).view(np.uint64))[0]))
    x = np.array([r[2] for r in rows], np.float32).reshape(-1, 3 * DIM + 1)
    return vectors, fit_network(x, np.array([r[1] for r in rows], np.int64))


def score_quality(docs: DataFrame, vectors: np.ndarray, network: Network) -> DataFrame:
    """The columns of docs by place (c0, c1, ...) and the score of every row. Null texts count as empty; empty ones are
    scored like any other, and texts of any length whole."""
    model = docs.sparkSession.sparkContext.broadcast((vectors, network))
    rows = by_place(docs, F.col("text").alias("text"))
    places = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, net = model.value
        for batch in batches:
            for b in by_bytes(batch, "text", SLICE_BYTES):
                score = net.score(pooled(whole_texts(b.column("text")), table).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in places), pa.array(score, pa.float64())], [*places, "score"])

    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[:-1])
    return rows.mapInArrow(trimmed(run), f"{head}score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs(doc_id, text).

    Null, empty and very long texts are scored like others, by their whole text. Equal texts have equal scores; repeated
    rows are rows of their own. Labels of identifiers that docs lacks, and null ones, teach nothing; without labels of both
    kinds all scores are the share of label 1. An empty table gives an empty result. Other columns aren't read.
    """
    docs = docs.select("doc_id", "text")
    scored = score_quality(docs, *fit_quality(docs, labels)).withColumnRenamed("c0", "doc_id")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject, with their columns.

    Null, empty and very long texts are judged by their score like others; repeated rows have equal scores and stay or go
    together. Other columns may have any names; an empty table gives an empty result.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    vectors, network = fit_quality(docs.select("doc_id", "text"), labels)
    return by_name(score_quality(docs, vectors, network).filter(F.col("score") >= THRESHOLD), docs.columns)

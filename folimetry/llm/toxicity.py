"""Toxicity by weak supervision: voters, a generative label model and a linear classifier.

Voters say toxic, clean or nothing about a document: lexicons of insults of four kinds; lexicons of words and patterns of
word beginnings, short and long, that labelled training rows show; patterns of repetition, density and variety over
these. How often each combination of votes occurs is counted over all documents; there are 3**VOTERS at most. The label
model explains these counts by a hidden label. Voters' accuracies are first estimated from how often they agree with the
others; then, by expectation maximisation, each label has a tree of voters, joined where they are most correlated given
the label, with the chance of each vote given the parent's. Labelled training rows count with their labels. Its
posteriors, not the labels, are what a logistic regression over words and word beginnings, and over their repetition in
a document, is trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folimetry.llm.folds import held_out, texts_of
from folimetry.llm.pieces import by_bytes, trimmed, whole_texts
from folimetry.llm.scratch import written
from folimetry.llm.words import LETTERS, mix, span_hashes, word_hashes, word_spans

#: Insults by kind.
LEXICONS = (
    ("stupid", "idiot", "moron", "dumb", "fool", "imbecile", "brainless", "dimwit"),
    ("scum", "trash", "garbage", "vermin", "filth", "parasite", "worthless", "useless"),
    ("loser", "pathetic", "clown", "coward", "failure"),
    ("disgusting", "repulsive", "hateful", "despicable", "revolting"),
)
#: Lengths in bytes of the word beginnings that are features of longer words; from LONG on they are long patterns.
BEGINNINGS = (4, 5, 6, 7, 8)
LONG = 7
#: Voters after the lexicons: telling words, short and long beginnings, repetition, density, variety.
WORDS, SHORT, LONGER, AGAIN, DENSE, VARIED = range(len(LEXICONS), len(LEXICONS) + 6)
VOTERS = len(LEXICONS) + 6
#: Votes; a combination is a number of base 3.
CLEAN, NOTHING, TOXIC = 0, 1, 2
POWERS = 3 ** np.arange(VOTERS, dtype=np.int64)
#: Words of a text from which on the absence of all telling words is a vote, and shares of telling words that are votes.
LEAST_WORDS, DENSE_SHARE, THIN_SHARE = 20, 0.008, 0.001
#: Labelled rows of either label, and unlabelled rows for the classifier beside them, at most; those of smallest hash.
SAMPLE_ROWS = 8_000
#: Features the classifier knows at most.
VOCABULARY = 60_000
#: Documents that a feature must occur in, its log odds, and by how many standard errors its two shares must differ.
LEAST_DOCS, LEAST_LOG_ODDS, LEAST_ERRORS = 3, 1.0, 2.5
#: The same of a voter's key.
VOTER_DOCS, VOTER_LOG_ODDS, VOTER_ERRORS = 4, 2.5, 4.0
#: Min-hashes of a sampled document, band and matches from which two count as copies, of which one is kept.
MIN_HASHES, BAND, ALIKE = 16, 4, 10
SMOOTHING = 4.0
EM_ROUNDS = 25
EPOCHS, STEPS, BATCH, RATE, DECAY, SEED = 30, 4000, 256, 0.1, 1e-4, 23
THRESHOLD = 0.5
SLICE_BYTES = 1 << 19
KINDS = mix(np.arange(1, len(BEGINNINGS) + 2, dtype=np.uint64))


def keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, kind) of every word of letters and of its beginnings, A-Z lower-cased, repeated ones too, and the words of
    each row. Kind 0 is a whole word, others the place of a beginning's length, counted from 1."""
    part, starts, ends, borders = word_spans(texts, LETTERS)
    rows = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    whole, *beginnings = span_hashes(part, starts, ends, BEGINNINGS)
    out_rows, out_keys, kinds = [rows], [mix(whole ^ KINDS[0])], [np.zeros(len(rows), np.int8)]
    for k, (size, found) in enumerate(zip(BEGINNINGS, beginnings, strict=True), 1):
        longer = np.flatnonzero(ends - starts > size)
        out_rows.append(rows[longer])
        out_keys.append(mix(found[longer] ^ KINDS[k]))
        kinds.append(np.full(len(longer), k, np.int8))
    return np.concatenate(out_rows), np.concatenate(out_keys), np.concatenate(kinds), np.diff(borders)


def word_keys(words: tuple[str, ...]) -> np.ndarray:
    return keys(pa.array(words, pa.large_string()))[1][: len(words)]


class KeyTable:
    """Positions of known keys: a table of bits spares the search for nearly all others."""

    def __init__(self, known: np.ndarray) -> None:
        self.order = np.argsort(known)
        self.known = known[self.order]
        self.flags = np.zeros(1 << 22, bool)
        self.flags[known & np.uint64((1 << 22) - 1)] = True

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the asked are known, their positions)."""
        if not len(self.known):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        maybe = np.flatnonzero(self.flags[asked & np.uint64((1 << 22) - 1)])
        at = np.minimum(np.searchsorted(self.known, asked[maybe]), len(self.known) - 1)
        hit = self.known[at] == asked[maybe]
        return maybe[hit], self.order[at[hit]]


@dataclass
class Features:
    """Known keys, the voter that each belongs to (-1: none), and whether its repetition in a document is a vote (0 or 1).
    Feature k is key k's occurrence, feature len(keys) + k its repetition."""

    keys: np.ndarray
    voter: np.ndarray
    again: np.ndarray

    def __post_init__(self) -> None:
        self.table = KeyTable(self.keys)

    @property
    def size(self) -> int:
        return 2 * len(self.keys)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature), each pair once and by row, and each row's combination of votes."""
        rows, asked, _, words = keys(texts)
        which, feature = self.table.find(asked)
        pair, times = np.unique(rows[which] * max(len(self.keys), 1) + feature, return_counts=True)
        row, key = np.divmod(pair, max(len(self.keys), 1))
        n = len(texts)

        def rows_of(hit: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
            return np.bincount(row[hit], None if weight is None else weight[hit], minlength=n)

        voter, votes = self.voter[key], np.full((n, VOTERS), NOTHING, np.int64)
        telling = voter >= 0
        fired = np.stack([rows_of(voter == v) > 0 for v in range(LONGER + 1)], axis=1)
        repeated = rows_of((self.again[key] > 0) & (times > 1)) > 0
        # telling words count together; the telling beginning that occurs most counts alone, for they overlap
        hits, begun = rows_of(telling & (voter < SHORT), times.astype(float)), voter >= SHORT
        np.maximum.at(hits, row[begun], times[begun])
        share, different = hits / np.maximum(words, 1), rows_of(telling & (voter < SHORT))
        silent = (rows_of(telling) == 0) & (words >= LEAST_WORDS)
        votes[:, : LONGER + 1][fired] = TOXIC
        votes[repeated, AGAIN] = TOXIC
        votes[(share >= DENSE_SHARE) & (hits >= 2), DENSE] = TOXIC
        votes[different >= 2, VARIED] = TOXIC
        for v in (WORDS, SHORT, LONGER, AGAIN, VARIED):
            votes[silent & (votes[:, v] == NOTHING), v] = CLEAN
        votes[(share < THIN_SHARE) & (words >= LEAST_WORDS) & (votes[:, DENSE] == NOTHING), DENSE] = CLEAN
        twice = times > 1
        row, feature = np.concatenate([row, row[twice]]), np.concatenate([key, key[twice] + len(self.keys)])
        order = np.argsort(row, kind="stable")
        return row[order], feature[order], votes @ POWERS


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in by_bytes(batch, "text", SLICE_BYTES):
            part, starts, ends, borders = word_spans(whole_texts(b.column("text")), LETTERS)
            hashes = word_hashes(part, starts, ends)
            some = np.flatnonzero(np.diff(borders))
            out = np.zeros((b.num_rows, MIN_HASHES), np.uint64)
            for k in range(MIN_HASHES if len(some) else 0):
                out[some, k] = np.minimum.reduceat(mix(hashes ^ mix(np.array([k + 1], np.uint64))), borders[:-1][some])
            lists = pa.FixedSizeListArray.from_arrays(pa.array(out.reshape(-1).view(np.int64)), MIN_HASHES).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), lists], ["doc_id", "signature"])


def independent(doc_ids: np.ndarray, signatures: np.ndarray) -> np.ndarray:
    """Of documents that are copies of each other, near ones too, the one of smallest doc_id: else a group of copies would
    make any word of theirs look telling."""
    order = np.argsort(doc_ids, kind="stable")
    kept: list[int] = []
    bands: dict[tuple, list[int]] = {}
    for i in order.tolist():
        names = [(k, *signatures[i, k : k + BAND].tolist()) for k in range(0, MIN_HASHES, BAND)]
        near = {j for n in names for j in bands.get(n, ())}
        if any((signatures[i] == signatures[j]).sum() >= ALIKE for j in near):
            continue
        kept.append(i)
        for n in names:
            bands.setdefault(n, []).append(i)
    return doc_ids[kept]


def _sample(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, text, label) of at most SAMPLE_ROWS training rows of either label."""
    usable = labels.filter(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    part = [usable.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS) for y in (0, 1)]
    chosen = written(texts_of(docs, part[0].unionByName(part[1])))
    rows = chosen.select("doc_id", "text").mapInArrow(trimmed(_signatures), "doc_id long, signature array<long>").toPandas()
    if len(rows):
        apart = independent(rows["doc_id"].to_numpy(), np.stack(rows["signature"].to_numpy()))
        kept = docs.sparkSession.createDataFrame([(int(i),) for i in apart], "doc_id long")
        chosen = chosen.join(F.broadcast(kept), "doc_id", "left_semi")  # bounded too
    return chosen


def _key_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label that hold each key, and hold it again, over the task's rows (a bounded sample)."""
    found: list[np.ndarray] = []
    for batch in batches:
        for b in by_bytes(batch, "text", SLICE_BYTES):
            label = b.column("label").to_numpy()
            rows, key, kind, _ = keys(whole_texts(b.column("text")))
            order = np.lexsort((rows, key))
            rows, key, kind = rows[order], key[order], kind[order]
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (rows[1:] != rows[:-1]))[: len(key)])
            again = np.diff(np.append(first, len(key))) > 1
            y = label[rows[first]]
            found.append(np.stack([key[first].view(np.int64), kind[first].astype(np.int64), y, y * again, 1 - y, (1 - y) * again]).astype(np.int64))
    if found:
        key, kind, *counts = np.concatenate(found, axis=1)
        order = np.argsort(key, kind="stable")
        at = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])[: len(key)])
        sums = [np.add.reduceat(c[order], at) if len(at) else c for c in counts]
        yield pa.RecordBatch.from_arrays([pa.array(key[order][at]), pa.array(kind[order][at].astype(np.int32)), *map(pa.array, sums)], ["key", "kind", "ones", "ones_again", "zeros", "zeros_again"])


COUNTS = ("ones", "ones_again", "zeros", "zeros_again")


def find_features(sample: DataFrame) -> Features:
    """Keys that tell the labels of the sample apart by occurring or by occurring again, and the voters made of them."""
    totals = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    fixed = [word_keys(words) for words in LEXICONS]
    known = np.concatenate(fixed)
    voters = np.concatenate([np.full(len(k), i) for i, k in enumerate(fixed)])
    again = np.ones(len(known), np.int8)
    if len(totals) < 2:
        return Features(known, voters, again)
    ones, zeros = totals[1], totals[0]
    share = ones / (ones + zeros)
    counted = sample.select("label", "text").mapInArrow(trimmed(_key_counts), "key long, kind int, " + ", ".join(f"{c} long" for c in COUNTS))
    counted = counted.groupBy("key").agg(F.first("kind").alias("kind"), *(F.sum(c).alias(c) for c in COUNTS))

    def odds(suffix: str) -> Column:
        return F.log((F.col(f"ones{suffix}") + SMOOTHING * share) / (F.col(f"zeros{suffix}") + SMOOTHING * (1 - share))) - float(np.log(share / (1 - share)))

    def errors(suffix: str) -> Column:
        a, b = F.col(f"ones{suffix}") / ones, F.col(f"zeros{suffix}") / zeros
        p = (F.col(f"ones{suffix}") + F.col(f"zeros{suffix}")) / (ones + zeros)
        return F.abs(a - b) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / ones + 1 / zeros))

    def tells(suffix: str) -> Column:
        held = F.col(f"ones{suffix}") + F.col(f"zeros{suffix}") >= LEAST_DOCS
        return held & (F.abs(odds(suffix)) >= LEAST_LOG_ODDS) & (errors(suffix) >= LEAST_ERRORS)

    def votes(suffix: str) -> Column:
        return (F.col(f"ones{suffix}") >= VOTER_DOCS) & (odds(suffix) >= VOTER_LOG_ODDS) & (errors(suffix) >= VOTER_ERRORS)

    chosen = (
        counted.filter(tells("") | tells("_again")).withColumns({"votes": votes(""), "votes_again": votes("_again"), "errors": F.greatest(errors(""), errors("_again"))})
        .orderBy(F.desc("errors"), "key").limit(VOCABULARY).select("key", "kind", "votes", "votes_again").toPandas()
    )
    chosen = chosen[~np.isin(chosen["key"].to_numpy(np.int64).view(np.uint64), known)]
    kind = chosen["kind"].to_numpy()
    voter = np.where(kind == 0, WORDS, np.where(np.array((0, *BEGINNINGS))[kind] >= LONG, LONGER, SHORT))
    return Features(
        np.concatenate([known, chosen["key"].to_numpy(np.int64).view(np.uint64)]), np.concatenate([voters, np.where(chosen["votes"].to_numpy(bool), voter, -1)]),
        np.concatenate([again, chosen["votes_again"].to_numpy(bool).astype(np.int8)]),
    )


def _vote_counts(features):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((3, 3**VOTERS), np.int32)
        for batch in batches:
            for b in by_bytes(batch, "text", SLICE_BYTES):
                bits = features.value.of(whole_texts(b.column("text")))[2]
                label = b.column("label").to_numpy(zero_copy_only=False)
                np.add.at(counts, (label, bits), 1)
        label, bits = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(bits, pa.int64()), pa.array(counts[label, bits].astype(np.int64))], ["label", "votes", "docs"])

    return run


@dataclass
class LabelModel:
    """Chance of label 1 of each combination of votes, the tree's parents, and each voter's accuracy where it votes."""

    posterior: np.ndarray
    parents: np.ndarray
    accuracies: np.ndarray


def agreement(said: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Accuracy of each voter, estimated from how often its votes (1, 0, -1) are those of the others' majority."""
    out = np.empty(said.shape[1])
    for j in range(said.shape[1]):
        others = np.sign(said.sum(axis=1) - said[:, j])
        both = (others != 0) & (said[:, j] != 0)
        same = docs @ (both & (others == said[:, j]))
        out[j] = (same + 3) / (docs @ both + 4)
    return np.clip(out, 0.05, 0.98)


def _tree(weight: np.ndarray) -> np.ndarray:
    """Parent of each voter in the tree of largest weight; voter 0 has none (-1)."""
    n = len(weight)
    parent, best = np.full(n, -1), np.full(n, -np.inf)
    inside = np.zeros(n, bool)
    at = 0
    for _ in range(n - 1):
        inside[at] = True
        closer = ~inside & (weight[at] > best)
        best[closer], parent[closer] = weight[at][closer], at
        at = int(np.argmax(np.where(inside, -np.inf, best)))
    return parent


def fit_label_model(votes: np.ndarray, docs: np.ndarray, ones: np.ndarray, zeros: np.ndarray, rounds: int = EM_ROUNDS) -> LabelModel:
    """From combinations of votes with the documents that have them, and labelled training documents among these."""
    state = votes[:, None] // POWERS % 3
    said = state - NOTHING
    accuracies = agreement(said, docs)
    post = 1 / (1 + np.exp(-np.clip(said @ np.log(accuracies / (1 - accuracies)), -30, 30)))
    is_ = (state[:, :, None] == np.arange(3)).astype(float)  # combination, voter, vote
    flat = is_.reshape(len(votes), -1)
    parents = np.full(VOTERS, -1)
    for _ in range(rounds):
        prior = (docs @ post + 1) / (docs.sum() + 2)
        weights = [docs * (1 - post) + zeros, docs * post + ones]
        apart, single, joint = np.zeros((VOTERS, VOTERS)), [], []
        for w in weights:
            total = w.sum() + 3
            one = (np.tensordot(w, is_, 1) + 1) / total
            both = ((flat.T @ (flat * w[:, None])).reshape(VOTERS, 3, VOTERS, 3) + one[:, :, None, None] * one[None, None]) / (w.sum() + 1)
            apart += total * np.einsum("iajb,iajb->ij", both, np.log(np.maximum(both, 1e-12) / (one[:, :, None, None] * one[None, None])))
            single.append(one)
            joint.append(both)
        parents = _tree(apart)
        score = np.full(len(votes), np.log(prior / (1 - prior)))
        for y, one, both in ((-1, *(x[0] for x in (single, joint))), (1, *(x[1] for x in (single, joint)))):
            for j, parent in enumerate(parents):
                chance = one[j][state[:, j]] if parent < 0 else both[parent, state[:, parent], j, state[:, j]] / both[parent, :, j].sum(axis=1)[state[:, parent]]
                score += y * np.log(np.clip(chance, 1e-6, 1))
        post = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    table = np.zeros(3**VOTERS)
    table[votes] = post
    right = docs @ np.where(said > 0, post[:, None], np.where(said < 0, 1 - post[:, None], 0))
    return LabelModel(table, parents, right / np.maximum(docs @ (said != 0), 1))


@dataclass
class Linear:
    weights: np.ndarray
    bias: float

    def score(self, rows: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
        z = np.bincount(rows, self.weights[features], minlength=n) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_linear(rows: list[np.ndarray], target: np.ndarray, size: int) -> Linear:
    """Logistic regression on soft targets by AdaGrad; a feature is there or not."""
    weights, bias = np.zeros(size), -2.0
    squares, bias_square = np.full(size, 1e-2), 1e-2
    rng = np.random.default_rng(SEED)
    for _ in range(max(EPOCHS, STEPS * BATCH // len(rows)) if len(rows) else 0):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            features, row = np.concatenate([rows[i] for i in batch]), np.repeat(np.arange(len(batch)), [len(rows[i]) for i in batch])
            z = np.bincount(row, weights[features], minlength=len(batch)) + bias
            out = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - target[batch]
            used, place = np.unique(features, return_inverse=True)
            slope = np.bincount(place, out[row], minlength=len(used)) / len(batch) + DECAY * weights[used]
            squares[used] += slope**2
            weights[used] -= RATE * slope / np.sqrt(squares[used])
            bias_square += out.mean() ** 2
            bias -= RATE * out.mean() / bias_square**0.5
    return Linear(weights, bias)


def _featured(features):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in by_bytes(batch, "text", SLICE_BYTES):
                rows, feature, bits = features.value.of(whole_texts(b.column("text")))
                at = np.searchsorted(rows, np.arange(b.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(bits), pa.ListArray.from_arrays(pa.array(at), pa.array(feature.astype(np.int32)))], ["doc_id", "votes", "features"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[Features, LabelModel, Linear]:
    spark = docs.sparkSession
    sample = _sample(docs, labels, label)
    features = find_features(sample)
    shared = spark.sparkContext.broadcast(features)
    schema = "label int, votes long, docs long"
    every = docs.select("text", F.lit(2).alias("label")).mapInArrow(trimmed(_vote_counts(shared)), schema)
    counted = every.unionByName(sample.select("text", "label").mapInArrow(trimmed(_vote_counts(shared)), schema))
    rows = counted.groupBy("label", "votes").agg(F.sum("docs").alias("docs")).collect()  # 3 * 3**VOTERS at most
    votes = np.array(sorted({r.votes for r in rows}), np.int64)
    counts = np.zeros((3, len(votes)))
    for r in rows:
        counts[r.label, np.searchsorted(votes, r.votes)] = r.docs
    model = fit_label_model(votes, counts[2], counts[1], counts[0]) if len(votes) else LabelModel(np.zeros(3**VOTERS), np.full(VOTERS, -1), np.zeros(VOTERS))
    others = docs.filter(~held_out(F.col("doc_id"))).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS).distinct()
    beside = texts_of(docs, others).select("doc_id", "text")
    fitted = sorted(sample.select("doc_id", "text").unionByName(beside).mapInArrow(trimmed(_featured(shared)), "doc_id long, votes long, features array<int>").collect())
    lists = [np.array(r.features, np.int64) for r in fitted]
    linear = fit_linear(lists, model.posterior[np.array([r.votes for r in fitted], np.int64)], features.size)
    return features, model, linear


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs(doc_id, text).

    Null texts count as empty and are scored like any other (by the bias alone); texts of any length are scored whole.
    Equal texts have equal scores; repeated rows are rows of their own. Labels of identifiers that docs lacks teach
    nothing; without labels the voters are the fixed lexicons. An empty table gives an empty result. Other columns aren't read.
    """
    features, _, linear = fit_toxicity(docs, labels)
    model = docs.sparkSession.sparkContext.broadcast((features, linear))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, line = model.value
        for batch in batches:
            for b in by_bytes(batch, "text", SLICE_BYTES):
                rows, feature, _ = known.of(whole_texts(b.column("text")))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(line.score(rows, feature, b.num_rows))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))

"""Exact dedup by a log-structured merge index of text digests.

Map tasks put the digests of their rows into an index: a memtable is flushed as a sorted run when full, and runs of like
size are compacted, keeping the smallest identifier and the number of rows of each digest. So a group of copies leaves a
task as one entry, however large. The runs are dealt out by digest and compacted again; entries with more than one row
are hits, and know the row that stays and the size of the group. A Bloom filter over the hits' digests is asked for
every row: what it doesn't know has no copy and is done, the others look their digest up among the hits. The texts of
hits, and of no other rows, are then compared byte by byte; where one digest has several texts, these decide instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folimetry.llm.pieces import trimmed
from folimetry.llm.scratch import free_name, numbered, shared_folder, without_rows, written

MEMTABLE_ROWS = 1 << 18
#: Runs of one level that are compacted into one of the next.
FANOUT = 4
FILTER_BITS_PER_KEY = 10
FILTER_PROBES = 7
#: Bits of the filter over hits at most (16 MB); with more hits than that suits, more rows than need to look them up.
MOST_FILTER_BITS = 1 << 27
FILTER_BLOCK = 1 << 16
#: Lists are broadcast up to this many rows (some 60 bytes each); beyond, the join shuffles.
BROADCAST_HITS = 200_000
#: Identifiers as three columns in order of preference: 1 for a null doc_id, the doc_id (or its complement), the row number.
IDENTITY = ("unknown", "place", "row")
RUN = ("high", "low", *IDENTITY, "copies")
RUN_SCHEMA = ", ".join(f"{n} long" for n in RUN)


class BloomFilter:
    """Bits over 64-bit keys that are digests already: probes come from their two halves."""

    def __init__(self, bits: int, words: np.ndarray | None = None) -> None:
        self.bits = bits
        self.words = np.zeros(bits // 8, np.uint8) if words is None else words

    @staticmethod
    def size(keys: int) -> int:
        return min(MOST_FILTER_BITS, 1 << max(FILTER_BLOCK.bit_length() + 2, (keys * FILTER_BITS_PER_KEY).bit_length()))

    def _places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        key = keys.view(np.uint64)
        step = (key >> np.uint64(32)) | np.uint64(1)
        for i in range(FILTER_PROBES):
            yield (key + np.uint64(i) * step) & np.uint64(self.bits - 1)

    def add(self, keys: np.ndarray) -> None:
        for at in self._places(keys):
            np.bitwise_or.at(self.words, at >> np.uint64(3), (1 << (at & np.uint64(7))).astype(np.uint8))

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in self._places(keys):
            found &= (self.words[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return found


Run = tuple[np.ndarray, ...]  # the columns of RUN, sorted by digest, each digest once


def compact(runs: list[Run]) -> Run:
    """Merge entries: of each digest the smallest identifier and the sum of copies."""
    columns = [np.concatenate(x) for x in zip(*runs, strict=True)] if runs else [np.empty(0, np.int64)] * len(RUN)
    order = np.lexsort(columns[-2::-1])
    high, low, *identity, copies = (c[order] for c in columns)
    at = np.flatnonzero(np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))[: len(high)])
    return (high[at], low[at], *(c[at] for c in identity), np.add.reduceat(copies, at) if len(at) else copies)


class DigestIndex:
    """Log-structured merge index of the entries of RUN."""

    def __init__(self, memtable_rows: int = MEMTABLE_ROWS, fanout: int = FANOUT) -> None:
        self.memtable_rows, self.fanout = memtable_rows, fanout
        self.memtable: list[Run] = []
        self.rows = 0
        self.levels: list[list[Run]] = []

    def put(self, entries: Run) -> None:
        self.memtable.append(entries)
        self.rows += len(entries[0])
        if self.rows >= self.memtable_rows:
            self.flush()

    def flush(self) -> None:
        if not self.rows:
            return
        run, self.memtable, self.rows, level = compact(self.memtable), [], 0, 0
        while True:
            if len(self.levels) <= level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            run, self.levels[level] = compact(self.levels[level]), []
            level += 1

    def merged(self) -> Run:
        self.flush()
        return compact([run for level in self.levels for run in level])


def _indexed(hits: bool):
    """The compacted index of a task's entries; if asked, only those of several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestIndex()
        for b in batches:
            index.put(tuple(b.column(n).to_numpy() for n in RUN))
        whole = index.merged()
        kept = whole[-1] > 1 if hits else slice(None)
        yield pa.RecordBatch.from_arrays([pa.array(c[kept], pa.int64()) for c in whole], list(RUN))

    return run


def digest_hits(rows: DataFrame) -> DataFrame:
    """Entries of digests that several rows have, from rows of (high, low, unknown, place, row)."""
    entries = rows.select(*RUN[:-1], F.lit(1).cast("long").alias("copies"))
    runs = entries.mapInArrow(trimmed(_indexed(False)), RUN_SCHEMA)
    return runs.repartition("high", "low").mapInArrow(trimmed(_indexed(True)), RUN_SCHEMA)


def filter_of(hits: DataFrame, n: int) -> BloomFilter:
    """A Bloom filter over the hits' digests; tasks fill parts of it, of which the driver holds MOST_FILTER_BITS at most."""
    bits = BloomFilter.size(n)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BloomFilter(bits)
        for b in batches:
            own.add(b.column("high").to_numpy())
        blocks = own.words.reshape(-1, FILTER_BLOCK // 8)
        some = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([blocks[k].tobytes() for k in some], pa.binary())], ["block", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, np.ndarray] = {}
        for b in batches:
            for k, part in zip(b.column("block").to_pylist(), b.column("bits").to_pylist(), strict=True):
                part = np.frombuffer(part, np.uint8)
                whole[k] = whole[k] | part if k in whole else part
        yield pa.RecordBatch.from_arrays([pa.array(list(whole), pa.int64()), pa.array([w.tobytes() for w in whole.values()], pa.binary())], ["block", "bits"])

    schema = "block long, bits binary"
    made = hits.select("high").mapInArrow(trimmed(fill), schema).repartition("block").mapInArrow(trimmed(merge), schema)
    out = BloomFilter(bits)
    for row in made.collect():
        out.words.reshape(-1, FILTER_BLOCK // 8)[row.block] = np.frombuffer(row.bits, np.uint8)
    return out


def may_have_copies(keys: DataFrame, hits: DataFrame, n: int) -> DataFrame:
    """keys with `maybe`: whether the hits' filter knows the row's digest."""
    shared = keys.sparkSession.sparkContext.broadcast(filter_of(hits, n))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("maybe", pa.array(shared.value.may_hold(b.column("high").to_numpy())))

    return keys.mapInArrow(trimmed(ask), T.StructType([*keys.schema, T.StructField("maybe", T.BooleanType())]))


def exact_groups(docs: DataFrame, keep: str = "largest", digest_hex: int = 32, row: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs(doc_id, text), plus its row_id.

    Null texts count as empty; empty texts are a group like others. Of equal texts the row with the largest (or
    `keep="smallest"`) doc_id stays; of rows that repeat both text and doc_id, one. Null doc_ids lose to all others, and
    a group of only null ones has keep_id null. Texts of any length are compared whole. An empty table gives an empty
    result. `digest_hex` is the number of hex digits of SHA-256 that make the index's digest (32 at most); fewer only
    make more texts to compare. `row` names a column of docs with row numbers that stay; without it rows are numbered
    here. Other columns are neither read nor returned, whatever their names.
    """
    folder = shared_folder(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    half = (digest_hex + 1) // 2

    def number(hexes):
        return F.conv(hexes, 16, -10).cast("long")

    rows = docs.select("doc_id", "text", F.col(row).alias("row_id")) if row else numbered(docs.select("doc_id", "text"), "row_id")
    doc_id = F.col("doc_id").cast("long")
    hashed = (
        rows.select("doc_id", F.sha2(text, 256).alias("text_sha256"), text.alias("text"), "row_id")
        .withColumn("high", number(F.substring("text_sha256", 1, half)))
        .withColumn("low", F.coalesce(number(F.substring("text_sha256", 17, digest_hex - half)), F.lit(0)))
        .withColumn("unknown", doc_id.isNull().cast("long"))
        .withColumn("place", F.coalesce(F.bitwise_not(doc_id) if keep == "largest" else doc_id, F.lit(0)))
    )
    keys = written(hashed.drop("text").withColumn("row", F.bitwise_not("row_id") if keep == "largest" else F.col("row_id")), folder)
    hits = written(digest_hits(keys), folder)
    n = hits.count()
    found = F.broadcast(hits.select("high", "low")) if n <= BROADCAST_HITS else hits.select("high", "low")
    texts = hashed.select("high", "low", *IDENTITY[:2], "row_id", "doc_id", "text", "text_sha256").join(found, ["high", "low"], "left_semi")
    # byte by byte: copies are one row a task and text before they meet
    several = texts.groupBy("high", "low", "text").agg(F.lit(1).alias("one")).groupBy("high", "low").agg(F.count("*").alias("texts")).filter("texts > 1")
    several = written(several.select("high", "low"), folder, n)
    asked = may_have_copies(keys, hits, n)
    own = {"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)}
    columns = ["row_id", "doc_id", "text_sha256", "keep_id", "group_size", "kept"]
    alone = asked.filter("not maybe").withColumns(own).select(*columns)
    entries = hits.select("high", "low", F.lit(True).alias("hit"), *(F.col(c).alias("of_" + c) for c in IDENTITY), "copies")
    looked_up = asked.filter("maybe").join(F.broadcast(entries) if n <= BROADCAST_HITS else entries, ["high", "low"], "left")
    place = F.bitwise_not("of_place") if keep == "largest" else F.col("of_place")
    indexed = {
        "keep_id": F.when(F.col("hit").isNull(), F.col("doc_id")).when(F.col("of_unknown") == 0, place.cast(docs.schema["doc_id"].dataType)),
        "group_size": F.coalesce("copies", F.lit(1).cast("long")), "kept": F.col("hit").isNull() | (F.col("row") == F.col("of_row")),
    }
    few = several.count()
    if not few:
        return alone.unionByName(looked_up.withColumns(indexed).select(*columns))
    mixed = F.broadcast(several) if few <= BROADCAST_HITS else several
    plain = looked_up.join(mixed, ["high", "low"], "left_anti").withColumns(indexed).select(*columns)
    unlike = written(texts.join(mixed, ["high", "low"], "left_semi"), folder)
    best = F.max if keep == "largest" else F.min
    identity = F.struct(F.col("doc_id").isNotNull().alias("known") if keep == "largest" else F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_id")
    groups = written(unlike.groupBy("high", "low", "text").agg(best(identity).alias("keeper"), F.count("*").alias("group_size")), folder)
    by_text = {"keep_id": F.col("keeper.doc_id"), "kept": F.col("keeper.row_id") == F.col("row_id")}
    return alone.unionByName(plain).unionByName(unlike.join(groups, ["high", "low", "text"]).withColumns(by_text).select(*columns))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that stay, with their columns; rows are told apart by their place in the stored table.

    Null texts are empty ones, of which one stays; of equal texts that of largest doc_id, and of rows that repeat that too,
    the last stored. Texts of any length are compared whole. Other columns may have any names; an empty table gives an
    empty result.
    """
    row = free_name(docs, "__row")
    docs = numbered(docs, row)
    dropped = written(exact_groups(docs, row=row).filter("not kept").select("row_id"))
    return without_rows(docs, row, dropped, BROADCAST_HITS)


OP4_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text) AS kept, sha256(text) AS text_sha256
FROM d
"""

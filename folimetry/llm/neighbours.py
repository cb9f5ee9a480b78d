"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, results merged.

Vectors are dealt to shards by a hash; shards grow with the table up to a bound. A shard's equal vectors are one node. A
node's top layer follows from a hash. Nodes are inserted a block at a time: each looks for its nearest in the graph built
so far, layer by layer, and among its block; what is found is thinned so that links lead in different directions, and
made mutual, where a node with too many links thins them in the same way. Layers are flat arrays of neighbour numbers. Queries go
down the layers in step, many at a time; the distances of what they find are computed again in double precision.

The graph works in single precision on vectors that are moved to the shard's mean and scaled by a power of two. A query that
is far from the shard, or finds vectors nearer than single precision tells apart, is compared with all of the shard's
vectors in double precision instead: no vector of finite components is lost, whatever its size.

Queries are written once to the shared folder and read by each shard's task in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folimetry.llm.pieces import trimmed
from folimetry.llm.scratch import filesystem, shared_folder, written
from folimetry.llm.words import mix

#: Vectors of a shard at least, while there are fewer shards than cores, and at most; and its bytes at most.
LEAST_SHARD, MOST_SHARD, SHARD_BYTES = 8192, 1 << 15, 64 << 20
LINKS, GROUND_LINKS = 16, 32
#: Nodes that an inserted node or a query keeps in sight, in upper layers and on the ground, and looks beyond at a time.
BUILD_BEAM, BEAM, UPPER_BEAM, EXPAND = 48, 256, 8, 6
QUERY_BLOCK = 128
BUILD_BLOCK = 256
NEAREST = 10
#: Against the shard's largest component: a query is far beyond this, and distances below this aren't told apart (some 64
#: roundings of a component).
FAR, CLOSE = 16.0, 2.0**-18
#: Vectors that a query is compared with at once in double precision.
EXACT_ROWS = 1 << 12
QUERY_STEP = 100


@dataclass
class Layer:
    """Nodes of a layer, each node's place in it, and its neighbours with their squared distances, nearest first, -1 where
    there are fewer."""

    nodes: np.ndarray
    place: np.ndarray
    links: np.ndarray
    gaps: np.ndarray


def _nearest(near: np.ndarray, gaps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of each row's nodes in order, at most so many."""
    if near.shape[1] > most:
        part = np.argpartition(gaps, most - 1, axis=1)[:, :most]
        near, gaps = np.take_along_axis(near, part, axis=1), np.take_along_axis(gaps, part, axis=1)
    order = np.argsort(gaps, axis=1, kind="stable")
    return np.take_along_axis(near, order, axis=1), np.take_along_axis(gaps, order, axis=1)


#: Part of a distance by which another node must be nearer to a candidate than the row's own node, to make it needless. Of
#: nodes close together one then doesn't hide the others' links to far ones.
HIDDEN = 1 - 2.0**-10
#: Squared distances up to this part of a squared norm are rounding: such nodes hide each other, too.
ROUNDING = 2.0**-20


def _chosen(near: np.ndarray, apart: np.ndarray, vectors: np.ndarray, links: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's candidates, nearest first, those nearer to the row's node than to any chosen before; then the nearest
    of the others, up to the number of links; and their distances."""
    found = vectors[near]
    norms = np.einsum("ijk,ijk->ij", found, found)
    between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(found, found.transpose(0, 2, 1))
    taken = np.zeros(near.shape, bool)
    for j in range(near.shape[1]):
        blocked = (taken & ((between[:, j, :] < HIDDEN * apart[:, j, None]) | (between[:, j, :] <= ROUNDING * norms[:, j, None]))).any(axis=1)
        taken[:, j] = ~blocked & (taken.sum(axis=1) < links) & np.isfinite(apart[:, j])
    rank = np.argsort(np.where(taken, 0, 1) + np.isinf(apart), axis=1, kind="stable")[:, :links]
    out, gaps = np.take_along_axis(near, rank, axis=1), np.take_along_axis(apart, rank, axis=1)
    out[np.isinf(gaps)] = -1
    return out, gaps


class Graph:
    """Layers from the ground up over distinct vectors."""

    def __init__(self, vectors: np.ndarray, identities: np.ndarray) -> None:
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        n = len(vectors)
        chance = (mix(identities.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        self.top = np.floor(-np.log(np.maximum(chance, 1e-12)) / np.log(LINKS)).astype(int)
        self.layers: list[Layer] = []
        while not self.layers or (self.top >= len(self.layers)).sum() > UPPER_BEAM:
            nodes, links = np.flatnonzero(self.top >= len(self.layers)), LINKS if self.layers else GROUND_LINKS
            place = np.full(n + 1, -1, np.int32)
            place[nodes] = np.arange(len(nodes))
            self.layers.append(Layer(nodes, place, np.full((len(nodes), links), -1, np.int32), np.full((len(nodes), links), np.inf, np.float32)))
        order = np.argsort(mix(identities.astype(np.uint64) ^ np.uint64(BUILD_BLOCK)), kind="stable")  # as they come, in no order
        self.entries = [np.empty(0, np.int64) for _ in self.layers]
        for a in range(0, n, BUILD_BLOCK):
            self._insert(order[a : a + BUILD_BLOCK])

    def _insert(self, block: np.ndarray) -> None:
        found = np.empty((len(block), 0), np.int64)
        for level in range(len(self.layers) - 1, -1, -1):
            here, layer = self.top[block] >= level, self.layers[level]
            known = self.entries[level]
            if len(known):  # what is found a layer above leads into this one
                start = np.hstack([found, np.broadcast_to(known, (len(block), len(known)))])
                found = self._descend(layer, self.vectors[block], start, BUILD_BEAM if here.any() else UPPER_BEAM)
            if here.any():
                new = block[here]
                self._link(layer, new, found[here])
                if len(known) < UPPER_BEAM:
                    self.entries[level] = np.concatenate([known, new[: UPPER_BEAM - len(known)]])

    def _link(self, layer: Layer, new: np.ndarray, found: np.ndarray) -> None:
        """Links of new nodes to those found for each and to each other, and back."""
        own = self.vectors[new]
        norms = np.einsum("ij,ij->i", own, own)
        among = np.maximum(norms[:, None] + norms - 2 * own @ own.T, 0)
        np.fill_diagonal(among, np.inf)
        near = np.hstack([found, np.broadcast_to(new, (len(new), len(new)))])
        gaps = np.hstack([self._gaps(own, found), among.astype(np.float32)])
        near, gaps = _nearest(near, gaps, BUILD_BEAM)
        chosen, _ = _chosen(near, gaps, self.vectors, layer.links.shape[1] // 2)
        start, end = np.repeat(new, chosen.shape[1]), chosen.reshape(-1)
        start, end = start[end >= 0], end[end >= 0]
        start, end = np.divmod(np.unique(np.concatenate([start * len(self.vectors) + end, end * len(self.vectors) + start])), len(self.vectors))
        gap = ((self.vectors[start] - self.vectors[end]) ** 2).sum(axis=1)
        order = np.lexsort((gap, start))
        start, end, gap = start[order], end[order], gap[order]
        targets, first = np.unique(start, return_index=True)
        rank = np.arange(len(start)) - np.repeat(first, np.diff(np.append(first, len(start))))
        width = layer.links.shape[1]
        fits = rank < width
        row = np.searchsorted(targets, start)
        more, more_gaps = np.full((len(targets), width), -1, np.int64), np.full((len(targets), width), np.inf, np.float32)
        more[row[fits], rank[fits]], more_gaps[row[fits], rank[fits]] = end[fits], gap[fits]
        at = layer.place[targets]
        both, both_gaps = _nearest(np.hstack([layer.links[at], more]), np.hstack([layer.gaps[at], more_gaps]), 2 * width)
        kept, kept_gaps = both[:, :width].copy(), both_gaps[:, :width].copy()
        full = np.flatnonzero(np.isfinite(both_gaps[:, width]))  # links that lead elsewhere stay among many near ones
        for k in range(0, len(full), BUILD_BLOCK):
            part = full[k : k + BUILD_BLOCK]
            kept[part], kept_gaps[part] = _chosen(both[part], both_gaps[part], self.vectors, width)
        layer.links[at], layer.gaps[at] = np.where(np.isfinite(kept_gaps), kept, -1), kept_gaps

    def search(self, queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Nodes found near each query, nearest first, -1 where there are fewer."""
        queries = np.ascontiguousarray(queries, np.float32)
        start = self.entries[-1]
        found = np.broadcast_to(start, (len(queries), len(start)))
        for level in range(len(self.layers) - 1, -1, -1):
            found = self._descend(self.layers[level], queries, found, beam if level == 0 else UPPER_BEAM)
        return found

    def _gaps(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        delta = self.vectors[nodes] - queries[:, None, :]
        gaps = np.einsum("ijk,ijk->ij", delta, delta)
        gaps[nodes < 0] = np.inf
        return gaps

    def _descend(self, layer: Layer, queries: np.ndarray, entries: np.ndarray, beam: int) -> np.ndarray:
        rows = np.arange(len(queries))[:, None]
        seen = np.zeros((len(queries), len(self.vectors) + 1), bool)  # the last column takes the -1
        ids = np.sort(entries.astype(np.int64), axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        gaps = self._gaps(queries, ids)
        seen[rows, ids] = True
        done = ids < 0
        while True:
            order = np.argsort(gaps, axis=1, kind="stable")[:, :beam]
            ids, gaps, done = (np.take_along_axis(x, order, axis=1) for x in (ids, gaps, done))
            live = np.flatnonzero(~done.all(axis=1))
            if not len(live):
                return np.where(np.isfinite(gaps), ids, -1)
            pick = np.argsort(np.where(done[live], np.inf, np.arange(done.shape[1])), axis=1, kind="stable")[:, :EXPAND]
            todo = np.take_along_axis(~done[live], pick, axis=1)
            nodes = np.where(todo, np.take_along_axis(ids[live], pick, axis=1), -1)
            done[live[:, None], pick] = True
            at = layer.place[nodes]
            near = np.where((nodes >= 0)[:, :, None], layer.links[at], -1).reshape(len(live), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[live[:, None], near]] = -1
            seen[live[:, None], near] = True
            seen[:, -1] = False
            fresh = np.full((len(queries), near.shape[1]), -1, np.int64)
            fresh[live] = near
            more = np.full(fresh.shape, np.inf, np.float32)
            more[live] = self._gaps(queries[live], near)
            ids, gaps, done = np.hstack([ids, fresh]), np.hstack([gaps, more]), np.hstack([done, fresh < 0])


def _power(x: np.ndarray) -> int:
    """Exponent of two above the largest component."""
    return int(np.frexp(np.abs(x).max(initial=0.0))[1])


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, scaled by a power of two so that squares neither overflow nor vanish."""
    power = max(_power(vectors), _power(query)) + 1
    delta = np.ldexp(vectors, -power) - np.ldexp(query, -power)
    inner = _power(delta)
    return np.ldexp(np.sqrt((np.ldexp(delta, -inner) ** 2).sum(axis=1)), power + inner)


class Shard:
    """A graph over a shard's distinct vectors, with the identifiers and row numbers of each, by identifier."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray) -> None:
        self.vectors, node = np.unique(vectors.astype(np.float64), axis=0, return_inverse=True)
        node = node.reshape(-1)
        order = np.lexsort((rows, ids, node))
        self.ids, self.rows, self.first = ids[order], rows[order], np.searchsorted(node[order], np.arange(len(self.vectors) + 1))
        self.power = _power(self.vectors)
        moved = np.ldexp(self.vectors, -self.power)
        self.centre = moved.mean(axis=0)
        moved -= self.centre
        self.inner = _power(moved)
        self.graph = Graph(np.ldexp(moved, -self.inner), self.rows[self.first[:-1]])

    def _found(self, queries: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Nodes that the graph finds for each query, and which queries are too far away for it."""
        with np.errstate(over="ignore"):
            moved = np.ldexp(np.ldexp(queries, -self.power) - self.centre, -self.inner)
        far = ~(np.abs(moved).max(axis=1, initial=0.0) <= FAR)
        out = [np.empty(0, np.int64)] * len(queries)
        near = np.flatnonzero(~far)
        if len(near):
            for k, nodes in zip(near.tolist(), self.graph.search(moved[near]), strict=True):
                out[k] = nodes[nodes >= 0]
        return out, far

    def _rows_of(self, nodes: np.ndarray, gap: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers and distances of the k nearest rows of the nodes but the query's own, by distance and identifier."""
        places, gaps, have = [], [], 0
        for g in np.unique(gap):  # of a vector's rows the first k + 1 are enough: one may be the query
            here = np.concatenate([np.arange(self.first[n], min(self.first[n + 1], self.first[n] + k + 1)) for n in nodes[gap == g]])
            here = here[self.rows[here] != own]
            places.append(here[np.argsort(self.ids[here], kind="stable")])
            gaps.append(np.full(len(here), g))
            have += len(here)
            if have >= k:
                break
        return (self.ids[np.concatenate(places)[:k]], np.concatenate(gaps)[:k]) if places else (np.empty(0, np.int64), np.empty(0))

    def _exact(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest rows by comparison with all vectors; of each part, only nodes that can be among them are kept."""
        nodes, gaps = np.empty(0, np.int64), np.empty(0)
        for a in range(0, len(self.vectors), EXACT_ROWS):
            nodes = np.concatenate([nodes, np.arange(a, min(a + EXACT_ROWS, len(self.vectors)))])
            gaps = np.concatenate([gaps, distances(self.vectors[a : a + EXACT_ROWS], query)])
            if len(nodes) > k + 1:
                kept = gaps <= np.partition(gaps, k)[k]
                nodes, gaps = nodes[kept], gaps[kept]
        return self._rows_of(nodes, gaps, own, k)

    def nearest(self, query_rows: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Identifiers and distances of each query's k nearest rows found but its own one, by distance and identifier."""
        out, close = [], np.ldexp(CLOSE, self.power + self.inner) * max(queries.shape[1], 1) ** 0.5
        for a in range(0, len(query_rows), QUERY_BLOCK):
            block = queries[a : a + QUERY_BLOCK].astype(np.float64)
            found, far = self._found(block)
            for own, query, nodes, away in zip(query_rows[a : a + QUERY_BLOCK], block, found, far, strict=True):
                if not away:
                    ids, gaps = self._rows_of(nodes, distances(self.vectors[nodes], query), own, k)
                if away or len(ids) < min(k, len(self.rows)) or 0 < gaps[-1] < close:
                    ids, gaps = self._exact(query, own, k)
                out.append((ids, gaps))
        return out


def usable(vector: Column) -> Column:
    """Not null, not zero, no component null or not finite."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(x, lambda v: v != 0)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column("vector")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _query_blocks(path: str, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, identifiers and vectors of queries of one vector length from the shared table, block by block."""
    from pyarrow import fs

    where, inner = filesystem(path)
    for info in sorted(where.get_file_info(fs.FileSelector(inner)), key=lambda i: i.path):
        if info.base_name.endswith(".parquet"):
            with where.open_input_file(info.path) as source:
                for batch in pq.ParquetFile(source).iter_batches(1024, columns=["row", "vec_id", "vector", "width"]):
                    batch = batch.filter(pa.compute.equal(batch.column("width"), width))
                    if batch.num_rows:
                        yield batch.column("row").to_numpy(), batch.column("vec_id").to_numpy(), _matrix(batch)


def nearest_rows(table: DataFrame, key: str, vector: str, queries: Column, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest rows found for each query of the table.

    Null, zero and non-finite vectors, and rows without a key, take no part; vectors of different lengths aren't
    compared. Components may have any finite size: counts and distances hold as long as the distance itself is a double.
    Ties go to the smaller key. A query isn't its own neighbour; other rows that repeat its key or vector are. Queries that repeat a
    key have k answers each. With fewer candidates than k all are given. Groups of equal vectors of any size are one node
    each a shard. An empty table gives an empty result. Other columns aren't read.
    """
    spark = table.sparkSession
    folder = shared_folder(spark)
    rows = table.filter(usable(F.col(vector)) & F.col(key).isNotNull())
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"), F.size(vector).alias("width"), queries.alias("asked"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), folder)
    asked = f"{folder}/queries"
    rows.filter("asked").select("row", "vec_id", "vector", "width").write.parquet(asked)
    shards = _shards(rows)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).select("width", "shard", "vec_id", "row", "vector")
    dealt = dealt.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("width", "shard")  # a task a shard

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answers(parts: list[tuple[np.ndarray, ...]], width: int) -> Iterator[pa.RecordBatch]:
            shard = Shard(*map(np.concatenate, zip(*parts, strict=True)))
            for query_rows, query_ids, block in _query_blocks(asked, width):
                found = shard.nearest(query_rows, block, k)
                sizes = [len(f[0]) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(query_rows, sizes)), pa.array(np.repeat(query_ids, sizes)), pa.array(np.concatenate([f[0] for f in found]), pa.int64()), pa.array(np.concatenate([f[1] for f in found]))],
                    ["row", "query_id", "vec_id", "score"],
                )

        name, parts = None, []
        for b in batches:
            shard_of = np.stack([b.column("width").to_numpy().astype(np.int64), b.column("shard").to_numpy()])
            cuts = [0, *(np.flatnonzero((np.diff(shard_of, axis=1) != 0).any(axis=0)) + 1).tolist(), b.num_rows]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if y == x:
                    continue
                here = tuple(shard_of[:, x].tolist())
                if here != name:
                    if parts:
                        yield from answers(parts, name[0])
                    name, parts = here, []
                part = b.slice(x, y - x)
                parts.append((part.column("vec_id").to_numpy(), part.column("row").to_numpy(), _matrix(part)))
        if parts:
            yield from answers(parts, name[0])

    found = dealt.mapInArrow(trimmed(search), "row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("row").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _shards(rows: DataFrame) -> int:
    """As many shards as there are cores while each has LEAST_SHARD vectors; then they grow up to MOST_SHARD or SHARD_BYTES."""
    n, width = rows.agg(F.count("*"), F.max("width")).first()
    most = min(MOST_SHARD, max(1, SHARD_BYTES // (8 * (width or 1))))
    return max(1, min(-(-n // LEAST_SHARD), rows.sparkSession.sparkContext.defaultParallelism), -(-n // most))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest_rows(table, "vec_id", "embedding", F.col("vec_id") % QUERY_STEP == 0)

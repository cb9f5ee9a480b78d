"""N-gram Jaccard join in size-banded tiles with hashed bitmap signatures.

Texts become sets of hashed word shingles. Sets lie in bands of size, each wider than the one below by 1/threshold, so
that two sets that link are in one band or in neighbouring ones. The keys of tiles are a band and one of the set's first
shingles, in an order that puts those of frequent passages last: two linked sets always share one of these, and a
passage that many documents share makes few tiles.

Equal sets are one representative first. Tiles of the same members are one tile. In a tile, parity bitmaps bound each
overlap from above by their bit counts, and what passes is a candidate; tiles of too many members take all of them as
candidates. Components of candidates are clusters, cut into blocks of neighbouring sizes, and only there are the shingles
themselves compared: exact intersection of sorted arrays settles what the bitmaps pass, and pairs already joined are
left out. Components of different blocks are joined through one member of each, round by round; what is then outside a
cluster's largest component visits the blocks whose sizes allow a link, its size and bitmap first, its shingles only
where these pass. So no link between components is missed, and no block holds more than its own members.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folimetry.llm.components import components
from folimetry.llm.overlaps import Members, parity_bitmap
from folimetry.llm.pieces import by_bytes, trimmed, whole_texts
from folimetry.llm.scratch import free_name, numbered, release, shared_folder, without_rows, written
from folimetry.llm.words import mix, word_hashes, word_spans

#: Shingles that the order of keys puts last (8 bytes each), and documents of a chunk from which they are counted.
HOT_SHINGLES, HOT_IN_CHUNK = 400_000, 3
#: Keys or shingles that a task sorts at once.
CHUNK = 1 << 19
#: Holders of a key in one chunk, and members of a tile, above which all members are candidates without a look at bitmaps.
CHUNK_HOLDERS, TILE_MEMBERS = 64, 4096
#: Shingles of a block; a set counts as BLOCK_SHINGLES / BLOCK_MEMBERS at least.
BLOCK_SHINGLES, BLOCK_MEMBERS = 1 << 20, 1024
#: Rounds in which components of different blocks are joined through one member of each.
JOINING_ROUNDS = 4
SLICE_BYTES = 1 << 19
#: Row ids up to which a list of them is broadcast to a scan of the texts (some 40 bytes each); beyond, the scan shuffles.
BROADCAST_ROWS = 1_000_000
SALTS = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
SET_SCHEMA = "row_id long, doc_id long, n_shingles long, sum_a long, sum_b long, bitmap binary"
KEY_SCHEMA = "key long, u long, v long"
LINK_SCHEMA = "u long, v long"


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text; fewer words than asked for make one shingle of all of them."""
    part, starts, ends, borders = word_spans(texts)
    hashes = word_hashes(part, starts, ends)
    rolled = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        rolled += mix(hashes[k : k + len(rolled)] + np.uint64((int(SALTS[k % 4]) * (k + 1)) % (1 << 64)))
    rolled = mix(rolled)
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        if b - a >= words:
            found = np.sort(rolled[a : b - words + 1])
            new = np.ones(len(found), bool)
            np.not_equal(found[1:], found[:-1], out=new[1:])
            yield found[new]
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                whole = mix(whole * SALTS[3] + hashes[k : k + 1])
            yield whole
        else:
            yield np.empty(0, np.uint64)


class Bands:
    """Bands of set size for links with percent * union <= 100 * intersection."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.lows = [1]

    def _low(self, band: int) -> int:
        while len(self.lows) <= band:
            self.lows.append(self.lows[-1] * 100 // self.percent + 1)
        return self.lows[band]

    def prefixes(self, n: int) -> list[tuple[int, int]]:
        """(band, number of first shingles) of the tiles of a set: its own band and, if a larger partner may lie there, the next.

        Sets of n and m shingles that link share percent * (n + m) / (100 + percent) at least. Two sets that share c of
        them share one among the first n - c + 1 and m - c + 1, for leaving out fewer than c can't leave out all.
        """
        while self.lows[-1] <= n:
            self._low(len(self.lows))
        band = bisect_right(self.lows, n) - 1

        def first(least: int) -> int:
            return n + 1 + -self.percent * (n + least) // (100 + self.percent)

        own = [(band, first(-(-self.percent * n // 100)))]
        above = self._low(band + 1)
        return [*own, (band + 1, first(above))] if n * 100 >= self.percent * above else own

    def keys(self, shingles: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """Keys of a set's tiles, of its first shingles in an order that all sets share: hot ones last, else by hash."""
        prefixes = self.prefixes(len(shingles))
        if len(hot):
            at = np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)
            shingles = shingles[np.argsort(hot[at] == shingles, kind="stable")[: max(k for _, k in prefixes)]]
        return np.concatenate([mix(shingles[:k] + np.uint64((band + 1) << 40)) for band, k in prefixes])


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in by_bytes(batch, "text", SLICE_BYTES):
                sizes, sums_a, sums_b, maps = [], [], [], []
                for s in shingle_sets(whole_texts(b.column("text")), words):
                    sizes.append(len(s))
                    sums_a.append(np.add.reduce(mix(s ^ SALTS[2])) if len(s) else np.uint64(0))
                    sums_b.append(np.add.reduce(mix(s ^ SALTS[3])) if len(s) else np.uint64(0))
                    maps.append(parity_bitmap(s) if len(s) else None)
                sums = [pa.array(_signed(np.array(x, np.uint64))) for x in (sums_a, sums_b)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("row_id"), b.column("doc_id"), pa.array(sizes, pa.int64()), *sums, pa.array(maps, pa.binary())], [f.split()[0] for f in SET_SCHEMA.split(", ")],
                )

    return run


def _local_counts(words: int):
    """Shingles that several documents of a chunk hold."""

    def counted(found: list[np.ndarray]) -> pa.RecordBatch:
        shingle, count = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
        several = count >= HOT_IN_CHUNK
        return pa.RecordBatch.from_arrays([pa.array(_signed(shingle[several])), pa.array(count[several], pa.int64())], ["shingle", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for b in by_bytes(batch, "text", SLICE_BYTES):
                found += list(shingle_sets(whole_texts(b.column("text")), words))
                held += sum(map(len, found[-b.num_rows :]))
                if held > CHUNK:
                    yield counted(found)
                    found, held = [], 0
        yield counted(found)

    return run


def hot_shingles(texts: DataFrame, words: int) -> np.ndarray:
    """The HOT_SHINGLES that most documents hold, sorted; only the order of keys depends on them, never a link."""
    counts = texts.select("text").mapInArrow(trimmed(_local_counts(words)), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "shingle").limit(HOT_SHINGLES).select("shingle").toPandas()
    return np.sort(top["shingle"].to_numpy(np.int64).view(np.uint64))


def _key_batch(key: np.ndarray | None, u: np.ndarray, v: np.ndarray | None, names: str = KEY_SCHEMA) -> pa.RecordBatch:
    columns = [pa.nulls(len(u), pa.int64()) if c is None else pa.array(c, pa.int64()) for c in (key, u, v)]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in names.split(", ")])


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of equal keys."""
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    return first, np.diff(np.append(first, len(key)))


def _held_keys(key: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
    """(key, row, v) of a chunk's keys, v being null; a key that many rows of the chunk hold is one row with v = 1 for its
    first holder, and the others are candidates (no key) of that one."""
    order = np.lexsort((row, key))
    key, row = key[order], row[order]
    first, count = _groups(key)
    many = np.repeat(count > CHUNK_HOLDERS, count)
    leader = np.repeat(row[first], count)
    at = np.zeros(len(key), bool)
    at[first] = True
    links = many & ~at & (row != leader)
    pairs = np.unique(np.stack([row[links], leader[links]]), axis=1) if links.any() else np.empty((2, 0), np.int64)
    kept = ~many | at
    return pa.RecordBatch.from_arrays(
        [
            pa.concat_arrays([pa.nulls(pairs.shape[1], pa.int64()), pa.array(key[kept], pa.int64())]),
            pa.array(np.concatenate([pairs[0], row[kept]]), pa.int64()),
            pa.concat_arrays([pa.array(pairs[1], pa.int64()), pa.array(many[kept].astype(np.int64), pa.int64(), mask=~many[kept])]),
        ],
        ["key", "u", "v"],
    )


def _keys(words: int, percent: int, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, none = Bands(percent), np.empty(0, np.int64)
        keys, rows, held = [none], [none], 0
        for batch in batches:
            for b in by_bytes(batch, "text", SLICE_BYTES):
                found = [_signed(bands.keys(s, hot.value)) if len(s) else none for s in shingle_sets(whole_texts(b.column("text")), words)]
                keys += found
                rows.append(np.repeat(b.column("row_id").to_numpy(), [len(k) for k in found]))
                held += len(rows[-1])
                if held > CHUNK:
                    yield _held_keys(np.concatenate(keys), np.concatenate(rows))
                    keys, rows, held = [none], [none], 0
        yield _held_keys(np.concatenate(keys), np.concatenate(rows))

    return run


class Tiles:
    """Tiles of keys that come in order; the rows of the last key wait for what may follow."""

    def __init__(self) -> None:
        self.key = self.row = self.many = np.empty(0, np.int64)
        self.seen: set[int] = set()

    def add(self, key: np.ndarray, row: np.ndarray, many: np.ndarray, last: bool = False) -> Iterator[pa.RecordBatch]:
        key, row, many = (np.concatenate(x) for x in ((self.key, key), (self.row, row), (self.many, many)))
        new = np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1]))[: len(key)]
        at = np.flatnonzero(new)
        key, row, many = key[at], row[at], np.maximum.reduceat(many, at) if len(at) else many
        done = len(key) if last or not len(key) else int(np.searchsorted(key, key[-1]))
        rest = slice(done, None)
        if len(key) - done > TILE_MEMBERS:  # all join the first, which goes on alone
            yield _key_batch(None, row[done + 1 :], np.full(len(key) - done - 1, row[done]))
            rest, many = slice(done, done + 1), np.ones_like(many)
        self.key, self.row, self.many = key[rest], row[rest], many[rest]
        if done:
            yield from self._ready(key[:done], row[:done], many[:done])

    def _ready(self, key: np.ndarray, row: np.ndarray, many: np.ndarray) -> Iterator[pa.RecordBatch]:
        first, count = _groups(key)
        large = (np.maximum.reduceat(many, first) > 0) | (count > TILE_MEMBERS)
        in_large = np.repeat(large, count)
        in_large[first] = False
        yield _key_batch(None, row[in_large], np.repeat(row[first], count)[in_large])
        name = np.add.reduceat(mix(row.view(np.uint64) ^ SALTS[0]), first) + mix(count.astype(np.uint64))
        tile = np.flatnonzero(~large & (count > 1))
        if len(self.seen) > CHUNK // 2:
            self.seen = set()
        names, at = np.unique(name[tile], return_index=True)
        fresh = [k not in self.seen for k in names.tolist()]
        tile = tile[at[fresh]]
        self.seen.update(name[tile].tolist())
        chosen = np.zeros(len(count), bool)
        chosen[tile] = True
        member = np.repeat(chosen, count)
        yield _key_batch(np.repeat(_signed(name), count)[member], row[member], None)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, u) of every member of tiles with at least two, and candidates (no key) (u, v), from keys in order."""
    tiles, none = Tiles(), np.empty(0, np.int64)
    for b in batches:
        linked = b.column("key").is_null()
        yield b.filter(linked)
        held = b.filter(pc.invert(linked))
        yield from tiles.add(held.column("key").to_numpy(), held.column("u").to_numpy(), pc.fill_null(held.column("v"), 0).to_numpy())
    yield from tiles.add(none, none, none, last=True)


def candidates(texts: DataFrame, sets: DataFrame, words: int, percent: int, folder: str) -> DataFrame:
    """Links (u, v) whose components hold all rows of texts(row_id, text) that link; bitmaps come from sets."""
    hot = texts.sparkSession.sparkContext.broadcast(hot_shingles(texts, words))
    held = texts.select("row_id", "text").mapInArrow(trimmed(_keys(words, percent, hot)), KEY_SCHEMA)
    tiles = written(held.repartition(F.coalesce("key", "u")).sortWithinPartitions("key", "u").mapInArrow(trimmed(_tiles), KEY_SCHEMA), folder)
    members = tiles.filter("key is not null").select(F.col("key").alias("tile"), F.col("u").alias("row_id")).distinct()
    sized = members.join(sets.select("row_id", F.col("n_shingles").alias("n"), "bitmap"), "row_id")
    near = sized.repartition("tile").sortWithinPartitions("tile", "n", "row_id").mapInArrow(trimmed(_links_within(percent, ["tile"], False)), LINK_SCHEMA)
    found = written(near.unionByName(tiles.filter("key is null").select("u", "v")), folder)
    release(tiles)
    return found


def _pairs(u: list[int], v: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _links_within(percent: int, group: list[str], exact: bool):
    """Links inside groups, from rows of (group, n, row_id, bitmap, and shingles if exact) in this order."""
    wanted = [*group, "row_id", "n", "bitmap", *(["shingles"] if exact else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []

        def links() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                rows, sizes, *sets = zip(*held, strict=True)
                pairs = Members(percent, list(sizes), *map(list, sets)).links()
                yield _pairs([rows[i] for i, _ in pairs], [rows[j] for _, j in pairs])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in wanted), strict=True):
                if row[: len(group)] != name:
                    yield from links()
                    name, held = row[: len(group)], []
                held.append(row[len(group) :])
        yield from links()

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """rows(cluster, row_id, n) with their block: neighbouring sizes together, about BLOCK_SHINGLES in each."""
    weight = F.greatest("n", F.lit(BLOCK_SHINGLES // BLOCK_MEMBERS)).cast("long")
    sizes = rows.groupBy("cluster", "n").agg(F.count("*").alias("same"))
    before = F.sum(F.col("same") * weight).over(Window.partitionBy("cluster").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("before", F.coalesce(before, F.lit(0)))
    place = F.col("before") + F.pmod(F.xxhash64("row_id"), F.col("same")) * weight
    return rows.join(sizes, ["cluster", "n"]).select("cluster", F.floor(place / BLOCK_SHINGLES).cast("int").alias("block"), "row_id", "n")


def _arrays(words: int, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in by_bytes(batch, "text", SLICE_BYTES):
                sets = list(shingle_sets(whole_texts(b.column("text")), words))
                arrays = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array([parity_bitmap(s) for s in sets], pa.binary()), arrays], [*kept, "bitmap", "shingles"])

    return run


BLOCK = ["cluster", "block"]


def _inside(members: DataFrame, percent: int) -> DataFrame:
    """Links inside blocks of members(cluster, block, row_id, n, bitmap, shingles)."""
    dealt = members.repartition(*BLOCK).sortWithinPartitions(*BLOCK, "n", "row_id")
    return dealt.mapInArrow(trimmed(_links_within(percent, BLOCK, True)), LINK_SCHEMA)


def _visits(percent: int, exact: bool):
    """From block members and then visitors, both by size: (row_id, block) of visits that bitmaps allow or, if exact, links."""
    wanted = [*BLOCK, "visitor", "row_id", "n", "component", "bitmap", *(["shingles"] if exact else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, block = None, [], None
        for batch in batches:
            u, v = [], []
            for row in zip(*(batch.column(c).to_pylist() for c in wanted), strict=True):
                if row[:2] != name:
                    name, held, block = row[:2], [], None
                if not row[2]:
                    held.append(row[3:])
                    continue
                if block is None:
                    rows, sizes, labels, *sets = zip(*held, strict=True)
                    block, labels = Members(percent, list(sizes), *map(list, sets)), np.array(labels, np.int64)
                joined = {row[5]}
                for k in block.possible(row[4], np.frombuffer(row[6], np.uint64)).tolist():
                    if int(labels[k]) in joined:
                        continue
                    if not exact:
                        u.append(row[3])
                        v.append(row[1])
                        break
                    if block.linked(k, np.frombuffer(row[7], np.uint64)):
                        joined.add(int(labels[k]))
                        u.append(row[3])
                        v.append(rows[k])
            yield _pairs(u, v)

    return run


def _across(members: DataFrame, links: DataFrame, percent: int, folder: str) -> list[DataFrame]:
    """Links between blocks of one cluster, from members(cluster, block, row_id, n, bitmap, shingles) of clusters of several
    blocks and the links inside blocks."""
    found, places = [links], members.select(*BLOCK, "row_id", "n")
    n = places.count()

    def labelled() -> DataFrame:
        parts = components(found[0] if len(found) == 1 else found[0].unionByName(found[1]))
        tagged = places.join(parts.withColumnRenamed("node", "row_id"), "row_id", "left")
        return written(tagged.withColumn("component", F.coalesce("component", "row_id")), folder, n)

    now = labelled()
    for _ in range(JOINING_ROUNDS):
        several = now.groupBy("cluster", "component").agg(F.count("*").alias("size"), F.min_by(F.struct("row_id", "n"), F.xxhash64("row_id")).alias("head")).filter("size > 1")
        heads = written(_dealt(several.select("cluster", "head.row_id", "head.n")), folder, n)
        more = written(_inside(heads.join(members.drop(*BLOCK, "n"), "row_id"), percent), folder)
        joined = more.count()
        found = [found[0], more if len(found) == 1 else found[1].unionByName(more)]
        if not joined:
            break
        release(now)
        now = labelled()
    largest = now.groupBy("cluster", "component").agg(F.count("*").alias("size")).groupBy("cluster")
    largest = largest.agg(F.max_by("component", F.struct("size", "component")).alias("largest"))
    ranges = now.groupBy(*BLOCK).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    calling = now.join(largest, "cluster").filter("component <> largest").select("cluster", F.col("block").alias("home"), "row_id", "n", "component")
    sizes_allow = (F.col("n") * 100 >= F.col("low") * percent) & (F.col("high") * 100 >= F.col("n") * percent)
    calls = written(calling.join(ranges, "cluster").filter((F.col("block") != F.col("home")) & sizes_allow).select(*BLOCK, "row_id", "n", "component"), folder)

    def meetings(calls: DataFrame, blocks: DataFrame, exact: bool) -> DataFrame:
        sets = members.select("row_id", "bitmap", *(["shingles"] if exact else []))
        both = blocks.withColumn("visitor", F.lit(False)).unionByName(calls.withColumn("visitor", F.lit(True)))
        dealt = both.join(sets, "row_id").repartition(*BLOCK).sortWithinPartitions(*BLOCK, "visitor", "n", "row_id")
        return dealt.mapInArrow(trimmed(_visits(percent, exact)), LINK_SCHEMA)

    hosts = now.join(calls.select(*BLOCK).distinct(), BLOCK, "left_semi").select(*BLOCK, "row_id", "n", "component")
    passed = written(meetings(calls, hosts, False).select(F.col("u").alias("row_id"), F.col("v").cast("int").alias("block")), folder)
    let_in = calls.join(passed, ["row_id", "block"], "left_semi")
    hosts = now.join(let_in.select(*BLOCK).distinct(), BLOCK, "left_semi").select(*BLOCK, "row_id", "n", "component")
    return [*found, written(meetings(let_in, hosts, True), folder)]


def ngram_components(docs: DataFrame, words: int = 3, percent: int = 90, row: str | None = None) -> DataFrame:
    """row_id, doc_id, n_shingles, set_rows (rows with an equal set), component and component_id of every row of
    docs(doc_id, text); `component` is a number for the component itself.

    A-Z is lower-cased; words are runs of all but ASCII white space. Two rows link when 100 * intersection >= percent *
    union. component_id is the smallest doc_id that links lead to. Null and blank texts have no shingles and link with
    nothing, not even each other: their component_id is their own doc_id. Null doc_ids are ignored unless a component
    has no other. Repeated rows have equal sets. Texts of any length are used whole. An empty table gives an empty result.
    `row` names a column of docs with row numbers that stay; without it rows are numbered here. Other columns are
    neither read nor returned, whatever their names.
    """
    folder = shared_folder(docs.sparkSession)
    rows = docs.select(F.col(row).alias("row_id"), "doc_id", "text") if row else numbered(docs.select("doc_id", "text"), "row_id")
    rows = rows.select("row_id", F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = written(rows.mapInArrow(trimmed(_sets(words)), SET_SCHEMA), folder)
    equal = ["n_shingles", "sum_a", "sum_b"]
    classes = sets.filter("n_shingles > 0").groupBy(*equal)
    n = sets.count()
    classes = written(classes.agg(F.min("doc_id").alias("least_id"), F.min("row_id").alias("leader"), F.count("*").alias("set_rows")), folder, n)
    copies = written(sets.join(classes.filter("set_rows > 1"), equal).filter("row_id <> leader").select("row_id"), folder, n)
    leaders = rows.select("row_id", "text").join(_listed(copies), "row_id", "left_anti")
    near = candidates(leaders, sets, words, percent, folder)
    clusters = components(near).select(F.col("node").alias("row_id"), F.col("component").alias("cluster"))
    plan = written(_dealt(clusters.join(sets.select("row_id", F.col("n_shingles").cast("int").alias("n")), "row_id")), folder, clusters.count())

    def members(of: DataFrame) -> DataFrame:
        kept = ["row_id", *BLOCK, "n"]
        chosen = rows.select("row_id", "text").join(_listed(of), "row_id").select("text", *kept)
        return chosen.mapInArrow(trimmed(_arrays(words, kept)), "row_id long, cluster long, block int, n int, bitmap binary, shingles binary")

    inside = written(_inside(members(plan), percent), folder)
    wide = written(plan.join(plan.filter("block > 0").select("cluster").distinct(), "cluster", "left_semi"), folder, plan.count())
    links = inside
    if not wide.isEmpty():
        arrays = written(members(wide.select(*BLOCK, "row_id", "n")), folder)
        of_wide = written(inside.join(wide.select(F.col("row_id").alias("u")), "u", "left_semi"), folder)
        links = inside
        for found in _across(arrays, of_wide, percent, folder)[1:]:
            links = links.unionByName(found)
        links = written(links, folder)
        release(arrays)
    linked = components(links)
    joined = classes.select(*equal, "leader", "least_id", "set_rows").join(linked.withColumnRenamed("node", "leader"), "leader", "left")
    joined = written(joined.withColumn("component", F.coalesce("component", "leader")), folder, n)
    labels = joined.groupBy("component").agg(F.min("least_id").alias("component_id"))
    known = written(joined.join(labels, "component").select(*equal, "set_rows", "component", "component_id"), folder, n)
    release(classes, copies, near, plan, inside, wide, joined)
    return sets.select("row_id", "doc_id", *equal).join(known, equal, "left").select(
        "row_id", "doc_id", "n_shingles", F.coalesce("set_rows", F.lit(1)).alias("set_rows"),
        F.coalesce("component", -F.col("row_id") - 1).alias("component"),
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def _listed(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ngram_components(docs).select("doc_id", "n_shingles", "component_id")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingles at a similarity of 0.8 or more, with its columns.

    The one of smallest doc_id stays (null ones after all others), of rows that repeat it the first stored. Documents
    without words all stay. Other columns may have any names; an empty table gives an empty result.
    """
    row = free_name(docs, "__row")
    docs = numbered(docs, row)
    found = ngram_components(docs, words=5, percent=80, row=row)
    keeper = F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")
    found = written(found.select("component", "doc_id", "row_id"))
    kept = found.groupBy("component").agg(F.min(keeper).alias("keeper")).select(F.col("keeper.row_id").alias("row_id"))
    dropped = written(found.join(kept, "row_id", "left_anti").select("row_id"))
    release(found)
    return without_rows(docs, row, dropped, BROADCAST_ROWS)

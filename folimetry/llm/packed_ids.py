"""Token-id files with fixed-width bit packing.

A file holds the ids of documents end to end, each id in the fewest bits the vocabulary needs. Ids are packed in blocks
of BLOCK_IDS that start on whole 64-bit words; a table of block offsets lets a reader unpack any block by itself with
numpy, so that any range of ids can be read without the rest.

Layout, little endian: magic, version, bits, documents, ids, blocks (u64 each); document ids (i64) and a null flag each
(u8); ids before each document and in all (u64); byte offset of each block from the payload's start (u64, and the end);
payload.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folimetry.llm.pieces import Memo, Ragged, by_bytes, row_slices, text_bytes, trimmed, whole_texts
from folimetry.llm.scratch import filesystem, numbered, shared_folder, write_atomically, written

MAGIC = b"FOLIOIDS"
BLOCK_IDS = 1 << 14
END_ID = 2
#: Distinct runs whose ids a worker keeps (some 100 MB).
MEMO_RUNS = 500_000
JOINED_WORDS = 256
SLICE_BYTES = 32 << 20
SLICE_IDS = 1 << 20
HEAD = struct.Struct("<8sIIQQQ")


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """64-bit words; 64 ids fill exactly `bits` words, so each column of 64 has one word and shift."""
    rows = -(-len(ids) // 64)
    table = np.zeros((rows, 64), np.uint64)
    table.reshape(-1)[: len(ids)] = ids
    words = np.zeros((rows, bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        words[:, word] |= table[:, j] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= table[:, j] >> np.uint64(64 - shift)
    return words.reshape(-1)


def unpack(words: np.ndarray, bits: int, count: int) -> np.ndarray:
    """The first `count` ids of packed words."""
    table = words.reshape(-1, bits)
    ids = np.empty((len(table), 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        value = table[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | table[:, word + 1] << np.uint64(64 - shift)
        ids[:, j] = value & mask
    return ids.reshape(-1)[:count]


def file_chunks(doc_ids: list[int | None], lengths: np.ndarray, ids: Iterator[np.ndarray], bits: int) -> Iterator[bytes]:
    """Bytes of one file. `ids`: arrays that together hold all documents' ids."""
    before = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    total = int(before[-1])
    blocks = -(-total // BLOCK_IDS)
    ends = np.minimum(np.arange(blocks + 1, dtype=np.int64) * BLOCK_IDS, total)
    offsets = (-(-ends // 64) * bits * 8).astype("<u8")
    yield HEAD.pack(MAGIC, 1, bits, len(doc_ids), total, blocks)
    yield np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([x is None for x in doc_ids], np.uint8).tobytes()
    yield before.tobytes() + offsets.tobytes()
    held: list[np.ndarray] = []
    have = 0
    for part in ids:
        held.append(part)
        have += len(part)
        if have >= BLOCK_IDS:
            whole = np.concatenate(held)
            cut = have - have % BLOCK_IDS
            yield pack(whole[:cut], bits).astype("<u8").tobytes()
            held, have = [whole[cut:]], have - cut
    if have:
        yield pack(np.concatenate(held), bits).astype("<u8").tobytes()


class PackedFile:
    """Random access to one file through anything with seek and read."""

    def __init__(self, source) -> None:
        self.source = source
        magic, version, self.bits, self.docs, self.ids, self.blocks = HEAD.unpack(self._read(0, HEAD.size))
        if magic != MAGIC or version != 1:
            raise ValueError("not a file of packed ids")
        at = HEAD.size
        self.doc_ids = np.frombuffer(self._read(at, 8 * self.docs), "<i8")
        self.nulls = np.frombuffer(self._read(at := at + 8 * self.docs, self.docs), np.uint8).astype(bool)
        self.before = np.frombuffer(self._read(at := at + self.docs, 8 * (self.docs + 1)), "<u8").astype(np.int64)
        self.offsets = np.frombuffer(self._read(at := at + 8 * (self.docs + 1), 8 * (self.blocks + 1)), "<u8").astype(np.int64)
        self.payload = at + 8 * (self.blocks + 1)

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def read(self, first: int, last: int) -> np.ndarray:
        """Ids [first, last), from the blocks that hold them and no others."""
        if first >= last:
            return np.empty(0, np.uint32)
        a, b = first // BLOCK_IDS, -(-last // BLOCK_IDS)
        words = np.frombuffer(self._read(self.payload + int(self.offsets[a]), int(self.offsets[b] - self.offsets[a])), "<u8")
        return unpack(words, self.bits, min(b * BLOCK_IDS, self.ids) - a * BLOCK_IDS)[first - a * BLOCK_IDS : last - a * BLOCK_IDS]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.before[k]), int(self.before[k + 1]))


LETTER = np.zeros(256, bool)  # bytes of letters in a plain text
LETTER[65:91] = LETTER[97:123] = LETTER[0x80:] = True
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x0A]] = True
ODD = np.zeros(256, bool)  # bytes that no plain text has
ODD[:0x20] = ODD[0x7F] = ODD[0xC0:] = ODD[0x27] = True
ODD[[0x0A, 0xC3]] = False


class ByteLevelEncoder:
    """The tokenizers library with its work done once per distinct run.

    The byte-level pre-tokeniser parts letters from all else, and a single U+0020 starts a piece of its own. So a plain
    text (ASCII and the Latin letters U+00C0 to U+00FF; no apostrophes, control characters or double white space) is
    cut where letters begin or end and before each space, and its ids are those of the runs end to end. Other texts,
    and all that hold an added token such as <|endoftext|>, are encoded whole. Spaced words are handed to the library many at a time: only the first token of each begins with
    the space, so that their ids can be told apart.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.uint16 if self.vocabulary <= 1 << 16 else np.uint32
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(self.vocabulary)])
        self.memo = Memo(self._runs, MEMO_RUNS)

    def _library(self, texts: list[str]) -> list[bytes]:
        encode = self.tokenizer.encode_batch_fast
        return [array(np.dtype(self.kind).char, e.ids).tobytes() for e in encode(texts, add_special_tokens=False)]

    def _runs(self, runs: list[str]) -> list[bytes]:
        known: dict[str, bytes] = {}
        spaced = [r for r in runs if r[0] == " " and r[1:2].isalpha()]
        groups = [spaced[i : i + JOINED_WORDS] for i in range(0, len(spaced), JOINED_WORDS)]
        groups = [g for g in groups if not self._holds_added("".join(g))]
        for group, ids in zip(groups, self._library(["".join(g) for g in groups]), strict=True):
            at = np.flatnonzero(self.opens[np.frombuffer(ids, self.kind)]) * np.dtype(self.kind).itemsize
            if len(at) == len(group):
                ends = [*at[1:].tolist(), len(ids)]
                known.update((w, ids[x:y]) for w, x, y in zip(group, at.tolist(), ends, strict=True))
        rest = [r for r in runs if r not in known]
        known.update(zip(rest, self._library(rest), strict=True))
        return [known[r] for r in runs]

    def _holds_added(self, text: str) -> bool:
        return any(token in text for token in self.added)

    def plain(self, texts: pa.Array) -> np.ndarray:
        borders, data = text_bytes(texts)
        part = data[borders[0] : borders[-1]]
        odd, space = ODD[part], SPACE[part]
        odd[1:] |= space[1:] & space[:-1]
        odd[1:] |= (part[:-1] == 0xC3) & ((part[1:] == 0x97) | (part[1:] == 0xB7))
        fine = np.ones(len(texts), bool)
        fine[np.searchsorted(borders, np.flatnonzero(odd) + borders[0], "right") - 1] = False
        for token in self.added:
            fine &= ~pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        return fine

    def _plain_rows(self, texts: pa.Array) -> Iterator[np.ndarray]:
        borders, data = text_bytes(texts)
        part = data[borders[0] : borders[-1]]
        letter, space = LETTER[part], part == 0x20
        start = space.copy()
        start[1:] |= letter[1:] & ~letter[:-1] & ~space[:-1]
        start[1:] |= ~letter[1:] & letter[:-1]
        start[(borders[:-1] - borders[0])[np.diff(borders) > 0]] = True
        starts = np.append(np.flatnonzero(start) + borders[0], borders[-1])
        runs = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), texts.buffers()[2]).dictionary_encode()
        at, firsts = runs.indices.to_numpy(), np.searchsorted(starts, borders)
        ids = Ragged(self.memo(runs.dictionary.to_pylist()), self.kind)
        for a, b in row_slices(firsts, SLICE_IDS // 4):
            here = at[firsts[a] : firsts[b]]
            flat = ids.gather(here)
            ends = np.concatenate([[0], np.cumsum(ids.size[here])])[firsts[a : b + 1] - firsts[a]]
            for x, y in zip(ends[:-1], ends[1:], strict=True):
                yield flat[x:y]

    def rows(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a large_string array without nulls, in order."""
        if not len(texts):
            return
        fine = self.plain(texts)
        if fine.all():
            yield from self._plain_rows(texts)
            return
        cut = self._plain_rows(texts.filter(pa.array(fine))) if fine.any() else iter(())
        whole = iter(self._library(texts.filter(pa.array(~fine)).to_pylist()))
        for ok in fine:
            yield next(cut) if ok else np.frombuffer(next(whole), self.kind)


_ENCODERS: dict[str, ByteLevelEncoder] = {}


def encoder(path: str) -> ByteLevelEncoder:
    """One a worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteLevelEncoder(path)
    return _ENCODERS[path]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """One file a partition of docs(doc_id, text) ranged by doc_id; returns (part, path, documents, ids), a row a file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part = encoder(tokenizer), TaskContext.get().partitionId()
        bits = bits_for(max(tool.vocabulary, end_id + 1))
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []  # ids in the tokenizer's width: a partition's ids, about its text's size at most
        end = np.array([end_id], tool.kind)
        for batch in batches:
            for b in by_bytes(batch, "text", SLICE_BYTES):
                doc_ids += b.column("doc_id").to_pylist()
                rows = []
                for ids in tool.rows(whole_texts(b.column("text"))):
                    lengths.append(len(ids) + 1)
                    rows += [ids, end]
                parts.append(np.concatenate(rows))
        path = f"{folder}/ids-{part:06d}.bin"
        write_atomically(path, file_chunks(doc_ids, np.array(lengths, np.int64), iter(parts), bits))
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "documents": [len(doc_ids)], "ids": [sum(lengths)]}, pa.schema([("part", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))

    return docs.mapInArrow(trimmed(write), "part int, path string, documents long, ids long")


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of files(path, first_id), block range by block range."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first_id").to_pylist(), strict=True):
                where, inner = filesystem(path)
                with where.open_input_file(inner) as source:
                    file = PackedFile(source)
                    sums = []
                    for a, b in row_slices(file.before, SLICE_IDS):
                        ids = file.read(int(file.before[a]), int(file.before[b])).astype("<u4")
                        at = file.before[a : b + 1] - file.before[a]
                        sums += [zlib.crc32(ids[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(file.doc_ids, pa.int64(), mask=file.nulls), pa.array(file.before[:-1] + first), pa.array(np.diff(file.before)), pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return files.select("path", "first_id").mapInArrow(trimmed(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def packed_documents(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write docs(doc_id, text) to files in ascending doc_id order and read them back.

    Null texts count as empty and hold the end id alone. Null doc_ids come first; rows of equal doc_id stand next to each
    other, as they are stored. Each row is a document, repeated ones too. An empty table gives an empty result. Texts of any
    length are encoded whole. Other columns aren't read.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    texts = docs.select("doc_id", "text")
    rows = numbered(texts, "row")  # rows of one doc_id needn't be one file
    ranged = rows.repartitionByRange(_parts(spark, texts), "doc_id", "row").sortWithinPartitions("doc_id", "row").drop("row")
    files = written(write_token_files(ranged, folder, tokenizer, end_id), folder + "-files")
    first, starts = 0, []
    for row in files.orderBy("part").collect():  # a row a file
        starts.append((row.path, first))
        first += row.ids
    plan = spark.createDataFrame(starts, "path string, first_id long").repartition(max(1, len(starts)), "path") if starts else spark.createDataFrame([], "path string, first_id long")
    return read_token_files(plan)


#: Bytes of a scan, as the planner sees it, that make a file.
PART_BYTES = 32 << 20


def _parts(spark: SparkSession, docs: DataFrame) -> int:
    """Partitions of about PART_BYTES of docs' scan, where the planner knows its size, as many as the session shuffles into
    at least."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES) if size < 1 << 55 else 1)


def op8_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))

"""SentencePiece encoding and decoding of merge-type (BPE) models.

Encoding keeps, for each prefix of a chunk, the one token that its encoding ends with. An automaton over all pieces yields
the tokens that end at a position; of these exactly one fits the last token of the prefix before it, in that the merge
order would leave the two side by side. The ids are recovered from the end backwards. That takes time linear in the
chunk, and no merging is replayed.

Chunks are parts between which the model can never merge: it has no piece that holds both characters of the border.
Each distinct chunk is encoded once a worker while its memo has room.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folimetry.llm.pieces import Memo, Ragged, by_bytes, row_slices, text_bytes, trimmed, whole_texts
from folimetry.llm.scratch import by_name, by_place, free_name, quoted

SPACE = "▁"
#: Distinct chunks whose ids a worker keeps (some 30 MB).
MEMO_CHUNKS = 150_000
#: Answers of the pair test that a worker keeps.
MEMO_PAIRS = 300_000
SLICE_BYTES = 1 << 20
SLICE_IDS = 1 << 18
NEVER = float("inf")
#: Characters of one or two bytes; texts of these alone are cut into chunks with numpy.
NARROW = 0x800


def merged_by_rank(text: str, rank: dict[str, float]) -> list[str]:
    """Merging replayed: the pair whose union ranks first, of equal ones the leftmost, until none is a piece."""
    left, right = [i - 1 for i in range(len(text))], [i + 1 for i in range(len(text))]
    part: list[str | None] = list(text)
    queue = [(rank[text[i : i + 2]], i, text[i : i + 2]) for i in range(len(text) - 1) if text[i : i + 2] in rank]
    heapify(queue)
    while queue:
        _, i, union = heappop(queue)
        j = right[i] if part[i] is not None else len(text)
        if j >= len(text) or part[j] is None or part[i] + part[j] != union:
            continue
        part[i], part[j], right[i] = union, None, right[j]
        if right[j] < len(text):
            left[right[j]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if 0 <= a and b < len(text) and (whole := part[a] + part[b]) in rank:
                heappush(queue, (rank[whole], a, whole))
    return [x for x in part if x is not None]


class PieceModel:
    """Pieces, ranks and tables of one model file; everything is read through the library's own accessors."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.begin, self.end = sp.get_piece_size(), sp.bos_id(), sp.eos_id()
        pieces = [sp.id_to_piece(i) for i in range(self.size)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(self.size)]
        _require_plain(sp)
        self.ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        self.rank = {p: -sp.get_score(i) for p, i in self.ids.items() if len(p) > 1}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.inner = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self._parts: dict[str, tuple[str, str] | None] = {}
        self._pairs: dict[int, bool] = {}
        self._edges: dict[tuple[str, bool], list[tuple[str, float, float]] | None] = {}
        self.pieces = pieces
        self.unknown = frozenset(i for i in range(self.size) if sp.is_unknown(i))
        self.byte_set = frozenset(self.byte_ids)
        self.text_of = self._texts(sp, pieces)
        self.texts = Ragged(self.text_of, np.uint8)
        self.may_join = self._joins()
        self._automaton = self._build()
        self.chunks = Memo(lambda chunks: [np.array(self.encode_chunk(c.replace(" ", SPACE)), "<u4").tobytes() for c in chunks], MEMO_CHUNKS)

    def _joins(self) -> np.ndarray:
        """For characters below NARROW, with U+0020 for U+2581: does some piece hold the two side by side?"""
        table = np.zeros((NARROW, NARROW), bool)
        for two in self.inner:
            a, b = (0x20 if c == SPACE else ord(c) for c in two)
            if a < NARROW and b < NARROW:
                table[a, b] = True
        return table

    def _texts(self, sp, pieces: list[str]) -> list[bytes]:
        out = []
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                out.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i):
                out.append(b"")
            else:
                out.append((sp.decode([self.begin, i]) if sp.is_unknown(i) else p.replace(SPACE, " ")).encode())
        return out

    def _build(self):
        """Automaton over the pieces that merging can make; each match gives (id, characters)."""
        import ahocorasick

        made = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if len(p) == 1 or merged_by_rank(p, self._within(p)) == [p]:
                made.add_word(p, (i, len(p)))
        made.make_automaton()
        return made

    # --- compatibility of neighbouring tokens

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two tokens whose merge makes a piece; None for characters and for pieces that merging never makes."""
        if piece not in self._parts:
            halves = None
            if len(piece) > 1:
                without = {k: v for k, v in self._within(piece).items() if k != piece}
                last = merged_by_rank(piece, without)
                halves = (last[0], last[1]) if len(last) == 2 and merged_by_rank(piece, self._within(piece)) == [piece] else None
            self._parts[piece] = halves
        return self._parts[piece]

    def _within(self, text: str) -> dict[str, float]:
        n = len(text)
        return {s: self.rank[s] for i in range(n) for j in range(i + 2, n + 1) if (s := text[i:j]) in self.rank}

    def _edge(self, piece: str, last: bool) -> list[tuple[str, float, float]] | None:
        """Tokens that stand at one end of a piece while it is merged, with the ranks of the merges that make and absorb
        each; None if a later merge ranks before an earlier one, so that ranks don't tell the order."""
        key = (piece, last)
        if key not in self._edges:
            at, absorbed, out = piece, NEVER, []
            while True:
                made = self.rank.get(at, -NEVER) if len(at) > 1 else -NEVER
                if made >= absorbed:
                    out = None
                    break
                out.append((at, made, absorbed))
                halves = self._halves(at)
                if halves is None:
                    if len(at) > 1:
                        out = None
                    break
                other = halves[0] if last else halves[1]
                if len(other) > 1 and self.rank[other] >= made:
                    out = None
                    break
                at, absorbed = halves[1] if last else halves[0], made
            self._edges[key] = out
        return self._edges[key]

    def fits(self, first: int, second: int) -> bool:
        """Would merging the joint text leave exactly these two tokens?"""
        known = self._fits(self.pieces[first], self.pieces[second])
        if len(self._pairs) < MEMO_PAIRS:
            self._pairs[first * self.size + second] = known
        return known

    def _fits(self, first: str, second: str) -> bool:
        ends, starts = self._edge(first, True), self._edge(second, False)
        if ends is None or starts is None:
            return merged_by_rank(first + second, self._within(first + second)) == [first, second]
        if first[-1] + second[0] not in self.inner:
            return True
        rank = self.rank
        for a, made_a, gone_a in ends:
            for b, made_b, gone_b in starts:
                across = rank.get(a + b)
                if across is None or made_a >= gone_b or made_b > gone_a:
                    continue
                # The union merges as soon as both stand there and its rank comes up. The merge that absorbs `a` lies
                # further left and wins a tie; the one that absorbs `b` lies further right and loses it.
                when = max(across, made_a, made_b)
                if across < gone_a and across <= gone_b and when < gone_a and when <= gone_b:
                    return False
        return True

    # --- encoding

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a chunk that has its spaces as U+2581, by the prefix table."""
        n = len(chunk)
        if n == 1:
            return [self.ids[chunk]] if chunk in self.ids else [self.byte_ids[b] for b in chunk.encode()]
        last = [-1] * (n + 1)
        pairs, size = self._pairs, self.size
        for at, (token, length) in self._automaton.iter(chunk):
            end = at + 1
            if last[end] >= 0:
                continue
            if length == end:
                last[end] = token
                continue
            before = last[end - length]
            if before >= 0:
                fits = pairs.get(before * size + token)
                if self.fits(before, token) if fits is None else fits:
                    last[end] = token
        out: list[int] = []
        while n > 0 and last[n] >= 0:
            out.append(last[n])
            n -= len(self.pieces[last[n]])
        if n:  # only in a model that lacks a character of its own pieces
            return [i for p in merged_by_rank(chunk, self.rank) for i in ([self.ids[p]] if p in self.ids else [self.byte_ids[b] for b in p.encode()])]
        return out[::-1]

    def _narrow_rows(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of texts that hold no character of three bytes or more."""
        texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        borders, data = text_bytes(texts)
        part = data[borders[0] : borders[-1]]
        at = np.flatnonzero((part & 0xC0) != 0x80)
        value = part[at].astype(np.int32)
        wide = np.flatnonzero(value >= 0xC0)
        value[wide] = (value[wide] & 31) << 6 | (part[at[wide] + 1] & 63)
        cut = np.ones(len(at), bool)
        cut[1:] = ~self.may_join.reshape(-1)[value[:-1] * NARROW + value[1:]]
        cut[np.searchsorted(at, (borders[:-1] - borders[0])[np.diff(borders) > 0])] = True
        starts = np.append(at[cut] + borders[0], borders[-1])
        chunks = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), texts.buffers()[2]).dictionary_encode()
        number, firsts = chunks.indices.to_numpy(), np.searchsorted(starts, borders)
        ids = Ragged(self.chunks(chunks.dictionary.to_pylist()), np.dtype("<u4"))
        for a, b in row_slices(firsts, SLICE_IDS // 4):
            here = number[firsts[a] : firsts[b]]
            flat = ids.gather(here)
            ends = np.concatenate([[0], np.cumsum(ids.size[here])])[firsts[a : b + 1] - firsts[a]]
            for x, y in zip(ends[:-1], ends[1:], strict=True):
                yield flat[x:y]

    def rows(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a large_string array without nulls, without begin and end ids."""
        if not len(texts):
            return
        borders, data = text_bytes(texts)
        narrow = np.ones(len(texts), bool)
        narrow[np.searchsorted(borders, np.flatnonzero(data[borders[0] : borders[-1]] >= 0xE0) + borders[0], "right") - 1] = False
        rest = iter(texts.filter(pa.array(~narrow)).to_pylist())
        cut = self._narrow_rows(texts.filter(pa.array(narrow))) if narrow.any() else iter(())
        for ok in narrow:
            yield next(cut) if ok else self.encode(next(rest))

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text of any make. A text that isn't empty gets one space in front."""
        if not text:
            return np.empty(0, "<u4")
        full, inner = SPACE + text.replace(" ", SPACE), self.inner
        cuts = [0, *[i for i in range(1, len(full)) if full[i - 1 : i + 1] not in inner], len(full)]
        return np.frombuffer(b"".join(self.chunks([full[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])), "<u4")

    # --- decoding

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the ids' text: pieces and bytes end to end, without the space that encoding put in front."""
        out = self.texts.gather(ids).tobytes()
        try:
            out.decode()
        except UnicodeDecodeError:
            out = self._mended(ids)
        first = next((i for i in map(int, ids) if i not in (self.begin, self.end)), None)
        return out[1:] if first is not None and self.pieces[first][0] == SPACE else out

    def _mended(self, ids: np.ndarray) -> bytes:
        """Runs of byte ids that aren't UTF-8 get U+FFFD for each byte that can't be read."""
        out, run = [], b""
        for i in [*ids.tolist(), -1]:
            if i in self.byte_set:
                run += self.text_of[i]
                continue
            while run:
                for n in (4, 3, 2, 1):
                    try:
                        good = run[:n].decode()
                    except UnicodeDecodeError:
                        continue
                    if len(good) == 1:
                        out.append(run[: len(good.encode())])
                        run = run[len(good.encode()) :]
                        break
                else:
                    out.append("�".encode())
                    run = run[1:]
            if i >= 0:
                out.append(self.text_of[i])
        return b"".join(out)


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield key >> 3, data[at : at + size]
        at += size


def _require_plain(sp) -> None:
    """Models this operator can encode: BPE with byte fallback, identity normalisation, a space put in front, none removed."""
    model = dict(x for x in _fields(sp.serialized_model_proto()) if x[0] in (2, 3))
    trainer, normaliser = dict(_fields(model[2])), dict(_fields(model[3]))
    fine = trainer.get(3) == 2 and trainer.get(35) == 1 and not trainer.get(24)
    fine = fine and not normaliser.get(2) and normaliser.get(3, 1) == 1 and normaliser.get(4, 1) == 0 and normaliser.get(5, 1) == 1
    if not fine:
        raise ValueError("this operator reads BPE models with byte fallback and identity normalisation")


_MODELS: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """One a worker process."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_texts(docs: DataFrame, model: str, digests: bool = False) -> DataFrame:
    """The columns of docs but its texts, with n_tokens, ids (array of int, begin and end ids included) and decoded text of
    every row; with `digests`, n_tokens, ids_sha256 and decoded_sha256 instead.

    Null texts count as empty: two ids, empty decoded text. Texts of any length are encoded whole; equal texts have equal
    ids; repeated rows are rows of their own; an empty table gives an empty result. Columns of docs keep their names: where
    one has the name of a result, the result's name begins with an underscore.
    """
    others = docs.select(*(F.col(quoted(c)) for c in docs.columns if c != "text"))
    rows = by_place(docs.select(*(F.col(quoted(c)) for c in others.columns), F.col("text")))
    places, text = rows.columns[:-1], rows.columns[-1]
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    kinds = [pa.int64(), pa.string(), pa.string()] if digests else [pa.int64(), pa.list_(pa.int32()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = piece_model(model)
        begin, end = np.array([tool.begin], "<u4"), np.array([tool.end], "<u4")
        for batch in batches:
            for b in by_bytes(batch, text, SLICE_BYTES):
                made: list[list] = [[] for _ in names]
                for inner in tool.rows(whole_texts(b.column(text))):
                    ids = np.concatenate([begin, inner, end])
                    back = tool.decode(ids)
                    if digests:
                        row = (len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest())
                    else:
                        row = (len(ids), ids.astype(np.int32), back.decode())
                    for out, x in zip(made, row, strict=True):
                        out.append(x)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in places), *map(pa.array, made, kinds)], [*places, *names])

    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[:-1])
    tail = ", ".join(f"{n} {k}" for n, k in zip(names, ("long", "string", "string") if digests else ("long", "array<int>", "string"), strict=True))
    return by_name(rows.mapInArrow(trimmed(run), head + tail), others.columns, *(F.col(n).alias(free_name(others, n)) for n in names))


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), digests=True)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of the documents but their texts, with n_tokens, ids and decoded text; defined as in encode_texts."""
    import public_tokenizers

    return encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"))

"""Image files as pixels: PNG, BMP and PPM families decoded to red, green and blue bytes in tasks, and PNG written.

Spark's readers bring the files' bytes, from any store and split by size; a file that can't be read becomes a row with an
error, never a failed task.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folimetry.sources.files import load_images

# Signature of PNG, and channels of its colour types.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: First column and row, and steps, of the passes of an interlaced PNG.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: Images with more pixels are an error: a small file may claim any size.
LARGEST = 1 << 28
#: Bytes of pixels that are passed on at once (or one image).
SENT_BYTES = 16 << 20


def _rgb(values: np.ndarray) -> np.ndarray:
    """Grey, grey with alpha, colour or colour with alpha as (height, width, 3) bytes; alpha is left out."""
    return values[:, :, :3] if values.shape[2] >= 3 else np.repeat(values[:, :, :1], 3, axis=2)


def _sized(width: int, height: int) -> None:
    if width < 1 or height < 1 or width * height > LARGEST:
        raise ValueError(f"size {width} x {height}")


# --- PNG


def _unpredicted(kinds: np.ndarray, coded: np.ndarray) -> np.ndarray:
    """Rows of (height, units, bytes a unit) from their differences to the unit on the left, above and above left.

    Where only the left or the row above counts, a row is a running sum. Else all rows go in step, each a unit behind the
    one above: what a unit needs is then there.
    """
    h, n, unit = coded.shape
    if kinds.max(initial=0) > 4:
        raise ValueError(f"row predictor {kinds.max()}")
    if not np.isin(kinds, (3, 4)).any():
        out = np.zeros((h, n, unit), np.uint8)
        above = np.zeros((n, unit), np.uint8)
        for y in range(h):
            row = np.cumsum(coded[y], axis=0, dtype=np.uint8) if kinds[y] == 1 else coded[y]
            out[y] = above = row + above if kinds[y] == 2 else row
        return out
    known = np.zeros((h + 1, n + 1, unit), np.int16)  # with an empty row above and an empty column on the left
    kind = kinds[:, None]
    for t in range(h + n - 1):
        y = np.arange(max(0, t - n + 1), min(h - 1, t) + 1)
        x = t - y
        left, above, corner, k = known[y + 1, x], known[y, x + 1], known[y, x], kind[y]
        by_left, by_above, by_corner = np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)
        nearest = np.where((by_left <= by_above) & (by_left <= by_corner), left, np.where(by_above <= by_corner, above, corner))
        guess = np.select([k == 0, k == 1, k == 2, k == 3], [0, left, above, (left + above) >> 1], nearest)
        known[y + 1, x + 1] = (coded[y, x] + guess) & 255
    return known[1:, 1:].astype(np.uint8)


def _samples(data: np.ndarray, at: int, width: int, height: int, channels: int, depth: int) -> tuple[np.ndarray, int]:
    """(height, width, channels) values from predicted rows, and where they end."""
    line = -(-width * channels * depth // 8)
    if not width or not height:
        return np.zeros((height, width, channels), np.uint16), at
    end = at + height * (line + 1)
    if len(data) < end:
        raise ValueError("pixels are missing")
    rows = data[at:end].reshape(height, line + 1)
    unit = max(1, channels * depth // 8)
    plain = _unpredicted(rows[:, 0], rows[:, 1:].reshape(height, line // unit, unit)).reshape(height, line)
    if depth == 16:
        return plain.view(">u2").reshape(height, width, channels).astype(np.uint16), end
    if depth < 8:
        bits = np.unpackbits(plain, axis=1)[:, : width * channels * depth].reshape(height, -1, depth)
        plain = bits @ (1 << np.arange(depth - 1, -1, -1))
    return plain.reshape(height, width, channels).astype(np.uint16), end


def _png(data: bytes) -> np.ndarray:
    at, head, palette, packed = 8, None, None, []
    while True:
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(name + body):
            raise ValueError(f"checksum of {name.decode('latin1')}")
        at += 12 + size
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            packed.append(body)
        elif name == b"IEND":
            break
    width, height, depth, colour, _, _, interlaced = head
    _sized(width, height)
    channels = CHANNELS[colour]
    most = (height + 7 * 8) * (-(-width * channels * depth // 8) + 9)
    values = np.frombuffer(zlib.decompressobj().decompress(b"".join(packed), most), np.uint8)
    out, at = np.zeros((height, width, channels), np.uint16), 0
    for left, top, step_x, step_y in PASSES if interlaced else ((0, 0, 1, 1),):
        part = out[top::step_y, left::step_x]
        part[:], at = _samples(values, at, part.shape[1], part.shape[0], channels, depth)
    if colour == 3:
        if palette is None or out.max(initial=0) >= len(palette):
            raise ValueError("a colour isn't in the palette")
        return palette[out[:, :, 0]]
    return _rgb((out >> 8 if depth == 16 else out * (255 // ((1 << depth) - 1))).astype(np.uint8))


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG file of (height, width, 3) bytes, rows as differences to the row above."""
    height, width = pixels.shape[:2]
    _sized(width, height)
    lines = pixels.reshape(height, -1)
    change = lines.copy()
    change[1:] -= lines[:-1]
    body = np.hstack([np.full((height, 1), 2, np.uint8), change]).tobytes()

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


# --- BMP


def _masked(values: np.ndarray, mask: int) -> np.ndarray:
    """The bits of a mask, stretched to a byte."""
    if not mask:
        return np.zeros(values.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    return (((values & mask) >> low).astype(np.uint64) * 255 // (mask >> low)).astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    start, size = struct.unpack("<I", data[10:14])[0], struct.unpack("<I", data[14:18])[0]
    if size == 12:
        width, height, _, bits = struct.unpack("<HHHH", data[18:26])
        packing, colours, entry = 0, 0, 3
    else:
        width, height, _, bits, packing = struct.unpack("<iiHHI", data[18:34])
        colours, entry = struct.unpack("<I", data[46:50])[0], 4
    down, height = height < 0, abs(height)
    _sized(width, height)
    if packing not in (0, 3) or bits not in (1, 4, 8, 16, 24, 32):
        raise ValueError(f"packing {packing} of {bits} bits")
    line = (width * bits + 31) // 32 * 4
    if len(data) < start + line * height:
        raise ValueError("pixels are missing")
    rows = np.frombuffer(data, np.uint8, line * height, start).reshape(height, line)
    rows = rows if down else rows[::-1]
    if bits == 24:
        return rows[:, : width * 3].reshape(height, width, 3)[:, :, ::-1]
    if bits in (16, 32):
        values = np.ascontiguousarray(rows).view(f"<u{bits // 8}")[:, :width].astype(np.uint32)
        masks = struct.unpack("<III", data[54:66]) if packing == 3 else (0x7C00, 0x3E0, 0x1F) if bits == 16 else (0xFF0000, 0xFF00, 0xFF)
        return np.stack([_masked(values, m) for m in masks], axis=2)
    count = colours or 1 << bits
    palette = np.frombuffer(data, np.uint8, count * entry, 14 + size).reshape(count, entry)[:, 2::-1]
    places = np.unpackbits(rows, axis=1).reshape(height, -1, bits) @ (1 << np.arange(bits - 1, -1, -1))
    if places[:, :width].max() >= count:
        raise ValueError("a colour isn't in the palette")
    return palette[places[:, :width]]


# --- PPM, PGM and PBM


def _ppm(data: bytes) -> np.ndarray:
    kind = data[1:2].decode()
    wanted, at, numbers = 2 if kind in "14" else 3, 2, []
    while len(numbers) < wanted:
        m = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)").match(data, at)
        if not m:
            raise ValueError("no size")
        numbers.append(int(m[1]))
        at = m.end()
    width, height, most = (*numbers, 1)[:3]
    _sized(width, height)
    if not 1 <= most < 1 << 16:
        raise ValueError(f"largest value {most}")
    channels = 3 if kind in "36" else 1
    count = width * height * channels
    if kind in "123":
        words = re.sub(rb"#[^\n]*", b"", data[at:])
        values = np.array(re.findall(rb"[01]" if kind == "1" else rb"\d+", words)[:count], np.int64)
    elif kind == "4":
        line = -(-width // 8)
        values = np.unpackbits(np.frombuffer(data, np.uint8, line * height, at + 1).reshape(height, line), axis=1)[:, :width].reshape(-1)
    else:
        values = np.frombuffer(data, ">u2" if most > 255 else np.uint8, count, at + 1)
    if len(values) < count:
        raise ValueError("pixels are missing")
    values = values.astype(np.int64)
    values = (1 - values) * 255 if kind in "14" else np.minimum(values, most) * 255 // most
    return _rgb(values.reshape(height, width, channels).astype(np.uint8))


def decoded(data: bytes | None) -> tuple[np.ndarray | None, str | None]:
    """(height, width, 3) bytes, or what is wrong."""
    try:
        if not data:
            return None, "empty"
        if data.startswith(SIGNATURE):
            return _png(data), None
        if data.startswith(b"BM"):
            return _bmp(data), None
        if re.match(rb"P[1-6][\s#]", data):
            return _ppm(data), None
        return None, "not a PNG, BMP or PPM file"
    except (ValueError, KeyError, IndexError, TypeError, struct.error, zlib.error) as wrong:
        return None, f"{type(wrong).__name__}: {wrong}"


def decode_images(files: DataFrame, content: str = "content") -> DataFrame:
    """The columns of `files` but `content`, with width, height, pixels (rows of red, green and blue bytes) and error.

    Grey images have three equal channels, alpha is left out, 16-bit values keep their higher byte. What isn't a PNG, BMP or
    PPM file, is cut off, has a wrong checksum or claims more than LARGEST pixels, and null or empty content, has null
    pixels and an error. An empty table gives an empty result.
    """
    others = [c for c in files.columns if c != content]
    clash = {"width", "height", "pixels", "error"} & {c.lower() for c in others}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are in the way")
    rows = files.select(*(F.col(f"`{c}`") for c in others), F.col(content).cast("binary").alias(content))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(batch: pa.RecordBatch, a: int, images: list) -> pa.RecordBatch:
            part = batch.slice(a, len(images))
            columns = [
                pa.array([None if p is None else p.shape[1] for p, _ in images], pa.int32()), pa.array([None if p is None else p.shape[0] for p, _ in images], pa.int32()),
                pa.array([None if p is None else p.tobytes() for p, _ in images], pa.binary()), pa.array([e for _, e in images], pa.string()),
            ]
            return pa.RecordBatch.from_arrays([*(part.column(c) for c in others), *columns], [*others, "width", "height", "pixels", "error"])

        for batch in batches:
            a, images = 0, []
            for k in range(batch.num_rows):
                images.append(decoded(batch.column(content)[k].as_py()))
                if sum(0 if p is None else p.size for p, _ in images) >= SENT_BYTES:
                    yield made(batch, a, images)
                    a, images = k + 1, []
            if images:
                yield made(batch, a, images)

    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[:-1])
    return rows.mapInArrow(run, f"{head}width int, height int, pixels binary, error string")


def load_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """(path, width, height, pixels, error) of the image files below a folder."""
    return decode_images(load_images(spark, folder))

"""Image files: every kind against pixels that it was written from."""

import random
import struct
import zlib

import numpy as np
import pytest

from folimetry.sources import images

RNG = np.random.default_rng(9)


def predicted(kind, rows, unit):
    """Rows of bytes as differences, each by its own predictor, unit by unit."""
    out = []
    for y, row in enumerate(rows):
        k, line = kind(y), bytearray()
        for i, v in enumerate(row):
            a = int(row[i - unit]) if i >= unit else 0
            b = int(rows[y - 1][i]) if y else 0
            c = int(rows[y - 1][i - unit]) if y and i >= unit else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((int(v) - (0, a, b, (a + b) // 2, near)[k]) % 256)
        out.append(bytes([k]) + bytes(line))
    return b"".join(out)


def chunk(name, data):
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def png(values, depth, colour, palette=None, interlaced=False, kind=lambda y: y % 5):
    h, w, c = values.shape
    parts = [(0, 0, 1, 1)] if not interlaced else images.PASSES
    body = b""
    for x, y, sx, sy in parts:
        v = values[y::sy, x::sx]
        if v.size:
            bits = ((v.reshape(len(v), -1, 1) >> np.arange(depth - 1, -1, -1)) & 1).reshape(len(v), -1).astype(np.uint8)
            body += predicted(kind, np.packbits(bits, axis=1), max(1, c * depth // 8))
    data = zlib.compress(body)
    plte = chunk(b"PLTE", palette.tobytes()) if palette is not None else b""
    return images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, int(interlaced))) + plte + chunk(b"tEXt", b"a\0b") + chunk(b"IDAT", data[:5]) + chunk(b"IDAT", data[5:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize(("depth", "colour"), [(8, 2), (8, 0), (8, 6), (8, 4), (16, 2), (16, 0), (1, 0), (2, 0), (4, 0), (1, 3), (4, 3), (8, 3)])
def test_png_of_every_kind(depth, colour, interlaced):
    for h, w in ((1, 1), (7, 5), (13, 22)):
        values = RNG.integers(0, 1 << depth, (h, w, images.CHANNELS[colour]))
        palette = RNG.integers(0, 256, (1 << min(depth, 8), 3)).astype(np.uint8) if colour == 3 else None
        want = palette[values[:, :, 0]] if colour == 3 else images._rgb((values >> 8 if depth == 16 else values * 255 // ((1 << depth) - 1)).astype(np.uint8))
        for kind in (lambda y: y % 5, lambda y: y % 3, lambda y: 4, lambda y: 3):
            got, wrong = images.decoded(png(values, depth, colour, palette, interlaced, kind))
            assert wrong is None and (got == want).all()


def bmp(pixels, bits, down=False, palette=None):
    h, w = pixels.shape[:2]
    if bits == 24:
        rows = pixels[:, :, ::-1].reshape(h, -1)
    elif bits == 32:
        rows = np.dstack([pixels[:, :, ::-1], np.zeros((h, w, 1), np.uint8)]).reshape(h, -1)
    else:
        rows = np.packbits(((pixels[:, :, None] >> np.arange(bits - 1, -1, -1)) & 1).reshape(h, -1).astype(np.uint8), axis=1)
    rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4)))
    table = b"" if palette is None else np.hstack([palette[:, ::-1], np.zeros((len(palette), 1), np.uint8)]).tobytes()
    body = (rows if down else rows[::-1]).tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(table) + len(body), 0, 0, 54 + len(table)) + struct.pack("<IiiHHIIiiII", 40, w, -h if down else h, 1, bits, 0, len(body), 0, 0, 0 if palette is None else len(palette), 0) + table + body


def test_bmp():
    p = RNG.integers(0, 256, (6, 7, 3)).astype(np.uint8)
    for bits in (24, 32):
        for down in (False, True):
            assert (images.decoded(bmp(p, bits, down))[0] == p).all()
    for bits in (1, 4, 8):
        palette, places = RNG.integers(0, 256, (1 << bits, 3)).astype(np.uint8), RNG.integers(0, 1 << bits, (5, 9))
        assert (images.decoded(bmp(places, bits, palette=palette))[0] == palette[places]).all()
    five = np.array([[0x7FFF, 0x001F]], "<u2")
    data = b"BM" + struct.pack("<IHHI", 58, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, 16, 0, 4, 0, 0, 0, 0) + five.tobytes()
    assert images.decoded(data)[0].tolist() == [[[255, 255, 255], [0, 0, 255]]]


def test_ppm():
    p = RNG.integers(0, 256, (4, 5, 3)).astype(np.uint8)
    assert (images.decoded(b"P6 # a\n5 4\n255\n" + p.tobytes())[0] == p).all()
    assert (images.decoded(b"P3\n5 4\n255\n" + " ".join(map(str, p.reshape(-1))).encode())[0] == p).all()
    grey = p[:, :, 0]
    assert (images.decoded(b"P5\n5 4\n255\n" + grey.tobytes())[0] == grey[:, :, None]).all()
    assert (images.decoded(b"P5\n5 4\n65535\n" + (grey.astype(">u2") * 257).tobytes())[0] == grey[:, :, None]).all()
    assert images.decoded(b"P1\n3 2\n101 0#c\n1 0")[0][:, :, 0].tolist() == [[0, 255, 0], [255, 0, 255]]
    assert images.decoded(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000]))[0][:, :, 0].tolist() == [[0, 255, 0], [255, 0, 255]]


def test_broken_files_are_errors(spark):
    p = RNG.integers(0, 256, (6, 7, 3)).astype(np.uint8)
    whole = images.encode_png(p)
    assert (images.decoded(whole)[0] == p).all()
    rng, kinds = random.Random(1), [whole, bmp(p, 24), b"P6 7 6 255 " + p.tobytes()]
    for data in kinds:
        for _ in range(150):
            cut = bytearray(data[: rng.randrange(len(data))]) if rng.random() < 0.5 else bytearray(data)
            for _ in range(rng.randrange(4)):
                if cut:
                    cut[rng.randrange(len(cut))] = rng.randrange(256)
            got, wrong = images.decoded(bytes(cut))
            assert (got is None) == (wrong is not None)
    huge = images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 1 << 30, 1 << 30, 8, 2, 0, 0, 0)) + chunk(b"IEND", b"")
    rows = [(0, whole), (1, whole[:40]), (2, None), (3, b""), (4, b"GIF89a"), (5, huge), (6, bmp(p, 24))]
    got = {r.k: r for r in images.decode_images(spark.createDataFrame(rows, "k int, content binary")).collect()}
    assert {k for k, r in got.items() if r.error is None} == {0, 6} and all((r.pixels is None) == (r.error is not None) for r in got.values())
    assert bytes(got[0].pixels) == p.tobytes() and (got[6].width, got[6].height) == (7, 6)
    with pytest.raises(ValueError):
        images.decode_images(spark.createDataFrame(rows, "Width int, content binary"))


def test_folder_of_images(spark, tmp_path):
    p = RNG.integers(0, 256, (3, 4, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(images.encode_png(p))
    (tmp_path / "b.BMP").write_bytes(bmp(p, 24))
    (tmp_path / "c.jpg").write_bytes(b"\xff\xd8")
    (tmp_path / "d.txt").write_bytes(b"x")
    got = {r.path[-5:]: r for r in images.load_pixels(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.png", "b.BMP", "c.jpg"} and bytes(got["a.png"].pixels) == bytes(got["b.BMP"].pixels) == p.tobytes() and got["c.jpg"].error

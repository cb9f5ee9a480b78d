"""Pixel work against direct sums, point tests and round trips."""

import math

import numpy as np
import pytest

from folimetry.operators import raster

RNG = np.random.default_rng(3)


def image(h, w, c=3):
    return RNG.integers(0, 256, (h, w, c)).astype(np.uint8)


@pytest.mark.parametrize(("shape", "radius"), [((9, 7, 3), 1.0), ((5, 12, 1), 2.0), ((1, 1, 3), 3.0), ((4, 4, 3), 0.4)])
def test_blur_is_the_direct_sum(shape, radius):
    p, reach = image(*shape), math.ceil(3 * radius)
    h, w = shape[:2]
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / radius) ** 2)
    k = np.outer(k, k) / np.outer(k, k).sum()
    want = np.zeros(shape)
    for y in range(h):
        for x in range(w):
            for dy in range(-reach, reach + 1):
                for dx in range(-reach, reach + 1):
                    want[y, x] += k[dy + reach, dx + reach] * p[min(max(y + dy, 0), h - 1), min(max(x + dx, 0), w - 1)]
    assert np.abs(raster.blurred(p, radius).astype(float) - want).max() <= 0.5 + 1e-9
    assert (raster.blurred(p, 0) == p).all() and (raster.blurred(np.full(shape, 77, np.uint8), radius) == 77).all()


def test_jpeg_loses_more_at_lower_quality_and_keeps_flat_images():
    y, x = np.mgrid[0:45, 0:70]
    smooth = np.stack([127 + 100 * np.sin(x / 9), 127 + 90 * np.cos(y / 7), (x * 3 + y) % 256], axis=2).astype(np.uint8)
    errors = [float(((raster.recompressed(smooth, q).astype(float) - smooth) ** 2).mean()) for q in (95, 75, 50, 25, 10, 2)]
    assert errors == sorted(errors) and errors[0] < 60 < errors[-1]
    for colour in ((200, 200, 200), (0, 0, 0), (255, 255, 255)):
        assert (raster.recompressed(np.full((20, 9, 3), colour, np.uint8), 50) == colour).all()
    assert np.abs(raster.recompressed(np.full((8, 8, 3), (10, 200, 90), np.uint8), 50).astype(int) - (10, 200, 90)).max() <= 8
    assert raster.recompressed(image(7, 5, 1), 80).shape == (7, 5, 1) and raster.recompressed(image(0, 5), 80).shape == (0, 5, 3)
    four = image(10, 10, 4)
    assert (raster.recompressed(four, 50)[:, :, 3] == four[:, :, 3]).all()


def test_block_transform_is_the_defining_sum():
    block = RNG.integers(0, 256, (8, 8)).astype(float)
    u, v = 3, 5
    direct = 0.25 * sum((block[y, x] - 128) * math.cos((2 * y + 1) * u * math.pi / 16) * math.cos((2 * x + 1) * v * math.pi / 16) for y in range(8) for x in range(8))
    assert math.isclose((raster.COSINES @ (block - 128) @ raster.COSINES.T)[u, v], direct, abs_tol=1e-9)
    assert np.abs(raster._through_blocks(block, np.full((8, 8), 1.0)) - block).max() <= 2
    assert raster.quantisation(raster.BRIGHTNESS, 50)[0].tolist() == [16, 11, 10, 16, 24, 40, 51, 61] and (raster.quantisation(raster.COLOUR, 100) == 1).all()


def test_rotation():
    p = image(6, 6)
    assert (raster.rotated(p, 90) == np.rot90(p)).all() and (raster.rotated(p, 180) == p[::-1, ::-1]).all() and (raster.rotated(p, -90) == np.rot90(p, -1)).all()
    assert (raster.rotated(p, 720) == p).all() and raster.rotated(image(0, 4), 10).shape == (0, 4, 3)
    wide = raster.rotated(np.zeros((10, 40, 3), np.uint8), 45)
    assert (wide[0, 0] == 255).all() and (wide[5, 20] == 0).all() and wide.shape == (10, 40, 3)
    flat = raster.rotated(np.full((31, 31, 1), 90, np.uint8), 17)
    assert set(np.unique(flat)) == {90, 255}


def test_rotation_is_the_direct_interpolation(monkeypatch):
    monkeypatch.setattr(raster, "TURN_PIXELS", 20)
    p, turn = image(9, 11), math.radians(23)
    got = raster.rotated(p, 23)
    for y in range(9):
        for x in range(11):
            dx, dy = x + 0.5 - 5.5, y + 0.5 - 4.5
            fx, fy = math.cos(turn) * dx - math.sin(turn) * dy + 5.5, math.sin(turn) * dx + math.cos(turn) * dy + 4.5
            if not (0 <= fx < 11 and 0 <= fy < 9):
                assert (got[y, x] == 255).all()
                continue
            fx, fy = fx - 0.5, fy - 0.5
            total = np.zeros(3)
            for j in range(math.floor(fy) - 1, math.floor(fy) + 3):
                for i in range(math.floor(fx) - 1, math.floor(fx) + 3):
                    total += p[min(max(j, 0), 8), min(max(i, 0), 10)] * float(raster._cubic(np.array(fx - i))) * float(raster._cubic(np.array(fy - j)))
            assert np.abs(np.clip(total, 0, 255) - got[y, x]).max() <= 0.5 + 1e-6


def test_resampling():
    p = image(12, 20)
    assert (raster.resampled(p, 20, 12) == p).all()
    assert (raster.resampled(np.full((9, 9, 3), 13, np.uint8), 31, 4) == 13).all()
    at, weights = raster._bands(20, 7)
    assert np.allclose(weights.sum(axis=1), 1)
    row = [sum(p[0, i, 0] * w for i, w in zip(a, ws)) for a, ws in zip(at.tolist(), weights.tolist())]
    assert np.abs(np.clip(row, 0, 255) - raster.resampled(p, 7, 12)[0, :, 0]).max() <= 0.5 + 1e-9
    assert raster.coarsened(p, 0.5).shape == p.shape and raster.coarsened(p, 1e-9).shape == p.shape and len(np.unique(raster.coarsened(p, 1e-9)[:, :, 0])) == 1
    y, x = np.mgrid[0:64, 0:64]
    slow = (127 + 100 * np.sin(x / 20) * np.cos(y / 23)).astype(np.uint8)[:, :, None]
    assert np.abs(raster.coarsened(slow, 0.5).astype(int) - slow).max() <= 3
    assert raster.limited(image(10, 400), 100).shape == (2, 100, 3) and raster.limited(p, 100).shape == p.shape


def covers(points, x, y):
    inside = False
    for (a, b), (c, d) in zip(points, points[1:] + points[:1]):
        if (c - a) * (y - b) == (d - b) * (x - a) and min(a, c) <= x <= max(a, c) and min(b, d) <= y <= max(b, d):
            return True
        if (b <= y) != (d <= y) and (x - a) * (d - b) * (1 if d > b else -1) < (y - b) * (c - a) * (1 if d > b else -1):
            inside = not inside
    return inside


def test_polygons_by_testing_every_pixel():
    shapes = [[(0, 0), (9, 0), (9, 9), (0, 9)], [(5, 5)], [(2, 3), (8, 3)], [(-5, -5), (30, 4), (3, 30)], [(1, 1), (10, 10), (10, 1), (1, 10)], [(4, 4), (4, 4), (4, 4)]]
    shapes += [[tuple(RNG.integers(-6, 24, 2).tolist()) for _ in range(RNG.integers(3, 9))] for _ in range(150)]
    for points in shapes:
        want = np.array([[covers(points, x, y) for x in range(18)] for y in range(15)])
        assert (raster.polygon_mask(points, 15, 18) == want).all(), points


def test_crops_and_frames():
    p = image(40, 50)
    assert (raster.cropped(p, (100, 250, 500, 750)) == p[10:30, 5:25]).all()
    got = raster.cropped(p, (0, 0, 1000, 1000), [(0, 0), (1000, 0), (0, 1000)])
    assert (got[0] == p[0]).all() and (got[39, 10:] == 255).all() and (got[5, 5] == p[5, 5]).all()
    assert (raster.cropped(p, (0, 0, 1000, 1000), [(0, 0), (9, 9)]) == p).all() and raster.cropped(p, (500, 500, 400, 600)).size == 0
    assert (raster.cropped(p, (900, 0, 1100, 100))[:, 5:] == 0).all()
    framed = raster.outlined(np.zeros((20, 20, 3), np.uint8), [(2, 2, 15, 12), (18, 18, 40, 40)], (255, 0, 0), 2)
    assert framed[2, 2, 0] == framed[12, 15, 0] == framed[3, 9, 0] == 255 and framed[7, 8, 0] == 0 and framed[18, 19, 0] == 255

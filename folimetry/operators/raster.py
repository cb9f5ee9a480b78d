"""Pixel work on one image, an array of (height, width, channels) bytes: blur, JPEG losses, turning, resampling, polygons."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

WHITE = 255
#: Pixels whose neighbours are gathered at once when an image is turned.
TURN_PIXELS = 1 << 18

# Quantisation tables of the JPEG standard for brightness and colour, row by row, at quality 50.
BRIGHTNESS = np.array("""
16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99
""".split(), np.float64).reshape(8, 8)
COLOUR = np.array("""
17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99
""".split(), np.float64).reshape(8, 8)


def _bytes(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values + 0.5), 0, 255).astype(np.uint8)


def blurred(pixels: np.ndarray, radius: float) -> np.ndarray:
    """Gaussian blur of standard deviation `radius`, rows and then columns; what is outside is as the nearest edge."""
    if radius <= 0 or not pixels.size:
        return pixels.copy()
    reach = math.ceil(3 * radius)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / radius) ** 2)
    weights /= weights.sum()
    out = pixels.astype(np.float64)
    for axis in (1, 0):
        size = out.shape[axis]
        wide = np.take(out, np.clip(np.arange(-reach, size + reach), 0, size - 1), axis=axis)
        out = sum(w * (wide[:, k : k + size] if axis else wide[k : k + size]) for k, w in enumerate(weights))
    return _bytes(out)


# --- JPEG


def _cosines() -> np.ndarray:
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.where(k == 0, math.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * k * math.pi / 16)


COSINES = _cosines()
#: The transform of a block whose 64 values are in one row.
BLOCK_COSINES = np.kron(COSINES, COSINES)


def quantisation(table: np.ndarray, quality: int) -> np.ndarray:
    """The table at a quality from 1 to 100, as the common scale has it."""
    quality = min(max(int(quality), 1), 100)
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((table * scale + 50) // 100, 1, 255)


def _through_blocks(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A plane of whole 8x8 blocks, transformed, rounded to multiples of the table and transformed back."""
    h, w = plane.shape
    blocks = plane.reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3).reshape(-1, 64) - 128
    kept = np.round(blocks @ BLOCK_COSINES.T / table.reshape(64)) * table.reshape(64)
    back = np.clip(np.round(kept @ BLOCK_COSINES + 128), 0, 255)
    return back.reshape(h // 8, w // 8, 8, 8).transpose(0, 2, 1, 3).reshape(h, w)


def _doubled(plane: np.ndarray, axis: int) -> np.ndarray:
    """Twice as many along an axis, each three parts the value it comes from and one part the next one on its side."""
    size = plane.shape[axis]
    before, after = (np.take(plane, np.clip(np.arange(size) + s, 0, size - 1), axis=axis) for s in (-1, 1))
    pair = np.stack([(3 * plane + before) / 4, (3 * plane + after) / 4], axis=axis + 1)
    return pair.reshape(*plane.shape[:axis], 2 * size, *plane.shape[axis + 1 :])


def recompressed(pixels: np.ndarray, quality: int) -> np.ndarray:
    """What JPEG at this quality leaves of an image: colour at half size, blocks of 8x8 rounded by frequency. An image of one
    channel has brightness only; of others, three at least, the first three are red, green and blue."""
    h, w = pixels.shape[:2]
    if not pixels.size:
        return pixels.copy()
    padded = np.pad(pixels.astype(np.float64), ((0, -h % 16), (0, -w % 16), (0, 0)), mode="edge")
    if pixels.shape[2] < 3:
        planes = [_through_blocks(padded[:, :, c], quantisation(BRIGHTNESS, quality)) for c in range(pixels.shape[2])]
        return np.stack(planes, axis=2)[:h, :w].astype(np.uint8)
    r, g, b = (padded[:, :, c] for c in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    out = [_through_blocks(np.round(y), quantisation(BRIGHTNESS, quality))]
    for colour, scale in ((b, 1.772), (r, 1.402)):
        full = (colour - y) * (0.25 / scale)
        half = np.round(full[::2, ::2] + full[1::2, ::2] + full[::2, 1::2] + full[1::2, 1::2] + 128)
        out.append(_doubled(_doubled(_through_blocks(half, quantisation(COLOUR, quality)), 0), 1) - 128)
    y, cb, cr = out
    rgb = np.stack([y + 1.402 * cr, y - (0.114 * 1.772 * cb + 0.299 * 1.402 * cr) / 0.587, y + 1.772 * cb], axis=2)
    return np.concatenate([_bytes(rgb[:h, :w]), pixels[:, :, 3:]], axis=2)


# --- geometry


def _cubic(x: np.ndarray) -> np.ndarray:
    """Cubic convolution with a slope of -1/2."""
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0))


def rotated(pixels: np.ndarray, degrees: float, fill: int = WHITE) -> np.ndarray:
    """Turned about the centre, against the clock, at the same size; `fill` where nothing comes to lie. Each pixel is
    interpolated from the 4x4 around the place that it comes from. Whole turns change nothing."""
    h, w = pixels.shape[:2]
    if degrees % 360 == 0 or not pixels.size:
        return pixels.copy()
    cos, sin = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    out = np.full(pixels.shape, fill, np.uint8)
    edged = np.pad(pixels, ((2, 2), (2, 2), (0, 0)), mode="edge")
    values = edged.reshape(-1, pixels.shape[2]).astype(np.float32)
    rows = max(1, TURN_PIXELS // w)
    for top in range(0, h, rows):
        y, x = np.mgrid[top : min(top + rows, h), 0:w] + 0.5
        y, x = y - h / 2, x - w / 2
        from_x, from_y = np.round(cos * x - sin * y + w / 2, 9), np.round(sin * x + cos * y + h / 2, 9)
        inside = (from_x >= 0) & (from_x < w) & (from_y >= 0) & (from_y < h)
        from_x, from_y = from_x[inside] - 0.5, from_y[inside] - 0.5
        left, above = np.floor(from_x).astype(int), np.floor(from_y).astype(int)
        corner = (above + 1) * edged.shape[1] + left + 1  # of the 4x4
        across = [_cubic(from_x - left - dx)[:, None] for dx in range(-1, 3)]
        total = np.zeros((len(left), pixels.shape[2]))
        for dy in range(4):
            line = sum(weight * values.take(corner + (dy * edged.shape[1] + dx), axis=0) for dx, weight in enumerate(across))
            total += _cubic(from_y - above - (dy - 1))[:, None] * line
        out[top : top + rows][inside] = _bytes(total)
    return out


@lru_cache(64)
def _bands(size: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the wanted places along a side, the places that it is made of and their weights: a sinc windowed by a
    wider sinc, three lobes, stretched where the side shrinks."""
    ratio = size / wanted
    stretch = max(ratio, 1.0)
    centre = (np.arange(wanted) + 0.5) * ratio
    first = np.maximum(np.floor(centre - 3 * stretch + 0.5), 0).astype(int)
    last = np.minimum(np.floor(centre + 3 * stretch + 0.5), size).astype(int)
    at = first[:, None] + np.arange(int((last - first).max()))
    x = (at - centre[:, None] + 0.5) / stretch
    weights = np.where((at < last[:, None]) & (np.abs(x) < 3), np.sinc(x) * np.sinc(x / 3), 0)
    return np.minimum(at, size - 1), weights / weights.sum(axis=1, keepdims=True)


def resampled(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """The image at another size, rows and then columns."""
    out = pixels
    for axis, wanted in ((1, width), (0, height)):
        if out.shape[axis] != wanted:
            at, weights = _bands(out.shape[axis], wanted)
            shape = [1] * 3
            shape[axis] = wanted
            out = _bytes(sum(out.take(at[:, k], axis=axis) * weights[:, k].reshape(shape) for k in range(at.shape[1])))
    return out.copy() if out is pixels else out


def coarsened(pixels: np.ndarray, factor: float) -> np.ndarray:
    """Detail of a lower resolution: down by the factor, to one pixel at least, and up again."""
    h, w = pixels.shape[:2]
    return resampled(resampled(pixels, max(1, int(w * factor)), max(1, int(h * factor))), w, h) if pixels.size else pixels.copy()


def limited(pixels: np.ndarray, long_side: int = 3500) -> np.ndarray:
    """Made smaller, if its longer side is above `long_side`."""
    h, w = pixels.shape[:2]
    scale = min(1.0, long_side / max(h, w, 1))
    return resampled(pixels, max(1, int(w * scale)), max(1, int(h * scale))) if scale < 1 and pixels.size else pixels.copy()


# --- polygons


def polygon_mask(points: list[tuple[int, int]], height: int, width: int) -> np.ndarray:
    """Which pixels a polygon of whole coordinates covers: those on its edges, and inside by the even-odd rule. Each row
    takes the edges that it crosses, in order from the left, two by two."""
    change = np.zeros((height, width + 1), np.int32)
    x0, y0 = np.array(points, np.int64).reshape(-1, 2).T
    x1, y1 = np.roll(x0, -1), np.roll(y0, -1)
    swap = y0 > y1
    x0, y0, x1, y1 = np.where(swap, x1, x0), np.where(swap, y1, y0), np.where(swap, x0, x1), np.where(swap, y0, y1)
    low, high = np.clip(y0, 0, height), np.clip(y1, 0, height)
    edge = np.repeat(np.arange(len(x0)), high - low)
    row = np.arange(len(edge)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[edge]
    rise, run = (row - y0[edge]) * (x1 - x0)[edge], np.maximum((y1 - y0)[edge], 1)
    order = np.lexsort((x0[edge] + rise / run, row))
    row, floor, ceil = row[order], (x0[edge] + rise // run)[order], (x0[edge] - (-rise // run))[order]
    begin, end = np.clip(ceil[0::2], 0, width), np.clip(floor[1::2] + 1, 0, width)
    some = end > begin
    np.add.at(change, (row[0::2][some], begin[some]), 1)
    np.add.at(change, (row[0::2][some], end[some]), -1)
    mask = np.cumsum(change[:, :width], axis=1) > 0
    for a, b, c, d in zip(x0.tolist(), y0.tolist(), x1.tolist(), y1.tolist(), strict=True):
        steps = math.gcd(c - a, d - b)
        k = np.arange(steps + 1)
        x, y = a + k * ((c - a) // max(steps, 1)), b + k * ((d - b) // max(steps, 1))
        seen = (x >= 0) & (x < width) & (y >= 0) & (y < height)
        mask[y[seen], x[seen]] = True
    return mask


def cropped(pixels: np.ndarray, box: tuple[float, ...], polygon: list[tuple[float, float]] | None = None, fill: int = WHITE) -> np.ndarray:
    """The part of an image in a box given in thousandths of its sides, with `fill` outside the polygon, given likewise, if
    that has three points. A box beyond the image is filled with 0; an empty one gives an empty image."""
    h, w = pixels.shape[:2]
    x1, y1, x2, y2 = (int(v * side / 1000) for v, side in zip(box, (w, h, w, h), strict=True))
    out = np.zeros((max(y2 - y1, 0), max(x2 - x1, 0), pixels.shape[2]), np.uint8)
    top, left, bottom, right = max(y1, 0), max(x1, 0), min(y2, h), min(x2, w)
    if top < bottom and left < right:
        out[top - y1 : bottom - y1, left - x1 : right - x1] = pixels[top:bottom, left:right]
    if polygon is not None and len(polygon) >= 3:
        points = [(int(x * w / 1000) - x1, int(y * h / 1000) - y1) for x, y in polygon]
        out[~polygon_mask(points, *out.shape[:2])] = fill
    return out


def outlined(pixels: np.ndarray, boxes: list[tuple[int, int, int, int]], colour: tuple[int, ...], thickness: int = 2) -> np.ndarray:
    """Boxes drawn as frames that reach `thickness` pixels inwards; what is outside the image isn't drawn."""
    out = pixels.copy()
    for x1, y1, x2, y2 in boxes:
        whole = polygon_mask([(x1, y1), (x2, y1), (x2, y2), (x1, y2)], *pixels.shape[:2])
        if min(x2 - x1, y2 - y1) >= 2 * thickness:
            whole &= ~polygon_mask([(x1 + thickness, y1 + thickness), (x2 - thickness, y1 + thickness), (x2 - thickness, y2 - thickness), (x1 + thickness, y2 - thickness)], *pixels.shape[:2])
        out[whole] = colour
    return out

"""Raster measures on PNG bytes, in numpy inside Arrow batches: masks, error, structure, components, complexity, resizing."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A pixel whose channels all exceed WHITE is background; differences over APART count; weights of the blend.
WHITE, APART = 250, 0.1
RMSE, SSIM, STRUCTURE = 0.125, 0.125, 0.75
EDGE_LOW, EDGE_HIGH = 100, 200
#: Pixels of a stack of rasters that are compared at the same time.
STACK_PIXELS = 1 << 19
_MEASURES = ("rmse", "ssim", "abs_diff", "components", "structural", "complexity", "combined")


#: First pixel and step of the passes of an interlaced PNG, as (y, x, down, right).
_PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def decode_png(data: bytes | None) -> np.ndarray | None:
    """(height, width, 3) of a PNG, laid on white where it is transparent; of 16-bit channels the upper bytes. None for null or
    unreadable bytes, other formats among them."""
    if not data or bytes(data[:8]) != b"\x89PNG\r\n\x1a\n":
        return None
    data, at, packed, palette, alpha = bytes(data), 8, [], None, None
    try:
        while at + 8 <= len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            body = data[at + 8 : at + 8 + size]
            at += 12 + size
            if kind == b"IHDR":
                width, height, depth, color, _, _, laced = struct.unpack(">IIBBBBB", body)
            elif kind == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif kind == b"tRNS":
                alpha = np.frombuffer(body, np.uint8)
            elif kind == b"IDAT":
                packed.append(body)
        channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
        if not width or not height:
            return None
        raw, at = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8), 0
        out = np.zeros((height, width, channels), np.uint8)
        for y, x, down, right in _PASSES if laced else ((0, 0, 1, 1),):
            h, w = -(-(height - y) // down), -(-(width - x) // right)
            if h > 0 and w > 0:
                part, used = _raster(raw[at:], h, w, depth, channels, color == 3)
                out[y::down, x::right] = part
                at += used
        cover = np.full((height, width, 1), 255)
        if color == 3:
            if alpha is not None:
                cover = np.concatenate([alpha, np.full(256 - len(alpha), 255)])[out[..., 0]][..., None]
            out = palette[out[..., 0]]
        elif color in (4, 6):
            out, cover = out[..., :-1], out[..., -1:]
        rgb = np.repeat(out, 3, axis=2) if out.shape[2] == 1 else out
        return np.rint(rgb * (cover / 255) + 255 * (1 - cover / 255)).astype(np.uint8)
    except (ValueError, KeyError, struct.error, zlib.error, UnboundLocalError, IndexError, TypeError):
        return None


def _raster(raw: np.ndarray, height: int, width: int, depth: int, channels: int, indexed: bool) -> tuple[np.ndarray, int]:
    """(height, width, channels) bytes of filtered lines, and how many bytes these took."""
    line, step = (width * channels * depth + 7) // 8, max(1, channels * depth // 8)
    used = height * (line + 1)
    lines = raw[:used].reshape(height, line + 1)
    above = np.zeros(line + step, np.int64)
    rows = np.empty((height, line), np.uint8)
    for y in range(height):
        above[step:] = _unfilter(int(lines[y, 0]), lines[y, 1:].astype(np.int64), above, step)
        rows[y] = above[step:]
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth).dot(1 << np.arange(depth)[::-1])[:, :width]
        rows = bits if indexed else bits * 255 // ((1 << depth) - 1)
    return rows.reshape(height, width, channels), used


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    up = above[step:]
    if kind == 0:
        return line
    if kind == 2:
        return (line + up) & 255
    if kind == 1:  # each byte adds to the one a pixel before it: sums along each channel
        wide = np.zeros(-(-len(line) // step) * step, np.int64)
        wide[: len(line)] = line
        return (wide.reshape(-1, step).cumsum(0) & 255).reshape(-1)[: len(line)]
    out = np.zeros(len(line) + step, np.int64)
    for i in range(len(line)):
        left, top, corner = out[i], up[i], above[i]
        if kind == 3:
            guess = (left + top) // 2
        else:
            near = left + top - corner
            guess = min((abs(near - left), 0, left), (abs(near - top), 1, top), (abs(near - corner), 2, corner))[2]
        out[i + step] = (line[i] + guess) & 255
    return out[step:]


def encode_png(pixels: np.ndarray) -> bytes:
    """PNG of (height, width, 3) bytes."""
    height, width = pixels.shape[:2]
    body = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def foreground(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pixels that are not background in at least one of two rasters of one size."""
    return ~((a > WHITE).all(-1)) | ~((b > WHITE).all(-1))


def resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Scaled to fit, its proportions kept, by the mean over the area each pixel covers; the rest is white, split evenly."""
    h, w = pixels.shape[:2]
    scale = min(height / h, width / w)
    to_h, to_w = max(1, round(h * scale)), max(1, round(w * scale))

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.arange(m + 1) * n / m
        lo, hi = np.arange(n), np.arange(1, n + 1)
        part = np.clip(np.minimum(edges[1:, None], hi) - np.maximum(edges[:-1, None], lo), 0, None)
        return part / part.sum(1, keepdims=True)

    small = np.einsum("ij,jkc,lk->ilc", weights(h, to_h), pixels.astype(float), weights(w, to_w))
    out = np.full((height, width, pixels.shape[2]), 255, np.uint8)
    top, left = (height - to_h) // 2, (width - to_w) // 2
    out[top : top + to_h, left : left + to_w] = np.rint(small)
    return out


def same_size(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    height, width = max(a.shape[0], b.shape[0]), max(a.shape[1], b.shape[1])
    fit = lambda x: x if x.shape[:2] == (height, width) else resize(x, height, width)
    return fit(a), fit(b)


def trimmed_square(pixels: np.ndarray, size: int) -> np.ndarray:
    """Cut to what isn't background, padded to a square with white, scaled to `size`. A blank raster stays blank."""
    inside = ~((pixels > WHITE).all(-1))
    if inside.any():
        rows, cols = np.flatnonzero(inside.any(1)), np.flatnonzero(inside.any(0))
        pixels = pixels[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1]
    side = max(pixels.shape[:2])
    out = np.full((side, side, pixels.shape[2]), 255, np.uint8)
    top, left = (side - pixels.shape[0]) // 2, (side - pixels.shape[1]) // 2
    out[top : top + pixels.shape[0], left : left + pixels.shape[1]] = pixels
    return resize(out, size, size)


def _window_means(x: np.ndarray, win: int) -> np.ndarray:
    """Means over win x win windows of the second and third axis, by running sums."""
    for axis in (1, 2):
        sums = np.cumsum(x, axis=axis)
        first = np.take(sums, [win - 1], axis=axis)
        rest = np.take(sums, range(win, x.shape[axis]), axis=axis) - np.take(sums, range(x.shape[axis] - win), axis=axis)
        x = np.concatenate([first, rest], axis=axis)
    return x / (win * win)


def ssim_map(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Structural similarity per pixel and channel of stacks of rasters: uniform window of 7 (less in smaller rasters), sample
    covariance, edges mirrored."""
    win = min(7, *(n - (n + 1) % 2 for n in a.shape[1:3]))
    half = win // 2
    x, y = (np.pad(z.astype(float), ((0, 0), (half, half), (half, half), (0, 0)), mode="symmetric") for z in (a, b))
    mx, my = _window_means(x, win), _window_means(y, win)
    unbiased = win * win / max(1, win * win - 1)
    vx, vy, cov = (unbiased * (_window_means(p * q, win) - m * n) for p, q, m, n in ((x, x, mx, mx), (y, y, my, my), (x, y, mx, my)))
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return (2 * mx * my + c1) * (2 * cov + c2) / ((mx**2 + my**2 + c1) * (vx + vy + c2))


def labelled(masks: np.ndarray) -> np.ndarray:
    """(n, height, width) masks -> for each set pixel the flat index of the first pixel of its region (touching, diagonally too),
    -1 elsewhere. All masks at once: every pixel's root takes the lowest root next to it, then roots are followed to their end;
    the number of rounds grows with the logarithm of the longest path in a region."""
    n, height, width = masks.shape
    at = np.full((n, height + 2, width + 2), -1)
    at[:, 1:-1, 1:-1][masks] = np.arange(masks.sum())
    here = at[at >= 0]
    pairs = [(at[:, 1:-1, 1:-1], at[:, 1 + i : height + 1 + i, 1 + j : width + 1 + j]) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))]
    p, q = (np.concatenate([side[(a >= 0) & (b >= 0)] for a, b in pairs for side in ((a, b)[k],)]) for k in (0, 1))
    root = here.copy()
    while len(p):
        a, b = root[p], root[q]
        apart = a != b
        if not apart.any():
            break
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    out = np.full(masks.shape, -1)
    where = np.flatnonzero(masks)
    out.reshape(-1)[where] = where[root] if len(where) else where
    return out


def region_areas(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask, area) of each region of set pixels of a stack of masks."""
    labels = labelled(masks)
    first, area = np.unique(labels[labels >= 0], return_counts=True)
    return first // (masks.shape[1] * masks.shape[2]), area


def component_areas(mask: np.ndarray) -> list[int]:
    """Areas of the regions of set pixels that touch, diagonally too."""
    return sorted(region_areas(mask[None])[1].tolist())


def edges(stack: np.ndarray) -> np.ndarray:
    """Edge pixels by the usual two-threshold detector: Sobel gradients, thinned to those that are greatest across the edge,
    over EDGE_HIGH, or over EDGE_LOW and in one region with such a pixel."""
    gray = np.pad(np.rint(stack.astype(float) @ [0.299, 0.587, 0.114]), ((0, 0), (1, 1), (1, 1)), mode="edge")
    gx = gray[:, :-2, 2:] + 2 * gray[:, 1:-1, 2:] + gray[:, 2:, 2:] - gray[:, :-2, :-2] - 2 * gray[:, 1:-1, :-2] - gray[:, 2:, :-2]
    gy = gray[:, 2:, :-2] + 2 * gray[:, 2:, 1:-1] + gray[:, 2:, 2:] - gray[:, :-2, :-2] - 2 * gray[:, :-2, 1:-1] - gray[:, :-2, 2:]
    size = np.abs(gx) + np.abs(gy)
    ring = np.pad(size, ((0, 0), (1, 1), (1, 1)))
    h, w = size.shape[1:]
    beside = lambda i, j: ring[:, 1 + i : 1 + i + h, 1 + j : 1 + j + w]
    flat, steep = np.abs(gy) < np.tan(np.pi / 8) * np.abs(gx), np.abs(gy) > np.tan(3 * np.pi / 8) * np.abs(gx)
    rising = (gx < 0) != (gy < 0)
    thin = np.where(
        flat,
        (size > beside(0, -1)) & (size >= beside(0, 1)),
        np.where(steep, (size > beside(-1, 0)) & (size >= beside(1, 0)), np.where(rising, (size > beside(-1, 1)) & (size > beside(1, -1)), (size > beside(-1, -1)) & (size > beside(1, 1)))),
    )
    weak = thin & (size > EDGE_LOW)
    labels = labelled(weak)
    strong = np.unique(labels[weak & (size > EDGE_HIGH)])
    return weak & np.isin(labels, strong)


def complexities(stack: np.ndarray) -> np.ndarray:
    """Edge density times 1 + ln(1 + outlines) of each raster; outlines are the regions of edge pixels."""
    found = edges(stack)
    outlines = np.bincount(region_areas(found)[0], minlength=len(stack))
    return found.mean((1, 2)) * (1 + np.log1p(outlines))


def complexity(pixels: np.ndarray) -> float:
    return float(complexities(pixels[None])[0])


def compare_stacks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(n, measures): the _MEASURES (dissimilarities) of two stacks of rasters of one size. ssim is NaN where nothing is foreground.

    structural sums the areas of the regions of difference that exceed their mean, over the size: one region alone gives 0.
    """
    n, height, width = a.shape[:3]
    mask = foreground(a, b)
    inked = mask.sum((1, 2))
    apart = (a.astype(float) - b) / 255
    over = lambda x: (x * mask[..., None]).sum((1, 2, 3)) / np.maximum(inked * 3, 1)
    rmse, diff = np.sqrt(over(apart**2)), over(np.abs(apart))
    ssim = np.where(inked > 0, 1 - over(ssim_map(a, b)), np.nan)
    of, area = region_areas((np.abs(apart).mean(-1) * mask) > APART)
    regions = np.bincount(of, minlength=n)
    mean = np.bincount(of, area, minlength=n) / np.maximum(regions, 1)
    large = area > mean[of]
    weighted = np.bincount(of[large], area[large], minlength=n) / (height * width)
    busy = np.maximum(complexities(a), complexities(b))
    structural = weighted * (1 + busy)
    combined = RMSE * rmse + SSIM * np.nan_to_num(ssim) + STRUCTURE * structural
    return np.stack([rmse, ssim, diff, regions.astype(float), structural, busy, combined], 1)


def compare(a: np.ndarray | None, b: np.ndarray | None) -> tuple[float | None, ...]:
    """The _MEASURES of two rasters; all null if one is missing, ssim where nothing is foreground."""
    if a is None or b is None:
        return (None,) * len(_MEASURES)
    a, b = same_size(a, b)
    return tuple(None if np.isnan(v) else float(v) for v in compare_stacks(a[None], b[None])[0])


def compare_many(firsts: list[bytes | None], seconds: list[bytes | None]) -> np.ndarray:
    """(n, measures) of pairs of PNGs, NaN for null. Images that occur again are decoded once, pairs that do are compared once,
    and those of one size at the same time, STACK_PIXELS at most."""
    rasters: dict[bytes, np.ndarray | None] = {}
    place: dict[tuple, int] = {}
    index = np.empty(len(firsts), np.int64)
    for i, pair in enumerate(zip(firsts, seconds, strict=True)):
        index[i] = place.setdefault(tuple(None if p is None else bytes(p) for p in pair), len(place))
    sizes: dict[tuple, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    out = np.full((len(place), len(_MEASURES)), np.nan)
    for (p, q), i in place.items():
        for png in (p, q):
            if png is not None and png not in rasters:
                rasters[png] = decode_png(png)
        a, b = rasters.get(p), rasters.get(q)
        if a is not None and b is not None:
            a, b = same_size(a, b)
            sizes.setdefault(a.shape, []).append((i, a, b))
    for (height, width, _), rows in sizes.items():
        many = max(1, STACK_PIXELS // (height * width))
        for some in (rows[i : i + many] for i in range(0, len(rows), many)):
            out[[i for i, _, _ in some]] = compare_stacks(np.stack([a for _, a, _ in some]), np.stack([b for _, _, b in some]))
    return out[index]


def compare_column(original: Column, generated: Column) -> Column:
    """Struct of the measures of two PNG columns."""
    def batches(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for x, y in pairs:
            found = compare_many(x.tolist(), y.tolist()).astype(object)
            yield pd.DataFrame(np.where(found == found, found, None), columns=list(_MEASURES))

    return F.pandas_udf(batches, ", ".join(f"{m} double" for m in _MEASURES))(original, generated)


def describe_column(png: Column) -> Column:
    """Struct of height, width, number of colours and foreground share of a PNG; null for unreadable ones."""
    def one(data: bytes | None) -> tuple:
        p = decode_png(data)
        return (None,) * 4 if p is None else (p.shape[0], p.shape[1], len(np.unique(p.reshape(-1, 3), axis=0)), float((~(p > WHITE).all(-1)).mean()))

    def batches(images: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in images:
            yield pd.DataFrame([one(p) for p in x], columns=["height", "width", "colours", "ink"], dtype="float64")

    return F.pandas_udf(batches, "height double, width double, colours double, ink double")(png)


def square_column(png: Column, size: int = 8) -> Column:
    def batches(images: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in images:
            yield pd.Series([None if (p := decode_png(d)) is None else encode_png(trimmed_square(p, size)) for d in x], dtype=object)

    return F.pandas_udf(batches, "binary")(png)


def pixel_rmse(a: Column, b: Column, white: float) -> Column:
    """Masked RMSE of two equally long arrays of grey levels in 0..255, natively; 0 where nothing is foreground."""
    zipped = F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: (p["x"] <= white) | (p["y"] <= white))
    total = F.aggregate(zipped, F.lit(0.0), lambda s, p: s + ((p["x"] - p["y"]) / 255.0) * ((p["x"] - p["y"]) / 255.0))
    return F.when(F.size(zipped) > 0, F.sqrt(total / F.size(zipped))).otherwise(0.0)

"""Measures of small grey rasters, as Arrow-batched functions over array columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _stacks(*rasters: pd.Series) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Places and stacks (n, side, side) of the rows of one size in which no raster is null; a batch mostly has one size."""
    known = np.logical_and.reduce([r.notna().to_numpy() for r in rasters])
    sizes = np.array([len(p) if ok else -1 for p, ok in zip(rasters[0], known, strict=True)])
    for size in np.unique(sizes[known]):
        side = int(round(size**0.5))
        if side * side != size:
            raise ValueError("a raster must be square")
        at = np.flatnonzero(sizes == size)
        yield at, [np.stack(r.iloc[at].to_numpy()).astype(float).reshape(-1, side, side) for r in rasters]


def laplacian(images: np.ndarray) -> np.ndarray:
    """Four-neighbour Laplacian of images (n, h, w); the border is mirrored without its edge."""
    p = np.pad(images, ((0, 0), (1, 1), (1, 1)), mode="reflect")
    return p[:, :-2, 1:-1] + p[:, 2:, 1:-1] + p[:, 1:-1, :-2] + p[:, 1:-1, 2:] - 4 * images


def tile_variances(images: np.ndarray, tiles: int = 3) -> np.ndarray:
    """Population variance of the Laplacian in each of ``tiles`` by ``tiles`` tiles, row by row: (n, tiles * tiles)."""
    response = laplacian(images)
    return np.stack([t.var(axis=(1, 2)) for rows in np.array_split(response, tiles, 1) for t in np.array_split(rows, tiles, 2)], axis=1)


def structural_similarity(a: np.ndarray, b: np.ndarray, peak: float = 255.0) -> np.ndarray:
    """Similarity of images (n, h, w) from their means, variances and covariance over the whole raster."""
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    mean = lambda x: x.mean(axis=(1, 2))
    ma, mb, va, vb = mean(a), mean(b), a.var(axis=(1, 2)), b.var(axis=(1, 2))
    cov = mean((a - ma[:, None, None]) * (b - mb[:, None, None]))
    return (2 * ma * mb + c1) * (2 * cov + c2) / ((ma**2 + mb**2 + c1) * (va + vb + c2))


def _numbers(n: int, parts: Iterator[tuple[np.ndarray, np.ndarray]], missing: float = np.nan) -> pd.Series:
    out = np.full(n, missing)
    for at, values in parts:
        out[at] = values
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def sharpness(pixels: pd.Series) -> pd.Series:
    """Population variance of the Laplacian; null for null, as all of these."""
    return _numbers(len(pixels), ((at, laplacian(x).var(axis=(1, 2))) for at, (x,) in _stacks(pixels)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def sharpness_tiles(pixels: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(pixels), dtype=object)
    for at, (x,) in _stacks(pixels):
        for i, values in zip(at, tile_variances(x), strict=True):
            out.iat[i] = values
    return out


@F.pandas_udf(T.DoubleType())
def ssim(a: pd.Series, b: pd.Series) -> pd.Series:
    return _numbers(len(a), ((at, structural_similarity(x, y)) for at, (x, y) in _stacks(a, b)))


@F.pandas_udf(T.DoubleType())
def motion(before: pd.Series, now: pd.Series) -> pd.Series:
    """Mean absolute difference over 255 after the best shift of a pixel; 1 without a frame before."""

    def least(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        shifts = [np.abs(x - np.roll(y, (dy, dx), (1, 2)))[:, 1:-1, 1:-1].mean(axis=(1, 2)) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        return np.minimum(np.min(shifts, axis=0) / 255, 1.0)

    return _numbers(len(now), ((at, least(x, y)) for at, (x, y) in _stacks(before, now)), 1.0)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def split_spread(pixels: pd.Series) -> pd.Series:
    """Left and right page of a spread; an odd middle column goes to the right."""
    out = pd.Series([None] * len(pixels), dtype=object)
    for at, (x,) in _stacks(pixels):
        half = x.shape[2] // 2
        for i, left, right in zip(at, x[:, :, :half], x[:, :, half:], strict=True):
            out.iat[i] = [left.ravel(), right.ravel()]
    return out


def difference_hash(pixels: Column, side: int = 8) -> Column:
    """Bits of "brighter than the pixel to its left", row by row, as a long; no Python."""
    bits = [
        F.when(F.element_at(pixels, r * side + c + 2) > F.element_at(pixels, r * side + c + 1), F.lit(1 << (r * (side - 1) + c))).otherwise(F.lit(0))
        for r in range(side)
        for c in range(side - 1)
    ]
    return sum(bits[1:], bits[0].cast("long"))


def tile_statistics(tiles: Column) -> dict[str, Column]:
    """Median, tenth percentile, minimum and log-weighted uniformity of nine tile variances; no Python."""
    ordered = F.array_sort(tiles)

    def at(share: float) -> Column:
        place = share * 8
        low = int(place)
        a = F.element_at(ordered, low + 1)
        return a + (F.element_at(ordered, min(low + 2, 9)) - a) * (place - low)

    median, p10, worst = at(0.5), at(0.1), F.element_at(ordered, 1)
    uniformity = (0.5 * F.log1p(median) + 0.3 * F.log1p(p10) + 0.2 * F.log1p(worst)) / 8
    return {"tile_median": median, "tile_p10": p10, "tile_worst": worst, "uniformity": uniformity}

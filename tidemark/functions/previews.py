"""Small grey previews: resizing by area, 64-bit hashes, windowed similarity; a batch of rasters is one array."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows and columns of the hash, constants of the similarity, least contrast, bits and similarity of the same page.
HASH_ROWS, HASH_COLUMNS = 8, 9
C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
CONTRAST, BITS, SIMILAR = 8.0, 4, 0.99
#: Bytes of the largest array that a batch is cut into.
CHUNK = 1 << 25


def area_weights(size: int, wanted: int) -> np.ndarray:
    """Row i has the shares of ``size`` pixels in the i-th of ``wanted`` equal parts of their line."""
    step = size / wanted
    first, last = np.arange(wanted)[:, None] * step, (np.arange(wanted)[:, None] + 1) * step
    pixel = np.arange(size)[None, :]
    return np.clip(np.minimum(last, pixel + 1) - np.maximum(first, pixel), 0, None) / step


def resized(images: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Images (n, h, w) by the mean of the area under each new pixel, as whole grey values."""
    down, across = area_weights(images.shape[1], rows), area_weights(images.shape[2], columns)
    return np.rint(np.round(np.einsum("ij,njk,lk->nil", down, images, across, optimize=True), 6))


def hashes(images: np.ndarray) -> np.ndarray:
    """64 bits of "brighter than the pixel to its left", row by row, the first bit highest, as signed numbers."""
    small = resized(images, HASH_ROWS, HASH_COLUMNS)
    bits = (small[:, :, 1:] > small[:, :, :-1]).reshape(len(images), 64)
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


def gaussian(width: int, sigma: float) -> np.ndarray:
    raw = np.exp(-((np.arange(width) - (width - 1) / 2) ** 2) / (2 * sigma * sigma))
    return raw / raw.sum()


def similarity(a: np.ndarray, b: np.ndarray, width: int = 11, sigma: float = 1.5) -> np.ndarray:
    """Mean structural similarity of images (n, h, w) over all windows of ``width`` that lie inside."""
    kernel = gaussian(width, sigma)

    def blurred(x: np.ndarray) -> np.ndarray:
        for axis in (1, 2):
            x = np.lib.stride_tricks.sliding_window_view(x, width, axis=axis) @ kernel
        return x

    mean_a, mean_b = blurred(a), blurred(b)
    var_a, var_b = np.maximum(0, blurred(a * a) - mean_a**2), np.maximum(0, blurred(b * b) - mean_b**2)
    cov = blurred(a * b) - mean_a * mean_b
    value = (2 * mean_a * mean_b + C1) * (2 * cov + C2) / ((mean_a**2 + mean_b**2 + C1) * (var_a + var_b + C2))
    return value.mean(axis=(1, 2))


def _chunks(n: int, pixels: int) -> Iterator[slice]:
    step = max(1, CHUNK // (8 * pixels))
    yield from (slice(at, at + step) for at in range(0, n, step))


def preview_hash(preview: Column, rows: int, columns: int) -> Column:
    """The 64-bit hash of a raster of ``rows`` by ``columns`` grey values in one list; null for null."""

    @F.pandas_udf("long")
    def made(previews: pd.Series) -> pd.Series:
        known = previews.notna().to_numpy()
        out = pd.Series([None] * len(previews), dtype="Int64")
        if known.any():
            stack = np.stack(previews[known].to_numpy()).reshape(-1, rows, columns).astype(float)
            out[known] = np.concatenate([hashes(stack[part]) for part in _chunks(len(stack), rows * columns)])
        return out

    return made(preview)


def compared(a: Column, b: Column, rows: int, columns: int, width: int = 11, sigma: float = 1.5, size: tuple[int, int] | None = (256, 256)) -> Column:
    """Two rasters compared: ``contrast`` (the lower deviation), ``bits`` that differ, ``similar`` (the least of whole, left and right half).

    For the similarity rasters are brought to ``size`` (rows, columns), halves
    too; None leaves them. Null if one raster is null. A batch is compared as
    one array, cut where it would get large.
    """

    def sized(x: np.ndarray) -> np.ndarray:
        return x if size is None else resized(x, *size)

    @F.pandas_udf("contrast double, bits int, similar double")
    def made(first: pd.Series, second: pd.Series) -> pd.DataFrame:
        known = (first.notna() & second.notna()).to_numpy()
        out = pd.DataFrame({"contrast": np.full(len(first), np.nan), "bits": pd.array([None] * len(first), dtype="Int32"), "similar": np.full(len(first), np.nan)})
        if known.any():
            x, y = (np.stack(s[known].to_numpy()).reshape(-1, rows, columns).astype(float) for s in (first, second))
            half, rowset = columns // 2, []
            for part in _chunks(len(x), max(rows * columns, math.prod(size or (1, 1)) * 4)):
                p, q = x[part], y[part]
                views = [(p, q), (p[:, :, :half], q[:, :, :half]), (p[:, :, half:], q[:, :, half:])]
                similar = np.min([similarity(sized(u), sized(v), width, sigma) for u, v in views], axis=0)
                differ = np.bitwise_count((hashes(p) ^ hashes(q)).view(np.uint64))
                rowset.append(pd.DataFrame({"contrast": np.minimum(p.std(axis=(1, 2)), q.std(axis=(1, 2))), "bits": differ.astype(np.int32), "similar": similar}))
            found = pd.concat(rowset)
            for c in out.columns:
                out.loc[known, c] = found[c].to_numpy()
        return out

    both = made(a, b)
    return F.when(a.isNotNull() & b.isNotNull(), both)


def same_page(comparison: Column, bits: int = BITS, similar: float = SIMILAR, contrast: float = CONTRAST) -> Column:
    """Do two previews show the same page? Both need some contrast; without a preview they don't."""
    alike = (comparison["contrast"] >= contrast) & (comparison["bits"] <= bits) & (comparison["similar"] >= max(SIMILAR, similar))
    return F.coalesce(alike, F.lit(False))

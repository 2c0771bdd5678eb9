"""Column functions over frames (arrays of bins or samples).

A frame is one row, so these need no shuffle at all. Only the moving mean of the
CFAR and the FFT run in numpy, on whole Arrow batches of frames.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DOUBLES = "array<double>"
EMPTY_DB = -240.0


def indices(frame: Column) -> Column:
    """0 .. n-1, empty for an empty frame."""
    return F.when(F.size(frame) > 0, F.sequence(F.lit(0), F.size(frame) - 1)).otherwise(
        F.array().cast("array<int>")
    )


def bin_hz(center: Column, width: Column, n: Column, i: Column) -> Column:
    return center - n / 2 * width + (i + 0.5) * width


def to_linear(frame: Column) -> Column:
    return F.transform(frame, lambda x: F.pow(F.lit(10.0), x / 10))


def upper_median(frame: Column) -> Column:
    """The element at n div 2 of the sorted frame."""
    return F.get(F.array_sort(frame), F.floor(F.size(frame) / 2).cast("int"))


def last_peak(frame: Column) -> Column:
    """Index of the maximum, the last one on ties."""
    return (F.size(frame) - F.array_position(F.reverse(frame), F.array_max(frame))).cast("int")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def notch_dc(frame: Column, radius: int = 3) -> Column:
    """Replace the bins around the centre by the mean of the two beyond."""
    n = F.size(frame)
    mid = F.floor(n / 2).cast("int")
    fill = (F.get(frame, mid - radius - 1) + F.get(frame, F.least(mid + radius + 1, n - 1))) / 2
    return F.when(
        n > 2 * radius + 2,
        F.transform(frame, lambda x, i: F.when((i >= mid - radius) & (i <= mid + radius), fill).otherwise(x)),
    ).otherwise(frame)


def local_maxima(frame: Column, threshold: Column) -> Column:
    """Indices of bins above the threshold and above both neighbours."""
    at = lambda i: F.get(frame, i)
    return F.filter(
        indices(frame), lambda i: (at(i) > threshold) & (at(i) > at(i - 1)) & (at(i) > at(i + 1))
    )


def vertex(frame: Column, i: Column) -> tuple[Column, Column]:
    """Offset (bins) and height of the parabola through a bin and its neighbours."""
    a, b, c = F.get(frame, i - 1), F.get(frame, i), F.get(frame, i + 1)
    bend = a - 2 * b + c
    offset = F.when(F.abs(bend) > 1e-10, 0.5 * (a - c) / bend).otherwise(0.0)
    return offset, b - 0.25 * (a - c) * offset


def _stacked(frames: pd.Series):
    """Yield (row numbers, matrix) for every frame length in the batch."""
    lengths = frames.map(lambda a: -1 if a is None else len(a)).to_numpy()
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == n)
        yield rows, np.stack([np.asarray(frames.iloc[r], dtype="float64") for r in rows])


def training_mean(train: int, guard: int):
    """Pandas UDF: mean of the training cells either side, NULL near the edges."""

    @F.pandas_udf(DOUBLES)
    def udf(linear: pd.Series) -> pd.Series:
        out = [None] * len(linear)
        reach = train + guard
        for rows, m in _stacked(linear):
            mean = np.full(m.shape, np.nan)
            if m.shape[1] >= 2 * reach + 1:
                sums = np.lib.stride_tricks.sliding_window_view(m, train, axis=1).sum(axis=2)
                inner = m.shape[1] - 2 * reach
                left, right = sums[:, :inner], sums[:, reach + guard + 1: reach + guard + 1 + inner]
                mean[:, reach: reach + inner] = (left + right) / (2 * train)
            for r, line in zip(rows, mean):
                out[r] = line
        return pd.Series(out)

    return udf


def cfar_alpha(train: int, pfa: float) -> float:
    cells = 2 * train
    return cells * (pfa ** (-1.0 / cells) - 1.0)


def clusters(flags: Column, gap: int = 2) -> Column:
    """(first, last) of groups of set flags with at most ``gap`` unset between."""
    on = lambda i: F.coalesce(F.get(flags, i), F.lit(False))
    quiet = lambda i, sign: ~sum_or([on(i + sign * d) for d in range(1, gap + 2)])
    first = F.filter(indices(flags), lambda i: on(i) & quiet(i, -1))
    last = F.filter(indices(flags), lambda i: on(i) & quiet(i, 1))
    return F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), b.alias("last")))


def sum_or(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def energy_crossing(linear: Column, share: float) -> Column:
    """Index where the running energy first reaches ``share`` of the total."""
    goal = total(linear) * share
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("at"), F.lit(0).alias("i"))
    return F.aggregate(
        linear,
        start,
        lambda acc, x: F.struct(
            (acc["sum"] + x).alias("sum"),
            F.when((acc["at"] < 0) & (acc["sum"] + x >= goal), acc["i"]).otherwise(acc["at"]).alias("at"),
            (acc["i"] + 1).alias("i"),
        ),
        lambda acc: F.when(acc["at"] < 0, acc["i"] - 1).otherwise(acc["at"]),
    )


def resample(frame: Column, start: Column, step: Column, grid_start: Column, grid_step: Column, points: int) -> Column:
    """Linear interpolation of evenly spaced bins onto a grid, ends clamped."""
    n = F.size(frame)

    def value(j: Column) -> Column:
        x = (grid_start + j * grid_step - start) / step
        lo = F.floor(x).cast("int")
        t = x - lo
        inside = F.get(frame, lo) * (1 - t) + F.get(frame, F.least(lo + 1, n - 1)) * t
        return F.when(x <= 0, F.get(frame, F.lit(0))).when(x >= n - 1, F.get(frame, n - 1)).otherwise(inside)

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), value)


def blackman_harris(n: int) -> np.ndarray:
    x = 2 * np.pi * np.arange(n) / (n - 1)
    # The coefficients of the 4-term window.
    return 0.35875 - 0.48829 * np.cos(x) + 0.14128 * np.cos(2 * x) - 0.01168 * np.cos(3 * x)


def welch_psd(fft_size: int, overlap: float = 0.5):
    """Pandas UDF over (i, q): averaged spectrum in dB of full scale, DC in the middle."""
    window = blackman_harris(fft_size)
    hop = max(int(fft_size * (1 - min(max(overlap, 0.0), 0.95))), 1)

    @F.pandas_udf(DOUBLES)
    def udf(i: pd.Series, q: pd.Series) -> pd.Series:
        out = [None] * len(i)
        for rows, re in _stacked(i):
            z = re + 1j * np.stack([np.asarray(q.iloc[r], dtype="float64") for r in rows])
            if z.shape[1] < fft_size:
                z = np.pad(z, ((0, 0), (0, fft_size - z.shape[1])))
            segments = np.lib.stride_tricks.sliding_window_view(z, fft_size, axis=1)[:, ::hop]
            power = np.abs(np.fft.fft(segments * window, axis=2)) ** 2 / window.sum() ** 2
            mean = np.fft.fftshift(power.mean(axis=1), axes=1)
            db = np.where(mean > 1e-24, 10 * np.log10(np.maximum(mean, 1e-24)), EMPTY_DB)
            for r, line in zip(rows, db):
                out[r] = line
        return pd.Series(out)

    return udf


def hann_spectrum():
    """Pandas UDF over (i, q): one Hann-windowed spectrum per row, padded to a power of two."""

    @F.pandas_udf(DOUBLES)
    def udf(i: pd.Series, q: pd.Series) -> pd.Series:
        out = [None] * len(i)
        for rows, re in _stacked(i):
            z = re + 1j * np.stack([np.asarray(q.iloc[r], dtype="float64") for r in rows])
            used = z.shape[1]
            n = 1 << (used - 1).bit_length()
            w = 0.5 * (1 - np.cos(2 * np.pi * np.arange(used) / n))
            power = np.abs(np.fft.fftshift(np.fft.fft(z * w, n=n, axis=1), axes=1)) ** 2 / n
            for r, line in zip(rows, 10 * np.log10(power + 1e-20)):
                out[r] = line
        return pd.Series(out)

    return udf

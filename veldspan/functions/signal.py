"""Waveform functions as Arrow UDFs: resampling and log-mel spectrograms as matrix products over whole batches.

Rows of one length are one matrix; null arrays, and those with a null sample, give null.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-5
CELLS = 1 << 22  # numbers that a product expands at a time


@cache
def sinc_filter(up: int, down: int, zeros: int = 16, beta: float = 8.0) -> np.ndarray:
    """A Kaiser-windowed low-pass filter for a rational change of rate."""
    cutoff = 1 / max(up, down)
    half = int(zeros / cutoff)
    n = np.arange(-half, half + 1)
    return np.sinc(n * cutoff) * cutoff * np.kaiser(2 * half + 1, beta) * up


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Rows of samples (rows x n) at the target rate, ceil(n target / rate) a row.

    An output is a product of the filter's taps of its phase with the samples around it.
    """
    if rate == target or not x.size:
        return x
    n = x.shape[1]
    common = int(np.gcd(rate, target))
    up, down = target // common, rate // common
    taps = sinc_filter(up, down)
    half, width = len(taps) // 2, -(-len(taps) // up) + 1
    at = np.arange(-(-n * up // down)) * down  # place of each output among the samples with up - 1 zeros after each
    k = np.arange(width) - width // 2
    tap = (at % up)[:, None] + up * k + half
    weight = np.where((tap >= 0) & (tap < len(taps)), taps[np.clip(tap, 0, len(taps) - 1)], 0)
    padded = np.pad(x, ((0, 0), (width, width)))
    out = np.empty((len(x), len(at)))
    for lo in range(0, len(at), max(1, CELLS // (width * max(len(x), 1)))):
        some = slice(lo, lo + max(1, CELLS // (width * max(len(x), 1))))
        near = (at[some] // up)[:, None] - k + width
        out[:, some] = np.einsum("rtk,tk->rt", padded[:, near], weight[some])
    return out


@cache
def mel_filters(rate: int, window: int, bands: int) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale from 0 to half the rate."""
    mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    points = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(window, 1 / rate)
    rising = (bins - points[:-2, None]) / (points[1:-1] - points[:-2])[:, None]
    falling = (points[2:, None] - bins) / (points[2:] - points[1:-1])[:, None]
    return np.maximum(0, np.minimum(rising, falling))


def hann(window: int) -> np.ndarray:
    return np.hanning(window + 1)[:-1]


def log_mel(x: np.ndarray, rate: int, window: int, hop: int, bands: int) -> np.ndarray:
    """log10 of mel energies of rows of samples, rows x bands x frames; the ends are mirrored, values floored."""
    padded = np.pad(x, ((0, 0), (window // 2, window // 2)), "reflect" if x.shape[1] > window // 2 else "constant")
    frames = np.lib.stride_tricks.sliding_window_view(padded, window, axis=1)[:, ::hop]
    magnitude = np.abs(np.fft.rfft(frames * hann(window), axis=2))
    return np.log10(np.maximum(magnitude @ mel_filters(rate, window, bands).T, FLOOR)).transpose(0, 2, 1)


def nested(x: np.ndarray) -> pa.Array:
    """A list column of the rows of an array of two or three dimensions."""
    out = pa.array(np.ascontiguousarray(x).reshape(-1))
    for i in range(x.ndim - 1, 0, -1):
        rows = int(np.prod(x.shape[:i]))
        out = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * x.shape[i]), out)
    return out


def by_length(column: pa.Array, function, kind: pa.DataType) -> pa.Array:
    """``function`` of the rows of each length, a matrix at a time, in the rows' order; null where the row or one of its samples is."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.asarray(column.value_lengths().fill_null(-1))
    parts, order = [], []
    for n in np.unique(size[size >= 0]).tolist():
        rows = np.flatnonzero(size == n)
        step = max(1, CELLS // max(n, 1))
        for lo in range(0, len(rows), step):
            some = rows[lo : lo + step]
            x = column.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(some), n)
            whole = ~np.isnan(x).any(1) if n else np.ones(len(some), bool)
            if whole.any():
                parts.append(nested(function(x[whole])).cast(kind))
                order.append(some[whole])
    place = np.full(len(column), -1)
    if parts:
        place[np.concatenate(order)] = np.arange(sum(map(len, order)))
    values = pa.concat_arrays(parts) if parts else pa.array([], kind)
    return values.take(pa.array(place, mask=place < 0))


def resampled(x: Column, rate: int, target: int) -> Column:
    @F.arrow_udf("array<double>")
    def run(values: pa.Array) -> pa.Array:
        return by_length(values, lambda rows: resample(rows, rate, target), pa.list_(pa.float64()))

    return run(x)


def log_mel_spectrogram(x: Column, rate: int = 16_000, window: int = 1024, hop: int = 256, bands: int = 80) -> Column:
    @F.arrow_udf("array<array<double>>")
    def run(values: pa.Array) -> pa.Array:
        return by_length(values, lambda rows: log_mel(rows, rate, window, hop, bands), pa.list_(pa.list_(pa.float64())))

    return run(x)

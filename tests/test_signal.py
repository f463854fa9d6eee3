"""Waveform functions against their definitions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspan.functions import signal as S
from veldspan.functions import vectors as V


def test_resampling_keeps_a_tone():
    t = np.arange(1600) / 1600
    x = np.sin(2 * np.pi * 50 * t)
    y = S.resample(x[None], 1600, 800)[0]
    assert len(y) == 800 and np.abs(y[100:700] - x[::2][100:700]).max() < 1e-2
    assert S.resample(x[None], 1600, 2400).shape == (1, 2400) and S.resample(x, 8, 8) is x


@pytest.mark.parametrize(("rate", "target"), [(2, 1), (1, 2), (3, 2), (2, 3), (160, 147)])
@pytest.mark.parametrize("n", [1, 7, 200])
def test_resampling_is_a_filter_over_stuffed_zeros(rate, target, n, monkeypatch):
    monkeypatch.setattr(S, "CELLS", 5000)
    x = np.random.default_rng(n).normal(size=(3, n))
    up, down = target // np.gcd(rate, target), rate // np.gcd(rate, target)
    taps = S.sinc_filter(int(up), int(down))
    for row, got in zip(x, S.resample(x, rate, target)):
        wide = np.zeros(n * up)
        wide[::up] = row
        full = np.convolve(wide, taps, "full")[len(taps) // 2 :][: n * up]
        assert np.allclose(got, full[::down][: -(-n * up // down)])


def test_log_mel_finds_the_band_of_a_tone():
    x = np.sin(2 * np.pi * 1000 * np.arange(16_000) / 16_000)
    mel = S.log_mel(x[None], 16_000, 1024, 256, 80)[0]
    centres = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + 8000 / 700), 82)[1:-1] / 2595) - 1)
    assert mel.shape == (80, 63) and abs(centres[mel[:, 30].argmax()] - 1000) < 60 and S.log_mel(np.zeros((2, 64)), 64, 32, 16, 4).max() == -5


def test_columns(spark):
    rows = [([1.0, 0.0, 0.0, 1.0],), (None,), ([],), ([1.0, None],), ([1.0, 2.0],), ([1.0, 0.0, 0.0, 1.0],)]
    mixed = spark.createDataFrame(rows, "x array<double>").coalesce(1).select(S.resampled(F.col("x"), 2, 1).alias("r")).collect()
    assert [None if r.r is None else len(r.r) for r in mixed] == [2, None, 0, None, 1, 2] and mixed[0].r == mixed[5].r
    df = spark.createDataFrame([([1.0, 0.0, 0.0, 1.0],), (None,)], "x array<double>")
    got = df.select(S.resampled(F.col("x"), 2, 1).alias("r"), S.log_mel_spectrogram(F.col("x"), 4, 2, 1, 2).alias("m")).collect()
    assert len(got[0].r) == 2 and len(got[0].m) == 2 and got[1].r is None and got[1].m is None
    row = df.limit(1).select(
        V.rotated(F.col("x"), F.lit(math.pi / 2)).alias("rot"), V.timestep_embedding(F.lit(0.0), 4).alias("emb"), V.preserving_sum(F.col("x"), F.col("x")).alias("sum")
    ).first()
    assert row.rot == pytest.approx([0, 1, -1, 0], abs=1e-12) and row.emb == [1, 1, 0, 0] and row["sum"][0] == pytest.approx(2**0.5)

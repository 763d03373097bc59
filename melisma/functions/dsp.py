"""Measurements of sound as a pandas UDF: samples in, ten numbers out, null where the samples don't tell."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FRAME, HOP = 2048, 1024
SCHEMA = "rms double, peak double, crest double, low double, mid double, high double, centroid double, flatness double, flux double, onset_rate double"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def measure(samples: np.ndarray | None, rate: int) -> tuple[float | None, ...]:
    """Level and crest of the whole; shares of power below 250 Hz, to 4 kHz and above; spectral centroid in Hz, flatness and flux, and rises of flux a second that are beyond the median by three median deviations."""
    if samples is None or len(samples) < FRAME or not np.isfinite(samples).all():
        return (None,) * len(NAMES)
    x = np.asarray(samples, float)
    rms, peak = float(np.sqrt((x * x).mean())), float(np.abs(x).max())
    if rms == 0:
        return (0.0, 0.0, *(None,) * (len(NAMES) - 2))
    n = 1 + (len(x) - FRAME) // HOP
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:n] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    mean = power.mean(0)
    total = mean.sum()
    share = lambda lo, hi: float(mean[(hz >= lo) & (hz < hi)].sum() / total)
    m = np.sqrt(power)
    rise = np.maximum(np.diff(m, axis=0), 0).sum(1) / np.maximum(m[1:].sum(1), 1e-12)
    mad = np.median(np.abs(rise - np.median(rise))) if len(rise) else 0.0
    onsets = int((rise > np.median(rise) + 3 * mad + 1e-3).sum()) if len(rise) else 0
    return rms, peak, peak / rms, share(0, 250), share(250, 4000), share(4000, np.inf), float((hz * mean).sum() / total), float(np.exp(np.log(mean + 1e-20).mean()) / (mean + 1e-20).mean()), float(rise.mean()) if len(rise) else 0.0, onsets / (len(x) / rate)


def features(samples: Column, rate: Column) -> Column:
    return F.pandas_udf(lambda s, r: pd.DataFrame([measure(x, int(y)) for x, y in zip(s, r, strict=True)], columns=NAMES, dtype=float), SCHEMA)(samples, rate)

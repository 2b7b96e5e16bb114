"""Numpy kernels for one bounded window of samples."""

from __future__ import annotations

import sys
from math import erf, sqrt

import numpy as np
from pyspark import cloudpickle

# the kernels travel with the tasks that call them, so executors need numpy but not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def normal_cdf(x: np.ndarray) -> np.ndarray:
    """Standard normal distribution function."""
    return np.fromiter((0.5 * (1.0 + erf(v / sqrt(2.0))) for v in x), float, len(x))


def ks_distance(values: np.ndarray, standardised: bool = False) -> float:
    """Two-sided distance between the sample and N(0, 1)."""
    x = np.sort(values)
    if standardised and x.std() > 0:
        x = (x - x.mean()) / x.std()
    n, cdf = len(x), normal_cdf(x)
    ranks = np.arange(1, n + 1)
    return float(max((ranks / n - cdf).max(), (cdf - (ranks - 1) / n).max()))


def magnitude_features(values: np.ndarray, rate: float = 1.0) -> tuple[float, float, float, float]:
    """Dominant frequency, peak, flatness and low/high ratio of the magnitudes at positive frequencies."""
    n = len(values)
    if n < 4:
        return 0.0, 0.0, 0.0, 0.0
    last = (n - 1) // 2
    magnitude = np.abs(np.fft.rfft(values))[1 : last + 1]
    frequency = np.arange(1, last + 1) * (rate / n)
    flatness = np.exp(np.log(magnitude + 1e-10).mean()) / (magnitude.mean() + 1e-10)
    low = magnitude[frequency <= frequency[-1] / 3].sum()
    high = magnitude[frequency > 2 * frequency[-1] / 3].sum()
    best = int(magnitude.argmax())
    return float(frequency[best]), float(magnitude[best]), float(flatness), float(low / (high + 1e-10))


def welch(values: np.ndarray, segment: int, rate: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Welch density: periodic Hann, half overlap, mean removed per segment, incomplete tail left out."""
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / segment)
    if segment == 1:
        taper = np.ones(1)
    pieces = np.lib.stride_tricks.sliding_window_view(values, segment)[:: segment - segment // 2]
    spectra = np.abs(np.fft.rfft((pieces - pieces.mean(axis=1, keepdims=True)) * taper, axis=1)) ** 2
    density = spectra / (rate * (taper**2).sum())
    density[:, 1 : (-1 if segment % 2 == 0 else None)] *= 2
    return np.arange(segment // 2 + 1) * (rate / segment), density.mean(axis=0)


def filled(array) -> np.ndarray:
    """Nulls filled linearly by position, ends with the nearest value."""
    x = np.array([np.nan if v is None else v for v in array], dtype=float)
    known = np.flatnonzero(~np.isnan(x))
    return x if len(known) == len(x) else np.interp(np.arange(len(x)), known, x[known])


def detrended(x: np.ndarray) -> np.ndarray:
    t = np.arange(len(x)) - (len(x) - 1) / 2
    return x - x.mean() - t * ((t * x).sum() / (t * t).sum())

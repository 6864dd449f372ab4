"""Short-time Fourier spectra over chunks with a halo."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers in the frames that are transformed at a time.
FRAMES = 1 << 22


def tukey(n: int, alpha: float = 0.25) -> np.ndarray:
    """Cosine-tapered window, as used for spectra (periodic)."""
    x = np.arange(n) / n
    edge = alpha / 2
    rise = lambda t: 0.5 * (1 + np.cos(np.pi * (t / edge - 1)))
    return np.where(x < edge, rise(x), np.where(x > 1 - edge, rise(1 - x), 1.0))


def psd(frames: np.ndarray, rate: float, window: np.ndarray) -> np.ndarray:
    """One-sided power density of each row, its mean taken off."""
    return spectra(frames, rate, window)


def spectra(frames: np.ndarray, rate: float, window: np.ndarray, detrend: str | None = "constant", scaling: str = "density", mode: str = "psd") -> np.ndarray:
    """One-sided spectra of each row: power (``psd``) or amplitude (``magnitude``), as ``density`` or ``spectrum``.

    ``detrend`` takes off each row's mean (``constant``) or its straight line (``linear``) before.
    """
    n = frames.shape[1]
    if detrend is not None:
        frames = frames - frames.mean(axis=1, keepdims=True)
    if detrend == "linear":
        x = np.arange(n) - (n - 1) / 2
        frames = frames - np.outer(frames @ x / (x @ x), x)
    scale = 1 / (rate * (window**2).sum()) if scaling == "density" else 1 / window.sum() ** 2
    size = np.abs(np.fft.rfft(frames * window))
    if mode == "magnitude":
        return size * np.sqrt(scale)
    out = size**2 * scale
    out[:, 1 : (n + 1) // 2] *= 2
    return out


def _window(kind: str, n: int, taper: float) -> np.ndarray:
    if kind == "hann":
        return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    return tukey(n, taper) if kind == "tukey" and taper else np.ones(n)


def stft(
    df: DataFrame, keys: list[str], nfft: int, stride: int, rate: float = 1.0, chunk: int = 1 << 16, index: str = "i", value: str = "value", taper: float = 0.25,
    window: str = "tukey", detrend: str | None = "constant", scaling: str = "density", mode: str = "psd",
) -> DataFrame:
    """(keys, frame, spectrum) of regular samples (keys, index, value); frame k covers samples k * stride and on.

    A sample goes to its chunk and, within a frame's length of the chunk's start, to the one before too: a row holds
    one chunk and at most nfft samples more, never a series. Many chunks are transformed in one call. Frames with
    missing or null samples are left out; indices may be negative; of repeated ones the largest value counts.
    ``window`` is tukey (with ``taper``), hann or boxcar; see ``spectra`` for the others.
    """
    for name, given, known in (("window", window, ("tukey", "hann", "boxcar")), ("detrend", detrend, (None, "constant", "linear")), ("scaling", scaling, ("density", "spectrum")), ("mode", mode, ("psd", "magnitude"))):
        if given not in known:
            raise ValueError(f"unknown {name} {given!r}")
    chunk = max(chunk, nfft) // stride * stride or stride
    home = F.floor(F.col(index) / chunk)
    homes = F.when(F.col(index) - home * chunk < nfft, F.array(home, home - 1)).otherwise(F.array(home))
    shape, starts = _window(window, nfft, taper), np.arange(0, chunk, stride)

    def transformed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, FRAMES // (len(starts) * nfft))
        for whole in parts:
            for begin in range(0, len(whole), step):
                part = whole.slice(begin, step)
                base = part.column("_chunk").to_numpy() * chunk
                at, values = part.column("_at"), part.column("_v")
                owner = np.repeat(np.arange(len(part)), at.value_lengths().to_numpy())
                held = np.full((len(part), chunk + nfft), np.nan)
                held[owner, at.flatten().to_numpy() - base[owner]] = values.flatten().to_numpy()
                frames = np.lib.stride_tricks.sliding_window_view(held, nfft, axis=1)[:, starts]
                row, nth = np.nonzero(~np.isnan(frames).any(axis=2))
                if not len(row):
                    continue
                found = spectra(frames[row, nth], rate, shape, detrend, scaling, mode)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
                columns = [part.column(k).take(pa.array(row)) for k in keys]
                yield pa.RecordBatch.from_arrays([*columns, pa.array((base[row] + starts[nth]) // stride), flat], [*keys, "frame", "spectrum"])

    rows = df.filter(F.col(value).isNotNull() & F.col(index).isNotNull()).select(*keys, F.col(index).cast("long").alias("_i"), F.col(value).cast("double").alias("_x"), F.explode(homes).alias("_chunk"))
    pairs = rows.groupBy(*keys, "_chunk").agg(F.sort_array(F.collect_list(F.struct("_i", "_x"))).alias("_p"))
    pairs = pairs.select(*keys, "_chunk", F.col("_p._i").alias("_at"), F.col("_p._x").alias("_v"))
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema]
    return pairs.mapInArrow(transformed, ", ".join([*names, "frame long", "spectrum array<double>"]))

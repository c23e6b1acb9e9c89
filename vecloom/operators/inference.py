"""Batch inference and spectral features over windows, as Arrow jobs."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom import fixed_values as fixed
from vecloom.functions.vectors import l2_normalize
from vecloom.operators.labels import aggregate_windows_to_tracks

Model = Callable[[np.ndarray], np.ndarray]


def batched_inference(
    windows: DataFrame,
    make_model: Callable[[], Model],
    window: int,
    *,
    column: str = "window",
    out: str = "embedding",
    batch_size: int = 256,
    precise: bool = False,
) -> DataFrame:
    """Apply a batch model to every window. ``make_model`` runs once per Python worker.

    Windows that are NULL, of another length, or with NULL or NaN elements are kept with ``status = 'failed'`` and no vector.
    Where the model raises on a batch, its windows are tried one by one; those it fails on, or answers with NaN, are failed too,
    so a window never stops the job. Vectors are 32-bit floats unless ``precise``.
    """
    number, element = (np.float64, T.DoubleType()) if precise else (np.float32, T.FloatType())

    def make_predict() -> Model:
        model = make_model()

        def alone(row: np.ndarray) -> np.ndarray | None:
            try:
                return np.asarray(model(row[None]), dtype=number)[0]
            except Exception:  # noqa: BLE001  whatever the model raises is this window's failure
                return None

        def predict(batch: np.ndarray) -> np.ndarray:
            batch = np.asarray(batch, dtype=np.float32)
            try:
                return np.asarray(model(batch), dtype=number)
            except Exception:  # noqa: BLE001
                rows = [alone(row) for row in batch]
            width = next((len(r) for r in rows if r is not None), 1)
            return np.stack([np.full(width, np.nan, dtype=number) if r is None else r for r in rows])

        return predict

    predict = predict_batch_udf(
        make_predict,
        return_type=T.ArrayType(element),
        batch_size=batch_size,
        input_tensor_shapes=[[window]],
    ).asNondeterministic()  # or a later filter on the vector would run the model a second time
    unusable = F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double")))
    good = F.col(column).isNotNull() & (F.size(column) == window) & ~unusable
    blank = F.array_repeat(F.lit(0.0).cast("float"), window)
    safe = windows.withColumn("_ok", F.coalesce(good, F.lit(False))).withColumn(
        "_in", F.when(F.col("_ok"), F.col(column).cast("array<float>")).otherwise(blank)
    )
    scored = safe.withColumn("_raw", F.when(F.col("_ok"), predict("_in")))
    answered = F.col("_ok") & ~F.coalesce(F.exists("_raw", lambda x: F.isnan(x)), F.lit(True))
    scored = scored.withColumn("_ok", answered).withColumn(out, F.when(F.col("_ok"), F.col("_raw")))
    return scored.withColumn("status", F.when(F.col("_ok"), "ok").otherwise("failed")).drop("_ok", "_in", "_raw")


def projection_model(width: int, dim: int) -> Callable[[], Model]:
    """A fixed linear map, cos(1 + 7 i + 13 j): a stand-in model for jobs and tests."""

    def make() -> Model:
        i = np.arange(width)[:, None]
        j = np.arange(dim)[None, :]
        weights = np.cos(1.0 + 7.0 * i + 13.0 * j)
        return lambda batch: batch.astype(np.float64) @ weights

    return make


def embed_tracks(windows: DataFrame, make_model: Callable[[], Model], window: int, **kwargs) -> DataFrame:
    """Inference per window, unit length, then one pooled vector per track."""
    scored = batched_inference(windows, make_model, window, **kwargs)
    good = scored.where(F.col("status") == "ok").withColumn("embedding", l2_normalize(F.col("embedding")))
    return aggregate_windows_to_tracks(good)


# ---------------------------------------------------------------- log-mel


@lru_cache(maxsize=4)
def mel_filters(rate: int, n_fft: int, bands: int, f_min: float, f_max: float) -> np.ndarray:
    """Triangular filters on the HTK mel scale, (n_fft / 2 + 1) x bands."""
    to_mel = lambda f: 2595.0 * np.log10(1.0 + f / 700.0)
    mels = np.linspace(to_mel(f_min), to_mel(f_max), bands + 2)
    edges = 700.0 * (10.0 ** (mels / 2595.0) - 1.0)
    freqs = np.linspace(0.0, rate / 2, n_fft // 2 + 1)
    rising = (freqs[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    falling = (edges[None, 2:] - freqs[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0.0, np.minimum(rising, falling))


def log_mel_batch(
    waves: np.ndarray,
    rate: int = fixed.TARGET_SR,
    n_fft: int = fixed.MEL_N_FFT,
    hop: int = fixed.MEL_HOP,
    bands: int = fixed.MEL_BANDS,
) -> np.ndarray:
    """(rows, bands, frames): centered power spectrogram, log of the clamped mel, standardized."""
    half = n_fft // 2
    padded = np.pad(waves.astype(np.float64), ((0, 0), (half, half)), mode="reflect")
    frames = np.lib.stride_tricks.sliding_window_view(padded, n_fft, axis=1)[:, ::hop]
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    power = np.abs(np.fft.rfft(frames * taper, axis=2)) ** 2
    mel = power @ mel_filters(rate, n_fft, bands, fixed.MEL_F_MIN, fixed.MEL_F_MAX)
    log = np.log(np.maximum(mel, fixed.MEL_AMIN)).transpose(0, 2, 1)
    mean = log.mean(axis=(1, 2), keepdims=True)
    std = np.maximum(log.std(axis=(1, 2), ddof=1, keepdims=True), 1e-5)
    return (log - mean) / std


def log_mel(wave: Column, window: int = fixed.WINDOW_SAMPLES, rows_at_once: int = 32) -> Column:
    """Log-mel array (bands x frames) of a waveform padded or trimmed to ``window``."""
    from vecloom.functions.vectors import pad_or_trim

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.FloatType())))
    def extract(waves: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(waves), rows_at_once):
            part = waves.iloc[at : at + rows_at_once]
            mels = log_mel_batch(np.stack([np.asarray(w, dtype=np.float32) for w in part]))
            out.extend([list(m) for m in mels.astype(np.float32)])
        return pd.Series(out, index=waves.index)

    return extract(pad_or_trim(F.coalesce(wave, F.array().cast("array<float>")), window))

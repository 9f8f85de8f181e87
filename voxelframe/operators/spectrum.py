"""Windowed power spectra of patches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def window_weights(shape: Sequence[int]) -> np.ndarray:
    """Product of Hamming windows, each to the power 1 / number of axes."""
    out = np.ones(tuple(shape))
    for axis, n in enumerate(shape):
        w = np.hamming(n) ** (1.0 / len(shape))
        out = out * w.reshape([-1 if i == axis else 1 for i in range(len(shape))])
    return out


def power_spectrum(df: DataFrame, shape: Sequence[int], patch: str = "v", keep: Sequence[str] = ("pid",), out: str = "spectrum") -> DataFrame:
    """Magnitudes of the transform of each patch array, flattened row-major.

    The last position of every axis is cut off (an odd size has a centre), the window is applied, and
    of the symmetric transform the first n // 2 + 1 frequencies per axis are kept.
    """
    cut = tuple(slice(0, n - 1) for n in shape)
    weights = window_weights([n - 1 for n in shape])
    half = tuple(slice(0, (n - 1) // 2 + 1) for n in shape)
    kept = list(keep)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    axes = tuple(range(1, len(shape) + 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                data = np.stack(pdf[patch].to_numpy()).astype(np.float64).reshape((len(pdf), *shape))
                spectrum = np.abs(np.fft.fftn(weights * data[(slice(None), *cut)], axes=axes))
                flat = spectrum[(slice(None), *half)].reshape(len(pdf), -1)
                yield pdf[kept].assign(**{out: list(flat)})

    schema = ", ".join([f"`{k}` {types[k]}" for k in kept] + [f"`{out}` array<double>"])
    return df.select(*kept, patch).mapInPandas(run, schema)

"""Scoring of patches by a user model, and averaging over augmented replicas."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.functions.pooling import sigmoid
from voxelframe.functions.scalars import weighted_sum


class Scorer(Protocol):
    """A model: a batch of patches (n, values) to scores (n,), (n, 1) or class scores (n, 2)."""

    def score(self, batch: np.ndarray) -> np.ndarray: ...


class LinearSigmoid:
    """The smallest scorer: a weighted sum through a sigmoid."""

    def __init__(self, weights: Sequence[float], bias: float = 0.0):
        self.weights = np.asarray(weights, dtype=np.float64)
        self.bias = float(bias)

    def score(self, batch: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(batch @ self.weights + self.bias)))

    def column(self, patch: str | Column) -> Column:
        """The same scorer as an expression."""
        return sigmoid(weighted_sum(patch, list(self.weights)) + F.lit(self.bias))


def malignant_column(scores: np.ndarray) -> np.ndarray:
    """Class 1 of a two-class head, else the single output."""
    scores = np.asarray(scores)
    if scores.ndim == 2:
        return scores[:, 1] if scores.shape[1] == 2 else scores[:, 0]
    return scores


def score_patches(df: DataFrame, scorer: Scorer, patch: str = "v", out: str = "p", keep: Sequence[str] = ("pid",)) -> DataFrame:
    """Score every row's patch array in Arrow batches; the model travels as a broadcast variable."""
    packed = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(scorer))
    kept = list(keep)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"`{k}` {types[k]}" for k in kept] + [f"`{out}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = cloudpickle.loads(packed.value)
        for b in batches:
            if b.num_rows:
                patches = b.column(len(kept))
                lengths = patches.value_lengths()
                if patches.null_count or pc.count_distinct(lengths).as_py() != 1:
                    raise ValueError("patches of one table have one size")
                values = patches.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, lengths[0].as_py())
                scores = np.asarray(malignant_column(model.score(values)), np.float64)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(scores)], [*kept, out])

    return df.select(*kept, patch).mapInArrow(run, schema)


def average_replicas(scored: DataFrame, by: Sequence[str], p: str = "p") -> DataFrame:
    """Mean score over the augmented replicas, each counted once."""
    return scored.groupBy(*by).agg(F.avg(p).alias(p), F.count(F.lit(1)).alias("n_replicas"))

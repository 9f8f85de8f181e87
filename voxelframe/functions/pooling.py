"""Multiple-instance pooling: aggregate builders over the instances (candidates) of a patient.

All are plain sums, so they combine on the map side and a patient of any size pools without being
brought together.
"""

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from voxelframe.functions.scalars import weighted_sum

# Rational approximation of the error function (Abramowitz and Stegun 7.1.26).
ERF_P = 0.3275911
ERF_A = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]


def sigmoid(x: Column) -> Column:
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def softplus(x: Column, lower: float = 0.0) -> Column:
    """ln(1 + e^x) without overflow, raised by ``lower``."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))) + F.lit(float(lower))


def log_mean_exp(x: Column, r: float = 1.0) -> Column:
    return F.log(F.avg(F.exp(F.lit(float(r)) * x)) + F.lit(1e-7)) / F.lit(float(r))


def noisy_or(x: Column) -> Column:
    """1 - exp(-sum of softplus)."""
    return 1 - F.exp(-F.sum(softplus(x)))


def one_minus_product(x: Column) -> Column:
    """1 - product of sigmoids, as a sum of logarithms."""
    return 1 - F.exp(-F.sum(softplus(-x)))


def mean_power(x: Column, exponent: float = 2.0) -> Column:
    return F.avg(F.pow(sigmoid(x), F.lit(float(exponent))))


def log_benign(x: Column) -> Column:
    """Sum of ln(1 - sigmoid): the loss of a negative patient."""
    return F.sum(F.log(1 - sigmoid(x) + F.lit(1e-12)))


def sum_malignant(x: Column) -> Column:
    """Sum of sigmoids: the loss of a positive patient."""
    return F.sum(sigmoid(x))


def mil_loss(label: Column, benign: Column, malignant: Column) -> Column:
    return F.when(label == 1, malignant).otherwise(benign)


def masked_mean(x: Column, mask: Column) -> Column:
    return F.try_divide(F.sum(x * mask), F.sum(mask))


def masked_std(x: Column, mask: Column) -> Column:
    """Root of E[x^2] - E[x]^2 under a 0/1 mask."""
    mean = masked_mean(x, mask)
    return F.sqrt(F.greatest(masked_mean(x * x, mask) - mean * mean, F.lit(0.0)))


def attention_pool(
    df: DataFrame, by: Sequence[str], vector: str, u: Sequence[float]
) -> DataFrame:
    """Softmax(x . u)-weighted sum of the vectors of a group, one array per group.

    The shift by the group maximum keeps the exponentials finite; the sums are one per dimension.
    """
    n = len(u)
    scored = df.withColumn("__s", weighted_sum(vector, u))
    top = scored.groupBy(*by).agg(F.max("__s").alias("__m"))
    weighted = scored.join(top, list(by)).withColumn("__w", F.exp(F.col("__s") - F.col("__m")))
    sums = [F.sum(F.col("__w") * F.element_at(F.col(vector), i + 1).cast("double")) for i in range(n)]
    total = F.sum("__w")
    return weighted.groupBy(*by).agg(F.array(*[s / total for s in sums]).alias("pooled"))


def _erf_parts(x: Column, t: Column) -> Column:
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def erf(x: Column) -> Column:
    """Error function by the fixed approximation, absolute error below 1.5e-7."""
    return _erf_parts(x, 1 / (1 + F.lit(ERF_P) * F.abs(x)))


@F.pandas_udf(DoubleType())
def erf_exact(x: pd.Series) -> pd.Series:
    """Error function at full precision, on Arrow batches."""
    return x.map(math.erf, na_action="ignore")


def normal_cdf(mu: Column, sigma: Column, n: int, exact: bool = False) -> Column:
    """CDF of the normal at 0..n-1, as an array.

    The lambda steps bind each argument once per element; spelled out as n columns the same formula
    outgrows code generation.
    """
    scale = sigma * F.lit(2.0**0.5) + F.lit(1e-16)
    if exact:
        return F.array(*[(erf_exact((F.lit(float(k)) - mu) / scale) + 1) / 2 for k in range(n)])
    args = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (k - mu) / scale)
    parts = F.transform(args, lambda x: F.struct(x.alias("x"), (1 / (1 + F.lit(ERF_P) * F.abs(x))).alias("t")))
    return F.transform(parts, lambda s: (_erf_parts(s["x"], s["t"]) + 1) / 2)


def crps_mean(mu: Column, sigma: Column, target: Column, n: int) -> Column:
    """Mean over 0..n-1 of (:func:`normal_cdf` - :func:`heaviside`)^2, on Arrow batches: no arrays, no lambda steps."""

    @F.pandas_udf(DoubleType())
    def mean(mu: pd.Series, sigma: pd.Series, target: pd.Series) -> pd.Series:
        m, scale, t = mu.to_numpy(float), sigma.to_numpy(float) * 2.0**0.5 + 1e-16, target.to_numpy(float)
        total = np.zeros(len(m))
        with np.errstate(all="ignore"):
            for k in range(n):
                x = (k - m) / scale
                at = 1 / (1 + ERF_P * np.abs(x))
                poly = 0.0
                for a in reversed(ERF_A):
                    poly = (poly + a) * at
                gap = (np.sign(x) * (1 - poly * np.exp(-x * x)) + 1) / 2 - (k >= t)
                total += gap * gap
        return pd.Series(total / float(n))

    # without a target no step is reached; nan is above all numbers
    step = F.when(F.isnan(target), F.lit(float("-inf"))).otherwise(F.coalesce(target.cast("double"), F.lit(float("inf"))))
    value = F.coalesce(mean(mu.cast("double"), sigma.cast("double"), step), F.lit(float("nan")))
    return F.when(mu.isNotNull() & sigma.isNotNull(), value)


def heaviside(t: Column, n: int) -> Column:
    """1.0 where k >= t, k = 0..n-1, as an array."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(k - t >= 0, F.lit(1.0)).otherwise(F.lit(0.0))
    )

"""Order-free randomness: uniforms derived from md5 of a seed and a row key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = float(2**52)  # 13 hexadecimal digits


def uniform(seed: str | Column, *keys: str | Column) -> Column:
    """Uniform in [0, 1), a function of ``seed`` and the row's keys only.

    The same row always draws the same number, whatever its partition, so samples survive
    retries and re-runs.
    """
    head = F.lit(seed) if isinstance(seed, str) else seed
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws("|", head, *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(_SPAN)


def uniform_between(low: float, high: float, seed: str | Column, *keys: str | Column) -> Column:
    return F.lit(float(low)) + uniform(seed, *keys) * F.lit(float(high) - float(low))

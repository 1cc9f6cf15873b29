"""Quantiles of durations, as a load test reports them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILES = (0.5, 0.9, 0.99)


def quantiles(df: DataFrame, value: Column, by: Sequence[str] = (), at: Sequence[float] = QUANTILES, accuracy: int = 10_000) -> DataFrame:
    """p50, p90, ... of ``value`` by group: a sketch with map-side merging, so no group is sorted whole."""
    names = [f"p{q * 100:g}".replace(".", "_") for q in at]
    got = df.groupBy(*by).agg(F.count(value).alias("n"), F.percentile_approx(value, list(at), accuracy).alias("_q"))
    return got.select(*by, "n", *[F.element_at("_q", i + 1).alias(n) for i, n in enumerate(names)])

"""Ends of colour scales: quantiles from mergeable sketches.

A sketch of each column is kept per small group (cell, tile, day) and merged for a larger one, so a map of a
region, or of a further day, needs no second pass over the roads. Sketches hold at most a few times
`k` values whatever they have seen. The rank of a quantile read from one is off by at most `rank_error(k)` of the rows, with
a probability of 99 %; up to `k` rows it is exact, the value at rank ceil(share * rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 4096


def rank_error(k: int = K) -> float:
    """The error of one quantile's rank as a share of the rows, at 99 %, as published for these sketches."""
    return 2.296 / k ** 0.9021


def sketches(df: DataFrame, groups: list[str], columns: list[str], k: int = K) -> DataFrame:
    """One row per group with a sketch of each column; NULL and NaN values are left out."""
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    return df.groupBy(*groups).agg(*[F.kll_sketch_agg_double(value(c), F.lit(k)).alias(c) for c in columns])


def merged(kept: DataFrame, groups: list[str], columns: list[str], k: int = K) -> DataFrame:
    """The sketches of larger groups, from those of the smaller ones."""
    return kept.groupBy(*groups).agg(*[F.kll_merge_agg_double(c, F.lit(k)).alias(c) for c in columns])


def ends(kept: DataFrame, groups: list[str], shares: dict[str, tuple[float, float]]) -> DataFrame:
    """One row per group and column with the values at its low and high share; NULL for a column without values."""
    def at(column: str, share: float):
        some = F.kll_sketch_get_n_double(column) > 0
        return F.when(some, F.kll_sketch_get_quantile_double(column, F.lit(share)))
    return kept.select(*groups, F.inline(F.array(*[
        F.struct(F.lit(c).alias("scale"), at(c, low).alias("low"), at(c, high).alias("high")) for c, (low, high) in shares.items()])))

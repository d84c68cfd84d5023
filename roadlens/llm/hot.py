"""Joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 256


def hot_keys(counts: DataFrame, key: str, rows: str, share: int = 1000) -> list:
    """Keys with more than one row in `share`; there can be at most `share` of them."""
    total = counts.agg(F.sum(rows)).first()[0] or 0
    return [r[0] for r in counts.filter(F.col(rows) * share > total).select(key).collect()]


def join_salted(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """Join on `key`, of which `right` has one row each; the left rows of hot keys spread over salts."""
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    own = F.when(is_hot, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS))).otherwise(F.lit(0))
    all_salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return left.withColumn("_salt", own.cast("int")) \
        .join(right.withColumn("_salt", F.explode(all_salts)), [key, "_salt"], how).drop("_salt")

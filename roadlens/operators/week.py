"""Sums over the 168-hour week of each road, without multiplying rows by 168 before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens import fixed

HOURS = range(24)


def week_totals(df: DataFrame, keys: list[str], profile: str, weight: Column,
                value: str, counted: str | None = None) -> DataFrame:
    """`keys`, slot 0..167 and the sum of `profile[slot] * weight` over the rows of each key.

    A row goes through the aggregate seven times, once per day with its 24 hours side by side,
    instead of 168 times. Hours become rows again only after the rows of a key have been added up.
    With `counted`, the number of rows that have a value for the slot comes along. Rows without a
    profile add nothing, and a slot no row has a value for is left out.
    """
    profile_column = F.col(profile)
    days = (df.filter(profile_column.isNotNull())
            .select(*keys, weight.alias("_weight"), profile_column.alias("_profile"))
            .withColumn("_day", F.explode(F.sequence(F.lit(0), F.lit(fixed.DAYS_PER_WEEK - 1)))))
    at = lambda hour: F.get("_profile", F.col("_day") * 24 + hour)
    sums = [F.sum(at(hour) * F.col("_weight")).alias(f"_sum{hour}") for hour in HOURS]
    counts = [F.count(at(hour)).alias(f"_count{hour}") for hour in HOURS] if counted else []
    per_day = days.groupBy(*keys, "_day").agg(*sums, *counts)
    hours = F.array(*[
        F.struct(F.lit(hour).alias("hour"), F.col(f"_sum{hour}").alias("total"),
                 *([F.col(f"_count{hour}").alias("rows")] if counted else []))
        for hour in HOURS])
    cell = per_day.select(*keys, "_day", F.inline(hours))
    return cell.filter(F.col("total").isNotNull()).select(
        *keys, (F.col("_day") * 24 + F.col("hour")).alias("slot"), F.col("total").alias(value),
        *([F.col("rows").alias(counted)] if counted else []))

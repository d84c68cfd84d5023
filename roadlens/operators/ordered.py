"""Running totals, ranks and exact quantiles over a total order, without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.session import durable


def running_totals(df: DataFrame, order: list[Column], totals: dict[str, str],
                   groups: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Add, per row, the running total of columns in the given order within each group.

    `totals` maps a new column to the column it accumulates; the current row is included. The last
    entries of `order` should identify a row, so that the order is total. Group keys are not NULL.

    Rows are range-partitioned by group and order and written to the checkpoint folder together with
    the number of their range, because the ranges are drawn from a sample and must not be drawn
    again when a task is repeated. The totals of the ranges (at most ranges plus groups rows) are
    accumulated on their own and added to the running total inside each range. Ties do not pile up:
    the ranges are cut in the full order.
    """
    groups = groups or []
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(df.repartitionByRange(parts, *groups, *order)
                     .withColumn("_range", F.spark_partition_id()))
    names = list(totals)
    per_range = ranged.groupBy(*groups, "_range").agg(
        *[F.sum(totals[name]).alias(f"_before_{name}") for name in names])
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(*groups, "_range", *[
        F.coalesce(F.sum(f"_before_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}")
        for name in names])
    inside = Window.partitionBy(*groups, "_range").orderBy(*order) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = ranged.select("*", *[
        F.sum(totals[name]).over(inside).alias(f"_inside_{name}") for name in names])
    whole = counted.join(offsets, [*groups, "_range"])
    return whole.select(*df.columns, *[
        (F.col(f"_before_{name}") + F.col(f"_inside_{name}")).alias(name) for name in names])


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """One row per key and column; NULL values are left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value))
                      for c in columns])
    return df.select(*keys, F.inline(pairs)).filter(F.col(value).isNotNull())


def value_counts(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Distinct values of each group with their number of rows and the running number of rows."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_rows"))
    return running_totals(counts, [F.col(value).asc()], {"_upto": "_rows"}, groups)


def average_ranks(df: DataFrame, groups: list[str], value: str, rank: str) -> DataFrame:
    """Rows with the rank of `value` in their group, equal values sharing their mean rank.

    Only distinct values are ordered, so a value held by many rows costs one row.
    """
    ranks = value_counts(df, groups, value).select(
        *groups, value, (F.col("_upto") - (F.col("_rows") - 1) / 2.0).alias(rank))
    return df.join(ranks, [*groups, value])


def exact_quantiles(df: DataFrame, groups: list[str], value: str,
                    shares: dict[str, float]) -> DataFrame:
    """Interpolated quantiles of `value` per group, one column per entry of `shares`.

    The quantile at share p lies at position (n - 1) * p of the ordered rows, between the two rows
    around it. Both are read off the running counts of the distinct values.
    """
    counts = value_counts(df, groups, value)
    sizes = counts.groupBy(*groups).agg(F.max("_upto").alias("_n"))
    keyed = counts.join(sizes, groups) if groups else counts.withColumn("_n", sizes.scalar())
    position = lambda share: (F.col("_n") - 1) * F.lit(float(share))
    low = lambda share: F.floor(position(share))
    at = lambda place: F.min(F.when(F.col("_upto") > place, F.col(value)))
    found = keyed.groupBy(*groups, "_n").agg(*[
        part for name, share in shares.items() for part in (
            at(low(share)).alias(f"_low_{name}"),
            at(F.least(low(share) + 1, F.col("_n") - 1)).alias(f"_high_{name}"))])
    return found.select(*groups, *[
        (F.col(f"_low_{name}") + (position(share) - low(share))
         * (F.col(f"_high_{name}") - F.col(f"_low_{name}"))).alias(name)
        for name, share in shares.items()])


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of each column, one row per column.

    `df` is read twice; hand in a written or checkpointed frame when it is costly.
    """
    long = unpivot(df, [], columns, "feature", "value")
    basics = long.groupBy("feature").agg(
        F.count("*").alias("count"), F.avg("value").alias("mean"), F.stddev("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    quartiles = exact_quantiles(long, ["feature"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return basics.join(quartiles, "feature")


def rank_correlation(df: DataFrame, key: str, against: str, columns: list[str]) -> DataFrame:
    """Spearman correlation of each column with `against`, over the rows where both are known; NULL where one does not vary.

    `df` is read three times; hand in a written or checkpointed frame when it is costly.
    """
    known = df.filter(F.col(against).isNotNull()).withColumn("_against", F.col(against).cast("double"))
    pairs = unpivot(known, [key, "_against"], columns, "feature", "_value")
    ranked = average_ranks(average_ranks(pairs, ["feature"], "_value", "_rank"),
                           ["feature"], "_against", "_rank_against")
    # `corr` divides by zero where a column does not vary.
    return ranked.groupBy("feature").agg(F.try_divide(
        F.covar_pop("_rank", "_rank_against"), F.stddev_pop("_rank") * F.stddev_pop("_rank_against")).alias("correlation"))

"""Hours added up once per segment, hour and kind of day: the table behind nine reports.

One pass over the fact keeps, for each segment, UTC hour, local hour, weekend and weekday peak, how many hours there were
and the sums of what the reports average. Every column is a sum or a count, so two tables of different dates merge by adding
up: a new day costs a pass over that day. The table has at most a few rows per segment and hour
of day, whatever the length of the window, and no array in it.

`append` files the sums of a date range under its own name in a folder and refuses a range that is already there;
`stored` adds up all that the folder holds; `compact` replaces its parts by one.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens import fixed
from roadlens.functions import measures, timeaxis
from roadlens.functions.predicates import box_overlaps
from roadlens.operators.hours import road_hours
from roadlens.params import Box, Job
from roadlens.plans import speed_report

KEYS = ["dseg_id", "hour_utc", "hour_local", "is_weekend", "weekday_peak"]
POSITIONS = range(1, len(fixed.PERCENTILE_LEVELS) + 1)
SPEEDS = {"arithmetic": "avg_speed_kph", "median": "median_speed_kph", "spread": "spread"}
FLAGS = ["speeding", "congested"]


def _sums() -> dict[str, Column]:
    """Each column of the table as an aggregate over segment-hours."""
    known = lambda name: F.count(name)
    out = {"hours": F.count("*"), "lone_hours": F.count(F.when(F.col("p85_kph").isNull(), 1)),
           "bare_hours": F.count(F.when(F.col("speed_percentiles_kph").isNull(), 1)), "harmonic_sum": F.sum("harmonic_speed_kph")}
    for name, column in SPEEDS.items():
        out |= {f"{name}_sum": F.sum(column), f"{name}_hours": known(column)}
    for name in FLAGS:
        out |= {f"{name}_told": known(name), f"{name}_true": F.count(F.when(F.col(name), 1))}
    for p in POSITIONS:
        out[f"p{p}_sum"] = F.sum(measures.percentile_at(p))
    for p in (fixed.P15_POSITION, fixed.P85_POSITION):
        out[f"p{p}_hours"] = known(measures.percentile_at(p))
    return out


ADDED = ["hours", "lone_hours", "bare_hours", "harmonic_sum",
         *[f"{n}_{what}" for n in SPEEDS for what in ("sum", "hours")], *[f"{n}_{what}" for n in FLAGS for what in ("told", "true")],
         *[f"p{p}_sum" for p in POSITIONS], *[f"p{p}_hours" for p in (fixed.P15_POSITION, fixed.P85_POSITION)]]


def segment_hours(hourly: DataFrame, segments: DataFrame, job: Job) -> DataFrame:
    """The table of one window. A percentile array has all its positions, as published, or is NULL."""
    roads = segments.select(*[c for c in ("dseg_id", "tile_id", "region", "time_zone", "speed_limit_kph") if c in segments.columns])
    local = timeaxis.local_hours()
    hours = road_hours(hourly, roads, job).select(
        "dseg_id", "hour_utc", timeaxis.hour_of_day(local).alias("hour_local"),
        timeaxis.is_weekend(F.col("observation_date")).alias("is_weekend"), timeaxis.is_weekday_peak(local).alias("weekday_peak"),
        "avg_speed_kph", "median_speed_kph", "harmonic_speed_kph", measures.spread_ratio().alias("spread"),
        measures.speeding().alias("speeding"), measures.congested().alias("congested"), "p85_kph", "speed_percentiles_kph")
    return hours.groupBy(*KEYS).agg(*[column.alias(name) for name, column in _sums().items()])


def merged(*tables: DataFrame) -> DataFrame:
    """The sums over the dates of all tables; no date may be in two of them."""
    return reduce(DataFrame.unionByName, tables).groupBy(*KEYS).agg(*[F.sum(name).alias(name) for name in ADDED])


def _part(first: date, last: date) -> str:
    return f"dates={first.isoformat()}_{last.isoformat()}"


def parts(spark: SparkSession, folder: str) -> list[tuple[date, date]]:
    """The date ranges that the folder holds, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []
    ranges = [name.removeprefix("dates=").split("_") for name in names if name.startswith("dates=")]
    return sorted((date.fromisoformat(a), date.fromisoformat(b)) for a, b in ranges)


def append(spark: SparkSession, folder: str, hourly: DataFrame, segments: DataFrame, job: Job) -> None:
    """Add the dates of the job to the folder, from a pass over those dates alone.

    Raises ValueError when one of them is in the folder, so no hour is counted twice.
    """
    if job.first_date is None or job.last_date is None:
        raise ValueError("Appending needs the first and last date of the job.")
    taken = [r for r in parts(spark, folder) if r[0] <= job.last_date and job.first_date <= r[1]]
    if taken:
        raise ValueError(f"{folder} already holds dates of {taken}.")
    segment_hours(hourly, segments, job).write.parquet(f"{folder}/{_part(job.first_date, job.last_date)}")


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The sums over everything that was appended."""
    tables = [spark.read.parquet(f"{folder}/{_part(*r)}") for r in parts(spark, folder)]
    if not tables:
        raise ValueError(f"{folder} holds no dates. Append a window first.")
    return merged(*tables)


def compact(spark: SparkSession, folder: str, into: str) -> None:
    """Write the parts of `folder` as one part of the folder `into`; the old one can go when that is done."""
    ranges = parts(spark, folder)
    stored(spark, folder).write.parquet(f"{into}/{_part(ranges[0][0], max(r[1] for r in ranges))}")


# Reports ---------------------------------------------------------------


def _mean(total: str, count: str, keep: Column | None = None) -> Column:
    chosen = lambda name: F.col(name) if keep is None else F.when(keep, F.col(name))
    return F.try_divide(F.sum(chosen(total)), F.sum(chosen(count)))


def _percent(flag: str) -> Column:
    return 100.0 * F.try_divide(F.sum(f"{flag}_true"), F.sum(f"{flag}_told"))


def coverage_by_class(sums: DataFrame, segments: DataFrame) -> DataFrame:
    observed = sums.groupBy("dseg_id").agg(F.sum("hours").alias("hours"))
    rows = segments.select("dseg_id", "frc", "length_m", "speed_limit_kph").join(observed, "dseg_id", "left")
    return speed_report.class_coverage_of(rows)


def coverage_by_hour(sums: DataFrame) -> DataFrame:
    return speed_report.coverage_of_counters(sums.groupBy("dseg_id").agg(
        *[speed_report.hour_counter(hour, F.col("hours"), F.col("bare_hours")) for hour in range(24)]))


def three_averages(sums: DataFrame) -> DataFrame:
    return sums.agg(F.round(_mean("arithmetic_sum", "arithmetic_hours"), 1).alias("arithmetic_kph"),
                    F.round(_mean("median_sum", "median_hours"), 1).alias("median_kph"),
                    F.round(_mean("harmonic_sum", "hours"), 1).alias("harmonic_kph"))


def percentile_curve(sums: DataFrame) -> DataFrame:
    known = F.sum("hours") - F.sum("bare_hours")
    means = sums.agg(*[F.try_divide(F.sum(f"p{p}_sum"), known).alias(f"p{p}") for p in POSITIONS])
    rows = F.array(*[F.struct(F.lit(p).alias("position"), F.round(f"p{p}", 1).alias("speed_kph")) for p in POSITIONS])
    return means.select(F.inline(rows)).filter(F.col("speed_kph").isNotNull())


def congestion_ratio(sums: DataFrame, hour_column: str = "hour_utc") -> DataFrame:
    low, high = f"p{fixed.P15_POSITION}", f"p{fixed.P85_POSITION}"
    peak, night = F.col(hour_column).isin(fixed.PEAK_HOURS), F.col(hour_column).isin(fixed.NIGHT_HOURS)
    return sums.groupBy("dseg_id").agg(_mean(f"{low}_sum", f"{low}_hours", peak).alias("peak"),
                                       _mean(f"{high}_sum", f"{high}_hours", night).alias("night")) \
        .filter((F.col("night") > 0) & F.col("peak").isNotNull()).select("dseg_id", (F.col("peak") / F.col("night")).alias("ratio"))


def speed_by_class_hour(sums: DataFrame, segments: DataFrame, max_class: int = 4) -> DataFrame:
    roads = segments.filter(F.col("frc") <= max_class).select("dseg_id", "frc")
    return sums.select("dseg_id", "hour_local", "harmonic_sum", "hours").join(roads, "dseg_id").groupBy("hour_local", "frc").agg(
        F.round(_mean("harmonic_sum", "hours"), 1).alias("speed_kph"))


def speeding_by_hour(sums: DataFrame) -> DataFrame:
    return sums.groupBy("is_weekend", "hour_local").agg(F.round(_percent("speeding"), 1).alias("speeding_pct"))


def speeding_by_class(sums: DataFrame, segments: DataFrame) -> DataFrame:
    per_segment = sums.groupBy("dseg_id").agg(F.sum("speeding_true").alias("speeding_true"), F.sum("speeding_told").alias("speeding_told"))
    return per_segment.join(segments.select("dseg_id", "frc"), "dseg_id").groupBy("frc").agg(
        F.round(_percent("speeding"), 1).alias("speeding_pct"))


def cell_congestion(sums: DataFrame, segments: DataFrame, box: Box | None = None, min_segments: int = 3) -> DataFrame:
    per_segment = sums.groupBy("dseg_id").agg(
        _mean("harmonic_sum", "hours").alias("speed"), _percent("congested").alias("congested"),
        _percent("speeding").alias("speeding"), F.sum("speeding_told").alias("told"))
    roads = segments if box is None else segments.filter(box_overlaps(box))
    return speed_report.congestion_of_cells(
        per_segment.filter("told > 0").join(roads.select("dseg_id", "h3_r9", "length_m"), "dseg_id"), min_segments)


def road_signals(sums: DataFrame, segments: DataFrame, cell: Column) -> DataFrame:
    """The signals of every measured segment with a limit, as `territory.road_signals` gives them from the hours."""
    roads = segments.filter(F.col("speed_limit_kph") > 0).select("dseg_id", cell.alias("cell"), "length_m")
    return sums.groupBy("dseg_id").agg(
        _mean("harmonic_sum", "hours").alias("mean_speed_kph"),
        _mean("harmonic_sum", "hours", F.col("weekday_peak")).alias("peak_speed_kph"),
        _mean("spread_sum", "spread_hours").alias("speed_spread"), _percent("congested").alias("congested_hours_pct"),
        _percent("speeding").alias("speeding_hours_pct"),
        (100.0 * F.try_divide(F.sum("lone_hours"), F.sum("hours"))).alias("single_observation_pct")).join(roads, "dseg_id")

"""The table of sums against the hours, and tables laid out by segment: rows and plans."""

import re
import uuid
from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from roadlens.functions import grid
from roadlens.operators.hours import measured
from roadlens.params import Job
from roadlens.plans import segment_hours as sums
from roadlens.plans import speed_report, territory
from roadlens.sources import colocated
from roadlens.sources.tables import RoadTables
from tests import frames
from tests.test_plans import plan, scans

JOB = Job(first_date=date(2025, 10, 20), last_date=date(2025, 10, 27))      # British clocks change on the 26th
LEVEL = grid.LEVEL_FOR_RESOLUTION[9]


def road_frames(spark):
    """Two weeks around a clock change: NULL cells, roads without a limit, thin and zero hours, unknown averages."""
    roads, hours = [], []
    for key in range(40):
        roads.append(frames.segment(key, limit=None if key % 9 == 0 else 30.0 + key % 4 * 10, length=50.0 + key, frc=key % 6,
                                    cell=None if key % 8 == 3 else f"8928308280{key % 5}ffff", lon=-0.1 + key % 3 / 100,
                                    zone="America/Chicago" if key % 3 == 0 else "Europe/London"))
        for day in range(18, 30):
            for hour in range(key % 4, 24, 3):
                row = list(frames.hour(key, date(2025, 10, day), hour, harmonic=float((key * 7 + day * 3 + hour) % 50), stddev=float(hour),
                                       percentiles=None if (key + hour) % 5 == 0 else frames.curve(10.0 + (key + day) % 20)))
                if hour % 11 == 0:
                    row[3] = row[5] = None                       # arithmetic and median unknown
                hours.append(tuple(row))
    return frames.hours(spark, *hours), frames.segments(spark, *roads)


REPORTS = {
    "coverage_by_class": (lambda h, r, m: speed_report.coverage_by_class(h, r, JOB), lambda s, r: sums.coverage_by_class(s, r)),
    "coverage_by_hour": (lambda h, r, m: speed_report.coverage_by_hour(h, r, JOB), lambda s, r: sums.coverage_by_hour(s)),
    "three_averages": (lambda h, r, m: speed_report.three_averages(m), lambda s, r: sums.three_averages(s)),
    "percentile_curve": (lambda h, r, m: speed_report.percentile_curve(m), lambda s, r: sums.percentile_curve(s)),
    "congestion_ratio": (lambda h, r, m: speed_report.congestion_ratio(m), lambda s, r: sums.congestion_ratio(s)),
    "local congestion_ratio": (lambda h, r, m: speed_report.congestion_ratio(m, "hour_local"), lambda s, r: sums.congestion_ratio(s, "hour_local")),
    "speed_by_class_hour": (lambda h, r, m: speed_report.speed_by_class_hour(m), lambda s, r: sums.speed_by_class_hour(s, r)),
    "speeding_by_hour": (lambda h, r, m: speed_report.speeding_by_hour(m), lambda s, r: sums.speeding_by_hour(s)),
    "speeding_by_class": (lambda h, r, m: speed_report.speeding_by_class(m), lambda s, r: sums.speeding_by_class(s, r)),
    "cell_congestion": (lambda h, r, m: speed_report.cell_congestion(m), lambda s, r: sums.cell_congestion(s, r)),
    "road_signals": (lambda h, r, m: territory.road_signals(h, r, JOB, grid.cell_of_box(LEVEL)), lambda s, r: sums.road_signals(s, r, grid.cell_of_box(LEVEL)))}


def same(left, right):
    assert sorted(left.columns) == sorted(right.columns)
    key = lambda row: [(v is None, v if not isinstance(v, float) else round(v, 6)) for v in row]
    a, b = (sorted((tuple(r) for r in f.select(*sorted(left.columns)).collect()), key=key) for f in (left, right))
    assert len(a) == len(b) > 0
    for one, other in zip(a, b):
        assert all(x == y or (isinstance(x, float) and x == pytest.approx(y, abs=1e-9)) for x, y in zip(one, other)), (one, other)


@pytest.fixture(scope="module")
def stored_sums(spark, tmp_path_factory):
    hours, roads = road_frames(spark)
    folder = f"file://{tmp_path_factory.mktemp('sums')}"
    for first, last in (((10, 20), (10, 23)), ((10, 24), (10, 26)), ((10, 27), (10, 27))):
        sums.append(spark, folder, hours, roads, replace(JOB, first_date=date(2025, *first), last_date=date(2025, *last)))
    return folder


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_reports_from_sums_equal_those_from_hours(spark, stored_sums, name):
    """The sums were added three windows at a time; the reports from the hours read all days at once."""
    hours, roads = road_frames(spark)
    from_hours, from_sums = REPORTS[name]
    same(from_hours(hours, roads, measured(hours, roads, JOB)), from_sums(sums.stored(spark, stored_sums), roads))


def test_added_days_equal_a_rebuild(spark, stored_sums, tmp_path):
    hours, roads = road_frames(spark)
    whole = sums.segment_hours(hours, roads, JOB)
    same(whole, sums.stored(spark, stored_sums))
    sums.compact(spark, stored_sums, f"file://{tmp_path}/one")
    assert sums.parts(spark, f"file://{tmp_path}/one") == [(date(2025, 10, 20), date(2025, 10, 27))]
    same(whole, sums.stored(spark, f"file://{tmp_path}/one"))


def test_no_day_is_added_twice(spark, stored_sums):
    hours, roads = road_frames(spark)
    with pytest.raises(ValueError, match="already holds"):
        sums.append(spark, stored_sums, hours, roads, replace(JOB, first_date=date(2025, 10, 25), last_date=date(2025, 10, 30)))
    with pytest.raises(ValueError, match="holds no dates"):
        sums.stored(spark, f"{stored_sums}-of-nothing")


def test_one_pass_over_the_hours(spark, tmp_path):
    hours, roads = road_frames(spark)
    hours.write.partitionBy("observation_date").parquet(str(tmp_path / "hours"))
    text = plan(sums.segment_hours(spark.read.parquet(str(tmp_path / "hours")), roads, JOB))
    assert len(scans(text)) == 1 and "Expand" not in text


def test_coverage_by_hour_shuffles_one_row_a_segment(spark):
    hours, roads = road_frames(spark)
    text = plan(speed_report.coverage_by_hour(hours, roads, JOB))
    tree = text.split("\n\n")[0]
    assert "Expand" not in text and not re.search(r"Generate.*\n.*Exchange", tree)
    below = tree[tree.rindex("HashAggregate"):]
    assert "Join" not in below                       # hours are added up before anything is joined
    assert measured(hours, roads, JOB).select("dseg_id").distinct().count() <= 40


def test_narrow_reports_leave_the_array_below_the_join(spark, tmp_path):
    hours, roads = road_frames(spark)
    hours.write.parquet(str(tmp_path / "hours"))
    roads.write.parquet(str(tmp_path / "roads"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        h, r = (spark.read.parquet(str(tmp_path / n)) for n in ("hours", "roads"))
        for report in (speed_report.speeding_by_class(measured(h, r, JOB)), speed_report.cell_congestion(measured(h, r, JOB)),
                       territory.road_signals(h, r, JOB, grid.cell_of_box(LEVEL))):
            moved = [p for p in plan(report).split("\n\n") if re.match(r"\n*\(\d+\) Exchange", p)]
            assert moved and not any("speed_percentiles_kph" in p for p in moved)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def laid_out(spark, tmp_path_factory):
    hours, roads = road_frames(spark)
    tag, root, layout = uuid.uuid4().hex, tmp_path_factory.mktemp("laid"), colocated.Layout(buckets=4)
    names = f"roads_{tag}", f"hours_{tag}"
    colocated.write_segments(roads, names[0], layout, f"file://{root}/roads")
    colocated.write_hours(hours.filter("observation_date < '2025-10-25'"), names[1], layout, f"file://{root}/hours")
    colocated.write_hours(hours.filter("observation_date >= '2025-10-25'"), names[1], layout, f"file://{root}/hours", append=True)
    return names, root, layout


def test_tables_laid_out_alike_meet_without_a_shuffle(spark, laid_out):
    (roads, hours), _, _ = laid_out
    tables = colocated.colocated_tables(spark, roads, hours)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = measured(tables.hourly, tables.segments, JOB)
        text = plan(df)
        assert "SortMergeJoin" in text and "Exchange" not in text and "Bucketed: true" in text
        assert "2025-10-20" in next(p for p in scans(text) if "observation_date" in p)
        # One group-by per segment needs no shuffle either; only the cells do.
        tree = plan(speed_report.cell_congestion(df)).split("\n\n")[0]
        assert len(re.findall(r"Exchange", tree)) == 1
        counters = plan(speed_report.coverage_by_hour(tables.hourly, tables.segments, JOB)).split("\n\n")[0]
        assert len(re.findall(r"Exchange", counters)) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plain_hours, plain_roads = road_frames(spark)
    same(df, measured(plain_hours, plain_roads, JOB))


def test_layout_is_recognised_and_attached(spark, laid_out):
    (roads, hours), root, layout = laid_out
    assert colocated.bucketing(spark, hours) == (4, ["dseg_id"])
    other = f"again_{uuid.uuid4().hex}"
    colocated.attach(spark, other, f"file://{root}/hours", layout, spark.table(hours), hours=True)
    assert colocated.bucketing(spark, other) == (4, ["dseg_id"])
    assert spark.table(other).count() == spark.table(hours).count() == road_frames(spark)[0].count()
    plain = f"plain_{uuid.uuid4().hex}"
    road_frames(spark)[1].write.format("parquet").option("path", f"file://{root}/plain").saveAsTable(plain)
    with pytest.raises(ValueError, match="not laid out alike"):
        colocated.colocated_tables(spark, plain, hours)


def test_a_date_and_bucket_is_one_file(spark, laid_out):
    _, root, _ = laid_out
    for day in root.glob("hours/observation_date=*"):
        buckets = [re.search(r"_(\d{5})\.c000", f.name)[1] for f in day.glob("*.parquet")]
        assert len(buckets) == len(set(buckets)) <= 4


def test_tiles_prune_the_hours_while_the_job_runs(spark, tmp_path):
    hours, roads = road_frames(spark)
    tiled = lambda df: df.withColumn("tile_id", F.col("dseg_id") % 4)
    tiled(hours).write.partitionBy("tile_id", "observation_date").parquet(str(tmp_path / "hours"))
    tiled(roads).withColumn("region", F.when(F.col("tile_id") == 2, "austin").otherwise("london")).write.parquet(str(tmp_path / "roads"))
    job = replace(JOB, region="austin")
    h, r = (spark.read.parquet(str(tmp_path / n)) for n in ("hours", "roads"))
    text = plan(measured(h, r, job))
    fact = next(p for p in scans(text) if "harmonic_speed_kph" in p)
    assert re.search(r"PartitionFilters: \[.*tile_id.*dynamicpruning", fact)
    cut = colocated.cut_by_tiles(RoadTables(segments=r.filter("region = 'austin'"), hourly=h))
    assert "dynamicpruning" in plan(cut.hourly.groupBy("hour_utc").count())
    same(measured(h, r, job), measured(hours, roads.filter("dseg_id % 4 = 2"), JOB))


def test_files_do_not_multiply_with_the_tiles(spark, tmp_path):
    name, days, places = f"tiled_{uuid.uuid4().hex}", 2, 3 * colocated.TILE_FOLDERS
    roads = frames.segments(spark, *[frames.segment(k) for k in range(places)]).withColumn("tile_id", F.col("dseg_id") * 7)
    hours = frames.hours(spark, *[frames.hour(k, date(2025, 9, 1 + d)) for k in range(places) for d in range(days)]) \
        .withColumn("tile_id", F.when(F.col("dseg_id") != 5, F.col("dseg_id") * 7))
    colocated.write_hours(hours, name, colocated.Layout(buckets=2, by_tile=True), f"file://{tmp_path}/hours")
    assert len(list(tmp_path.glob("hours/*/*/*.parquet"))) <= (colocated.TILE_FOLDERS + 1) * days * 2
    roads.withColumn("region", F.when(F.col("dseg_id") % 48 < 6, "austin").otherwise("london")).write.parquet(f"{tmp_path}/roads")
    austin = spark.read.parquet(f"{tmp_path}/roads").filter("region = 'austin'")
    cut = colocated.cut_by_tiles(RoadTables(segments=austin, hourly=spark.table(name))).hourly
    text = plan(cut.groupBy("hour_utc").count())
    assert re.search(r"PartitionFilters: \[.*tile_folder.*dynamicpruning", text)
    same(cut.select(*hours.columns), hours.filter("dseg_id % 48 < 6 AND dseg_id != 5"))

"""What the physical plans must and must not contain."""

import contextlib
import io
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from roadlens.operators.hours import measured
from roadlens.params import Box, Job
from roadlens.plans import map_report, risk, speed_report, volume_report
from roadlens.session import durable
from roadlens.sources.tables import RoadTables, catalog_table, require_slice
from tests import frames

JOB = Job(region="london", first_date=date(2025, 9, 1), last_date=date(2025, 9, 7), vintage_year=2025)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Road tables on disk, the hours laid out by date."""
    root = tmp_path_factory.mktemp("roads")
    frames.segments(spark, *[frames.segment(k) for k in range(50)], frames.segment(99, region="austin")) \
        .write.parquet(str(root / "segments"))
    frames.hours(spark, *[frames.hour(k, date(2025, 9, d), percentiles=frames.curve(40.0))
                          for k in range(50) for d in range(1, 12)]) \
        .write.partitionBy("observation_date").parquet(str(root / "hourly"))
    frames.volumes(spark, *[frames.volume(k) for k in range(50)]).write.parquet(str(root / "volumes"))
    return RoadTables.from_parquet(spark, {name: str(root / name) for name in ("segments", "hourly", "volumes")})


def plan(df) -> str:
    """The formatted plan: the tree first, then one paragraph per operator."""
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def scans(text: str) -> list[str]:
    return [part for part in text.split("\n\n") if re.match(r"\n*\(\d+\) Scan parquet", part)]


def test_filters_and_columns_reach_the_scan(tables):
    text = plan(speed_report.three_averages(measured(tables.hourly, tables.segments, JOB)))
    assert "GreaterThan(harmonic_speed_kph,0.0)" in text and "EqualTo(region,london)" in text
    hours = next(part for part in scans(text) if "harmonic_speed_kph" in part)
    assert re.search(r"PartitionFilters: \[.*observation_date.*2025-09-01.*2025-09-07", hours)
    assert "speed_percentiles_kph" not in hours  # not needed for three averages


def test_date_window_prunes_files(tables):
    df = measured(tables.hourly, tables.segments, JOB)
    assert df.count() == 50 * 7


def test_box_reaches_the_scan(tables):
    text = plan(speed_report.major_roads_in(tables.segments, Box(-1, 51, 1, 52)))
    assert "GreaterThanOrEqual(max_lon,-1.0)" in text and "TakeOrderedAndProject" not in text


def test_hot_path_stays_in_the_jvm(tables):
    text = plan(risk.risky_km_by_slot(risk.cell_slot_km(tables, JOB)))
    assert "Python" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_week_is_not_exploded_before_the_shuffle(tables):
    """Seven rows per road go into the partial aggregate, not 168."""
    text = plan(risk.cell_week(tables.volumes, JOB))
    days = text.index("explode(")
    hours = text.index("inline(")
    shuffle = re.search(r"\(\d+\) Exchange\n", text).start()
    assert days < shuffle < hours and text.count("explode(") == 1


def test_local_time_is_converted_once(tables):
    """No NULL check on the slot is pushed below the aggregate, where it would convert time again."""
    text = plan(risk.cell_slot_km(tables, JOB))
    lines = [line for line in text.splitlines() if "from_utc_timestamp" in line]
    assert lines and not [line for line in lines if "ondition" in line.split(":")[0]]


def test_joins_meet_one_row_per_cell(tables):
    """Both sides are aggregated before the join, and hours are joined to roads only once."""
    text = plan(risk.cell_slot_km(tables, JOB))
    assert len(re.findall(r"\+?-? ?(?:BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin) ", text)) >= 1
    assert len(scans(text)) == 3


def test_large_dimension_is_not_broadcast(spark, tables):
    """The side to broadcast is chosen by its size: with none allowed both sides are shuffled."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(speed_report.speeding_by_class(measured(tables.hourly, tables.segments, JOB)))
        assert "SortMergeJoin" in text and "Broadcast" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_growth_needs_no_self_join(spark, tables):
    coverage = spark.createDataFrame([("london", 2024, 3, 50.0, 25.0)],
                                     "region string, vintage_year int, frc int, total_length_m double, covered_length_m double")
    text = plan(volume_report.vintage_growth(tables.volumes, coverage, 2024, 2025))
    assert len(scans(text)) == 1


def test_map_reads_only_the_fields_it_needs(spark, tmp_path):
    spark.sql("""SELECT 'london' AS region, 'a' AS id, 'road' AS subtype, 'trunk' AS class,
        named_struct('xmin', 0D, 'ymin', 0D, 'xmax', 1D, 'ymax', 1D) AS bbox, X'00' AS geometry,
        named_struct('primary', 'x', 'other', 'y') AS names""").write.parquet(str(tmp_path / "m"))
    df = map_report.roads_inside(spark.read.parquet(str(tmp_path / "m")), Box(0, 0, 1, 1), ["trunk"])
    text = plan(df)
    assert "GreaterThanOrEqual(bbox.xmax,0.0)" in text and "names" not in scans(text)[0]
    assert df.count() == 1


def test_checkpoints_survive_their_source(spark):
    df = durable(spark.range(10).withColumn("p", F.spark_partition_id()))
    assert df.count() == 10 and "Range" not in plan(df)


def test_preconditions_name_the_remedy(spark):
    with pytest.raises(ValueError, match="SHOW CATALOGS"):
        catalog_table(spark, "nowhere.hourly")
    with pytest.raises(ValueError, match="region 'atlantis', vintage 2025"):
        require_slice(frames.segments(spark), Job(region="atlantis", vintage_year=2025), "segments")
    with pytest.raises(ValueError, match="sector, district"):
        Job(postcode_level="street")
    with pytest.raises(ValueError, match="ends"):
        Job(first_date=date(2025, 9, 2), last_date=date(2025, 9, 1))


def test_slice_restricts_every_table(tables):
    cut = tables.slice(Job(region="austin"))
    assert cut.segments.count() == 1 and cut.volumes.count() == 0 and cut.coverage is None

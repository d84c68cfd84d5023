"""Running totals, ranks, quantiles and nearest cells against brute force, hot keys included."""

import contextlib
import io
import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadlens.functions import metric
from roadlens.operators import ordered
from roadlens.operators.nearest import nearest_within


def frame():
    """Three groups; a third of all rows share one value."""
    rng = np.random.default_rng(5)
    n = 900
    value = rng.integers(0, 60, n).astype(float)
    value[: n // 3] = 30.0
    return pd.DataFrame({"g": rng.choice(["a", "b", "c"], n, p=[0.8, 0.15, 0.05]), "key": np.arange(n),
                         "value": value, "weight": rng.integers(0, 9, n).astype(float)})


def test_running_totals(spark):
    pdf = frame()
    df = spark.createDataFrame(pdf).repartition(5)
    got = ordered.running_totals(df, [F.desc("value"), F.asc("key")], {"total": "weight"}, ["g"], parts=7) \
        .toPandas().sort_values("key").reset_index(drop=True)
    want = pdf.sort_values(["value", "key"], ascending=[False, True])
    want["total"] = want.groupby("g").weight.cumsum()
    assert np.allclose(got.total, want.sort_values("key").total)


def test_average_ranks(spark):
    pdf = frame()
    got = ordered.average_ranks(spark.createDataFrame(pdf), ["g"], "value", "rank").toPandas().sort_values("key")
    assert np.allclose(got["rank"].to_numpy(), pdf.groupby("g").value.rank().to_numpy())


@pytest.mark.parametrize("groups", [["g"], []])
def test_quantiles(spark, groups):
    pdf = frame()
    shares = {"q0": 0.0, "q1": 0.25, "mid": 0.5, "q9": 0.9, "end": 1.0}
    got = ordered.exact_quantiles(spark.createDataFrame(pdf), groups, "value", shares).toPandas()
    if groups:
        got = got.set_index("g").sort_index()
        want = pdf.groupby("g").value.quantile(list(shares.values())).unstack()
        assert np.allclose(got[list(shares)].to_numpy(), want.to_numpy())
    else:
        assert np.allclose(got[list(shares)].to_numpy()[0], pdf.value.quantile(list(shares.values())).to_numpy())


def test_rank_correlation_leaves_out_missing_pairs(spark):
    pdf = frame()[["key", "value", "weight"]]
    pdf.loc[::7, "weight"] = None
    df = spark.createDataFrame(pdf.replace({np.nan: None}), "key long, value double, weight double")
    got = ordered.rank_correlation(df, "key", "value", ["weight"]).first().correlation
    both = pdf.dropna()
    assert got == pytest.approx(np.corrcoef(both.value.rank(), both.weight.rank())[0, 1])


def test_summary(spark):
    pdf = frame()
    got = ordered.summary(spark.createDataFrame(pdf), ["value", "weight"]).toPandas().set_index("feature")
    want = pdf[["value", "weight"]].describe().T
    assert np.allclose(got.loc[want.index, ["count", "mean", "std", "min", "q1", "median", "q3", "max"]]
                       .to_numpy().astype(float), want.to_numpy())


def test_nearest_against_brute_force(spark):
    """A third of the points sit on one spot; targets lie on a grid with gaps, negative sides too."""
    rng = np.random.default_rng(3)
    targets = [(i, float(x), float(y)) for i, (x, y) in enumerate(
        (x, y) for x in range(-4000, 4000, 400) for y in range(-4000, 4000, 500)) if i % 3]
    points = [(i, 120.0, 80.0) if i % 3 == 0 else (i, *rng.uniform(-7000, 7000, 2)) for i in range(300)]
    t = spark.createDataFrame([(i, x, y, f"p{i % 7}") for i, x, y in targets],
                              "cell long, easting double, northing double, postcode string")
    p = spark.createDataFrame([(i, float(x), float(y)) for i, x, y in points],
                              "id long, easting double, northing double")
    got = {r.id: r.postcode for r in nearest_within(p, t, ["id"], 1500.0, ["postcode"], "cell").collect()}
    want = {}
    for i, x, y in points:
        best = min((math.sqrt((x - a) ** 2 + (y - b) ** 2), cell) for cell, a, b in targets)
        if best[0] < 1500:
            want[i] = f"p{best[1] % 7}"
    assert got == want


def test_reach_is_exclusive_and_ties_go_to_the_smaller_cell(spark):
    t = spark.createDataFrame([(9, 0.0, 0.0, "nine"), (4, 200.0, 0.0, "four")],
                              "cell long, easting double, northing double, postcode string")
    p = spark.createDataFrame([(1, -1500.0, 0.0), (2, 100.0, 0.0), (3, -1499.0, 0.0)],
                              "id long, easting double, northing double")
    got = {r.id: r.postcode for r in nearest_within(p, t, ["id"], 1500.0, ["postcode"], "cell").collect()}
    assert got == {2: "four", 3: "nine"}


def test_candidates_of_a_point_are_not_sorted(spark):
    """A point leaves the join with its neighbour; the candidates, hundreds a point, stay inside an array."""
    t = spark.range(40_000).selectExpr("id AS cell", "double(id % 200 * 10) AS easting", "double(id div 200 * 10) AS northing",
                                       "concat('p', id) AS postcode")
    p = spark.createDataFrame([(1, 333.0, 777.0), (2, 3300.0, 500.0), (3, 3490.0, 500.0), (4, None, 0.0), (1, 331.0, 774.0)],
                              "id long, easting double, northing double")
    near = nearest_within(p, t, ["id"], 1500.0, ["postcode"], "cell")
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        near.explain("formatted")
    sorts = [part for part in text.getvalue().split("\n\n") if re.match(r"\n*\(\d+\) Sort\b", part)]
    assert sorts and not any("_tie#" in part for part in sorts)
    # Keys that come twice share one row, the nearer of both; the second point is served by the wide squares only.
    assert sorted((r.id, r.postcode, round(r.distance_m, 3)) for r in near.collect()) \
        == [(1, "p15433", round(17 ** 0.5, 3)), (2, "p10199", 1310.0)]


def test_local_plane(spark):
    df = metric.local_plane(50.0)(spark.createDataFrame([(1.0, 50.0), (0.0, 50.0)], "lon double, lat double"))
    a, b = df.collect()
    assert a.easting - b.easting == pytest.approx(71_474, rel=1e-2)


def test_points_move_once_to_their_square_and_not_after(spark):
    """One exchange by square serves close and far points; with `each_row` none follows the search."""
    t = spark.createDataFrame([(1, 0.0, 0.0, "a"), (2, 1000.0, 0.0, "b")], "cell long, easting double, northing double, postcode string")
    p = spark.createDataFrame([(5, 10.0, 0.0), (5, 999.0, 0.0), (6, -1400.0, 0.0), (7, 9000.0, 0.0), (8, None, 0.0)],
                              "month int, easting double, northing double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = nearest_within(p, t, ["month"], 1500.0, ["postcode"], "cell", each_row=True)
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            near.explain("simple")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = text.getvalue().splitlines()
    exchanges = [line for line in lines if "Exchange hashpartitioning" in line]
    assert sum("Join" in line for line in lines) == 1
    # The points once; the targets once by small square and once as candidates of the wide ones.
    assert len(exchanges) == 3
    assert sorted((r.month, r.postcode, r.distance_m) for r in near.collect()) == [(5, "a", 10.0), (5, "b", 1.0), (6, "a", 1400.0)]


def test_targets_move_by_tile_and_are_copied_where_they_arrive(spark):
    """The exchanges are by tile, so the nine copies of a target do not move; borders of tiles, negative sides too, hide none."""
    rng = np.random.default_rng(8)
    targets = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-15000, 15000, (250, 2)))]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([
        rng.uniform(-16000, 16000, (250, 2)), rng.choice([-12012.0, -6006.0, 0.0, 6006.0], (50, 2)) + rng.uniform(-3, 3, (50, 2))]))]
    t = spark.createDataFrame([(i, x, y, f"p{i}") for i, x, y in targets], "cell long, easting double, northing double, postcode string")
    p = spark.createDataFrame(points, "id long, easting double, northing double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = nearest_within(p, t, ["id"], 1500.0, ["postcode"], "cell", each_row=True)
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            near.explain("simple")
        got = {r.id: r.postcode for r in near.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    exchanges = [line for line in text.getvalue().splitlines() if "Exchange hashpartitioning" in line]
    assert not any("(_we#" in line for line in exchanges) and sum("(_tile#" in line or "(_home#" in line for line in exchanges) == 2
    want = {}
    for i, x, y in points:
        distance, cell = min((math.sqrt((x - a) ** 2 + (y - b) ** 2), cell) for cell, a, b in targets)
        if distance < 1500:
            want[i] = f"p{cell}"
    assert got == want

"""Two-level scans against whole histories, and nearest points against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvio.operators import nearest, scans, verify


def km(a, b):
    lat1, lon1, lat2, lon2 = (np.radians(x) for x in (a[:, None, 0], a[:, None, 1], b[None, :, 0], b[None, :, 1]))
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * np.arcsin(np.sqrt(h))


def test_nearest_of_ten_thousand(spark):
    r = np.random.default_rng(0)
    n = 10_000
    places = np.stack([np.degrees(np.arcsin(r.uniform(-1, 1, n))), r.uniform(-180, 180, n)], 1)
    points = np.stack([np.degrees(np.arcsin(r.uniform(-1, 1, n))), r.uniform(-180, 180, n)], 1)
    points[: n // 3] = [51.5, -0.1] + 0.01 * r.standard_normal((n // 3, 2))  # a third in one town
    points[:50] = points[0]  # and some at one place
    places[:6] = [[90, 0], [-90, 70], [0.1, 179.99], [0.1, -179.99], [51.5, -0.1], [89.9, -100]]
    a = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(places)], "location_id long, lat double, lon double")
    b = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "station long, s_lat double, s_lon double")
    out = verify.nearest_station(a, b)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = {x.location_id: (x.station, x.km) for x in out.collect()}
    assert len(got) == n
    for low in range(0, n, 1000):
        d = km(places[low : low + 1000], points)
        for i, row in enumerate(d):
            station, dist = got[low + i]
            assert dist == pytest.approx(row.min(), abs=1e-6) and row[station] == pytest.approx(row.min(), abs=1e-6)
            if (points[station] == points[0]).all():
                assert station == 0  # of equal ones the least


@pytest.mark.parametrize("levels", [1, 3, 9])
def test_nearest_of_few_and_odd_rows(spark, levels):
    a = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 0.0), (2, None, 0.0), (3, -90.0, 10.0)], "location_id long, lat double, lon double")
    b = spark.createDataFrame([(9, 0.0, 1.0), (8, 0.0, -1.0), (7, None, None), (6, -89.0, 0.0)], "station long, s_lat double, s_lon double")
    got = sorted((r.location_id, r.station) for r in nearest.nearest(a, b, "location_id", "station", levels).collect())
    assert got == [(1, 8), (3, 6)]
    assert nearest.nearest(a, b.limit(0), "location_id", "station", levels).count() == 0


@pytest.mark.parametrize("bucket_s", [1, 7, 40, 10**9])
def test_scans_do_not_depend_on_buckets(spark, bucket_s):
    r = random.Random(2)
    events = [(k, i, r.randrange(-50, 200)) for i, k in enumerate([*("a" for _ in range(80)), *("b" for _ in range(30)), None, None])]
    states = [(k, r.randrange(-50, 200), r.choice([None, float(i)])) for i, k in enumerate(["a"] * 12 + ["b"] * 2 + ["c", None])]
    states = list({(k, t): (k, t, v) for k, t, v in states}.values())
    e = spark.createDataFrame(events, "k string, id int, t int")
    s = spark.createDataFrame(states, "k string, t int, v double")
    got = {x.id: x.v for x in scans.as_of(e, s, "k", "t", "t", "v", bucket_s).collect()}
    want = {}
    for k, i, t in events:
        known = [(u, v) for q, u, v in states if q == k and u <= t and v is not None]
        want[i] = max(known)[1] if known else None
    assert got == want
    out = scans.running_sum(e, "k", "t", ["t", "id"], F.col("id"), "total", bucket_s).collect()
    assert {x.id: x.total for x in out} == {i: sum(j for q, j, u in events if q == k and (u, j) <= (t, i)) for k, i, t in events}


def test_runs_of_misses_cross_buckets(spark):
    rows = [(i, "s", i * 400_000, False, i not in (4, 9)) for i in range(14)]
    df = spark.createDataFrame(rows, "event_id int, station string, t long, predicted boolean, observed boolean")
    got = sorted((r.length, r.first_t // 400_000, r.last_t // 400_000) for r in verify.miss_runs(df).collect())
    assert got == [(4, 0, 3), (4, 5, 8), (4, 10, 13)]


def test_cells_by_position_lend_their_scores(spark):
    from pluvio.operators import qc

    rows = [(0, 0, 2, 1, 50.0, 0.9), (0, 0, 1, 1, 1.0, 0.2), (0, 3, 1, 1, 200.0, 0.5), (1, 0, 5, 1, 7.0, 0.5)]
    df = spark.createDataFrame(rows, "session_id long, root_frame long, root_label int, location_id long, speed_kmh double, mean_conf double")
    got = {(r.session_id, r.label): (r.speed_kmh, r.cell_conf) for r in qc.by_position(df).collect()}
    assert got == {(0, 1): (1.0, 0.2), (0, 2): (50.0, 0.9), (0, 3): (200.0, 0.5), (1, 1): (7.0, 0.5)}

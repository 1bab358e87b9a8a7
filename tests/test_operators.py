import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meridia.operators import expectations as E
from meridia.operators import exposure, payload, schedule, shadow, spatial, weather


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_added_dates_win_over_removed_ones(spark):
    day = lambda n: dt.date(2026, 6, n)
    week = [True] * 5 + [False] * 2
    names = "monday tuesday wednesday thursday friday saturday sunday".split()
    schema = "service_id string, start_date date, end_date date, " + ", ".join(f"{n} boolean" for n in names)
    calendar = spark.createDataFrame([("W", day(22), day(28), *week), ("backwards", day(28), day(22), *week)], schema)
    changes = spark.createDataFrame([("W", day(24), 2), ("W", day(28), 1), ("W", day(25), 1), ("W", day(25), 2)], "service_id string, date date, exception_type int")
    found = schedule.service_dates(schedule.calendar_days(calendar, "service_id"), changes, "service_id")
    assert [r[1].day for r in rows(found)] == [22, 23, 25, 26, 28]
    assert {r[1] for r in rows(schedule.service_days(found, "service_id"))} == {"Monday", "Tuesday", "Thursday", "Friday", "Sunday"}
    assert rows(schedule.service_dates(None, changes, "service_id")) == [("W", day(25)), ("W", day(28))]


def test_waits_of_two_lines(spark):
    at = lambda line, *times: [("S1", line, h, h * 3600 + m * 60) for h, m in times]
    data = at("A", (13, 0), (13, 10), (13, 30), (17, 0)) + at("B", (13, 5), (13, 15))
    got = schedule.waits(spark.createDataFrame(data, "stop_id string, route_id string, raw_hour int, seconds int"))
    assert rows(got) == [("S1", 13, 6.3, 2, 12.5, 5.0, 7.5)]
    mixed = schedule.mixed_waits(got).first()
    assert (mixed.sync_share, mixed.wait_mixed_minutes, mixed.wait_time_bucket) == (0.5, 4.125, "low")


def test_risk_of_two_stops(spark):
    def hours(stop, kinds, shelter):
        return [(stop, 13 + i, k == "b", k == "t", shelter, k == "s" and not shelter) for i, k in enumerate(kinds)]

    schema = "osm_node_id string, hour int, in_building_shadow boolean, in_tree_shadow boolean, has_shelter boolean, exposed boolean"
    hourly = exposure.scored(spark.createDataFrame(hours("P", "sssstbb", True) + hours("Q", "sssssss", False), schema))
    sensitivity = exposure.risk_sensitivity(hourly)
    scores = {(r.osm_node_id, r.shelter_factor): r.exposure_score_hours for r in sensitivity.collect()}
    assert [scores["P", f] for f in (0.0, 0.25, 0.5, 0.75, 1.0, 1.2)] == [0.03, 1.03, 2.03, 3.03, 4.03, 4.83]
    trees = spark.createDataFrame([("P", 3)], "osm_node_id string, n_trees_20m long")
    p, q = sorted(exposure.heat_risk(hourly, sensitivity, trees).collect(), key=lambda r: r.osm_node_id)
    assert (p.exposure_score_hours, p.risk_level, p.risk_level_binary, p.risk_level_stable, p.tree_shade_hours, p.n_trees_20m) == (2.03, "medium", "low", False, 1, 3)
    assert (q.exposure_score_hours, q.risk_level, q.risk_level_binary, q.risk_level_stable, q.n_trees_20m) == (7.0, "high", "high", True, None)


def test_bridge(spark):
    stops = spark.createDataFrame([("a", "1", 45.46, 9.19), ("b", "2", 45.46, 9.29), ("c", None, 45.47, 9.2), ("d", "5", 45.46, 9.39), ("e", None, None, None)], "id string, ref string, lat double, lon double")
    others = spark.createDataFrame(
        [("1", 45.461, 9.19), ("2", 45.462, 9.29), ("3", 45.4702, 9.2), ("4", 45.4698, 9.2), ("5", 45.462, 9.39), ("6", 45.46, 9.3902), ("6", 45.46, 9.3902), ("7", None, None)],
        "stop_id string, lat double, lon double",
    )
    got = {r[0]: r[1:3] for r in rows(spatial.stop_bridge(stops, others))}
    assert got == {"a": ("1", "ref"), "b": (None, "unmatched"), "c": ("3", "nearest"), "d": ("6", "nearest"), "e": (None, "unmatched")}


points = st.lists(st.tuples(st.floats(45.0, 45.002), st.floats(9.0, 9.002)), max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(points, points, st.floats(5, 120))
def test_grid_join_finds_what_a_nested_loop_finds(spark, a, b, metres):
    from meridia.functions.geometry import haversine

    make = lambda ps: spark.createDataFrame([(i, *p) for i, p in enumerate(ps)], "id int, lat double, lon double")
    x, y = make(a), make(b)
    got = spatial.within(x, y, metres).select("a.id", F.col("b.id").alias("other"))
    brute = x.crossJoin(y.select(F.col("id").alias("other"), F.col("lat").alias("l2"), F.col("lon").alias("o2")))
    brute = brute.filter(haversine(F.col("lat"), F.col("lon"), F.col("l2"), F.col("o2")) <= metres).select("id", "other")
    assert rows(got) == rows(brute)


def one_cell(spark, row, col, height):
    return spark.createDataFrame([(row, col, height)], "row int, col int, height int")


@pytest.mark.parametrize(("row", "elevation", "radius", "shaded"), [(6, 30.0, 200.0, True), (6, 70.0, 200.0, False), (14, 30.0, 200.0, False), (6, 30.0, 20.0, False)])
def test_building_shadow(spark, row, elevation, radius, shaded):
    sun = spark.createDataFrame([(13, 0.0, elevation, radius)], "hour int, azimuth double, elevation double, radius double")
    spot = spark.createDataFrame([("s", 105.0, 95.0)], "id string, x double, y double")
    got = shadow.building_shadow(spot, sun, one_cell(spark, row, 10, 60), (0.0, 200.0))
    assert bool(rows(got)) is shaded


def test_search_radius(spark):
    day = spark.createDataFrame([(67.2,), (20.9,)], "e double").select(shadow.search_radius("e", 125.0).alias("r"))
    assert [r.r for r in day.collect()] == [60.0, 330.0]
    with pytest.raises(Exception, match="horizon"):
        spark.createDataFrame([(0.0,)], "e double").select(shadow.search_radius("e", 125.0).alias("r")).collect()


@pytest.mark.parametrize(("x", "y", "elevation", "hit"), [(0.0, -10.0, 45.0, True), (0.0, 10.0, 45.0, False), (20.0, -10.0, 45.0, False), (0.0, -10.0, 70.0, False)])
def test_tree_shadow(spark, x, y, elevation, hit):
    trees = shadow.tree_cylinders(spark.createDataFrame([("t", x, y, 12.0, 6.0)], "tree_id string, x double, y double, height_m double, crown_diameter_m double"))
    sun = spark.createDataFrame([(13, 180.0, elevation)], "hour int, azimuth double, elevation double")
    spot = spark.createDataFrame([("s", 0.0, 0.0)], "id string, x double, y double")
    assert bool(rows(shadow.tree_shadow(spot, sun, trees, 200.0))) is hit
    hidden = spark.createDataFrame([("s", 13)], "id string, hour int")
    assert rows(shadow.tree_shadow(spot, sun, trees, 200.0, hidden)) == []


def test_nearest_of_two_trees_throws_the_shadow(spark):
    trees = spark.createDataFrame([("far", 0.0, -14.0, 15.0, 6.0), ("near", 0.0, -9.0, 12.0, 6.0)], "tree_id string, x double, y double, height_m double, crown_diameter_m double")
    sun = spark.createDataFrame([(13, 180.0, 45.0), (21, 300.0, -3.0)], "hour int, azimuth double, elevation double")
    spot = spark.createDataFrame([("s", 0.0, 0.0)], "id string, x double, y double")
    found = shadow.tree_shadow(spot, sun, shadow.tree_cylinders(trees), 200.0)
    assert rows(found) == [("s", 13, "near")]
    stops = spark.createDataFrame([("s", True)], "id string, has_shelter boolean")
    none = spark.createDataFrame([], "id string, hour int")
    hours = {r.hour: (r.in_building_shadow, r.in_tree_shadow, r.exposed) for r in shadow.hourly_exposure(stops, sun, none, found).collect()}
    assert hours == {13: (False, True, False), 21: (False, False, False)}


def test_tree_columns_come_back(spark):
    data = [(i, "G" if i % 2 else None, f"s{i % 3}", 5.5, 4.25, 9.0 + (i * 37 % 100) * 1e-4, 45.0 + (i * 53 % 90) * 1e-4, i % 4 == 0) for i in range(40)]
    trees = spark.createDataFrame(data, "tree_id int, genus string, species string, height_m double, crown_diameter_m double, lon double, lat double, shades_stop boolean")
    columns = payload.tree_columns(trees)
    back = {r.i: (r.x, r.y) for r in payload.undelta(columns).collect()}
    ids = {r.i: r.tree_id for r in columns.collect()}
    assert sorted(ids) == list(range(40))
    for i, k in ids.items():
        lon, lat = data[k][5], data[k][6]
        assert back[i] == (round((lon - min(d[5] for d in data)) / 1e-5), round((lat - min(d[6] for d in data)) / 1e-5))
    assert payload.shading_only(columns).count() == 10
    assert columns.filter("h = 6 and c = 8").count() == 40  # 5.5 and 8.5 to even


def test_expectations(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 1, None), (None, 2, 9.0)], "k string, n int, v double")
    other = spark.createDataFrame([("b", 1)], "k string, n int")
    found = E.report({
        "null": E.not_null(df, "k"), "unique": E.unique(df, "k", "n"), "accepted": E.accepted(df, "n", [1]), "related": E.relationship(df, "k", other, "k"),
        "where": E.relationship(df, "k", other, "k", F.col("n") > 1), "between": E.between(df, "v", 0, 1), "nulls": E.between(df, "v", 0, 1, nulls=True),
        "rows": E.rows_per_key(df, ["k"], 2, other), "count": E.row_count(df, 2, "k", "n"), "share": E.share_at_most(df, F.col("n") == 1, 0.5),
        "same": E.same(df.select("n", "v").filter("v > 1"), other.select("n", F.lit(1.0).alias("v")), ["n"], "v"), "none": E.share_at_most(df.limit(0), F.col("n") == 1, 0.5),
    })
    assert dict(rows(found)) == {"null": 1, "unique": 1, "accepted": 1, "related": 2, "where": 0, "between": 2, "nulls": 1, "rows": 1, "count": 0, "share": 1, "same": 2, "none": 0}


def test_hot_windows(spark):
    days = spark.createDataFrame([(dt.date(2026, 6, n), t) for n, t in ((1, 31.0), (2, 33.0), (3, 33.0), (4, 20.0), (6, 32.0))], "date date, celsius double")
    got = sorted(map(tuple, weather.hot_windows(days, 30.0).collect()))
    assert [(a.day, b.day, n, h.day) for a, b, n, h in got] == [(1, 3, 3, 2), (6, 6, 1, 6)]


def test_trip_dates_are_not_dealt_out_by_service(spark):
    trips = spark.range(1000).selectExpr("'A' AS agency_code", "id AS trip_id", "1 AS route_id", "concat('s', id % 2) AS service_id", "'r' AS route_short_name", "3 AS route_type")
    days = spark.range(6).selectExpr("'A' AS agency_code", "concat('s', id % 2) AS service_id", "date_add(date'2026-01-01', CAST(id AS INT)) AS date").distinct()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables whose size isn't known
    try:
        out = schedule.trip_dates(trips, days)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 3000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_trip_dates_are_made_by_all_tasks(spark):
    trips = spark.range(1000).selectExpr("'A' AS agency_code", "id AS trip_id", "1 AS route_id", "concat('s', id % 2) AS service_id", "'r' AS route_short_name", "3 AS route_type")
    days = spark.range(6).selectExpr("'A' AS agency_code", "concat('s', id % 2) AS service_id", "date_add(date'2026-01-01', CAST(id AS INT)) AS date")
    out = schedule.trip_dates(trips.coalesce(1), days)
    found = [n for _, n in rows(out.groupBy(F.spark_partition_id()).count())]
    assert sum(found) == 3000 and len(found) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(found) <= 1.1 * min(found)


def test_trip_dates_keep_repeats_and_nulls(spark):
    trips = spark.createDataFrame([("A", 1, 1, "s"), ("A", 2, 1, "none"), ("B", 3, 1, "s"), ("A", 4, 1, None)], "agency_code string, trip_id int, route_id int, service_id string")
    day = dt.date(2026, 1, 1)
    days = spark.createDataFrame([("A", "s", day), ("A", "s", day), ("A", "s", None), ("A", None, day)], "agency_code string, service_id string, date date")
    out = schedule.trip_dates(trips.selectExpr("*", "'r' AS route_short_name", "3 AS route_type"), days)
    assert sorted(map(str, rows(out.select("trip_id", "service_date")))) == sorted(map(str, [(1, day), (1, day), (1, None)]))

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from meridia.functions import geometry as G
from meridia.functions import scalar as S


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(("x", "n", "want"), [(1.005, 2, 1.0), (0.285, 2, 0.28), (2.5, 0, 3.0), (-2.5, 0, -3.0), (None, 2, None)])
def test_rounded(spark, x, n, want):
    assert value(spark, S.rounded(lit(x).cast("double"), n)) == want


@pytest.mark.parametrize(("time", "hour", "seconds"), [("25:30:00", 1, 91800), ("47:10:00", 23, 169800), ("09:00:00", 9, 32400), ("9:00:05", 9, 32405), ("", None, None), (None, None, None)])
def test_clock(spark, time, hour, seconds):
    t = lit(time).cast("string")
    assert (value(spark, S.clock_hour(t)), value(spark, S.clock_seconds(t))) == (hour, seconds)


def test_days(spark):
    sunday = lit(dt.date(2026, 6, 28))
    assert value(spark, S.day_number(sunday)) == 0
    assert value(spark, S.day_name(sunday)) == "Sunday"
    assert value(spark, S.is_weekend(sunday)) is True
    assert value(spark, S.compact_date(lit("20260628"))) == dt.date(2026, 6, 28)
    assert value(spark, S.compact_date(lit("junk"))) is None
    assert len(value(spark, S.days_between(lit(dt.date(2026, 6, 22)), sunday))) == 7
    assert value(spark, S.days_between(sunday, lit(dt.date(2026, 6, 22)))) is None


@pytest.mark.parametrize(("h", "want"), [(5.0, 0.0), (8.0, 0.25), (10.0, 2.5 / 6), (11.0, 0.5), (30.0, 0.5), (None, None)])
def test_sync_share(spark, h, want):
    got = value(spark, S.sync_share(lit(h).cast("double"), 0.5))
    assert got == want if want is None else got == pytest.approx(want)


def test_mixed_wait(spark):
    assert value(spark, S.mixed_wait(lit(12.5), lit(0.5))) == 4.125


@pytest.mark.parametrize(("m", "want"), [(None, None), (25.0, "high"), (24.9, "medium"), (10.0, "medium"), (9.9, "low")])
def test_wait_bucket(spark, m, want):
    assert value(spark, S.wait_bucket(lit(m).cast("double"))) == want


@pytest.mark.parametrize(("flags", "want"), [((True, True, True), 0.0), ((False, True, True), 0.03), ((False, False, True), 0.5), ((False, False, False), 1.0), ((None, None, None), 1.0)])
def test_exposure_weight(spark, flags, want):
    assert value(spark, S.exposure_weight(*[lit(f).cast("boolean") for f in flags])) == want


@pytest.mark.parametrize(("s", "want"), [(5.0, "high"), (1.0, "low"), (2.03, "medium"), (None, "medium")])
def test_risk_level(spark, s, want):
    assert value(spark, S.risk_level(lit(s).cast("double"))) == want


@pytest.mark.parametrize(("h", "c", "lon", "want"), [(10.0, 5.0, 9.1, True), (46.0, 5.0, 9.1, False), (10.0, 0.4, 9.1, False), (None, 5.0, 9.1, False), (10.0, 5.0, None, False)])
def test_valid_tree(spark, h, c, lon, want):
    assert value(spark, S.valid_tree(*[lit(x).cast("double") for x in (h, c, lon, 45.0)])) is want


@pytest.mark.parametrize(("to", "want"), [((45.461, 9.19), 111.195), ((45.462, 9.19), 222.390), ((45.46, 9.1902), 15.599)])
def test_haversine(spark, to, want):
    assert value(spark, G.haversine(lit(45.46), lit(9.19), lit(to[0]), lit(to[1]))) == pytest.approx(want, abs=1e-3)


def test_haversine_of_antipodes_is_finite(spark):
    assert value(spark, G.haversine(lit(0.0), lit(0.0), lit(0.0), lit(180.0))) == pytest.approx(math.pi * 6_371_000)


def test_projection_of_the_worked_example(spark):
    x, y = G.laea(lit(50.0), lit(5.0))
    assert value(spark, x) == pytest.approx(3962799.45, abs=0.01)
    assert value(spark, y) == pytest.approx(2999718.85, abs=0.01)


def test_elevations_of_the_study_day(spark):
    got = []
    for hour in range(13, 20):
        utc = lit(f"2026-06-28T{hour - 2}:00:00Z").cast("timestamp")
        got.append(value(spark, F.round(G.solar_position(utc, 45.4642, 9.19)[1], 1)))
    assert got == [67.2, 66.8, 60.8, 51.9, 41.8, 31.3, 20.9]


def test_values_by_hour(spark):
    df = spark.createDataFrame([("a", 13, 1.0), ("a", 15, 2.0)], "k string, hour int, v double")
    assert df.groupBy("k").agg(S.by_hour("hour", "v").alias("v")).first().v == [1.0, None, 2.0, None, None, None, None]


def test_upper_median(spark):
    for values, want in (([1.0, 2.0, 3.0, 4.0], 3.0), ([5.0, 1.0, 2.0], 2.0)):
        assert spark.createDataFrame([(v,) for v in values], "v double").agg(S.upper_median("v").alias("m")).first().m == want


def test_solar_time(spark):
    assert value(spark, S.solar_to_summer(lit("2026-06-28 12:30:00").cast("timestamp"))) == dt.datetime(2026, 6, 28, 13, 30)

"""Scalar rules of schedules, waiting and exposure, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meridia.config import DEFAULTS, Params


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def prefixed(prefix: str, key: Column | str) -> Column:
    """A surrogate key that keeps feeds apart; a null id stays null."""
    return F.concat(F.lit(f"{prefix}-"), col(key).cast("string"))


def rounded(x: Column | str, digits: int) -> Column:
    """Round half away from zero on the scaled double, as column stores do (Spark's own
    ``round`` works on the decimal expansion and differs in the last digit)."""
    scale = F.lit(float(10**digits))
    return F.round(col(x).cast("double") * scale, 0) / scale


# -- dates


def day_number(date: Column | str) -> Column:
    """Sunday 0 to Saturday 6."""
    return F.dayofweek(col(date)) - 1


def day_name(date: Column | str) -> Column:
    return F.date_format(col(date), "EEEE")


def is_weekend(date: Column | str) -> Column:
    return F.dayofweek(col(date)).isin(1, 7)


def compact_date(x: Column | str) -> Column:
    """yyyyMMdd, as text or number, to a date; null where it isn't one."""
    return F.try_to_timestamp(col(x).cast("string"), F.lit("yyyyMMdd")).cast("date")


def days_between(start: Column | str, end: Column | str) -> Column:
    """All dates from start to end, both included; none if they are the wrong way round."""
    a, b = col(start), col(end)
    return F.when(a <= b, F.sequence(a, b, F.expr("interval 1 day")))


def solar_to_summer(time: Column | str) -> Column:
    """A station's solar time (an hour ahead of UTC all year) as summer time."""
    return col(time) + F.expr("interval 1 hour")


# -- times of day that may pass 24 hours


def clock_part(time: Column | str, n: int) -> Column:
    return F.try_to_number(F.split_part(col(time), F.lit(":"), F.lit(n)), F.lit("99")).cast("int")


def clock_hour(time: Column | str) -> Column:
    """The hour of the day of HH:MM:SS, where HH may exceed 23."""
    return clock_part(time, 1) % 24


def clock_seconds(time: Column | str) -> Column:
    return clock_part(time, 1) * 3600 + clock_part(time, 2) * 60 + clock_part(time, 3)


# -- waiting


def sync_share(headway: Column | str, most: Column | float, p: Params = DEFAULTS) -> Column:
    """Share of riders who time their arrival: none at short headways, then rising to ``most``."""
    h = col(headway)
    most = F.lit(float(most)) if isinstance(most, int | float) else most
    span = float(p.sync_headway_full - p.sync_headway_from)
    rising = most * (h - F.lit(float(p.sync_headway_from))) / F.lit(span)
    return F.when(h.isNull(), F.lit(None).cast("double")).when(h <= p.sync_headway_from, F.lit(0.0)).when(h < p.sync_headway_full, rising).otherwise(most)


def mixed_wait(headway: Column | str, share: Column, p: Params = DEFAULTS) -> Column:
    """Random arrivals wait half a headway, timed ones a fixed time at most."""
    half = col(headway) / F.lit(2.0)
    return (F.lit(1.0) - share) * half + share * F.least(half, F.lit(float(p.sync_wait_minutes)))


def wait_bucket(minutes: Column | str) -> Column:
    m = col(minutes)
    return F.when(m.isNull(), F.lit(None).cast("string")).when(m >= 25, "high").when(m >= 10, "medium").otherwise("low")


# -- exposure


def exposure_weight(building: Column, tree: Column, shelter: Column, p: Params = DEFAULTS, factor: Column | None = None) -> Column:
    """Weight of an hour, the strongest protection first; a null flag protects from nothing."""
    sheltered = F.lit(float(p.shelter_exposure_factor)) if factor is None else factor
    return F.when(building, F.lit(0.0)).when(tree, F.lit(float(p.tree_transmissivity))).when(shelter, sheltered).otherwise(F.lit(1.0))


def risk_level(score: Column | str) -> Column:
    """By hours of weighted exposure; a null score is neither high nor low."""
    s = col(score)
    return F.when(s >= 5, "high").when(s <= 1, "low").otherwise("medium")


def all_some_none(hits: Column, total: Column) -> Column:
    return F.when(hits == total, "high").when(hits == 0, "low").otherwise("medium")


def valid_tree(height: Column | str, crown: Column | str, lon: Column | str, lat: Column | str, p: Params = DEFAULTS) -> Column:
    sound = col(height).between(*p.tree_height) & col(crown).between(*p.tree_crown) & col(lon).isNotNull() & col(lat).isNotNull()
    return F.coalesce(sound, F.lit(False))


def upper_median(name: str) -> Column:
    """Aggregate: the middle value of a column, or the higher one of two in the middle."""
    return -F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY -`{name}`)")


def by_hour(hour: Column | str, value: Column | str, p: Params = DEFAULTS) -> Column:
    """Aggregate: the values of the studied hours as an array, null where there is none."""
    found = F.map_from_entries(F.collect_list(F.struct(col(hour).cast("int"), col(value))))
    return F.transform(F.array(*[F.lit(h) for h in p.hours]), lambda h: F.try_element_at(found, h))

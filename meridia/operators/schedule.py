"""Service calendars, stop visits and headways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.config import DEFAULTS, Params
from meridia.functions import scalar as S

WEEKDAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")


def calendar_days(calendar: DataFrame, *key: str) -> DataFrame:
    """A row (key.., date) for each day of a weekly calendar between its dates.

    ``calendar`` has the key columns, a boolean for each weekday, start_date and end_date. A
    calendar that ends before it starts has no days.
    """
    flags = F.array(*[F.col(d) for d in WEEKDAYS])
    days = calendar.select(*key, flags.alias("runs"), F.explode(S.days_between("start_date", "end_date")).alias("date"))
    return days.filter(F.element_at("runs", F.dayofweek("date"))).select(*key, "date")


def service_dates(planned: DataFrame | None, exceptions: DataFrame, *key: str) -> DataFrame:
    """Dates on which services run: planned, without those removed, with those added.

    ``exceptions`` has the key columns, date and exception_type (1 adds, 2 removes). A date both
    removed and added runs. Without a planned calendar the added dates are all there is, each as
    often as the feed has it.
    """
    added = exceptions.filter("exception_type = 1").select(*key, "date")
    if planned is None:
        return added
    removed = exceptions.filter("exception_type = 2").select(*key, "date")
    return planned.select(*key, "date").subtract(removed).union(added).distinct()


def service_days(dates: DataFrame, *key: str) -> DataFrame:
    """The types of day (Sunday ..) that each service runs on."""
    return dates.select(*key, S.day_name("date").alias("day_type"), S.is_weekend("date").alias("is_weekend")).distinct()


def date_spine(dates: DataFrame) -> DataFrame:
    """Every date from the first to the last, with its parts."""
    bounds = dates.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = bounds.select(F.explode(S.days_between("a", "b")).alias("date"))
    return days.select(
        "date", F.year("date").cast("long").alias("year"), F.month("date").cast("long").alias("month"),
        F.day("date").cast("long").alias("day"), S.day_name("date").alias("day_name"), S.is_weekend("date").alias("is_weekend"),
    )


def trips_enriched(trips: DataFrame, routes: DataFrame, agencies: DataFrame) -> DataFrame:
    """Trips with their route's and agency's attributes; unknown ones stay, with nulls."""
    r = routes.select("route_id", "agency_id", "route_short_name", "route_long_name", "route_type")
    a = agencies.select("agency_id", "agency_name")
    out = trips.join(r, "route_id", "left").join(a, "agency_id", "left")
    return out.select("agency_code", "trip_id", "route_id", "service_id", "trip_headsign", "route_short_name", "route_long_name", "route_type", "agency_name")


def trip_dates(trips: DataFrame, dates: DataFrame) -> DataFrame:
    """A row for each trip and date that its service runs.

    Dates, a row for each service and day, are broadcast, a list for each service: services are few,
    and dealt out by them all trips would meet in as many tasks. Trips are dealt out evenly first: a
    trip may run on hundreds of dates, and the few small partitions that files and joins leave would
    keep as few tasks busy with all of them.
    """
    of_service = dates.groupBy("agency_code", "service_id").agg(F.collect_list(F.struct("date"))["date"].alias("dates"))  # in structs nulls stay
    parts = int(trips.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = trips.repartition(parts).join(F.broadcast(of_service), ["agency_code", "service_id"])
    return out.select("agency_code", "trip_id", "route_id", "service_id", F.explode("dates").alias("service_date"), "route_short_name", "route_type")


def stop_visits(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """Scheduled visits with their route and hour of the day, at the schedule's own grain."""
    out = stop_times.join(trips.select("agency_code", "trip_id", "route_id"), ["agency_code", "trip_id"], "left")
    hour = S.clock_hour("arrival_time").alias("arrival_hour")
    return out.select("agency_code", "trip_id", "route_id", "stop_id", "stop_sequence", "arrival_time", "departure_time", hour)


def service_frequency(visits: DataFrame, trips: DataFrame, days: DataFrame) -> DataFrame:
    """Visits by stop, day type and hour.

    Visits are counted by stop, service and hour first, so that only counts, and not visits,
    are fanned out by day type and summed again.
    """
    by_service = (
        visits.join(trips.select("agency_code", "trip_id", "service_id"), ["agency_code", "trip_id"])
        .groupBy("agency_code", "stop_id", "service_id", "arrival_hour").agg(F.count(F.lit(1)).alias("n"))
    )
    out = by_service.join(days.select("agency_code", "service_id", "day_type"), ["agency_code", "service_id"])
    return out.groupBy("agency_code", "stop_id", "day_type", "arrival_hour").agg(F.sum("n").alias("trip_count"))


def stop_coverage(stops: DataFrame, visits: DataFrame) -> DataFrame:
    """Routes that serve each stop and its first and last arrival; unserved stops stay.

    Visits are aggregated by stop before the join. First and last compare the times as text.
    """
    seen = visits.groupBy("agency_code", "stop_id").agg(
        F.count_distinct("route_id").alias("routes"), F.min("arrival_time").alias("first_scheduled_arrival"), F.max("arrival_time").alias("last_scheduled_arrival")
    )
    out = stops.select("stop_id", "agency_code", "stop_name").join(seen, ["agency_code", "stop_id"], "left")
    return out.select("stop_id", "agency_code", "stop_name", F.coalesce("routes", F.lit(0)).cast("long").alias("route_count"), "first_scheduled_arrival", "last_scheduled_arrival")


def gaps(departures: DataFrame, *by: str, p: Params = DEFAULTS) -> DataFrame:
    """Seconds to the next departure of the same group, in the studied hours.

    ``departures`` has the group's columns, raw_hour and seconds. No gaps: of departures at the
    same second, at the end of a group, and of ``max_gap_seconds`` or more.
    """
    following = F.lead("seconds").over(Window.partitionBy(*by).orderBy("seconds"))
    out = departures.select(*by, (F.col("raw_hour") % 24).alias("hour"), (following - F.col("seconds")).alias("gap"))
    return out.filter(F.col("hour").between(p.first_hour, p.last_hour) & (F.col("gap") > 0) & (F.col("gap") < p.max_gap_seconds))


def waits(departures: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Waiting at each stop and hour, from departures (stop_id, route_id, raw_hour, seconds).

    Headways are medians by line, then across lines. The wait for any line weighs gaps by their
    length: E[H * H] / (2 E[H]). Departures are dealt out by stop once, which serves both orders
    and all groups.
    """
    departures = departures.repartition("stop_id")
    by_line = gaps(departures, "stop_id", "route_id", p=p).groupBy("stop_id", "route_id", "hour").agg(F.median("gap").alias("headway"))
    lines = by_line.groupBy("stop_id", "hour").agg(F.median("headway").alias("mid"), F.max("headway").alias("long"), F.count(F.lit(1)).alias("n_lines"))
    gap = F.col("gap").cast("double")
    merged = gaps(departures, "stop_id", p=p).groupBy("stop_id", "hour").agg((F.avg(gap * gap) / (F.lit(2.0) * F.avg(gap)) / F.lit(60.0)).alias("any"))
    return lines.join(merged, ["stop_id", "hour"], "left").select(
        "stop_id", F.col("hour").cast("int").alias("hour"),
        S.rounded(F.col("mid") / F.lit(2.0) / F.lit(60.0), 1).alias("median_wait_minutes"),
        F.col("n_lines").cast("int").alias("n_lines"),
        S.rounded(F.col("mid") / F.lit(60.0), 2).alias("median_headway_minutes"),
        S.rounded("any", 2).alias("wait_any_line_minutes"),
        S.rounded(F.col("long") / F.lit(2.0) / F.lit(60.0), 2).alias("wait_least_frequent_minutes"),
    )


def active_departures(stop_times: DataFrame, trips: DataFrame, exceptions: DataFrame, date: Column) -> DataFrame:
    """Departures of the services that exceptions add on a date."""
    running = exceptions.filter((F.col("date") == date) & (F.col("exception_type") == 1)).select("service_id")
    active = trips.join(running, "service_id").select("trip_id", "route_id")
    out = stop_times.join(active, "trip_id")
    return out.select("stop_id", "route_id", S.clock_part("departure_time", 1).alias("raw_hour"), S.clock_seconds("departure_time").alias("seconds"))


def placed_waits(found: DataFrame, stops: DataFrame) -> DataFrame:
    """Waits with their stop's name and place; stops that can't be placed drop out."""
    where = stops.select("stop_id", "stop_name", S.rounded("stop_lat", 6).alias("lat"), S.rounded("stop_lon", 6).alias("lon"))
    cols = [c for c in found.columns if c not in ("stop_id", "hour")]
    return found.join(where, "stop_id").select("stop_id", "stop_name", "lat", "lon", "hour", *cols)


def mixed_waits(found: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Waits with the share of timed riders, the mixed wait and its bucket."""
    out = found.withColumn("sync_share", S.sync_share("median_headway_minutes", p.sync_share_max, p))
    out = out.withColumn("wait_mixed_minutes", S.mixed_wait("median_headway_minutes", F.col("sync_share"), p))
    return out.withColumn("wait_time_bucket", S.wait_bucket("median_wait_minutes"))

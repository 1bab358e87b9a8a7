"""The models: feeds conformed into one star schema, service marts, and heat exposure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.functions import scalar as S
from meridia.operators import exposure, schedule, spatial
from meridia.plans.registry import Build, Registry
from meridia.sources import readers

REGISTRY = Registry()
model = REGISTRY.model
IDS = {"agency": ("agency_id",), "routes": ("route_id", "agency_id"), "trips": ("trip_id", "route_id", "service_id"), "stops": ("stop_id",), "stop_times": ("trip_id", "stop_id"), "calendar": ("service_id",), "calendar_dates": ("service_id",)}


def feeds(b: Build, table: str) -> list[str]:
    return sorted(n.split(".")[0] for n in b.sources if n.endswith(f".{table}"))


def conformed(b: Build, table: str) -> DataFrame | None:
    """A table of all feeds that have it: ids prefixed with the feed's code, typed alike."""
    found = []
    for code in feeds(b, table):
        df = b.source(f"{code}.{table}")
        for c in IDS[table]:
            df = df.withColumn(c, S.prefixed(code, c))
        found.append(df.withColumn("agency_code", F.lit(code)))
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), found) if found else None


@model(stored=True)
def dim_agency(b: Build) -> DataFrame:
    return conformed(b, "agency").select("agency_id", "agency_code", "agency_name", "agency_url", "agency_timezone")


@model(stored=True)
def dim_route(b: Build) -> DataFrame:
    return conformed(b, "routes").select("route_id", "agency_id", "agency_code", "route_short_name", "route_long_name", "route_type")


@model(stored=True)
def dim_stop(b: Build) -> DataFrame:
    return conformed(b, "stops").select("stop_id", "agency_code", "stop_name", "stop_lat", "stop_lon", "location_type", "wheelchair_boarding")


@model()
def stg_trips(b: Build) -> DataFrame:
    return conformed(b, "trips").select("trip_id", "route_id", "service_id", "agency_code", "trip_headsign", "shape_id")


@model()
def stg_stop_times(b: Build) -> DataFrame:
    return conformed(b, "stop_times").select("trip_id", "stop_id", "agency_code", "stop_sequence", "arrival_time", "departure_time")


@model()
def stg_calendar_dates(b: Build) -> DataFrame:
    return conformed(b, "calendar_dates").select("service_id", "agency_code", S.compact_date("date").alias("date"), "exception_type")


@model()
def stg_calendar(b: Build) -> DataFrame:
    flags = [F.col(d).cast("boolean").alias(d) for d in schedule.WEEKDAYS]
    return conformed(b, "calendar").select("service_id", "agency_code", *flags, S.compact_date("start_date").alias("start_date"), S.compact_date("end_date").alias("end_date"))


@model()
def int_service_dates(b: Build) -> DataFrame:
    """Feeds with a weekly calendar and feeds whose added dates are all there is."""
    weekly, out = feeds(b, "calendar"), []
    exceptions = b("stg_calendar_dates")
    if weekly:
        planned = schedule.calendar_days(b("stg_calendar"), "agency_code", "service_id")
        out.append(schedule.service_dates(planned, exceptions.filter(F.col("agency_code").isin(weekly)), "agency_code", "service_id"))
    out.append(schedule.service_dates(None, exceptions.filter(~F.col("agency_code").isin(weekly)) if weekly else exceptions, "agency_code", "service_id"))
    return reduce(DataFrame.unionByName, out)


@model()
def int_service_days(b: Build) -> DataFrame:
    return schedule.service_days(b("int_service_dates"), "agency_code", "service_id")


@model(stored=True)
def int_trips_enriched(b: Build) -> DataFrame:
    return schedule.trips_enriched(b("stg_trips"), b("dim_route"), b("dim_agency"))


@model(stored=True)
def dim_date(b: Build) -> DataFrame:
    return schedule.date_spine(b("int_service_dates"))


@model(stored=True)
def fct_trips(b: Build) -> DataFrame:
    return schedule.trip_dates(b("int_trips_enriched"), b("int_service_dates"))


@model(stored=True)
def fct_stop_times(b: Build) -> DataFrame:
    return schedule.stop_visits(b("stg_stop_times"), b("int_trips_enriched"))


@model(stored=True)
def mart_service_frequency(b: Build) -> DataFrame:
    return schedule.service_frequency(b("fct_stop_times"), b("int_trips_enriched"), b("int_service_days"))


@model(stored=True)
def mart_stop_coverage(b: Build) -> DataFrame:
    return schedule.stop_coverage(b("dim_stop"), b("fct_stop_times"))


@model()
def stg_stop_solar_exposure(b: Build) -> DataFrame:
    rows = b.source("stop_solar_exposure").withColumnRenamed("stop_id", "osm_node_id")
    return exposure.scored(rows, b.params)


@model()
def stg_stop_tree_shade(b: Build) -> DataFrame:
    return b.source("stop_tree_shade").select(F.col("stop_id").alias("osm_node_id"), "hour", "tree_id")


@model()
def stg_osm_shelter_stops(b: Build) -> DataFrame:
    return b.source("osm_shelter_stops").select("osm_node_id", "ref", "name", "lat", "lon")


@model()
def stg_trees(b: Build) -> DataFrame:
    return readers.with_validity(b.source("trees"), b.params)


@model(stored=True)
def int_stop_wait_time(b: Build) -> DataFrame:
    return schedule.mixed_waits(b.source("stop_wait_time").withColumnRenamed("stop_id", "gtfs_stop_id"), b.params)


@model(stored=True)
def int_osm_gtfs_stop_bridge(b: Build) -> DataFrame:
    stops = b("stg_osm_shelter_stops").select(F.col("osm_node_id").alias("id"), "ref", "lat", "lon")
    return spatial.stop_bridge(stops, b("int_stop_wait_time").select(F.col("gtfs_stop_id").alias("stop_id"), "lat", "lon"), b.params)


@model(stored=True)
def int_stop_tree_counts(b: Build) -> DataFrame:
    stops = b("stg_osm_shelter_stops").select(F.col("osm_node_id").alias("id"), "lat", "lon")
    found = spatial.count_near(stops, b("stg_trees").filter("is_valid"), b.params.tree_metres)
    return found.select(F.col("id").alias("osm_node_id"), F.col("n").alias("n_trees_20m"))


@model(stored=True)
def mart_stop_heat_risk_sensitivity(b: Build) -> DataFrame:
    return exposure.risk_sensitivity(b("stg_stop_solar_exposure"), b.params)


@model(stored=True)
def mart_stop_heat_risk(b: Build) -> DataFrame:
    return exposure.heat_risk(b("stg_stop_solar_exposure"), b("mart_stop_heat_risk_sensitivity"), b("int_stop_tree_counts"))


@model(stored=True)
def mart_stop_heat_wait_hourly(b: Build) -> DataFrame:
    return exposure.heat_wait_hourly(b("stg_stop_solar_exposure"), b("stg_osm_shelter_stops"), b("int_osm_gtfs_stop_bridge"), b("int_stop_wait_time"), b("mart_stop_heat_risk"))


@model(stored=True)
def mart_stop_heat_wait(b: Build) -> DataFrame:
    return exposure.heat_wait(b("mart_stop_heat_risk"), b("int_osm_gtfs_stop_bridge"), b("int_stop_wait_time"), b("mart_stop_heat_wait_hourly"), b.params)


@model(stored=True)
def mart_heat_wait_sensitivity(b: Build) -> DataFrame:
    return exposure.wait_sensitivity(b("mart_stop_heat_wait_hourly"), b("int_stop_wait_time"), b.params)


@model(stored=True)
def mart_trees_map(b: Build) -> DataFrame:
    return exposure.trees_for_map(b("stg_trees"), b("stg_stop_tree_shade"))

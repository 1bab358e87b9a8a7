"""What has to hold of the models: each assertion is a function of a build that returns the rows
that break it. ``report`` counts them, for as many assertions as the build has sources for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions import scalar as S
from meridia.operators import expectations as E
from meridia.plans.registry import Build

Assertion = Callable[[Build], DataFrame]
TRANSIT: dict[str, Assertion] = {}
HEAT: dict[str, Assertion] = {}
CLOSE = 1e-9


def entered(suite: dict[str, Assertion]) -> Callable[[Assertion], Assertion]:
    def enter(f: Assertion) -> Assertion:
        suite[f.__name__] = f
        return f

    return enter


transit, heat = entered(TRANSIT), entered(HEAT)


def at_most(low: str, high: str, slack: float) -> Column:
    """Whether one column is no larger than another, as far as both are there."""
    return F.coalesce(F.col(low) <= F.col(high) + F.lit(slack), F.lit(True))


# -- feeds


@transit
def agency_id_is_present_and_unique(b: Build) -> DataFrame:
    a = b("dim_agency").select("agency_id")
    return E.not_null(a, "agency_id").unionByName(E.unique(a, "agency_id").select("agency_id"))


@transit
def route_id_is_present_and_unique(b: Build) -> DataFrame:
    r = b("dim_route").select("route_id")
    return E.not_null(r, "route_id").unionByName(E.unique(r, "route_id").select("route_id"))


@transit
def stop_id_is_present_and_unique(b: Build) -> DataFrame:
    s = b("dim_stop").select("stop_id")
    return E.not_null(s, "stop_id").unionByName(E.unique(s, "stop_id").select("stop_id"))


@transit
def trip_id_is_present_and_unique(b: Build) -> DataFrame:
    t = b("stg_trips").select("trip_id")
    return E.not_null(t, "trip_id").unionByName(E.unique(t, "trip_id").select("trip_id"))


@transit
def trips_have_a_route(b: Build) -> DataFrame:
    return E.relationship(b("stg_trips"), "route_id", b("dim_route"), "route_id")


@transit
def visits_have_a_trip(b: Build) -> DataFrame:
    return E.relationship(b("stg_stop_times"), "trip_id", b("stg_trips"), "trip_id")


@transit
def visits_have_a_stop(b: Build) -> DataFrame:
    return E.relationship(b("stg_stop_times"), "stop_id", b("dim_stop"), "stop_id")


@transit
def exceptions_add_or_remove(b: Build) -> DataFrame:
    return E.accepted(b("stg_calendar_dates"), "exception_type", (1, 2))


@transit
def wheelchair_boarding_is_known_or_missing(b: Build) -> DataFrame:
    return E.accepted(b("dim_stop"), "wheelchair_boarding", (0, 1, 2))


@transit
def arrival_is_not_after_departure(b: Build) -> DataFrame:
    """Times are compared as text, hours past 23 included."""
    return b("fct_stop_times").filter(F.col("arrival_time") > F.col("departure_time"))


@transit
def a_trip_runs_once_a_date(b: Build) -> DataFrame:
    return E.unique(b("fct_trips"), "agency_code", "trip_id", "service_date")


# -- exposure and waiting


@heat
def exposure_score_is_valid(b: Build) -> DataFrame:
    weights = (0.0, b.params.tree_transmissivity, b.params.shelter_exposure_factor, 1.0)
    score, building, tree = F.col("exposure_score"), F.coalesce("in_building_shadow", F.lit(False)), F.coalesce("in_tree_shadow", F.lit(False))
    in_shade = F.when(building, score == 0).when(tree, score == b.params.tree_transmissivity).otherwise(True)
    return E.holds(b("stg_stop_solar_exposure"), score.isin(*weights) & in_shade)


@heat
def exposure_has_one_row_a_stop_and_hour(b: Build) -> DataFrame:
    return E.unique(b("stg_stop_solar_exposure"), "osm_node_id", "hour")


@heat
def never_both_shadows(b: Build) -> DataFrame:
    return b("stg_stop_solar_exposure").filter("in_building_shadow AND in_tree_shadow")


@heat
def deciles_span_one_to_ten(b: Build) -> DataFrame:
    ends = b("mart_stop_heat_risk").agg(F.min("exposure_decile").alias("low"), F.max("exposure_decile").alias("high"))
    return ends.filter("low <> 1 OR high <> 10")


@heat
def score_hours_are_in_range(b: Build) -> DataFrame:
    return E.between(b("mart_stop_heat_risk"), "exposure_score_hours", 0, len(b.params.hours))


@heat
def risk_level_matches_score(b: Build) -> DataFrame:
    risk = b("mart_stop_heat_risk").withColumn("expected", S.risk_level("exposure_score_hours"))
    return E.distinct_from(risk, "risk_level", "expected")


@heat
def every_factor_once_a_stop(b: Build) -> DataFrame:
    grid, counts = len(b.params.shelter_factor_grid), F.count(F.lit(1)).alias("n")
    by_stop = b("mart_stop_heat_risk_sensitivity").groupBy("osm_node_id").agg(counts, F.count_distinct("shelter_factor").alias("factors"))
    return E.holds(by_stop, (F.col("n") == grid) & (F.col("factors") == F.col("n")))


@heat
def mean_exposed_wait_matches_hours(b: Build) -> DataFrame:
    again = b("mart_stop_heat_wait_hourly").groupBy("osm_node_id").agg(F.avg("exposed_wait_minutes").alias("v"))
    return E.same(b("mart_stop_heat_wait").select("osm_node_id", F.col("avg_exposed_wait_minutes").alias("v")), again, ["osm_node_id"], "v", CLOSE)


@heat
def wait_bounds_are_in_order(b: Build) -> DataFrame:
    """Slack for seconds that are kept to two decimals, and to one for the random wait."""
    pairs = (("wait_minutes_low", "wait_minutes", 0.01), ("wait_minutes", "wait_minutes_random", 0.06), ("wait_minutes_random", "wait_minutes_high", 0.06))
    rule = F.lit(True)
    for low, high, slack in pairs:
        rule = rule & at_most(low, high, slack)
    return E.holds(b("mart_stop_heat_wait_hourly"), rule)


@heat
def exposed_wait_is_score_times_wait(b: Build) -> DataFrame:
    wait, exposed = F.col("wait_minutes"), F.col("exposed_wait_minutes")
    product = F.abs(exposed - F.col("exposure_score") * wait) <= CLOSE
    return E.holds(b("mart_stop_heat_wait_hourly"), F.when(wait.isNull(), exposed.isNull()).otherwise(product))


@heat
def every_stop_has_every_hour(b: Build) -> DataFrame:
    return E.rows_per_key(b("mart_stop_heat_wait_hourly"), ["osm_node_id"], len(b.params.hours), b("stg_osm_shelter_stops"))


@heat
def hourly_has_one_row_a_stop_and_hour(b: Build) -> DataFrame:
    return E.unique(b("mart_stop_heat_wait_hourly"), "osm_node_id", "hour")


@heat
def sensitivity_agrees_at_the_default_share(b: Build) -> DataFrame:
    """Medians by risk level, where the default is one of the grid's shares."""
    waits = b("mart_stop_heat_wait").filter("avg_exposed_wait_minutes IS NOT NULL")
    usual = waits.groupBy("risk_level").agg(F.median("avg_exposed_wait_minutes").alias("usual"))
    at_default = b("mart_heat_wait_sensitivity").filter(F.col("sync_share_max") == b.params.sync_share_max)
    return at_default.join(usual, "risk_level").filter(F.abs(F.col("median_avg_exposed_wait_minutes") - F.col("usual")) > 0.01)


@heat
def every_share_and_level_once(b: Build) -> DataFrame:
    n = 3 * len(b.params.sync_share_grid)
    counts = b("mart_heat_wait_sensitivity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct("sync_share_max", "risk_level")).alias("pairs"))
    return counts.filter((F.col("n") != n) | (F.col("pairs") != F.col("n")))


@heat
def match_distance_fits_its_method(b: Build) -> DataFrame:
    method, metres = F.col("match_method"), F.col("distance_m")
    near = lambda most: F.coalesce(metres <= most, F.lit(False))
    rule = F.when(method == "ref", near(b.params.ref_metres)).when(method == "nearest", near(b.params.near_metres))
    return E.holds(b("int_osm_gtfs_stop_bridge"), rule.when(method == "unmatched", F.col("gtfs_stop_id").isNull() & metres.isNull()).otherwise(True))


@heat
def few_stops_are_unmatched(b: Build) -> DataFrame:
    return E.share_at_most(b("int_osm_gtfs_stop_bridge"), F.col("match_method") == "unmatched", b.params.max_unmatched_share)


@heat
def tree_shade_hours_are_in_range(b: Build) -> DataFrame:
    both = [E.between(b(m).select("osm_node_id", "tree_shade_hours"), "tree_shade_hours", 0, len(b.params.hours)) for m in ("mart_stop_heat_risk", "mart_stop_heat_wait_hourly")]
    return both[0].unionByName(both[1])


@heat
def timed_share_is_in_range(b: Build) -> DataFrame:
    return E.between(b("int_stop_wait_time"), "sync_share", 0, b.params.sync_share_max + CLOSE, nulls=True)


def report(b: Build) -> DataFrame:
    """A row for each assertion that the build has sources for: its name and how many rows break it."""
    suite: dict[str, Assertion] = {}
    if any(name.endswith(".stop_times") for name in b.sources):
        suite |= TRANSIT
    if b.has("stop_solar_exposure", "stop_tree_shade", "osm_shelter_stops", "trees", "stop_wait_time"):
        suite |= HEAT
    return E.report({name: f(b) for name, f in suite.items()})

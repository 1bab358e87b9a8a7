"""Hourly exposure to the sun, risk by stop, and how both depend on the assumptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.config import DEFAULTS, Params
from meridia.functions import scalar as S


def numbers(df: DataFrame, name: str, values: tuple[float, ...]) -> DataFrame:
    """Each row once for each value of a parameter grid."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))


def scored(hourly: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Hourly rows with their exposure_score."""
    return hourly.withColumn("exposure_score", S.exposure_weight(F.col("in_building_shadow"), F.col("in_tree_shadow"), F.col("has_shelter"), p))


def factor_sums(p: Params = DEFAULTS) -> list[Column]:
    """Aggregates from which a stop's score follows for any shelter factor: an hour's weight
    depends on the factor only in sheltered sun."""
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in ("in_building_shadow", "in_tree_shadow", "has_shelter")]
    sheltered = ~flags[0] & ~flags[1] & flags[2]
    return [F.sum(S.exposure_weight(*flags, p, factor=F.lit(0.0))).alias("fixed"), F.count_if(sheltered).alias("sheltered")]


def score_for(factor: Column) -> Column:
    return S.rounded(F.col("fixed") + F.col("sheltered") * factor, 6)


def risk_sensitivity(hourly: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Score and risk of each stop for each shelter factor of the grid, which is applied to the
    sums of a stop's hours."""
    grid = numbers(hourly.groupBy("osm_node_id").agg(*factor_sums(p)), "shelter_factor", p.shelter_factor_grid)
    out = grid.withColumn("exposure_score_hours", score_for(F.col("shelter_factor")))
    return out.select("osm_node_id", "shelter_factor", "exposure_score_hours", S.risk_level("exposure_score_hours").alias("risk_level"))


def tiles(rows: DataFrame, n: int, value: Column, tie: str, name: str) -> DataFrame:
    """The rows with their tile (1 to n) in the order of a value and then ``tie``.

    Rows are numbered within each value, and values are counted: only a row for each value, of which
    there are few, is ever in one task, and a value's rows are sorted by themselves.
    """
    held = rows.withColumn("tile_value", value)
    counts = held.groupBy("tile_value").agg(F.count(F.lit(1)).alias("tile_rows"))
    before = Window.orderBy("tile_value").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("tile_value").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.select(
        F.col("tile_value").alias("start_value"), F.coalesce(F.sum("tile_rows").over(before), F.lit(0)).alias("tile_base"), F.sum("tile_rows").over(every).alias("tile_total")
    )
    own = F.row_number().over(Window.partitionBy("tile_value").orderBy(tie))
    held = held.withColumn("tile_place", own).join(starts, F.col("tile_value").eqNullSafe(F.col("start_value")))
    at = F.col("tile_base") + F.col("tile_place") - 1
    size, more = F.floor(F.col("tile_total") / n), F.col("tile_total") % n  # the first ``more`` tiles have one more
    large = more * (size + 1)
    tile = F.when(at < large, F.floor(at / (size + 1))).otherwise(more + F.floor((at - large) / F.greatest(size, F.lit(1)))) + 1
    return held.withColumn(name, tile.cast("long")).drop("tile_value", "start_value", "tile_base", "tile_total", "tile_place")


def heat_risk(hourly: DataFrame, sensitivity: DataFrame | None, trees: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """A stop's exposure over its hours (see ``scored``), its risk and whether that is stable.

    ``trees`` has osm_node_id and n_trees_20m. Without ``sensitivity`` stability comes from the same sums
    that everything else does, in one pass over the hours. Deciles are by score; ties go by id.
    """
    n, exposed = F.count(F.lit(1)), F.count_if("exposed")
    base = hourly.groupBy("osm_node_id").agg(
        n.alias("hours_measured"), F.sum("exposure_score").alias("score"), exposed.alias("hours_exposed_binary"),
        F.max(F.coalesce("has_shelter", F.lit(False))).alias("has_shelter"), F.count_if("in_tree_shadow").alias("tree_shade_hours"), *factor_sums(p),
    )
    if sensitivity is None:
        levels = F.array(*[S.risk_level(score_for(F.lit(float(v)))) for v in p.shelter_factor_grid])
        out = base.withColumn("risk_level_stable", F.size(F.array_distinct(levels)) == 1)
    else:
        out = base.join(sensitivity.groupBy("osm_node_id").agg((F.count_distinct("risk_level") == 1).alias("risk_level_stable")), "osm_node_id", "left")
    out = tiles(out.join(trees.select("osm_node_id", "n_trees_20m").hint("merge"), "osm_node_id", "left"), 10, S.rounded("score", 6), "osm_node_id", "exposure_decile")
    total = F.col("hours_measured").cast("double")
    return out.select(
        "osm_node_id", "hours_measured", S.rounded("score", 3).alias("exposure_score_hours"), S.rounded(F.col("score") / total, 3).alias("pct_exposure_score"),
        "hours_exposed_binary", S.rounded(F.col("hours_exposed_binary").cast("double") / total, 3).alias("pct_hours_exposed_binary"), "has_shelter",
        S.risk_level("score").alias("risk_level"), S.all_some_none(F.col("hours_exposed_binary"), F.col("hours_measured")).alias("risk_level_binary"),
        "exposure_decile", "risk_level_stable", "tree_shade_hours", "n_trees_20m",
    )


def heat_wait_hourly(hourly: DataFrame, stops: DataFrame, bridge: DataFrame, waits: DataFrame, risk: DataFrame) -> DataFrame:
    """Exposure, waiting and risk of each stop and hour; without service the waits are null."""
    place = stops.select("osm_node_id", F.col("name").alias("stop_name"), "lon", "lat")
    wait = waits.select("gtfs_stop_id", "hour", "median_wait_minutes", "wait_mixed_minutes", "wait_any_line_minutes", "wait_least_frequent_minutes")
    out = (
        hourly.select("osm_node_id", "hour", "in_building_shadow", "in_tree_shadow", "has_shelter", "exposure_score")
        .join(place.hint("merge"), "osm_node_id").join(bridge.select("osm_node_id", "gtfs_stop_id", "match_method").hint("merge"), "osm_node_id")
        .join(wait.hint("merge"), ["gtfs_stop_id", "hour"], "left")
        .join(risk.select("osm_node_id", "risk_level", "risk_level_stable", "exposure_decile", "tree_shade_hours", "n_trees_20m").hint("merge"), "osm_node_id", "left")
    )
    return out.select(
        "osm_node_id", "stop_name", "lon", "lat", "hour", "in_building_shadow", "in_tree_shadow", "has_shelter", "exposure_score", "gtfs_stop_id", "match_method",
        F.col("wait_mixed_minutes").alias("wait_minutes"), F.least("wait_any_line_minutes", "wait_mixed_minutes").alias("wait_minutes_low"),
        F.col("wait_least_frequent_minutes").alias("wait_minutes_high"), F.col("median_wait_minutes").alias("wait_minutes_random"),
        (F.col("exposure_score") * F.col("wait_mixed_minutes")).alias("exposed_wait_minutes"),
        "risk_level", "exposure_decile", "risk_level_stable", "tree_shade_hours", "n_trees_20m",
    )


def heat_wait(risk: DataFrame, bridge: DataFrame, waits: DataFrame, hourly: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Risk by stop with its match, its median wait in the studied hours and the mean exposed wait."""
    mid = waits.filter(F.col("hour").between(p.first_hour, p.last_hour)).groupBy("gtfs_stop_id").agg(F.median("median_wait_minutes").alias("median_wait_13_19"))
    mean = hourly.groupBy("osm_node_id").agg(F.avg("exposed_wait_minutes").alias("avg_exposed_wait_minutes"))
    out = risk.drop("tree_shade_hours", "n_trees_20m").join(bridge, "osm_node_id", "left").join(mid, "gtfs_stop_id", "left").join(mean, "osm_node_id", "left")
    return out.select(
        "osm_node_id", "hours_measured", "exposure_score_hours", "pct_exposure_score", "hours_exposed_binary", "pct_hours_exposed_binary", "has_shelter",
        "risk_level", "risk_level_binary", "exposure_decile", "risk_level_stable", "gtfs_stop_id", "match_method", "distance_m", "median_wait_13_19", "avg_exposed_wait_minutes",
    )


def wait_sensitivity(hourly: DataFrame, waits: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Exposed waits by risk level for each share of timed riders of the grid.

    ``hourly`` has osm_node_id, gtfs_stop_id, hour, exposure_score and risk_level.
    """
    head = waits.select("gtfs_stop_id", "hour", "median_headway_minutes").filter("median_headway_minutes IS NOT NULL")
    rows = numbers(hourly.select("osm_node_id", "gtfs_stop_id", "hour", "exposure_score", "risk_level").join(head, ["gtfs_stop_id", "hour"]), "sync_share_max", p.sync_share_grid)
    wait = S.mixed_wait("median_headway_minutes", S.sync_share("median_headway_minutes", F.col("sync_share_max"), p), p)
    stops = rows.groupBy("sync_share_max", "osm_node_id", "risk_level").agg(F.avg(F.col("exposure_score") * wait).alias("w"))
    return stops.groupBy("sync_share_max", "risk_level").agg(
        F.count(F.lit(1)).alias("n_stops"), F.median("w").alias("median_avg_exposed_wait_minutes"), F.percentile("w", F.lit(0.9)).alias("p90_avg_exposed_wait_minutes")
    )


def trees_for_map(trees: DataFrame, shade: DataFrame) -> DataFrame:
    """Usable trees, and whether each is the tree that shades some stop at some hour."""
    hits = shade.select("tree_id").distinct().withColumn("hit", F.lit(True))
    out = trees.filter("is_valid").join(hits.hint("merge"), "tree_id", "left")
    return out.select("tree_id", "genus", "species", "height_m", "crown_diameter_m", "lon", "lat", F.col("hit").isNotNull().alias("shades_stop"))

"""Shadows of buildings and trees on points, hour by hour, as joins on cells.

Places are in metres of a projected grid. ``sun`` has a row for each hour: hour, azimuth and
elevation in degrees; the azimuth is taken as the grid's own bearing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.config import DEFAULTS, Params
from meridia.functions.scalar import col


def required_height(distance: Column | str, elevation: Column | str) -> Column:
    """How high something has to be at a distance to hide the sun."""
    return col(distance) * F.tan(F.radians(col(elevation)))


def search_radius(elevation: Column | str, highest: Column | float, step: float = DEFAULTS.step_metres) -> Column:
    """The distance, in whole steps, beyond which nothing is high enough; an error at night."""
    high = F.lit(float(highest)) if isinstance(highest, int | float) else highest
    steps = F.ceil(high / F.tan(F.radians(col(elevation))) / F.lit(float(step))).cast("double") * F.lit(float(step))
    return F.when(col(elevation) > 0, steps).otherwise(F.raise_error(F.lit("the sun is not above the horizon")))


def with_radius(sun: DataFrame, cells: DataFrame, step: float = DEFAULTS.step_metres) -> DataFrame:
    """Hours with the radius that the tallest cell calls for."""
    top = cells.agg(F.coalesce(F.max("height"), F.lit(0)).cast("double").alias("top"))
    return sun.crossJoin(F.broadcast(top)).withColumn("radius", search_radius("elevation", F.col("top"), step)).drop("top")  # one row


def building_shadow(points: DataFrame, sun: DataFrame, cells: DataFrame, origin: tuple[float, float], size: float = 10.0, step: float = DEFAULTS.step_metres) -> DataFrame:
    """(id, hour) of points in a building's shadow.

    ``points`` has id, x, y; ``sun`` also a radius; ``cells`` row, col and height of a raster
    whose upper left corner is ``origin``, without cells that have no data. The ray is looked at
    every ``step`` metres from one step away up to the radius; outside the raster nothing hides
    the sun.
    """
    reach = F.sequence(F.lit(1), F.floor(F.col("radius") / F.lit(step) + F.lit(1e-9)).cast("int"))
    rays = points.select("id", "x", "y").crossJoin(F.broadcast(sun.select("hour", "azimuth", "elevation", "radius")))  # a row for each hour
    rays = rays.filter(F.col("radius") >= step).withColumn("steps", F.explode(reach)).withColumn("d", F.col("steps") * F.lit(float(step)))
    bearing = F.radians("azimuth")
    x, y = F.col("x") + F.col("d") * F.sin(bearing), F.col("y") + F.col("d") * F.cos(bearing)
    seen = rays.select(
        "id", "hour", required_height("d", "elevation").alias("needed"),
        F.floor((F.lit(origin[1]) - y) / F.lit(size)).cast("int").alias("row"), F.floor((x - F.lit(origin[0])) / F.lit(size)).cast("int").alias("col"),
    )
    hit = seen.join(cells.select("row", "col", "height"), ["row", "col"]).filter(F.col("height") >= F.col("needed"))
    return hit.select("id", "hour").distinct()


def tree_cylinders(trees: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Usable trees (tree_id, x, y, height_m, crown_diameter_m) as upright cylinders of crown."""
    return trees.select("tree_id", "x", "y", (F.col("crown_diameter_m") / 2).alias("r"), (F.col("height_m") * F.lit(p.crown_base)).alias("base"), F.col("height_m").alias("top"))


def tree_shadow(points: DataFrame, sun: DataFrame, cylinders: DataFrame, tallest: float | None = None, hidden: DataFrame | None = None) -> DataFrame:
    """(id, hour, tree_id): the nearest tree whose crown the ray to the sun crosses, if any.

    Hours in which a point is ``hidden`` (id, hour) by a building are left out beforehand.

    The search reaches as far as the tallest tree can throw a shadow, by hour; without ``tallest`` that is
    found first. Trees are found by
    cells as wide as that reach, looked up by their centres in three by three cells.
    """
    top = F.lit(0.0 if tallest is None else float(tallest))
    if tallest is None:
        sun = sun.crossJoin(F.broadcast(cylinders.agg(F.coalesce(F.max("top"), F.lit(0.0)).alias("tallest"))))  # one row
        top = F.col("tallest")
    high = sun.filter(F.col("elevation") > 0).select("hour", "azimuth", "elevation", (top / F.tan(F.radians("elevation"))).alias("reach"))
    rays = points.select("id", "x", "y").crossJoin(F.broadcast(high)).filter(F.col("reach") > 0)  # a row for each hour
    if hidden is not None:
        rays = rays.join(hidden, ["id", "hour"], "left_anti")
    near = F.array(*[F.struct((F.floor(F.col("x") / F.col("reach")) + i).alias("i"), (F.floor(F.col("y") / F.col("reach")) + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    rays = rays.withColumn("cell", F.explode(near))
    crowns = cylinders.select("tree_id", F.col("x").alias("tx"), F.col("y").alias("ty"), "r", "base", "top").crossJoin(F.broadcast(high.select(F.col("hour").alias("h"), F.col("reach").alias("w"))))
    crowns = crowns.withColumn("at", F.struct(F.floor(F.col("tx") / F.col("w")).alias("i"), F.floor(F.col("ty") / F.col("w")).alias("j"))).drop("w")
    pairs = rays.join(crowns, (F.col("hour") == F.col("h")) & (F.col("cell") == F.col("at")))
    bearing, slope = F.radians("azimuth"), F.tan(F.radians("elevation"))
    dx, dy = F.col("tx") - F.col("x"), F.col("ty") - F.col("y")
    pairs = pairs.withColumn("along", dx * F.sin(bearing) + dy * F.cos(bearing)).withColumn("off", F.pow(dx, 2) + F.pow(dy, 2) - F.pow(F.col("along"), 2))
    pairs = pairs.filter(F.col("off") <= F.pow("r", F.lit(2.0)))
    half = F.sqrt(F.greatest(F.pow("r", F.lit(2.0)) - F.greatest(F.col("off"), F.lit(0.0)), F.lit(0.0)))
    pairs = pairs.withColumn("enter", F.greatest(F.col("along") - half, F.lit(0.0))).withColumn("leave", F.col("along") + half)
    crossed = pairs.filter((F.col("leave") > 0) & (F.col("enter") <= F.col("reach")) & (F.col("enter") * slope <= F.col("top")) & (F.col("leave") * slope >= F.col("base")))
    best = crossed.groupBy("id", "hour").agg(F.min_by("tree_id", F.struct("enter", "tree_id")).alias("tree_id"))
    return best.select("id", "hour", "tree_id")


def hourly_exposure(points: DataFrame, sun: DataFrame, buildings: DataFrame, trees: DataFrame) -> DataFrame:
    """Each point (id, has_shelter) and hour with its shadows; trees count where no building does."""
    hours = points.select("id", "has_shelter").crossJoin(F.broadcast(sun.select("hour", "azimuth", "elevation")))  # a row for each hour
    out = hours.join(buildings.select("id", "hour", F.lit(True).alias("b")), ["id", "hour"], "left").join(trees.select("id", "hour", F.lit(True).alias("t")), ["id", "hour"], "left")
    building = F.coalesce("b", F.lit(False))
    tree = ~building & F.coalesce("t", F.lit(False))
    return out.select(
        F.col("id").alias("stop_id"), "hour", F.col("azimuth").alias("solar_azimuth"), F.col("elevation").alias("solar_elevation"),
        building.alias("in_building_shadow"), tree.alias("in_tree_shadow"), "has_shelter", (~building & ~tree & ~F.col("has_shelter")).alias("exposed"),
    )

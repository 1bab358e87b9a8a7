"""Analyses of station readings (station, ts, celsius) around which hours and days are studied."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hot_share_by_hour(readings: DataFrame, over: float = 30.0) -> DataFrame:
    """By hour of the day, the share of readings above a temperature."""
    hot = F.avg(F.when(F.col("celsius") > over, 1.0).otherwise(0.0))
    return readings.filter("celsius IS NOT NULL").groupBy(F.hour("ts").alias("hour")).agg(hot.alias("share"), F.count(F.lit(1)).alias("readings"))


def daily_maximum(readings: DataFrame) -> DataFrame:
    """By day, the mean over stations of each station's highest reading."""
    by_station = readings.groupBy("station", F.to_date("ts").alias("date")).agg(F.max("celsius").alias("top"))
    return by_station.groupBy("date").agg(F.avg("top").alias("celsius"))


def hot_windows(days: DataFrame, over: float | None = None) -> DataFrame:
    """Unbroken runs of days above a temperature, or else above their mean: first and last date,
    length, hottest day."""
    if over is None:
        days = days.withColumn("over", F.avg("celsius").over(Window.partitionBy()))  # a row a day
    hot = days.filter(F.col("celsius") > (F.col("over") if over is None else F.lit(over)))
    island = F.date_sub("date", F.row_number().over(Window.orderBy("date")))
    return hot.withColumn("island", island).groupBy("island").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("days"),
        F.min_by("date", F.struct(-F.col("celsius"), "date")).alias("hottest_date"),
    ).drop("island")

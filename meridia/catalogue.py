"""The registered queries: every operator over the test tables, and SQL to hold it against.

The test tables play parts: customers and suppliers are stops of two feeds, orders are trips,
events are stop visits and departures, parts are trees and buildings, lineitems are measured
hours. Places are derived from keys by the same arithmetic in both languages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.config import DEFAULTS as P
from meridia.functions import geometry as G
from meridia.functions import scalar as S
from meridia.operators import expectations, exposure, payload, schedule, shadow, spatial, weather
from meridia.sources import readers, shared, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable:
    """Register a function under its name, with its SQL."""

    def enter(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return enter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lat_of(k: Column) -> Column:
    return F.lit(45.40) + ((k * 7919) % 100000).cast("double") * F.lit(1e-6)


def lon_of(k: Column) -> Column:
    return F.lit(9.10) + ((k * 104729) % 140000).cast("double") * F.lit(1e-6)


def lat_sql(k: str) -> str:
    return f"(CAST(45.40 AS DOUBLE) + CAST(({k} * 7919) % 100000 AS DOUBLE) * 1e-6)"


def lon_sql(k: str) -> str:
    return f"(CAST(9.10 AS DOUBLE) + CAST(({k} * 104729) % 140000 AS DOUBLE) * 1e-6)"


def apart_sql(a: str, b: str) -> str:
    """Great-circle metres between a.lat, a.lon and b.lat, b.lon."""
    return (
        f"(2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2)"
        f" + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin((radians({b}.lon) - radians({a}.lon)) / 2), 2)))))"
    )


def round_sql(x: str, digits: int) -> str:
    return f"(round(CAST({x} AS DOUBLE) * 1e{digits}, 0) / 1e{digits})"


# -- schedules


@query(f"""
SELECT 'A-' || c_custkey AS stop_id, 'A' AS agency_code, c_name AS stop_name, {lat_sql('c_custkey')} AS stop_lat, {lon_sql('c_custkey')} AS stop_lon,
       CAST(0 AS BIGINT) AS location_type FROM customer
UNION ALL
SELECT 'B-' || s_suppkey, 'B', s_name, {lat_sql('s_suppkey')}, {lon_sql('s_suppkey')}, NULL FROM supplier
""")
def conformed_stops(spark: SparkSession, d: str) -> DataFrame:
    """Two feeds' stops under prefixed ids, the poorer one filled with typed nulls."""
    a, b = table(spark, d, "customer"), table(spark, d, "supplier")
    a = a.select(S.prefixed("A", "c_custkey").alias("stop_id"), F.lit("A").alias("agency_code"), F.col("c_name").alias("stop_name"), lat_of(F.col("c_custkey")).alias("stop_lat"), lon_of(F.col("c_custkey")).alias("stop_lon"), F.lit(0).cast("long").alias("location_type"))
    b = b.select(S.prefixed("B", "s_suppkey").alias("stop_id"), F.lit("B").alias("agency_code"), F.col("s_name").alias("stop_name"), lat_of(F.col("s_suppkey")).alias("stop_lat"), lon_of(F.col("s_suppkey")).alias("stop_lon"))
    return a.unionByName(b, allowMissingColumns=True)


def calendar(orders: DataFrame) -> DataFrame:
    """A fortnight's weekly calendar for each priority."""
    start = F.min(F.to_date("o_orderdate")).alias("start_date")
    c = orders.groupBy(F.col("o_orderpriority").alias("service_id")).agg(start)
    flags = [F.lit(True).alias(w) for w in schedule.WEEKDAYS[1:6]] + [(F.col("service_id") < "3").alias("saturday"), (F.col("service_id") < "2").alias("sunday")]
    return c.select("service_id", "start_date", F.date_add("start_date", 13).alias("end_date"), *flags)


def exceptions(orders: DataFrame) -> DataFrame:
    kind = F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 3 == 0), 2).when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 97 == 0), 1)
    return orders.select(F.col("o_orderpriority").alias("service_id"), F.to_date("o_orderdate").alias("date"), kind.alias("exception_type")).filter("exception_type IS NOT NULL")


def dates(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return schedule.service_dates(schedule.calendar_days(calendar(orders), "service_id"), exceptions(orders), "service_id")


DATES = """
cal AS (SELECT o_orderpriority AS service_id, CAST(min(o_orderdate) AS DATE) AS a FROM orders GROUP BY 1),
days AS (SELECT service_id, CAST(unnest(generate_series(a, a + INTERVAL 13 DAY, INTERVAL 1 DAY)) AS DATE) AS date FROM cal),
planned AS (
  SELECT service_id, date FROM days
  WHERE dayofweek(date) BETWEEN 1 AND 5 OR (dayofweek(date) = 6 AND service_id < '3') OR (dayofweek(date) = 0 AND service_id < '2')
),
dates AS (
  (SELECT service_id, date FROM planned
   EXCEPT SELECT o_orderpriority, CAST(o_orderdate AS DATE) FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0)
  UNION SELECT o_orderpriority, CAST(o_orderdate AS DATE) FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 97 = 0
)"""


@query(f"WITH {DATES} SELECT service_id, date FROM dates")
def service_dates(spark: SparkSession, d: str) -> DataFrame:
    """Calendar without removed dates, with added ones (which win)."""
    return dates(spark, d)


@query(f"WITH {DATES} SELECT DISTINCT service_id, dayname(date) AS day_type, dayofweek(date) IN (0, 6) AS is_weekend FROM dates")
def service_days(spark: SparkSession, d: str) -> DataFrame:
    return schedule.service_days(dates(spark, d), "service_id")


@query("""
WITH b AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS z FROM orders),
s AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date FROM b)
SELECT date, year(date) AS year, month(date) AS month, day(date) AS day, dayname(date) AS day_name, dayofweek(date) IN (0, 6) AS is_weekend FROM s
""")
def date_spine(spark: SparkSession, d: str) -> DataFrame:
    return schedule.date_spine(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")))


def trips(spark: SparkSession, d: str) -> DataFrame:
    """Orders as trips, customers as routes, nations as agencies."""
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    t = o.select(F.lit("A").alias("agency_code"), F.col("o_orderkey").alias("trip_id"), F.col("o_custkey").alias("route_id"), F.col("o_orderpriority").alias("service_id"), F.col("o_orderstatus").alias("trip_headsign"))
    r = c.select(F.col("c_custkey").alias("route_id"), F.col("c_nationkey").alias("agency_id"), F.col("c_name").alias("route_short_name"), F.col("c_mktsegment").alias("route_long_name"), F.lit(3).alias("route_type"))
    return schedule.trips_enriched(t, r, n.select(F.col("n_nationkey").alias("agency_id"), F.col("n_name").alias("agency_name")))


@query("""
SELECT 'A' AS agency_code, o_orderkey AS trip_id, o_custkey AS route_id, o_orderpriority AS service_id, o_orderstatus AS trip_headsign,
       c_name AS route_short_name, c_mktsegment AS route_long_name, CASE WHEN c_custkey IS NOT NULL THEN 3 END AS route_type, n_name AS agency_name
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
""")
def trips_enriched(spark: SparkSession, d: str) -> DataFrame:
    return trips(spark, d)


@query(f"""
WITH {DATES}
SELECT 'A' AS agency_code, o_orderkey AS trip_id, o_custkey AS route_id, o_orderpriority AS service_id, date AS service_date, c_name AS route_short_name,
       CASE WHEN c_custkey IS NOT NULL THEN 3 END AS route_type
FROM orders JOIN dates ON o_orderpriority = service_id LEFT JOIN customer ON o_custkey = c_custkey
""")
def trip_dates(spark: SparkSession, d: str) -> DataFrame:
    """A row for each trip and date it runs."""
    return schedule.trip_dates(trips(spark, d), dates(spark, d).withColumn("agency_code", F.lit("A")))


def visits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events as visits, the odd ones a day late on the clock, and their trips."""
    e = table(spark, d, "events")
    clock = F.concat(F.lpad((F.hour("ts") + 24 * (F.col("event_id") % 2)).cast("string"), 2, "0"), F.date_format("ts", ":mm:ss"))
    v = e.select(F.lit("A").alias("agency_code"), F.col("event_id").alias("trip_id"), F.col("user_id").alias("stop_id"), (F.col("event_id") % 50).cast("int").alias("stop_sequence"), clock.alias("arrival_time"), clock.alias("departure_time"))
    t = e.select(F.lit("A").alias("agency_code"), F.col("event_id").alias("trip_id"), F.col("event_type").alias("route_id"), F.col("event_type").alias("service_id"))
    return schedule.stop_visits(v, t), t


VISITS = """
v AS (
  SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS date,
         lpad(CAST(hour(ts) + 24 * (event_id % 2) AS VARCHAR), 2, '0') || strftime(ts, ':%M:%S') AS t
  FROM events
)"""


@query(f"""
WITH {VISITS}
SELECT 'A' AS agency_code, event_id AS trip_id, event_type AS route_id, user_id AS stop_id, CAST(event_id % 50 AS INTEGER) AS stop_sequence,
       t AS arrival_time, t AS departure_time, CAST(CAST(split_part(t, ':', 1) AS INTEGER) % 24 AS INTEGER) AS arrival_hour FROM v
""")
def stop_times_hour(spark: SparkSession, d: str) -> DataFrame:
    """Hours past 23 come back into the day."""
    return visits(spark, d)[0]


def event_days(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return schedule.service_days(e.select(F.lit("A").alias("agency_code"), F.col("event_type").alias("service_id"), F.to_date("ts").alias("date")).distinct(), "agency_code", "service_id")


FREQUENCY = f"""
{VISITS},
days AS (SELECT DISTINCT event_type, dayname(date) AS day_type FROM v),
freq AS (
  SELECT 'A' AS agency_code, user_id AS stop_id, day_type, CAST(CAST(split_part(t, ':', 1) AS INTEGER) % 24 AS INTEGER) AS arrival_hour, count(*) AS trip_count
  FROM v JOIN days USING (event_type) GROUP BY ALL
)"""


@query(f"WITH {FREQUENCY} SELECT * FROM freq")
def service_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Visits by stop, day type and hour."""
    v, t = visits(spark, d)
    return schedule.service_frequency(v, t, event_days(spark, d))


@query(f"WITH {FREQUENCY} SELECT * FROM freq ORDER BY trip_count DESC, stop_id, day_type, arrival_hour LIMIT 10")
def top_frequency(spark: SparkSession, d: str) -> DataFrame:
    """The ten busiest stops, day types and hours."""
    return service_frequency(spark, d).orderBy(F.desc("trip_count"), "stop_id", "day_type", "arrival_hour").limit(10)


@query("""
SELECT c_custkey AS stop_id, 'A' AS agency_code, c_name AS stop_name, count(DISTINCT o_orderpriority) AS route_count,
       min(strftime(o_orderdate, '%Y-%m-%d')) AS first_scheduled_arrival, max(strftime(o_orderdate, '%Y-%m-%d')) AS last_scheduled_arrival
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL
""")
def stop_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Routes and span of service by stop; unserved stops stay."""
    stops = table(spark, d, "customer").select(F.col("c_custkey").alias("stop_id"), F.lit("A").alias("agency_code"), F.col("c_name").alias("stop_name"))
    seen = table(spark, d, "orders").select(F.lit("A").alias("agency_code"), F.col("o_custkey").alias("stop_id"), F.col("o_orderpriority").alias("route_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("arrival_time"))
    return schedule.stop_coverage(stops, seen)


# -- waiting


def departures(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("stop_id"), F.col("event_type").alias("route_id"), F.hour("ts").alias("raw_hour"), (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).alias("seconds"))


def waits_sql(departures: str) -> str:
    """Waits of departures (stop_id, route_id, h, s)."""
    return f"""
dep AS ({departures}),
g1 AS (SELECT stop_id, route_id, h, lead(s) OVER (PARTITION BY stop_id, route_id ORDER BY s) - s AS gap FROM dep),
g2 AS (SELECT stop_id, h, lead(s) OVER (PARTITION BY stop_id ORDER BY s) - s AS gap FROM dep),
line AS (SELECT stop_id, route_id, h, median(gap) AS hw FROM g1 WHERE h BETWEEN 13 AND 19 AND gap > 0 AND gap < 10800 GROUP BY 1, 2, 3),
anyl AS (SELECT stop_id, h, avg(gap * CAST(gap AS DOUBLE)) / (2.0 * avg(gap)) / 60.0 AS w FROM g2 WHERE h BETWEEN 13 AND 19 AND gap > 0 AND gap < 10800 GROUP BY 1, 2),
waits AS (
  SELECT l.stop_id, CAST(l.h AS INTEGER) AS hour, {round_sql('median(hw) / 2.0 / 60.0', 1)} AS median_wait_minutes, CAST(count(DISTINCT route_id) AS INTEGER) AS n_lines,
         {round_sql('median(hw) / 60.0', 2)} AS median_headway_minutes, {round_sql('any_value(a.w)', 2)} AS wait_any_line_minutes,
         {round_sql('max(hw) / 2.0 / 60.0', 2)} AS wait_least_frequent_minutes
  FROM line l LEFT JOIN anyl a ON a.stop_id = l.stop_id AND a.h = l.h GROUP BY 1, 2
)"""


WAITS = waits_sql("SELECT user_id AS stop_id, event_type AS route_id, hour(ts) AS h, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS s FROM events")


def share_sql(h: str, most: str) -> str:
    return f"(CASE WHEN {h} IS NULL THEN NULL WHEN {h} <= 5 THEN CAST(0 AS DOUBLE) WHEN {h} < 11 THEN {most} * ({h} - 5) / 6 ELSE {most} END)"


def mixed_sql(h: str, most: str) -> str:
    s = share_sql(h, most)
    return f"((1 - {s}) * ({h} / 2) + {s} * least({h} / 2, 2))"


@query(f"WITH {WAITS} SELECT * FROM waits")
def headways(spark: SparkSession, d: str) -> DataFrame:
    """Waiting by stop and hour from medians of headways, by line and then across lines."""
    return schedule.waits(departures(spark, d))


HALF = "CAST(0.5 AS DOUBLE)"
MIXED = f"""{WAITS},
mixed AS (
  SELECT *, {share_sql('median_headway_minutes', HALF)} AS sync_share, {mixed_sql('median_headway_minutes', HALF)} AS wait_mixed_minutes,
         CASE WHEN median_wait_minutes IS NULL THEN NULL WHEN median_wait_minutes >= 25 THEN 'high' WHEN median_wait_minutes >= 10 THEN 'medium' ELSE 'low' END AS wait_time_bucket
  FROM waits
)"""


@query(f"WITH {MIXED} SELECT * REPLACE ({round_sql('sync_share', 6)} AS sync_share, {round_sql('wait_mixed_minutes', 6)} AS wait_mixed_minutes) FROM mixed")
def wait_mixed(spark: SparkSession, d: str) -> DataFrame:
    out = schedule.mixed_waits(headways(spark, d))
    return out.withColumns({c: S.rounded(c, 6) for c in ("sync_share", "wait_mixed_minutes")})


@query(f"""
WITH {WAITS}, v AS (SELECT median_wait_minutes AS x FROM waits WHERE median_wait_minutes IS NOT NULL)
SELECT count(*) AS n, list_sort(list(x))[count(*) // 2 + 1] AS upper_median, max(x) AS longest, min(x) AS shortest FROM v
""")
def wait_summary(spark: SparkSession, d: str) -> DataFrame:
    """The figures that are reported after waits have been made."""
    x = "median_wait_minutes"
    return headways(spark, d).filter(F.col(x).isNotNull()).agg(F.count(F.lit(1)).alias("n"), S.upper_median(x).alias("upper_median"), F.max(x).alias("longest"), F.min(x).alias("shortest"))


# -- exposure


def measured(spark: SparkSession, d: str) -> DataFrame:
    """Lineitems as hours measured at their order."""
    t = table(spark, d, "lineitem")
    building, tree, shelter = F.col("l_returnflag") == "R", (F.col("l_linestatus") == "O") & (F.col("l_quantity") < 20), F.col("l_orderkey") % 3 == 0
    rows = t.select(F.col("l_orderkey").alias("osm_node_id"), (F.col("l_linenumber") % 7 + 13).cast("int").alias("hour"), building.alias("in_building_shadow"), (~building & tree).alias("in_tree_shadow"), shelter.alias("has_shelter"))
    rows = rows.withColumn("exposed", ~F.col("in_building_shadow") & ~F.col("in_tree_shadow") & ~F.col("has_shelter"))
    return exposure.scored(rows)


def weight_sql(b: str, t: str, s: str, factor: str = "0.5") -> str:
    return f"(CASE WHEN {b} THEN CAST(0 AS DOUBLE) WHEN {t} THEN CAST(0.03 AS DOUBLE) WHEN {s} THEN CAST({factor} AS DOUBLE) ELSE CAST(1 AS DOUBLE) END)"


MEASURED = f"""
m0 AS (
  SELECT l_orderkey AS osm_node_id, CAST(l_linenumber % 7 + 13 AS INTEGER) AS hour, l_returnflag = 'R' AS in_building_shadow,
         l_returnflag <> 'R' AND l_linestatus = 'O' AND l_quantity < 20 AS in_tree_shadow, l_orderkey % 3 = 0 AS has_shelter FROM lineitem
),
m AS (
  SELECT *, NOT in_building_shadow AND NOT in_tree_shadow AND NOT has_shelter AS exposed,
         {weight_sql('in_building_shadow', 'in_tree_shadow', 'has_shelter')} AS exposure_score FROM m0
)"""


@query(f"WITH {MEASURED} SELECT * FROM m")
def exposure_score(spark: SparkSession, d: str) -> DataFrame:
    """Each hour's weight, the strongest protection first."""
    return measured(spark, d)


def level_sql(x: str) -> str:
    return f"(CASE WHEN {x} >= 5 THEN 'high' WHEN {x} <= 1 THEN 'low' ELSE 'medium' END)"


SENSITIVITY = f"""{MEASURED},
f AS (SELECT CAST(unnest([0, 0.25, 0.5, 0.75, 1.0, 1.2]) AS DOUBLE) AS shelter_factor),
sens AS (
  SELECT osm_node_id, shelter_factor, {round_sql('sum(' + weight_sql('in_building_shadow', 'in_tree_shadow', 'has_shelter', 'shelter_factor') + ')', 6)} AS exposure_score_hours
  FROM m, f GROUP BY 1, 2
)"""


@query(f"WITH {SENSITIVITY} SELECT *, {level_sql('exposure_score_hours')} AS risk_level FROM sens")
def risk_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Score and risk by stop and shelter factor."""
    return exposure.risk_sensitivity(measured(spark, d))


@query(f"""
WITH {SENSITIVITY},
st AS (SELECT osm_node_id, count(DISTINCT {level_sql('exposure_score_hours')}) AS n FROM sens GROUP BY 1),
a AS (
  SELECT osm_node_id, count(*) AS hours_measured, sum(exposure_score) AS score, CAST(sum(CASE WHEN exposed THEN 1 ELSE 0 END) AS BIGINT) AS hours_exposed_binary,
         max(CASE WHEN has_shelter THEN 1 ELSE 0 END) = 1 AS has_shelter, CAST(sum(CASE WHEN in_tree_shadow THEN 1 ELSE 0 END) AS BIGINT) AS tree_shade_hours FROM m GROUP BY 1
)
SELECT osm_node_id, hours_measured, {round_sql('score', 3)} AS exposure_score_hours, {round_sql('score / hours_measured', 3)} AS pct_exposure_score, hours_exposed_binary,
       {round_sql('CAST(hours_exposed_binary AS DOUBLE) / hours_measured', 3)} AS pct_hours_exposed_binary, has_shelter, {level_sql('score')} AS risk_level,
       CASE WHEN hours_exposed_binary = hours_measured THEN 'high' WHEN hours_exposed_binary = 0 THEN 'low' ELSE 'medium' END AS risk_level_binary,
       CAST(ntile(10) OVER (ORDER BY {round_sql('score', 6)}, osm_node_id) AS BIGINT) AS exposure_decile, n = 1 AS risk_level_stable, tree_shade_hours, o_custkey % 5 AS n_trees_20m
FROM a LEFT JOIN st USING (osm_node_id) LEFT JOIN orders ON o_orderkey = osm_node_id
""")
def heat_risk(spark: SparkSession, d: str) -> DataFrame:
    """Exposure, risk, decile and stability by stop."""
    trees = table(spark, d, "orders").select(F.col("o_orderkey").alias("osm_node_id"), (F.col("o_custkey") % 5).alias("n_trees_20m"))
    return exposure.heat_risk(measured(spark, d), None, trees)


@query(f"""
WITH {MEASURED}
SELECT count(*) AS hours, CAST(sum(CASE WHEN exposed THEN 1 ELSE 0 END) AS BIGINT) AS exposed_hours, {round_sql('avg(CASE WHEN exposed THEN 1.0 ELSE 0.0 END)', 6)} AS share, max(hour) AS last_hour FROM m
""")
def exposure_summary(spark: SparkSession, d: str) -> DataFrame:
    """How many hours are exposed, and their share."""
    n = F.count(F.lit(1))
    return measured(spark, d).agg(n.alias("hours"), F.count_if("exposed").alias("exposed_hours"), S.rounded(F.count_if("exposed").cast("double") / n, 6).alias("share"), F.max("hour").alias("last_hour"))


# -- places


def near_stops(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers a few metres from the customer with the same key."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.cast("string").alias("stop_id"), (lat_of(k) + ((k * 37) % 400).cast("double") * F.lit(1e-6)).alias("lat"), lon_of(k).alias("lon"))


def named_stops(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    ref = F.when(k % 3 == 0, k).when(k % 5 == 0, k + 1).cast("string")
    return table(spark, d, "customer").select(k.cast("string").alias("id"), ref.alias("ref"), lat_of(k).alias("lat"), lon_of(k).alias("lon"))


PLACES = f"""
b AS (SELECT CAST(s_suppkey AS VARCHAR) AS stop_id, {lat_sql('s_suppkey')} + CAST((s_suppkey * 37) % 400 AS DOUBLE) * 1e-6 AS lat, {lon_sql('s_suppkey')} AS lon FROM supplier),
a AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(CASE WHEN c_custkey % 3 = 0 THEN c_custkey WHEN c_custkey % 5 = 0 THEN c_custkey + 1 END AS VARCHAR) AS ref,
             {lat_sql('c_custkey')} AS lat, {lon_sql('c_custkey')} AS lon FROM customer),
r AS (SELECT id, stop_id, {apart_sql('a', 'b')} AS apart FROM a JOIN b ON ref = stop_id WHERE {apart_sql('a', 'b')} <= 200),
n AS (
  SELECT id, stop_id, {apart_sql('a', 'b')} AS apart FROM a JOIN b ON {apart_sql('a', 'b')} <= 30 AND abs(a.lat - b.lat) < 0.001
  WHERE id NOT IN (SELECT id FROM r)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY {apart_sql('a', 'b')}, stop_id) = 1
),
bridge AS (
  SELECT a.id AS osm_node_id, coalesce(r.stop_id, n.stop_id) AS gtfs_stop_id,
         CASE WHEN r.id IS NOT NULL THEN 'ref' WHEN n.id IS NOT NULL THEN 'nearest' ELSE 'unmatched' END AS match_method, coalesce(r.apart, n.apart) AS distance_m
  FROM a LEFT JOIN r ON r.id = a.id LEFT JOIN n ON n.id = a.id
)"""


@query(f"WITH {PLACES} SELECT * REPLACE ({round_sql('distance_m', 6)} AS distance_m) FROM bridge")
def stop_bridge(spark: SparkSession, d: str) -> DataFrame:
    """Stops of two id spaces, matched by reference or else by nearness."""
    return spatial.stop_bridge(named_stops(spark, d), near_stops(spark, d)).withColumn("distance_m", S.rounded("distance_m", 6))


@query(f"""
WITH s AS (SELECT s_suppkey AS id, {lat_sql('s_suppkey')} AS lat, {lon_sql('s_suppkey')} AS lon FROM supplier),
t AS (SELECT {lat_sql('(p_partkey % 100 + 1)')} + CAST((p_partkey * 13) % 500 - 250 AS DOUBLE) * 1e-6 AS lat, {lon_sql('(p_partkey % 100 + 1)')} AS lon FROM part)
SELECT s.id, count(t.lat) AS n FROM s LEFT JOIN t ON abs(t.lat - s.lat) < 0.001 AND {apart_sql('s', 't')} <= 20 GROUP BY 1
""")
def tree_counts(spark: SparkSession, d: str) -> DataFrame:
    """Trees within 20 m of each stop, zeros included."""
    k = F.col("p_partkey")
    trees = table(spark, d, "part").select((lat_of(k % 100 + 1) + ((k * 13) % 500 - 250).cast("double") * F.lit(1e-6)).alias("lat"), lon_of(k % 100 + 1).alias("lon"))
    k = F.col("s_suppkey")
    return spatial.count_near(table(spark, d, "supplier").select(k.alias("id"), lat_of(k).alias("lat"), lon_of(k).alias("lon")), trees, P.tree_metres)


@query(f"""
WITH s AS (SELECT s_suppkey AS id, {lat_sql('s_suppkey')} AS lat, {lon_sql('s_suppkey')} AS lon FROM supplier),
t AS (SELECT c_custkey AS cand, {lat_sql('c_custkey')} + CAST((c_custkey * 13) % 500 AS DOUBLE) * 1e-6 AS lat, {lon_sql('c_custkey')} AS lon FROM customer),
p AS (SELECT id, cand, {apart_sql('s', 't')} AS m FROM s JOIN t ON abs(s.lat - t.lat) < 0.01 AND {apart_sql('s', 't')} <= 400)
SELECT id, cand AS candidate, {round_sql('m', 6)} AS metres_apart, CAST(row_number() OVER w AS INTEGER) AS place FROM p
WINDOW w AS (PARTITION BY id ORDER BY m, cand) QUALIFY row_number() OVER w <= 3
""")
def nearest_three(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest customers within 400 m of each supplier, in order."""
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    a = table(spark, d, "supplier").select(k.alias("id"), lat_of(k).alias("lat"), lon_of(k).alias("lon"))
    b = table(spark, d, "customer").select(c.alias("candidate"), (lat_of(c) + ((c * 13) % 500).cast("double") * F.lit(1e-6)).alias("lat"), lon_of(c).alias("lon"))
    pairs = spatial.within(a, b, 400.0).select("a.id", "b.candidate", "metres_apart")
    return spatial.ranked_nearest(pairs, "id", "candidate", 3).withColumn("metres_apart", S.rounded("metres_apart", 6))


def map_trees(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    trees = table(spark, d, "part").select(k.alias("tree_id"), F.col("p_brand").alias("genus"), F.col("p_type").alias("species"), F.col("p_size").cast("double").alias("height_m"), (k % 70).cast("double").alias("crown2"), lon_of(k).alias("lon"), lat_of(k).alias("lat"))
    trees = readers.with_validity(trees.withColumn("crown_diameter_m", F.col("crown2") / 2).drop("crown2"))
    shade = table(spark, d, "lineitem").filter("l_quantity = 50 AND l_partkey % 2 = 0").select(F.col("l_partkey").alias("tree_id"))
    return exposure.trees_for_map(trees, shade)


TREES = f"""
tm AS (
  SELECT p_partkey AS tree_id, p_brand AS genus, p_type AS species, CAST(p_size AS DOUBLE) AS height_m, CAST(p_partkey % 70 AS DOUBLE) / 2 AS crown_diameter_m,
         {lon_sql('p_partkey')} AS lon, {lat_sql('p_partkey')} AS lat, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50 AND l_partkey % 2 = 0) AS shades_stop
  FROM part WHERE p_size BETWEEN 1 AND 45 AND CAST(p_partkey % 70 AS DOUBLE) / 2 BETWEEN 0.5 AND 30
)"""


@query(f"WITH {TREES} SELECT * FROM tm")
def trees_map(spark: SparkSession, d: str) -> DataFrame:
    """Usable trees, and whether they shade a stop."""
    return map_trees(spark, d)


GRID = f"""{TREES},
o AS (SELECT min(lon) AS lon0, min(lat) AS lat0 FROM tm),
q AS (
  SELECT tm.*, CAST(round_even((lon - lon0) / 1e-5, 0) AS BIGINT) AS x, CAST(round_even((lat - lat0) / 1e-5, 0) AS BIGINT) AS y FROM tm, o
),
k AS (SELECT *, row_number() OVER w - 1 AS i, x - coalesce(lag(x) OVER w, 0) AS dx, y - coalesce(lag(y) OVER w, 0) AS dy FROM q WINDOW w AS (ORDER BY y // 200, x, y, tree_id)),
ge AS (SELECT genus, row_number() OVER (ORDER BY min(i)) - 1 AS ge FROM k GROUP BY genus),
sp AS (SELECT genus, species, row_number() OVER (ORDER BY min(i)) - 1 AS sp FROM k GROUP BY genus, species),
cols AS (
  SELECT i, dx, dy, CAST(round_even(height_m, 0) AS BIGINT) AS h, CAST(round_even(crown_diameter_m * 2, 0) AS BIGINT) AS c, sp, ge, shades_stop, tree_id
  FROM k JOIN ge USING (genus) JOIN sp USING (genus, species)
)"""


@query(f"WITH {GRID} SELECT * FROM cols")
def tree_delta(spark: SparkSession, d: str) -> DataFrame:
    """Trees in map order with steps and codes."""
    return payload.tree_columns(map_trees(spark, d))


@query(f"WITH {GRID} SELECT i, x, y FROM k")
def tree_undelta(spark: SparkSession, d: str) -> DataFrame:
    """Places again from the steps."""
    return payload.undelta(tree_delta(spark, d)).select("i", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


@query(f"""
WITH {GRID}, z AS (SELECT i AS j, x, y FROM k WHERE shades_stop)
SELECT row_number() OVER w - 1 AS i, x - coalesce(lag(x) OVER w, 0) AS dx, y - coalesce(lag(y) OVER w, 0) AS dy, h, c, sp, ge
FROM z JOIN cols ON cols.i = j WINDOW w AS (ORDER BY j)
""")
def tree_shading_subset(spark: SparkSession, d: str) -> DataFrame:
    """Only the trees that shade a stop, encoded anew."""
    out = payload.shading_only(tree_delta(spark, d))
    return out.withColumns({c: F.col(c).cast("long") for c in ("dx", "dy")})


# -- exposure and waiting together


def hours_of(spark: SparkSession, d: str) -> DataFrame:
    """Customers by studied hour, shadows by arithmetic."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.cast("string").alias("osm_node_id"), k.alias("k"), F.explode(F.array(*[F.lit(h) for h in P.hours])).alias("hour"))
    building = (F.col("k") * 7 + F.col("hour")) % 5 == 0
    rows = rows.select("osm_node_id", "hour", building.alias("in_building_shadow"), (~building & ((F.col("k") + F.col("hour")) % 6 == 0)).alias("in_tree_shadow"), (F.col("k") % 3 == 0).alias("has_shelter"))
    return exposure.scored(rows.withColumn("exposed", ~F.col("in_building_shadow") & ~F.col("in_tree_shadow") & ~F.col("has_shelter")))


def stop_waits(spark: SparkSession, d: str) -> DataFrame:
    w = schedule.mixed_waits(headways(spark, d))
    return w.select(F.col("stop_id").cast("string").alias("gtfs_stop_id"), F.concat(F.lit("stop "), F.col("stop_id")).alias("stop_name"), (lat_of(F.col("stop_id")) + F.lit(2e-7)).alias("lat"), (lon_of(F.col("stop_id")) + F.lit(2e-7)).alias("lon"), *[c for c in w.columns if c != "stop_id"])


def matches(spark: SparkSession, d: str) -> DataFrame:
    """Customers at the stop of their own key, but for every fourth."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.cast("string").alias("osm_node_id"), F.when(k % 4 != 0, k.cast("string")).alias("gtfs_stop_id"), F.when(k % 4 != 0, "ref").otherwise("unmatched").alias("match_method"),
        F.when(k % 4 != 0, (k % 200).cast("double")).alias("distance_m"),
    )


def combined(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    k = F.col("c_custkey")
    hourly, waits, bridge = hours_of(spark, d), stop_waits(spark, d), matches(spark, d)
    stops = table(spark, d, "customer").select(k.cast("string").alias("osm_node_id"), F.col("c_name").alias("name"), (lon_of(k) + F.lit(2e-7)).alias("lon"), (lat_of(k) + F.lit(2e-7)).alias("lat"))
    trees = table(spark, d, "customer").select(k.cast("string").alias("osm_node_id"), (k % 4).alias("n_trees_20m"))
    risk = exposure.heat_risk(hourly, None, trees)
    return exposure.heat_wait_hourly(hourly, stops, bridge, waits, risk), risk, bridge, waits


COMBINED = f"""{MIXED},
h0 AS (
  SELECT CAST(c_custkey AS VARCHAR) AS osm_node_id, c_custkey AS k, c_name, CAST(hour AS INTEGER) AS hour, (c_custkey * 7 + hour) % 5 = 0 AS in_building_shadow,
         (c_custkey * 7 + hour) % 5 <> 0 AND (c_custkey + hour) % 6 = 0 AS in_tree_shadow, c_custkey % 3 = 0 AS has_shelter
  FROM customer, (SELECT unnest(generate_series(13, 19)) AS hour)
),
hh AS (SELECT *, {weight_sql('in_building_shadow', 'in_tree_shadow', 'has_shelter')} AS exposure_score, NOT in_building_shadow AND NOT in_tree_shadow AND NOT has_shelter AS exposed FROM h0),
fs AS (SELECT CAST(unnest([0, 0.25, 0.5, 0.75, 1.0, 1.2]) AS DOUBLE) AS factor),
se AS (SELECT osm_node_id, factor, {round_sql('sum(' + weight_sql('in_building_shadow', 'in_tree_shadow', 'has_shelter', 'factor') + ')', 6)} AS v FROM hh, fs GROUP BY 1, 2),
stab AS (SELECT osm_node_id, count(DISTINCT {level_sql('v')}) = 1 AS stable FROM se GROUP BY 1),
ra AS (
  SELECT osm_node_id, any_value(k) AS k, count(*) AS hours_measured, sum(exposure_score) AS score, CAST(sum(CASE WHEN exposed THEN 1 ELSE 0 END) AS BIGINT) AS hours_exposed_binary,
         bool_or(has_shelter) AS has_shelter, CAST(sum(CASE WHEN in_tree_shadow THEN 1 ELSE 0 END) AS BIGINT) AS tree_shade_hours FROM hh GROUP BY 1
),
risk AS (
  SELECT osm_node_id, k, hours_measured, {round_sql('score', 3)} AS exposure_score_hours, {round_sql('score / hours_measured', 3)} AS pct_exposure_score, hours_exposed_binary,
         {round_sql('CAST(hours_exposed_binary AS DOUBLE) / hours_measured', 3)} AS pct_hours_exposed_binary, has_shelter, {level_sql('score')} AS risk_level,
         CASE WHEN hours_exposed_binary = hours_measured THEN 'high' WHEN hours_exposed_binary = 0 THEN 'low' ELSE 'medium' END AS risk_level_binary,
         CAST(ntile(10) OVER (ORDER BY {round_sql('score', 6)}, osm_node_id) AS BIGINT) AS exposure_decile, stable AS risk_level_stable, tree_shade_hours, k % 4 AS n_trees_20m
  FROM ra JOIN stab USING (osm_node_id)
),
br AS (
  SELECT CAST(c_custkey AS VARCHAR) AS osm_node_id, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS gtfs_stop_id,
         CASE WHEN c_custkey % 4 <> 0 THEN 'ref' ELSE 'unmatched' END AS match_method, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 200 AS DOUBLE) END AS distance_m FROM customer
),
hw AS (
  SELECT hh.osm_node_id, c_name AS stop_name, {lon_sql('hh.k')} + 2e-7 AS lon, {lat_sql('hh.k')} + 2e-7 AS lat, hh.hour, in_building_shadow, in_tree_shadow, hh.has_shelter, exposure_score,
         br.gtfs_stop_id, match_method, wait_mixed_minutes AS wait_minutes, least(wait_any_line_minutes, wait_mixed_minutes) AS wait_minutes_low,
         wait_least_frequent_minutes AS wait_minutes_high, median_wait_minutes AS wait_minutes_random, exposure_score * wait_mixed_minutes AS exposed_wait_minutes,
         risk_level, exposure_decile, risk_level_stable, tree_shade_hours, n_trees_20m
  FROM hh JOIN br USING (osm_node_id) LEFT JOIN mixed w ON CAST(w.stop_id AS VARCHAR) = br.gtfs_stop_id AND w.hour = hh.hour LEFT JOIN risk r ON r.osm_node_id = hh.osm_node_id
)"""
WAIT_COLUMNS = ("wait_minutes", "wait_minutes_low", "exposed_wait_minutes")


@query(f"WITH {COMBINED} SELECT * REPLACE ({', '.join(f'{round_sql(c, 6)} AS {c}' for c in WAIT_COLUMNS)}) FROM hw")
def heat_wait_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Exposure, waiting and risk by stop and hour."""
    return combined(spark, d)[0].withColumns({c: S.rounded(c, 6) for c in WAIT_COLUMNS})


@query(f"""
WITH {COMBINED}
SELECT r.osm_node_id, hours_measured, exposure_score_hours, pct_exposure_score, hours_exposed_binary, pct_hours_exposed_binary, has_shelter, risk_level, risk_level_binary,
       exposure_decile, risk_level_stable, gtfs_stop_id, match_method, distance_m, {round_sql('md', 6)} AS median_wait_13_19, {round_sql('av', 6)} AS avg_exposed_wait_minutes
FROM risk r LEFT JOIN br USING (osm_node_id)
LEFT JOIN (SELECT CAST(stop_id AS VARCHAR) AS s, median(median_wait_minutes) AS md FROM mixed GROUP BY 1) ON s = gtfs_stop_id
LEFT JOIN (SELECT osm_node_id AS o, avg(exposed_wait_minutes) AS av FROM hw GROUP BY 1) ON o = r.osm_node_id
""")
def heat_wait(spark: SparkSession, d: str) -> DataFrame:
    """Risk by stop with its mean exposed wait."""
    hourly, risk, bridge, waits = combined(spark, d)
    return exposure.heat_wait(risk, bridge, waits, hourly).withColumns({c: S.rounded(c, 6) for c in ("median_wait_13_19", "avg_exposed_wait_minutes")})


@query(f"""
WITH {COMBINED},
gr AS (SELECT CAST(unnest([0, 0.25, 0.5, 0.6]) AS DOUBLE) AS sync_share_max),
ps AS (
  SELECT sync_share_max, osm_node_id, risk_level, avg(exposure_score * {mixed_sql('median_headway_minutes', 'sync_share_max')}) AS w
  FROM hw JOIN mixed m ON CAST(m.stop_id AS VARCHAR) = hw.gtfs_stop_id AND m.hour = hw.hour, gr WHERE median_headway_minutes IS NOT NULL GROUP BY 1, 2, 3
)
SELECT sync_share_max, risk_level, count(*) AS n_stops, {round_sql('median(w)', 6)} AS median_avg_exposed_wait_minutes, {round_sql('quantile_cont(w, 0.9)', 6)} AS p90_avg_exposed_wait_minutes
FROM ps GROUP BY 1, 2
""")
def wait_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Exposed waits by risk level and share of timed riders."""
    hourly, _, _, waits = combined(spark, d)
    out = exposure.wait_sensitivity(hourly, waits)
    return out.withColumns({c: S.rounded(c, 6) for c in ("median_avg_exposed_wait_minutes", "p90_avg_exposed_wait_minutes")})


def joined(values: Column, digits: int) -> Column:
    return F.array_join(F.transform(values, lambda v: F.coalesce(v.cast(f"decimal(18,{digits})").cast("string"), F.lit("null"))), ",")


def joined_sql(c: str, digits: int, source: str = "hw") -> str:
    return f"string_agg(coalesce(CAST(CAST(round_even({c}, {digits}) AS DECIMAL(18,{digits})) AS VARCHAR), 'null'), ',' ORDER BY hour)"


@query(f"""
WITH {COMBINED}
SELECT osm_node_id AS id, any_value(stop_name) AS n, round_even(any_value(lon), 5) AS lo, round_even(any_value(lat), 5) AS la, {joined_sql('exposure_score', 3)} AS s,
       {joined_sql('wait_minutes', 1)} AS w, {joined_sql('wait_minutes_low', 1)} AS wl, {joined_sql('wait_minutes_high', 1)} AS wh, CAST(any_value(exposure_decile) AS BIGINT) AS dc, CASE WHEN any_value(risk_level_stable) THEN 1 ELSE 0 END AS st,
       any_value(tree_shade_hours) AS ts, any_value(n_trees_20m) AS nt FROM hw GROUP BY 1
""")
def main_payload(spark: SparkSession, d: str) -> DataFrame:
    """The map's stops, hours as lists."""
    out = payload.main_payload(combined(spark, d)[0])
    return out.select("id", "n", "lo", "la", joined(F.col("s"), 3).alias("s"), *[joined(F.col(c), 1).alias(c) for c in ("w", "wl", "wh")], "dc", "st", "ts", "nt")


@query(f"""
WITH {COMBINED}
SELECT osm_node_id AS id, any_value(stop_name) AS n, round_even(any_value(lon), 5) AS lo, round_even(any_value(lat), 5) AS la, any_value(has_shelter) AS sh, CASE WHEN any_value(risk_level_stable) THEN 1 ELSE 0 END AS st,
       {round_sql('sum(exposure_score)', 3)} AS e, {joined_sql('exposure_score', 3)} AS h FROM hw GROUP BY 1
""")
def exposure_payload(spark: SparkSession, d: str) -> DataFrame:
    out = payload.exposure_payload(combined(spark, d)[0])
    return out.select("id", "n", "lo", "la", "sh", "st", "e", joined(F.col("h"), 3).alias("h"))


def wait_sql(c: str) -> str:
    return joined_sql(c, 1).replace("ORDER BY hour", "ORDER BY f.hour")


@query(f"""
WITH {MIXED},
full_ AS (SELECT stop_id, CAST(hour AS INTEGER) AS hour FROM (SELECT DISTINCT stop_id FROM mixed), (SELECT unnest(generate_series(13, 19)) AS hour))
SELECT CAST(f.stop_id AS VARCHAR) AS id, 'stop ' || f.stop_id AS n, round_even({lon_sql('f.stop_id')} + 2e-7, 5) AS lo, round_even({lat_sql('f.stop_id')} + 2e-7, 5) AS la,
       {wait_sql('wait_mixed_minutes')} AS w, {wait_sql('CASE WHEN wait_any_line_minutes IS NOT NULL THEN least(wait_any_line_minutes, wait_mixed_minutes) END')} AS wl,
       {wait_sql('wait_least_frequent_minutes')} AS wh,
       string_agg(CAST(coalesce(n_lines, 0) AS VARCHAR), ',' ORDER BY f.hour) AS nl
FROM full_ f LEFT JOIN mixed m ON m.stop_id = f.stop_id AND m.hour = f.hour GROUP BY f.stop_id
""")
def wait_payload(spark: SparkSession, d: str) -> DataFrame:
    out = payload.wait_payload(stop_waits(spark, d))
    return out.select("id", "n", "lo", "la", *[joined(F.col(c), 1).alias(c) for c in ("w", "wl", "wh")], F.array_join(F.transform("nl", lambda v: v.cast("string")), ",").alias("nl"))


@query(f"SELECT round_even(min({lon_sql('c_custkey')}), 5) AS west, round_even(min({lat_sql('c_custkey')}), 5) AS south, round_even(max({lon_sql('c_custkey')}), 5) AS east, round_even(max({lat_sql('c_custkey')}), 5) AS north FROM customer")
def map_bounds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return payload.bounds(table(spark, d, "customer").select(lon_of(k).alias("lon"), lat_of(k).alias("lat")))


# -- sun and shadow

#: Hour, azimuth and elevation of a summer day.
SUN = ((13, 140.0, 67.2), (14, 165.0, 66.8), (15, 191.0, 60.8), (16, 217.0, 51.9), (17, 241.0, 41.8), (18, 259.0, 31.3), (19, 278.0, 20.9))
SUN_SQL = "sun(hour, azimuth, elevation) AS (VALUES " + ", ".join(f"({h}, CAST({a} AS DOUBLE), CAST({e} AS DOUBLE))" for h, a, e in SUN) + ")"


def sun(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SUN), "hour int, azimuth double, elevation double")


def spots(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), ((k * 37) % 1000 + 0.5).cast("double").alias("x"), ((k * 53) % 1000 + 0.5).cast("double").alias("y"))


SPOTS = "pts AS (SELECT s_suppkey AS id, CAST((s_suppkey * 37) % 1000 AS DOUBLE) + 0.5 AS x, CAST((s_suppkey * 53) % 1000 AS DOUBLE) + 0.5 AS y FROM supplier)"


@query(f"""
WITH {SUN_SQL}, {SPOTS},
cells AS (SELECT p_partkey % 100 AS r, (p_partkey // 100 * 7) % 100 AS c, p_size AS height FROM part),
rad AS (SELECT sun.*, ceil(CAST(mx AS DOUBLE) / tan(radians(elevation)) / 10.0) * 10.0 AS radius FROM sun, (SELECT max(height) AS mx FROM cells)),
ray AS (SELECT id, x, y, hour, azimuth, elevation, CAST(unnest(generate_series(1, CAST(radius / 10 AS INTEGER))) AS DOUBLE) * 10.0 AS d FROM pts, rad)
SELECT DISTINCT id, hour FROM ray JOIN cells
  ON r = CAST(floor((1000.0 - (y + d * cos(radians(azimuth)))) / 10.0) AS BIGINT) AND c = CAST(floor((x + d * sin(radians(azimuth))) / 10.0) AS BIGINT)
WHERE height >= d * tan(radians(elevation))
""")
def building_shadow(spark: SparkSession, d: str) -> DataFrame:
    """Points in a building's shadow, by hour."""
    k = F.col("p_partkey")
    cells = table(spark, d, "part").select((k % 100).cast("int").alias("row"), ((F.floor(k / 100) * 7) % 100).cast("int").alias("col"), F.col("p_size").alias("height"))
    return shadow.building_shadow(spots(spark, d), shadow.with_radius(sun(spark), cells), cells, (0.0, 1000.0))


@query(f"""
WITH {SUN_SQL}, {SPOTS},
tr AS (SELECT p_partkey AS tree_id, CAST((p_partkey * 31) % 997 AS DOUBLE) AS tx, CAST((p_partkey * 17) % 991 AS DOUBLE) AS ty, (CAST(p_partkey % 10 AS DOUBLE) + 1) / 2 AS r,
              CAST(p_size % 20 + 2 AS DOUBLE) * (1.0::DOUBLE / 3) AS base, CAST(p_size % 20 + 2 AS DOUBLE) AS top FROM part),
g AS (
  SELECT id, hour, tree_id, r, base, top, tan(radians(elevation)) AS slope, 21.0::DOUBLE / tan(radians(elevation)) AS reach, x, y, tx, ty,
         (tx - x) * sin(radians(azimuth)) + (ty - y) * cos(radians(azimuth)) AS along FROM pts, sun, tr
),
i AS (
  SELECT *, pow(tx - x, 2) + pow(ty - y, 2) - pow(along, 2) AS off_ FROM g
  WHERE abs(floor(tx / reach) - floor(x / reach)) <= 1 AND abs(floor(ty / reach) - floor(y / reach)) <= 1
),
c AS (SELECT *, sqrt(greatest(r * r - greatest(off_, 0.0), 0.0)) AS half FROM i WHERE off_ <= r * r),
e AS (SELECT *, greatest(along - half, 0.0) AS t_in, along + half AS t_out FROM c)
SELECT id, hour, tree_id FROM e WHERE t_out > 0 AND t_in <= reach AND t_in * slope <= top AND t_out * slope >= base
QUALIFY row_number() OVER (PARTITION BY id, hour ORDER BY t_in, tree_id) = 1
""")
def tree_shadow(spark: SparkSession, d: str) -> DataFrame:
    """The nearest tree that hides the sun from each point, by hour."""
    k, high = F.col("p_partkey"), (F.col("p_size") % 20 + 2).cast("double")
    trees = table(spark, d, "part").select(k.alias("tree_id"), ((k * 31) % 997).cast("double").alias("x"), ((k * 17) % 991).cast("double").alias("y"), high.alias("height_m"), ((k % 10).cast("double") + 1).alias("crown_diameter_m"))
    return shadow.tree_shadow(spots(spark, d), sun(spark), shadow.tree_cylinders(trees), 21.0)


@query("""
WITH t0 AS (SELECT CAST(unnest(generate_series(11, 17)) AS INTEGER) AS h),
t1 AS (SELECT h, (epoch(TIMESTAMP '2026-06-28 00:00:00') + h * 3600.0) / 86400.0 + 2440587.5 - 2451545.0 AS days, h * 60.0 AS minutes FROM t0),
t2 AS (SELECT h, minutes, days / 36525.0 AS c FROM t1),
t3 AS (
  SELECT *, fmod(280.46646 + c * (36000.76983 + c * 0.0003032), 360.0) AS l0, 357.52911 + c * (35999.05029 - 0.0001537 * c) AS m,
         0.016708634 - c * (0.000042037 + 0.0000001267 * c) AS e, radians(125.04 - 1934.136 * c) AS node,
         23.0 + (26.0 + (21.448 - c * (46.815 + c * (0.00059 - c * 0.001813))) / 60) / 60 AS tilt0 FROM t2
),
t4 AS (
  SELECT *, l0 + sin(radians(m)) * (1.914602 - c * (0.004817 + 0.000014 * c)) + sin(radians(2 * m)) * (0.019993 - 0.000101 * c) + sin(radians(3 * m)) * 0.000289
            - 0.00569 - 0.00478 * sin(node) AS lam, radians(tilt0 + 0.00256 * cos(node)) AS tilt FROM t3
),
t5 AS (SELECT *, asin(sin(tilt) * sin(radians(lam))) AS dec, pow(tan(tilt / 2), 2) AS y FROM t4),
t6 AS (
  SELECT *, 4 * degrees(y * sin(2 * radians(l0)) - 2 * e * sin(radians(m)) + 4 * e * y * sin(radians(m)) * cos(2 * radians(l0))
            - 0.5 * y * y * sin(4 * radians(l0)) - 1.25 * e * e * sin(2 * radians(m))) AS eq FROM t5
),
t7 AS (SELECT *, radians(fmod(minutes + eq + 4 * 9.19 + 1440, 1440) / 4 - 180) AS ha, radians(45.4642) AS phi FROM t6),
t8 AS (SELECT *, 90 - degrees(acos(sin(phi) * sin(dec) + cos(phi) * cos(dec) * cos(ha))) AS plain, atan2(sin(ha), cos(ha) * sin(phi) - tan(dec) * cos(phi)) AS az FROM t7)
SELECT CAST(h + 2 AS INTEGER) AS hour, round(fmod(degrees(az) + 180 + 360, 360), 3) AS azimuth,
       round(plain + (58.1 / tan(radians(plain)) - 0.07 / pow(tan(radians(plain)), 3) + 0.000086 / pow(tan(radians(plain)), 5)) / 3600, 3) AS elevation FROM t8
""")
def solar_position(spark: SparkSession, d: str) -> DataFrame:
    """The sun over one place at the studied hours of a summer day, two hours ahead of UTC."""
    hours = spark.range(11, 18).select(F.col("id").cast("int").alias("h"))
    at = F.timestamp_micros(F.unix_micros(F.lit("2026-06-28T00:00:00Z").cast("timestamp")) + F.col("h").cast("long") * F.lit(3_600_000_000))
    azimuth, elevation = G.solar_position(at, 45.4642, 9.19)
    return hours.select((F.col("h") + 2).alias("hour"), S.rounded(azimuth, 3).alias("azimuth"), S.rounded(elevation, 3).alias("elevation"))


@query(f"""
WITH k AS (SELECT sqrt(f * (2 - f)) AS e FROM (SELECT 1 / 298.257222101::DOUBLE AS f)),
k2 AS (
  SELECT e, (1 - e * e) * (1 / (1 - e * e) - (1 / (2 * e)) * ln((1 - e) / (1 + e))) AS qp, sin(radians(52.0)) AS s0 FROM k
),
k3 AS (SELECT *, asin((1 - e * e) * (s0 / (1 - e * e * s0 * s0) - (1 / (2 * e)) * ln((1 - e * s0) / (1 + e * s0))) / qp) AS b0 FROM k2),
k4 AS (SELECT *, 6378137.0 * sqrt(qp / 2) AS rq, 6378137.0 * cos(radians(52.0)) / sqrt(1 - e * s0 * e * s0) / (6378137.0 * sqrt(qp / 2) * cos(b0)) AS d FROM k3),
p AS (SELECT s_suppkey AS id, sin(radians({lat_sql('s_suppkey')})) AS s, radians({lon_sql('s_suppkey')} - 10.0) AS t FROM supplier),
p2 AS (SELECT id, t, asin((1 - e * e) * (s / (1 - e * e * s * s) - (1 / (2 * e)) * ln((1 - e * s) / (1 + e * s))) / qp) AS b, b0, rq, d FROM p, k4),
p3 AS (SELECT *, rq * sqrt(2 / (1 + sin(b0) * sin(b) + cos(b0) * cos(b) * cos(t))) AS w FROM p2)
SELECT id, round(4321000.0 + w * d * cos(b) * sin(t), 3) AS x, round(3210000.0 + w / d * (cos(b0) * sin(b) - sin(b0) * cos(b) * cos(t)), 3) AS y FROM p3
""")
def project_laea(spark: SparkSession, d: str) -> DataFrame:
    """Places on the European equal-area grid, to the millimetre."""
    k = F.col("s_suppkey")
    x, y = G.laea(lat_of(k), lon_of(k))
    return table(spark, d, "supplier").select(k.alias("id"), S.rounded(x, 3).alias("x"), S.rounded(y, 3).alias("y"))


# -- readings and quality


READINGS = "rd AS (SELECT event_type AS station, ts, value AS celsius FROM events)"


def readings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("station"), "ts", F.col("value").alias("celsius"))


@query(f"""
WITH {READINGS}
SELECT CAST(hour(ts) AS INTEGER) AS hour, {round_sql('avg(CASE WHEN celsius > 30 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', 6)} AS share, count(*) AS readings
FROM rd WHERE celsius IS NOT NULL GROUP BY 1
""")
def hot_share_by_hour(spark: SparkSession, d: str) -> DataFrame:
    return weather.hot_share_by_hour(readings(spark, d)).withColumn("share", S.rounded("share", 6))


HOT_DAYS = f"""{READINGS},
dm AS (SELECT date, avg(top) AS celsius FROM (SELECT station, CAST(ts AS DATE) AS date, max(celsius) AS top FROM rd GROUP BY 1, 2) GROUP BY 1)"""


@query(f"WITH {HOT_DAYS} SELECT date, {round_sql('celsius', 6)} AS celsius FROM dm")
def daily_maximum(spark: SparkSession, d: str) -> DataFrame:
    return weather.daily_maximum(readings(spark, d)).withColumn("celsius", S.rounded("celsius", 6))


@query(f"""
WITH {HOT_DAYS}, av AS (SELECT avg(celsius) AS a FROM dm),
hot AS (SELECT date, celsius, date - CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS island FROM dm, av WHERE celsius > a)
SELECT min(date) AS first_date, max(date) AS last_date, count(*) AS days, first(date ORDER BY celsius DESC, date) AS hottest_date FROM hot GROUP BY island
""")
def hot_windows(spark: SparkSession, d: str) -> DataFrame:
    """Unbroken runs of days that are hotter than the mean."""
    return weather.hot_windows(weather.daily_maximum(readings(spark, d)))


@query(f"""
WITH {SENSITIVITY}
SELECT 'stop id is present' AS expectation, count(*) AS violations FROM m WHERE osm_node_id IS NULL
UNION ALL SELECT 'stop and hour are unique', count(*) FROM (SELECT 1 FROM m GROUP BY osm_node_id, hour HAVING count(*) > 1)
UNION ALL SELECT 'hour is one of four', count(*) FROM m WHERE hour NOT IN (13, 14, 15, 16)
UNION ALL SELECT 'stop is an order', count(*) FROM m WHERE osm_node_id NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'score is allowed', count(*) FROM m WHERE exposure_score NOT IN (0, 0.03::DOUBLE, 0.5, 1)
UNION ALL SELECT 'never both shadows', count(*) FROM m WHERE in_building_shadow AND in_tree_shadow
UNION ALL SELECT 'three hours a stop', count(*) FROM (SELECT o_orderkey FROM orders LEFT JOIN m ON osm_node_id = o_orderkey GROUP BY 1 HAVING count(m.hour) <> 3)
UNION ALL SELECT 'sheltered share', count(*) FROM (SELECT avg(CASE WHEN has_shelter THEN 1.0 ELSE 0.0 END) AS s FROM m) WHERE s > 0.12
UNION ALL SELECT 'seven hours', count(*) FROM (SELECT count(DISTINCT hour) AS n FROM m) WHERE n <> 7
UNION ALL SELECT 'scores agree', count(*) FROM (
  SELECT osm_node_id FROM (SELECT osm_node_id, sum(exposure_score) AS a FROM m GROUP BY 1) x
  FULL JOIN (SELECT osm_node_id, exposure_score_hours AS b FROM sens WHERE shelter_factor = 0.5) y USING (osm_node_id)
  WHERE a IS NULL OR b IS NULL OR abs(a - b) > 1e-6)
""")
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    """Violations by expectation over the measured hours."""
    m = measured(spark, d)
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("osm_node_id"))
    again = m.groupBy("osm_node_id").agg(S.rounded(F.sum("exposure_score"), 6).alias("v"))
    base = exposure.risk_sensitivity(m).filter("shelter_factor = 0.5").select("osm_node_id", F.col("exposure_score_hours").alias("v"))
    allowed = lambda c, *values: F.col(c).isNull() | F.col(c).isin(*values)
    rows = expectations.row_rules(m, {
        "stop id is present": F.col("osm_node_id").isNotNull(),
        "hour is one of four": allowed("hour", 13, 14, 15, 16),
        "score is allowed": allowed("exposure_score", 0.0, 0.03, 0.5, 1.0),
        "never both shadows": ~(F.col("in_building_shadow") & F.col("in_tree_shadow")),
    })
    return rows.unionByName(expectations.report({
        "stop and hour are unique": expectations.unique(m, "osm_node_id", "hour"),
        "stop is an order": expectations.relationship(m, "osm_node_id", orders, "osm_node_id"),
        "three hours a stop": expectations.rows_per_key(m, ["osm_node_id"], 3, orders),
        "sheltered share": expectations.share_at_most(m, F.col("has_shelter"), 0.12),
        "seven hours": expectations.row_count(m, 7, "hour"),
        "scores agree": expectations.same(again, base, ["osm_node_id"], "v", 1e-6),
    }))


# -- a day's service, exposure from end to end


DAY_DEPARTURES = """SELECT user_id AS stop_id, event_type AS route_id, (hour(ts) + 24 * (event_id % 2)) % 24 AS h,
       (hour(ts) + 24 * (event_id % 2)) * 3600 + minute(ts) * 60 + second(ts) AS s FROM events WHERE event_id % 3 IN (0, 1)"""


def day_departures(spark: SparkSession, d: str) -> DataFrame:
    """Departures of the services that run on one date: two of each route's three."""
    e = table(spark, d, "events")
    clock = F.concat(F.lpad((F.hour("ts") + 24 * (F.col("event_id") % 2)).cast("string"), 2, "0"), F.date_format("ts", ":mm:ss"))
    service = F.concat_ws("-", "event_type", (F.col("event_id") % 3).cast("string"))
    stop_times = e.select(F.col("event_id").alias("trip_id"), F.col("user_id").alias("stop_id"), clock.alias("departure_time"))
    trips = e.select(F.col("event_id").alias("trip_id"), F.col("event_type").alias("route_id"), service.alias("service_id"))
    part = F.explode(F.array(*map(F.lit, range(3)))).alias("part")
    routes = e.select("event_type").distinct().select("event_type", part)
    compact = F.when(F.col("part") == 1, "20260628").otherwise(F.when(F.col("part") == 0, "20260628").otherwise("20260627"))
    exceptions = routes.select(F.concat_ws("-", "event_type", "part").alias("service_id"), S.compact_date(compact).alias("date"), F.lit(1).alias("exception_type"))
    return schedule.active_departures(stop_times, trips, exceptions, F.lit("2026-06-28").cast("date"))


@query(f"""
WITH {waits_sql(DAY_DEPARTURES)},
place AS (SELECT c_custkey AS stop_id, c_name AS stop_name, {round_sql(lat_sql('c_custkey'), 6)} AS lat, {round_sql(lon_sql('c_custkey'), 6)} AS lon FROM customer WHERE c_custkey % 10 <> 0)
SELECT waits.*, stop_name, lat, lon FROM waits JOIN place USING (stop_id)
""")
def day_waits(spark: SparkSession, d: str) -> DataFrame:
    """Waits of one date's services by stop and hour, with places; stops that can't be placed drop out."""
    k = F.col("c_custkey")
    stops = table(spark, d, "customer").filter(k % 10 != 0).select(k.alias("stop_id"), F.col("c_name").alias("stop_name"), lat_of(k).alias("stop_lat"), lon_of(k).alias("stop_lon"))
    return schedule.placed_waits(schedule.waits(day_departures(spark, d)), stops)


@query(f"""
WITH {SUN_SQL}, {SPOTS},
cells AS (SELECT p_partkey % 100 AS r, (p_partkey // 100 * 7) % 100 AS c, p_size AS height FROM part),
rad AS (SELECT sun.*, ceil(CAST(mx AS DOUBLE) / tan(radians(elevation)) / 10.0) * 10.0 AS radius FROM sun, (SELECT max(height) AS mx FROM cells)),
ray AS (SELECT id, x, y, hour, azimuth, elevation, CAST(unnest(generate_series(1, CAST(radius / 10 AS INTEGER))) AS DOUBLE) * 10.0 AS d FROM pts, rad),
bs AS (
  SELECT DISTINCT id, hour FROM ray JOIN cells
    ON r = CAST(floor((1000.0 - (y + d * cos(radians(azimuth)))) / 10.0) AS BIGINT) AND c = CAST(floor((x + d * sin(radians(azimuth))) / 10.0) AS BIGINT)
  WHERE height >= d * tan(radians(elevation))
),
tr AS (SELECT CAST((p_partkey * 31) % 997 AS DOUBLE) AS tx, CAST((p_partkey * 17) % 991 AS DOUBLE) AS ty, (CAST(p_partkey % 10 AS DOUBLE) + 1) / 2 AS r,
              CAST(p_size % 20 + 2 AS DOUBLE) * (1.0::DOUBLE / 3) AS base, CAST(p_size % 20 + 2 AS DOUBLE) AS top FROM part),
g AS (
  SELECT id, hour, r, base, top, tan(radians(elevation)) AS slope, (SELECT max(top) FROM tr) / tan(radians(elevation)) AS reach, pow(tx - x, 2) + pow(ty - y, 2) AS far_,
         (tx - x) * sin(radians(azimuth)) + (ty - y) * cos(radians(azimuth)) AS along, x, y, tx, ty FROM pts, sun, tr
),
c AS (SELECT *, sqrt(greatest(r * r - greatest(far_ - pow(along, 2), 0.0), 0.0)) AS half FROM g WHERE far_ - pow(along, 2) <= r * r),
ts AS (SELECT DISTINCT id, hour FROM c WHERE along + half > 0 AND greatest(along - half, 0.0) <= reach AND greatest(along - half, 0.0) * slope <= top AND (along + half) * slope >= base
       AND abs(floor(tx / reach) - floor(x / reach)) <= 1 AND abs(floor(ty / reach) - floor(y / reach)) <= 1)
SELECT pts.id AS stop_id, CAST(sun.hour AS INTEGER) AS hour, azimuth AS solar_azimuth, elevation AS solar_elevation, bs.id IS NOT NULL AS in_building_shadow,
       bs.id IS NULL AND ts.id IS NOT NULL AS in_tree_shadow, pts.id % 4 = 0 AS has_shelter, bs.id IS NULL AND ts.id IS NULL AND pts.id % 4 <> 0 AS exposed
FROM pts CROSS JOIN sun LEFT JOIN bs ON bs.id = pts.id AND bs.hour = sun.hour LEFT JOIN ts ON ts.id = pts.id AND ts.hour = sun.hour
""")
def hourly_exposure(spark: SparkSession, d: str) -> DataFrame:
    """Each point and hour with its shadows: trees are looked at where no building hides the sun."""
    k, high = F.col("p_partkey"), (F.col("p_size") % 20 + 2).cast("double")
    trees = table(spark, d, "part").select(k.alias("tree_id"), ((k * 31) % 997).cast("double").alias("x"), ((k * 17) % 991).cast("double").alias("y"), high.alias("height_m"), ((k % 10).cast("double") + 1).alias("crown_diameter_m"))
    buildings, points = building_shadow(spark, d), spots(spark, d)
    shaded = shadow.tree_shadow(points, sun(spark), shadow.tree_cylinders(trees), hidden=buildings)
    return shadow.hourly_exposure(points.withColumn("has_shelter", F.col("id") % 4 == 0), sun(spark), buildings, shaded)


@query("""
SELECT event_id, CAST(hour(ts) + 24 * (event_id % 2) AS INTEGER) * 3600 + minute(ts) * 60 + second(ts) AS seconds, CAST(ts AS DATE) AS date, ts + INTERVAL 1 HOUR AS summer FROM events
""")
def clock_times(spark: SparkSession, d: str) -> DataFrame:
    """Times of day past 24 hours, compact dates and summer time."""
    clock = F.concat(F.lpad((F.hour("ts") + 24 * (F.col("event_id") % 2)).cast("string"), 2, "0"), F.date_format("ts", ":mm:ss"))
    return table(spark, d, "events").select("event_id", S.clock_seconds(clock).cast("long").alias("seconds"), S.compact_date(F.date_format("ts", "yyyyMMdd")).alias("date"), S.solar_to_summer("ts").alias("summer"))


@query("""
WITH o AS (
  SELECT o_orderkey, nullif(o_orderstatus, 'P') AS a, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'F' ELSE nullif(o_orderstatus, 'P') END AS b,
         nullif(o_totalprice, (SELECT max(o_totalprice) FROM orders)) AS price FROM orders
)
SELECT 'flags differ' AS expectation, count(*) AS violations FROM o WHERE a IS DISTINCT FROM b
UNION ALL SELECT 'price is in range', count(*) FROM o WHERE price IS NULL OR price NOT BETWEEN 1000 AND 200000
UNION ALL SELECT 'price is in range or missing', count(*) FROM o WHERE price NOT BETWEEN 1000 AND 200000
UNION ALL SELECT 'flags agree by key', count(*) FROM o WHERE a IS DISTINCT FROM b
UNION ALL SELECT 'pairs are 9', CASE WHEN (SELECT count(DISTINCT (coalesce(a, ''), coalesce(b, ''))) FROM o) = 9 THEN 0 ELSE 1 END
""")
def null_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules about nulls: a null equals a null and nothing else, and is in no range."""
    orders = table(spark, d, "orders")
    a, k = F.nullif("o_orderstatus", F.lit("P")), F.col("o_orderkey")
    price = F.nullif("o_totalprice", F.col("most"))
    o = orders.crossJoin(F.broadcast(orders.agg(F.max("o_totalprice").alias("most"))))  # one row
    o = o.select("o_orderkey", a.alias("a"), F.when(k % 5 == 0, None).when(k % 7 == 0, "F").otherwise(a).alias("b"), price.alias("price"))
    return expectations.report({
        "flags differ": expectations.distinct_from(o, "a", "b"),
        "price is in range": expectations.between(o, "price", 1000, 200000),
        "price is in range or missing": expectations.between(o, "price", 1000, 200000, nulls=True),
        "flags agree by key": expectations.same(o.select("o_orderkey", "a"), o.select("o_orderkey", F.col("b").alias("a")), ["o_orderkey"], "a"),
        "pairs are 9": expectations.row_count(o.select(F.coalesce("a", F.lit("")).alias("a"), F.coalesce("b", F.lit("")).alias("b")), 9, "a", "b"),
    })


# -- files written and read again


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared.folder(spark)}/round-trip/{spark.sparkContext.applicationId}-{name}"


@query("""
SELECT lpad(CAST(event_id AS VARCHAR), 9, '0') AS trip_id, lpad(CAST(user_id AS VARCHAR), 6, '0') AS stop_id, CAST(event_id % 50 AS INTEGER) AS stop_sequence,
       lpad(CAST(hour(ts) + 24 * (event_id % 2) AS VARCHAR), 2, '0') || strftime(ts, ':%M:%S') AS arrival_time, NULL AS departure_time FROM events
""")
def feed_files(spark: SparkSession, d: str) -> DataFrame:
    """A schedule feed's visits as CSV and back: leading zeros and hours past 23 survive, a column that the file lacks is null."""
    e = table(spark, d, "events")
    clock = F.concat(F.lpad((F.hour("ts") + 24 * (F.col("event_id") % 2)).cast("string"), 2, "0"), F.date_format("ts", ":mm:ss"))
    rows = e.select((F.col("event_id") % 50).alias("stop_sequence"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("trip_id"), clock.alias("arrival_time"), F.lpad(F.col("user_id").cast("string"), 6, "0").alias("stop_id"))
    at = scratch(spark, "feed")
    writers.csv(rows, f"{at}/stop_times.txt")
    return readers.feed_table(spark, at, "stop_times")


@query(f"WITH {MIXED} SELECT CAST(stop_id AS VARCHAR) AS stop_id, 'stop ' || stop_id AS stop_name, {round_sql(lat_sql('stop_id') + ' + 2e-7', 5)} AS lat, {round_sql(lon_sql('stop_id') + ' + 2e-7', 5)} AS lon, "
       "hour, median_wait_minutes, n_lines, median_headway_minutes, wait_any_line_minutes, wait_least_frequent_minutes FROM mixed")  # fmt: skip
def wait_seed(spark: SparkSession, d: str) -> DataFrame:
    """Waits as an ordered, gzipped CSV, read back with its types."""
    w = stop_waits(spark, d)
    rows = w.select(F.col("gtfs_stop_id").alias("stop_id"), "stop_name", S.rounded("lat", 5).alias("lat"), S.rounded("lon", 5).alias("lon"), "hour", "median_wait_minutes", "n_lines", "median_headway_minutes", "wait_any_line_minutes", "wait_least_frequent_minutes")
    at = scratch(spark, "waits.csv.gz")
    writers.csv(rows, at, compressed=True, order=("stop_id", "hour"))
    return readers.seed(spark, at, "stop_wait_time")


@query(f"""
WITH {TREES.replace('FROM part WHERE', 'FROM part WHERE p_partkey % 11 <> 0 AND')}
SELECT CAST(tree_id AS VARCHAR) AS tree_id, genus, species, height_m, crown_diameter_m, round(lon, 6) AS lon, round(lat, 6) AS lat, TRUE AS is_valid FROM tm
""")
def census_file(spark: SparkSession, d: str) -> DataFrame:
    """The census with semicolons, decimal commas and numbers that don't parse; usable trees only."""
    k = F.col("p_partkey")
    comma = lambda c: F.replace(c.cast("string"), F.lit("."), F.lit(","))
    raw = table(spark, d, "part").select(
        k.cast("string").alias("obj_id"), F.concat(F.lit(" "), "p_brand").alias("genere"), F.concat("p_type", F.lit(" ")).alias("specie"),
        F.when(k % 11 == 0, "n.d.").otherwise(comma(F.col("p_size").cast("double"))).alias("h_m"), comma((k % 70).cast("double") / 2).alias("diam_chiom"),
        comma(lon_of(k)).alias("LONG_X_4326"), comma(lat_of(k)).alias("LAT_Y_4326"),
    )
    at = scratch(spark, "census.csv")
    raw.write.mode("overwrite").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(at, header=True, sep=";")
    return readers.with_validity(readers.tree_census(spark, at)).filter("is_valid")


@query(f"""
SELECT 'node/' || s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS name, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS VARCHAR) END AS ref,
       {lon_sql('s_suppkey')} AS lon, {lat_sql('s_suppkey')} AS lat, s_suppkey % 5 = 0 AS has_shelter FROM supplier
""")
def shelter_features(spark: SparkSession, d: str) -> DataFrame:
    """Stops as one collection of map features, read back with their shelter flag."""
    k = F.col("s_suppkey")
    name = F.when(k % 3 != 0, F.col("s_name"))
    shelter = F.when(k % 5 == 0, "yes").when(k % 5 == 1, "no")
    properties = F.struct(F.concat(F.lit("node/"), k).alias("@id"), F.when(k % 2 == 0, k.cast("string")).alias("ref"), name.alias("name"), shelter.alias("shelter"))
    feature = F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(lon_of(k), lat_of(k)).alias("coordinates")).alias("geometry"))
    at = scratch(spark, "stops.geojson")
    one = table(spark, d, "supplier").agg(F.collect_list(feature).alias("features"))  # the format is one document
    one.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).write.mode("overwrite").text(at)
    return readers.shelter_stops(readers.features(spark, at))


@query("SELECT CAST(p_partkey % 100 AS INTEGER) AS row, CAST((p_partkey // 100 * 7) % 100 AS INTEGER) AS col, CAST(p_size AS INTEGER) AS height FROM part WHERE p_size <> 7")
def raster_file(spark: SparkSession, d: str) -> DataFrame:
    """Raster cells without those that have no data."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("int")
    at = scratch(spark, "raster")
    writers.table(table(spark, d, "part").select((k % 100).cast("int").alias("row"), ((F.floor(k / 100) * 7) % 100).cast("int").alias("col"), F.when(size != 7, size).otherwise(65535).alias("height")), at)
    return readers.raster_cells(spark, at)


@query(f"WITH {GRID} SELECT cols.i, k.x, k.y, cols.h, cols.c, genus, species, cols.shades_stop FROM cols JOIN k ON k.i = cols.i")
def tree_document(spark: SparkSession, d: str) -> DataFrame:
    """The trees' one JSON document, decoded by its own dictionaries."""
    trees = map_trees(spark, d)
    corner = trees.agg(F.min("lon").alias("lon0"), F.min("lat").alias("lat0")).first()
    at = scratch(spark, "trees.json")
    writers.document(spark, writers.tree_file(payload.tree_rows(trees), corner.lon0 or 0.0, corner.lat0 or 0.0, payload.SCALE), at)
    schema = "x array<long>, y array<long>, h array<long>, c array<long>, sp array<int>, species array<array<string>>, genera array<string>, s array<long>"
    one = spark.read.schema(schema).json(at)
    rows = one.select("species", "genera", "s", F.posexplode(F.arrays_zip("x", "y", "h", "c", "sp")).alias("i", "t"))
    kind = F.get("species", F.col("t.sp"))
    rows = rows.select(
        F.col("i").cast("long").alias("i"), F.col("t.x").alias("dx"), F.col("t.y").alias("dy"), "t.h", "t.c", F.get("genera", F.get(kind, F.lit(0)).cast("int")).alias("genus"),
        F.get(kind, F.lit(1)).alias("species"), F.array_contains("s", F.col("i").cast("long")).alias("shades_stop"),
    )
    return payload.undelta(rows).join(rows.drop("dx", "dy"), "i")


@query(f"""
WITH {COMBINED}, {TREES},
b AS (SELECT min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM hw)
SELECT round_even(w, 5) AS west, round_even(s, 5) AS south, round_even(e, 5) AS east, round_even(n, 5) AS north, (SELECT count(DISTINCT osm_node_id) FROM hw) AS stops,
       (SELECT min(osm_node_id) FROM hw) AS first_stop, (SELECT count(*) FROM tm) AS trees, (SELECT count(*) FILTER (WHERE shades_stop) FROM tm) AS shading,
       CAST(0.5 AS DOUBLE) AS sync_share_max, CAST(2 AS DOUBLE) AS sync_wait_minutes, 5 AS sync_headway_from, 11 AS sync_headway_full, CAST(0.03 AS DOUBLE) AS tree_transmissivity,
       CAST(0.5 AS DOUBLE) AS shelter_exposure_factor, CAST(0 AS DOUBLE) AS shelter_factor_min, CAST(1.2 AS DOUBLE) AS shelter_factor_max FROM b
""")
def main_document(spark: SparkSession, d: str) -> DataFrame:
    """The map's one JSON document: stops in order, bounds, parameters, number of trees."""
    hourly = combined(spark, d)[0]
    at = scratch(spark, "main.json")
    writers.main_document(payload.main_payload(hourly), payload.bounds(hourly), map_trees(spark, d), at)
    params = ", ".join(f"{k}: {'int' if isinstance(v, int) else 'double'}" for k, v in P.quoted().items())
    one = readers.main_document(spark, at, f"bounds array<double>, params struct<{params}>, trees struct<n: long, shading: long>")
    corners = [F.get("bounds", F.lit(i)).alias(c) for i, c in enumerate(("west", "south", "east", "north"))]
    return one.select(*corners, "stops", "first_stop", F.col("trees.n").alias("trees"), F.col("trees.shading").alias("shading"), "params.*")

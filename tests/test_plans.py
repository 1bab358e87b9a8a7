import gzip
import json
import struct

import pytest
from pyspark.sql import functions as F

from meridia.config import Params
from meridia.operators import expectations as E
from meridia.operators import payload
from meridia.plans import assertions
from meridia.plans.models import REGISTRY
from meridia.plans.registry import Build, Registry
from meridia.sources import geotiff, readers, writers

CITY = {
    "agency": "agency_id,agency_name,agency_url,agency_timezone\n01,City,http://c,Europe/Rome\n",
    "routes": "route_type,route_id,agency_id,route_short_name,route_long_name\n3,R1,01,1,One\n3,R2,,2,Two\n",
    "trips": "trip_id,route_id,service_id,trip_headsign,shape_id\nT1,R1,W,North,s\nT2,R2,W,South,s\nT3,R9,X,,\n",
    "stops": "stop_id,stop_name,stop_lat,stop_lon,location_type,wheelchair_boarding\n007,First,45.46,9.19,0,1\n008,Second,45.47,9.20,0,\n009,Unserved,45.48,9.21,,\n",
    "stop_times": "trip_id,stop_id,stop_sequence,arrival_time,departure_time\nT1,007,1,09:00:00,09:00:00\nT1,008,2,25:30:00,25:30:00\nT2,007,1,10:00:00,10:00:00\nT3,007,1,broken,broken\n",
    "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nW,1,1,1,1,1,0,0,20260622,20260628\n",
    "calendar_dates": "service_id,date,exception_type\nW,20260624,2\nW,20260628,1\nW,20260625,1\nW,20260625,2\n",
}
REGION = {
    "agency": CITY["agency"].replace("City", "Region"),
    "routes": "route_id,agency_id,route_short_name,route_long_name,route_type\nR1,01,100,Far,3\n",
    "trips": "trip_id,route_id,service_id\nT1,R1,W\n",
    "stops": "stop_id,stop_name,stop_lat,stop_lon\n007,Village,45.5,9.3\n",
    "stop_times": "trip_id,stop_id,stop_sequence,arrival_time,departure_time\nT1,007,1,47:10:00,47:10:00\n",
    "calendar_dates": "service_id,date,exception_type\nW,20260627,1\nW,20260628,2\n",
}


@pytest.fixture(scope="module")
def transit(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("feeds")
    build = Build(spark, REGISTRY, {}, folder=str(folder / "out"))
    for code, feed in (("C", CITY), ("R", REGION)):
        (folder / code).mkdir()
        for name, text in feed.items():
            (folder / code / f"{name}.txt").write_text(text)
        build.feed(code, str(folder / code))
    return build


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_feeds_are_conformed(transit):
    assert rows(transit("dim_stop").select("stop_id", "agency_code", "location_type")) == [("C-007", "C", 0), ("C-008", "C", 0), ("C-009", "C", None), ("R-007", "R", None)]
    assert rows(transit("int_trips_enriched").select("trip_id", "route_short_name", "agency_name")) == [("C-T1", "1", "City"), ("C-T2", "2", None), ("C-T3", None, None), ("R-T1", "100", "Region")]


def test_service_dates_of_both_kinds_of_feed(transit):
    got = [(a, d.day) for a, _, d in rows(transit("int_service_dates"))]
    assert got == [("C", 22), ("C", 23), ("C", 25), ("C", 26), ("C", 28), ("R", 27)]
    assert transit("dim_date").count() == 7
    assert transit("fct_trips").groupBy("trip_id").count().orderBy("trip_id").collect()[0]["count"] == 5


def test_marts(transit):
    visits = {(r.trip_id, r.stop_sequence): r.arrival_hour for r in transit("fct_stop_times").collect()}
    assert visits == {("C-T1", 1): 9, ("C-T1", 2): 1, ("C-T2", 1): 10, ("C-T3", 1): None, ("R-T1", 1): 23}
    assert ("R", "R-007", "Saturday", 23, 1) in rows(transit("mart_service_frequency"))
    assert transit("mart_service_frequency").filter("stop_id = 'C-007' AND day_type = 'Monday'").count() == 2
    cover = {r.stop_id: (r.route_count, r.first_scheduled_arrival) for r in transit("mart_stop_coverage").collect()}
    assert cover["C-007"] == (3, "09:00:00") and cover["C-009"] == (0, None)
    assert rows(E.unique(transit("fct_trips"), "agency_code", "trip_id", "service_date")) == []
    assert transit.counts["fct_stop_times"] == 5
    assert "int_service_days" in transit.edges["mart_service_frequency"]


def test_missing_file_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.feed_table(spark, str(tmp_path), "stops")


def test_cycles_and_doubles_are_errors(spark):
    registry = Registry()

    @registry.model()
    def a(b):
        return b("a")

    with pytest.raises(ValueError, match="a -> a"):
        Build(spark, registry, {})("a")
    with pytest.raises(ValueError, match="two models"):
        registry.model()(a)


def test_heat_models(spark, tmp_path):
    exposure = "stop_id,hour,solar_azimuth,solar_elevation,in_building_shadow,in_tree_shadow,has_shelter,exposed\n"
    for stop, shelter in (("node/1", "true"), ("node/2", "false")):
        for hour in range(13, 20):
            exposure += f"{stop},{hour},180.0,45.0,false,{str(hour == 17 and stop == 'node/1').lower()},{shelter},{str(shelter == 'false').lower()}\n"
    (tmp_path / "exposure.csv").write_text(exposure)
    (tmp_path / "shade.csv").write_text("stop_id,hour,tree_id\nnode/1,17,T1\n")
    (tmp_path / "waits.csv").write_text(
        "stop_id,stop_name,lat,lon,hour,median_wait_minutes,n_lines,median_headway_minutes,wait_any_line_minutes,wait_least_frequent_minutes\n"
        "S1,One,45.46,9.19,13,6.3,2,12.5,5.0,7.5\nS1,One,45.46,9.19,14,4.0,1,8.0,,4.0\n"
    )
    with gzip.open(tmp_path / "trees.csv.gz", "wt") as f:
        f.write("tree_id,genus,species,height_m,crown_diameter_m,lon,lat\nT1,Acer,campestre,10,5,9.19,45.4601\nT2,Acer,,60,5,9.19,45.46\n")
    feature = lambda i, ref, lon, **p: {"type": "Feature", "id": i, "properties": {"@id": i, "ref": ref, **p}, "geometry": {"type": "Point", "coordinates": [lon, 45.46]}}
    (tmp_path / "stops.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature("node/1", "S1", 9.19, name="One", shelter="yes"), feature("node/2", None, 9.3)]}))
    found = readers.features(spark, str(tmp_path / "stops.geojson"))
    assert rows(readers.shelter_stops(found)) == [("node/1", "One", "S1", 9.19, 45.46, True), ("node/2", "", None, 9.3, 45.46, False)]
    sources = {
        "stop_solar_exposure": readers.seed(spark, str(tmp_path / "exposure.csv"), "stop_solar_exposure"), "stop_tree_shade": readers.seed(spark, str(tmp_path / "shade.csv"), "stop_tree_shade"),
        "stop_wait_time": readers.seed(spark, str(tmp_path / "waits.csv"), "stop_wait_time"), "trees": readers.seed(spark, str(tmp_path / "trees.csv.gz"), "trees"), "osm_shelter_stops": found,
    }
    build = Build(spark, REGISTRY, sources, Params())
    hourly = build("mart_stop_heat_wait_hourly")
    assert hourly.count() == 14
    first = hourly.filter("osm_node_id = 'node/1' AND hour = 13").first()
    assert (first.wait_minutes, first.wait_minutes_low, first.exposed_wait_minutes, first.n_trees_20m) == (4.125, 4.125, 2.0625, 1)
    one, two = sorted(build("mart_stop_heat_wait").collect(), key=lambda r: r.osm_node_id)
    assert (one.exposure_score_hours, one.match_method, one.median_wait_13_19) == (3.03, "ref", 5.15)
    assert (two.match_method, two.avg_exposed_wait_minutes, two.risk_level) == ("unmatched", None, "high")
    assert build("mart_heat_wait_sensitivity").count() == 4
    assert rows(build("mart_trees_map").select("tree_id", "shades_stop")) == [("T1", True)]
    main = payload.main_payload(hourly).filter("id = '1'").first()
    assert main.w[:3] == [4.1, 3.5, None] and main.s[4] == 0.03 and main.ts == 1
    waits = payload.wait_payload(build("int_stop_wait_time")).first()
    assert waits.wl[:2] == [4.1, None] and waits.nl == [2, 1, 0, 0, 0, 0, 0]
    writers.json_lines(payload.main_payload(hourly), str(tmp_path / "main"))
    assert spark.read.json(str(tmp_path / "main")).count() == 2
    trees = payload.tree_rows(build("mart_trees_map"))
    text = json.loads(writers.tree_file(trees, 9.19, 45.4601, 1e-5))
    assert (text["s"], text["species"], text["genera"]) == ([0], [[0, "campestre"]], ["Acer"]) and "partial" not in text
    text = json.loads(writers.tree_file(trees, 9.19, 45.4601, 1e-5, most_bytes=10))
    assert text["partial"] and text["total"] == 1
    text = json.loads(writers.main_file(payload.main_payload(hourly), payload.bounds(hourly), build("mart_trees_map")))
    assert [s["id"] for s in text["stops"]] == ["1", "2"] and text["bounds"] == [9.19, 45.46, 9.3, 45.46] and text["trees"] == {"n": 1, "shading": 1}
    for some in (hourly, hourly.filter("osm_node_id = 'node/2'"), hourly.filter("false")):
        parts = payload.main_payload(some), payload.bounds(some), build("mart_trees_map")
        writers.main_document(*parts, str(tmp_path / "main.json"))
        text = json.loads((tmp_path / "main.json").read_text())
        assert text == json.loads(writers.main_file(*parts))
        frame = readers.main_document(spark, str(tmp_path / "main.json"), "bounds array<double>, trees struct<n: long, shading: long>").first()
        assert (frame.bounds, frame.stops, frame.first_stop, frame.trees.n) == (text["bounds"], len(text["stops"]), text["stops"][0]["id"] if text["stops"] else None, 1)
    writers.csv(payload.main_payload(hourly).select("id"), str(tmp_path / "ordered"), order=("id",))
    assert [r.id for r in spark.read.csv(str(tmp_path / "ordered"), header=True).collect()] == ["1", "2"]
    for sink, path in ((writers.csv, "csv"), (writers.table, "table")):
        sink(build("mart_trees_map"), str(tmp_path / path))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 1


def test_census(spark, tmp_path):
    (tmp_path / "census.csv").write_text("﻿obj_id;genere;specie;h_m;diam_chiom;LONG_X_4326;LAT_Y_4326\n 12 ;Acer;campestre ;7,5;3;9,1234567;45,7654321\nx;;;bad;;;\n", encoding="utf-8")
    got = rows(readers.tree_census(spark, str(tmp_path / "census.csv")))
    assert got == [("12", "Acer", "campestre", 7.5, 3.0, 9.123457, 45.765432), ("x", None, None, None, None, None, None)]
    trees = readers.with_validity(readers.tree_census(spark, str(tmp_path / "census.csv")))
    assert trees.filter(F.col("is_valid")).count() == 1


def test_transit_assertions(transit):
    """One trip of the feed has no route that is known; all else holds."""
    assert {r.expectation: r.violations for r in assertions.report(transit).collect() if r.violations} == {"trips_have_a_route": 1}


def heat_build(spark, broken=()):
    """Twelve stops over seven hours, in order unless something of it is broken."""
    hours = [(f"node/{i}", h, 180.0, 45.0, i % 5 == h % 5, i % 5 != h % 5 and (i + h) % 4 == 0, i < 5) for i in range(12) for h in range(13, 20)]
    rows = [(*r, not (r[4] or r[5] or r[6])) for r in hours]
    if "shadows" in broken:
        rows[0] = (*rows[0][:4], True, True, *rows[0][6:])
    if "hours" in broken:
        rows[1] = rows[0]
    waits = [(f"S{i}", f"stop {i}", 45.4 + i / 100, 9.1, h, 5.0, 2, 10.0, 4.0 if "order" not in broken else 9.9, 5.0 if "order" not in broken else 1.0) for i in range(12) for h in range(13, 20)]
    stops = [(f"node/{i}", f"S{i}" if "unmatched" not in broken or i else None, f"stop {i}", None, 9.1 if "unmatched" not in broken or i > 2 else 9.5, 45.4 + i / 100) for i in range(12)]
    sources = {
        "stop_solar_exposure": spark.createDataFrame(rows, readers.SEEDS["stop_solar_exposure"]), "stop_tree_shade": spark.createDataFrame([("node/1", 13, "T1")], readers.SEEDS["stop_tree_shade"]),
        "stop_wait_time": spark.createDataFrame(waits, readers.SEEDS["stop_wait_time"]), "trees": spark.createDataFrame([("T1", "Acer", "campestre", 9.0, 4.0, 9.1, 45.4)], readers.SEEDS["trees"]),
        "osm_shelter_stops": spark.createDataFrame(stops, "osm_node_id string, ref string, name string, shelter string, lon double, lat double"),
    }
    return Build(spark, REGISTRY, sources, Params())


@pytest.mark.parametrize(("broken", "found"), [
    ((), set()), (("shadows",), {"never_both_shadows"}), (("order",), {"wait_bounds_are_in_order"}), (("unmatched",), {"few_stops_are_unmatched"}),
    (("hours",), {"exposure_has_one_row_a_stop_and_hour", "hourly_has_one_row_a_stop_and_hour"}),
])
def test_heat_assertions(spark, broken, found):
    got = {r.expectation: r.violations for r in assertions.report(heat_build(spark, broken)).collect()}
    assert len(got) == len(assertions.HEAT) and found <= {k for k, n in got.items() if n}
    loose = {"every_share_and_level_once"}  # twelve stops don't have every level
    assert broken or {k for k, n in got.items() if n} <= loose


def tiff(values, order="<", deflated=False, predictor=1, rows_per_strip=2, tile=None, nodata="-1"):
    """A GeoTIFF of 16-bit numbers, by hand."""
    import zlib

    import numpy as np

    height, width = values.shape
    if tile:
        across, down = tile
        blocks = [np.pad(b := values[r : r + down, c : c + across], ((0, down - b.shape[0]), (0, across - b.shape[1]))) for r in range(0, height, down) for c in range(0, width, across)]
    else:
        blocks = [values[r : r + rows_per_strip] for r in range(0, height, rows_per_strip)]
    if predictor == 2:
        blocks = [np.diff(b, axis=1, prepend=0) for b in blocks]
    raw = [b.astype(f"{order}i2").tobytes() for b in blocks]
    raw = [zlib.compress(r) for r in raw] if deflated else raw
    body, at = b"", []
    for r in raw:
        at.append(8 + len(body))
        body += r
    own = {256: ("H", [width]), 257: ("H", [height]), 258: ("H", [16]), 259: ("H", [8 if deflated else 1]), 277: ("H", [1]), 317: ("H", [predictor]), 339: ("H", [2]), 33550: ("d", [10.0, 20.0, 0.0]), 33922: ("d", [0.0, 0.0, 0.0, 500.0, 900.0, 0.0])}
    own |= {322: ("H", [tile[0]]), 323: ("H", [tile[1]]), 324: ("I", at), 325: ("I", [len(r) for r in raw])} if tile else {273: ("I", at), 278: ("H", [rows_per_strip]), 279: ("I", [len(r) for r in raw])}
    own[42113] = ("s", nodata.encode() + b"\0")
    entries = b""
    for tag, (code, v) in sorted(own.items()):
        data = v if code == "s" else struct.pack(f"{order}{len(v)}{code}", *v)
        kind, n = {"H": 3, "I": 4, "d": 12, "s": 2}[code], len(v)
        if len(data) > 4:
            field = struct.pack(f"{order}I", 8 + len(body))
            body += data
        else:
            field = data.ljust(4, b"\0")
        entries += struct.pack(f"{order}HHI", tag, kind, n) + field
    head = {"<": b"II", ">": b"MM"}[order] + struct.pack(f"{order}HI", 42, 8 + len(body))
    return head + body + struct.pack(f"{order}H", len(own)) + entries + b"\0" * 4


@pytest.mark.parametrize("how", [{}, {"order": ">"}, {"deflated": True, "predictor": 2}, {"tile": (4, 3), "deflated": True}, {"rows_per_strip": 5}])
def test_geotiff(spark, tmp_path, how):
    import numpy as np

    values = np.random.default_rng(4).integers(-1, 60, (5, 7))
    (tmp_path / "heights.tif").write_bytes(tiff(values, **how))
    found = {(r.row, r.col): r.height for r in geotiff.cells(spark, str(tmp_path)).collect()}
    assert found == {(i, j): float(v) for (i, j), v in np.ndenumerate(values) if v != -1}
    at = geotiff.places(spark, str(tmp_path))
    assert tuple(at.first())[1:] == (500.0, 900.0, 10.0, 20.0)
    row, col = geotiff.cell_of(F.lit(525.0), F.lit(835.0), *map(F.col, ("x0", "y0", "dx", "dy")))
    assert tuple(at.select(row, col).first()) == (3, 2)


def test_what_is_no_geotiff(spark, tmp_path):
    for name, data, said in (("a", b"GIF89a..", "not a TIFF"), ("b", tiff(__import__("numpy").ones((1, 1), int)).replace(b"\x03\x01\x03\x00\x01\x00\x00\x00\x01", b"\x03\x01\x03\x00\x01\x00\x00\x00\x05"), "compression 5")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match=said):
            geotiff.cells(spark, str(tmp_path / name)).collect()


def test_raw_schemas(spark):
    for name in ("raw_b", "raw_a", "other"):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")
    try:
        assert [r.schema_name for r in readers.schemas_like(spark, "raw_%").collect()] == ["raw_a", "raw_b"]
        assert readers.schemas_like(spark, "none_%").count() == 0
    finally:
        for name in ("raw_b", "raw_a", "other"):
            spark.sql(f"DROP DATABASE {name}")

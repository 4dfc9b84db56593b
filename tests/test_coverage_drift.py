import json

from pyspark.sql import functions as F

from recordlens.functions import grid
from recordlens.operators import coverage as cov
from recordlens.operators import drift as dr
from recordlens.sources import catalogue
from tests.helpers import as_list

SQUARE = [[12.0, 55.0], [13.0, 55.0], [13.0, 56.0], [12.0, 56.0], [12.0, 55.0]]
NORTH = [[21.0, 63.0], [22.0, 63.0], [22.0, 63.5], [21.0, 63.5], [21.0, 63.0]]


def product(name, pid, start, end, ring, sums, **more):
    return {"Name": name, "Id": pid, "ContentDate": {"Start": start, "End": end}, "Checksum": sums,
            "GeoFootprint": {"type": "Polygon", "coordinates": [ring]}, **more}


PAGE = json.dumps({"value": [
    product("S1C_GRDH_SAFE", "aaa", "T05:30", "T05:31", SQUARE, [{"Algorithm": "MD5", "Value": "m1"}, {"Algorithm": "BLAKE3", "Value": "b1"}], Online=True),
    product("S1C_GRDH_COG", "bbb", "T05:30", "T05:31", SQUARE, [{"Algorithm": "BLAKE3", "Value": "b2"}, {"Algorithm": "X", "Value": ""}]),
    product("S1D_GRDH", "ccc", "T18:02", "T18:03", NORTH, None),
    product("S1C_SLC", "ddd", "T05:30", "", SQUARE, None),
]})
POINTS = json.dumps({"features": [
    {"geometry": {"coordinates": [12.3, 55.3]}, "properties": {"mmsi": 1}}, {"geometry": {"coordinates": [12.4, 55.4]}},
    {"geometry": {"coordinates": [21.9, 64.1]}}, {"geometry": {"coordinates": [2.5, 48.0]}}, {"geometry": {"coordinates": [2.5]}},
]})


def bodies(spark, body):
    return spark.createDataFrame([("n1", body)], "run_date string, body string")


def test_cells_of_points_and_footprints(spark):
    sc = catalogue.scenes(bodies(spark, PAGE))
    got = {r["id"]: r for r in cov.footprint_cells(sc).collect()}
    assert sorted(got) == ["aaa", "bbb", "ccc"]
    assert got["aaa"]["cells"] == ["E12.0_N55.0", "E12.5_N55.0", "E12.0_N55.5", "E12.5_N55.5"]
    assert got["aaa"]["checksums"] == {"md5": "m1", "blake3": "b1"} and got["bbb"]["checksums"] == {"blake3": "b2"}
    pts = spark.createDataFrame([(12.3, 55.3), (8.9, 55.3), (30.0, 60.0), (9.0, 53.5)], "lon double, lat double")
    assert [r[0] for r in pts.select(grid.cell_of(F.col("lon"), F.col("lat"))).collect()] == ["E12.0_N55.0", None, None, "E9.0_N53.5"]


def test_footprint_shapes(spark):
    docs = [
        {"type": "MultiPolygon", "coordinates": [[SQUARE], [NORTH], []]}, {"type": "Polygon", "coordinates": []},
        {"type": "Point", "coordinates": [1, 2]}, None, {"type": "Polygon", "coordinates": [[[100, 10], [101, 10], [101, 11], [100, 10]]]},
    ]
    page = json.dumps({"value": [{"Name": f"GRD{n}", "GeoFootprint": d} for n, d in enumerate(docs)]})
    got = cov.footprint_cells(catalogue.scenes(bodies(spark, page)))
    assert [len(r["cells"]) for r in got.orderBy("name").collect()] == [6, 0, 0, 0, 0]


def test_coverage_figures(spark):
    sc = catalogue.scenes(bodies(spark, PAGE))
    acq = cov.footprint_cells(cov.acquisitions(sc))
    assert as_list(acq, "name") == [("S1C_GRDH_COG",), ("S1D_GRDH",)]
    pos = cov.point_cells(catalogue.positions(bodies(spark, POINTS)))
    assert as_list(cov.declared_counts(pos), "cell", "declared_sample") == [("E12.0_N55.0", 2), ("E21.5_N64.0", 1)]
    assert as_list(cov.declared_totals(pos), "in_feed", "in_region") == [(4, 3)]
    cells = cov.two_axes(cov.observed_passes(acq), cov.declared_counts(pos))
    row = cov.coverage_figures(cells, sc, acq).collect()[0]
    assert (row["catalog_products"], row["acquisitions"], row["cells_observed"], row["cells_declared"]) == (3, 2, 6, 2)
    assert (row["cells_both"], row["cells_observed_silent"], row["cells_declared_unobserved"]) == (1, 5, 1)


FIELDS = "id string, date string, pos int, online boolean, eviction_date string, modification_date string, checksums map<string,string>"


def test_drift(spark):
    seen = [
        ("a", "d1", 0, True, "e1", None, {"md5": "1", "b3": "2"}), ("a", "d2", 0, False, "e9", "m9", {}),
        ("b", "d1", 1, True, "e1", None, {}), ("c", "d1", 2, True, "e1", "m1", {"md5": "1"}), ("d", "d1", 3, True, "e1", "m1", {"md5": "1"}),
    ]
    held = dr.held_values(dr.first_seen(spark.createDataFrame(seen, FIELDS)))
    assert as_list(held, "id", "first_seen")[0] == ("a", "d1")
    base = spark.createDataFrame([("b", "modification_date", "m0", "d2"), ("b", "modification_date", "m5", "d3")], "id string, field string, value string, date string")
    held = dr.with_baselines(held, base)
    now = [
        ("a", "d3", 0, True, "e1", "m2", {"b3": "2", "md5": "1"}), ("b", "d3", 0, False, None, "m5", {"md5": "7"}),
    ]
    current = dr.held_values(spark.createDataFrame(now, FIELDS))
    asked = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("d", False)], "id string, answered boolean")
    got = as_list(dr.drift(held, current, asked).fillna(""), "id", "kind", "field", "preserved", "current")
    assert got == [
        ("a", "baseline", "modification_date", "", "m2"), ("b", "baseline", "checksums", "", "md5=7"),
        ("b", "changed", "eviction_date", "e1", ""), ("b", "changed", "modification_date", "m0", "m5"),
        ("b", "changed", "online", "true", "false"), ("c", "gone_from_catalog", "", "", ""),
    ]
    states = dr.product_states(held, dr.drift(held, current, asked))
    assert as_list(states, "id", "state") == [("a", "held"), ("b", "diverged"), ("c", "diverged"), ("d", "held")]


def test_samples_on_time_and_the_window(spark):
    times = [("n1", "2024-03-01T02:15:00Z"), ("n2", "2024-03-02T03:46:00Z"), ("n3", "2024-03-03T03:45:00+00:00"), ("n4", "2024-03-03T23:50:00Z"), ("n5", None), ("n6", "soon")]
    table = spark.createDataFrame(times, "night string, sampled_at string")
    assert [r["on_time"] for r in cov.sampled_on_time(table, "02:15").orderBy("night").collect()] == [True, False, True, False, False, False]
    near_midnight = cov.sampled_on_time(table, "00:30").orderBy("night").collect()
    assert [r["on_time"] for r in near_midnight] == [False, False, False, True, False, False]
    cells = spark.createDataFrame([("n1", "a", 1, 1), ("n1", "b", 1, 0), ("n2", "b", 1, 9)], "night string, cell string, observed_passes int, declared_sample int")
    every = cov.window_figures(cells).first()
    timely = cov.window_figures(cells, samples=cov.sampled_on_time(table, "02:15")).first()
    assert (every["nights"], timely["nights"], timely["observed_median"], timely["discrepancy_median"]) == (2, 1, 2.0, 0.0)

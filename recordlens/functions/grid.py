"""Grid cells and point-in-polygon as native array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordlens import vocab as v
from recordlens.functions.text import once

N_LON = int((v.LON_EAST - v.LON_WEST) / v.CELL_DEG)
N_LAT = int((v.LAT_NORTH - v.LAT_SOUTH) / v.CELL_DEG)


def cell_name(i: Column, j: Column) -> Column:
    """Cell id from its column and row index: the south-west corner."""
    return F.format_string(
        "E%.1f_N%.1f", v.LON_WEST + i * v.CELL_DEG, v.LAT_SOUTH + j * v.CELL_DEG
    )


def cell_of(lon: Column, lat: Column) -> Column:
    """Cell of a position, null outside the half-open box."""
    inside = (
        (lon >= v.LON_WEST) & (lon < v.LON_EAST) & (lat >= v.LAT_SOUTH) & (lat < v.LAT_NORTH)
    )
    i = F.floor((lon - v.LON_WEST) / v.CELL_DEG).cast("double")
    j = F.floor((lat - v.LAT_SOUTH) / v.CELL_DEG).cast("double")
    return F.when(inside, cell_name(i, j))


def ring_edges(ring: Column) -> Column:
    """Each vertex with its predecessor; the first one follows the last."""
    n = F.size(ring)
    return F.transform(
        ring,
        lambda p, i: F.struct(
            p["lon"].alias("x"),
            p["lat"].alias("y"),
            F.element_at(ring, F.when(i == 0, n).otherwise(i).cast("int"))["lon"].alias("px"),
            F.element_at(ring, F.when(i == 0, n).otherwise(i).cast("int"))["lat"].alias("py"),
        ),
    )


def in_ring(lon: Column, lat: Column, edges: Column) -> Column:
    """Parity of the edges crossed by the ray running east from the point."""
    crossed = F.filter(
        edges,
        lambda e: ((e["y"] > lat) != (e["py"] > lat))
        & (lon < (e["px"] - e["x"]) * (lat - e["y"]) / (e["py"] - e["y"]) + e["x"]),
    )
    return F.size(crossed) % 2 == 1


def _index_range(low: Column, high: Column, origin: float, count: int) -> Column:
    """Indexes of the cells whose centre lies between low and high."""
    first = origin + v.CELL_DEG / 2
    a = F.greatest(F.lit(0), F.ceil((low - first) / v.CELL_DEG).cast("int"))
    b = F.least(F.lit(count - 1), F.floor((high - first) / v.CELL_DEG).cast("int"))
    return F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))


def ring_cells(ring: Column) -> Column:
    """Cells whose centre lies inside one ring, in grid order (south to north, west to east).

    The bounding box picks the index range first, so only cells near the ring are tested.
    """
    edges = ring_edges(ring)
    lons = F.transform(ring, lambda p: p["lon"])
    lats = F.transform(ring, lambda p: p["lat"])
    cols = _index_range(F.array_min(lons), F.array_max(lons), v.LON_WEST, N_LON)
    rows = _index_range(F.array_min(lats), F.array_max(lats), v.LAT_SOUTH, N_LAT)
    boxed = F.flatten(
        F.transform(rows, lambda j: F.transform(cols, lambda i: F.struct(i.alias("i"), j.alias("j"))))
    )
    kept = F.filter(
        boxed,
        lambda c: in_ring(
            v.LON_WEST + v.CELL_DEG / 2 + c["i"] * v.CELL_DEG,
            v.LAT_SOUTH + v.CELL_DEG / 2 + c["j"] * v.CELL_DEG,
            edges,
        ),
    )
    return F.when(F.size(ring) > 0, kept).otherwise(F.array().cast("array<struct<i:int,j:int>>"))


def covered_cells(rings: Column) -> Column:
    """Names of all cells covered by any of the rings, each once, in grid order."""
    cells = F.array_distinct(F.flatten(F.transform(rings, ring_cells)))
    ordered = F.array_sort(F.transform(cells, lambda c: F.struct(c["j"].alias("j"), c["i"].alias("i"))))
    return F.transform(ordered, lambda c: cell_name(c["i"].cast("double"), c["j"].cast("double")))


# --- the same cells by scan lines -------------------------------------------------------


def ring_spans(ring: Column) -> Column:
    """array<struct(j, i1, i2)>: the columns of each row of cells that a ring covers.

    A row's centre line crosses the ring an even number of times; between the first and
    second crossing from the west it runs inside, then outside, and so on. A centre on a
    crossing counts as east of it. Every row is looked at once, whatever the ring's width,
    so wide footprints cost no more than narrow ones.
    """
    n = F.size(ring)
    edges = F.zip_with(ring, F.concat(F.slice(ring, n, 1), F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0)))), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    first_lat, first_lon = v.LAT_SOUTH + v.CELL_DEG / 2, v.LON_WEST + v.CELL_DEG / 2

    def row(edges: Column, j: Column) -> Column:
        lat = first_lat + j * v.CELL_DEG
        cut = F.filter(edges, lambda e: (e["p"]["lat"] > lat) != (e["q"]["lat"] > lat))
        at = F.array_sort(F.transform(cut, lambda e: (e["q"]["lon"] - e["p"]["lon"]) * (lat - e["p"]["lat"]) / (e["q"]["lat"] - e["p"]["lat"]) + e["p"]["lon"]))

        def column(x: Column) -> Column:
            """The first column whose centre is at x or east of it."""
            near = F.ceil((x - first_lon) / v.CELL_DEG)
            off = F.when(first_lon + (near - 1) * v.CELL_DEG >= x, -1).when(first_lon + near * v.CELL_DEG < x, 1).otherwise(0)
            return F.least(F.greatest(near + off, F.lit(0)), F.lit(N_LON)).cast("int")

        inside = lambda at: F.transform(
            F.filter(F.sequence(F.lit(0), F.size(at)), lambda k: (k % 2 == 0) & (k + 1 < F.size(at))),
            lambda k: F.struct(j.alias("j"), column(F.get(at, k)).alias("i1"), (column(F.get(at, k + 1)) - 1).alias("i2")),
        )
        return F.filter(once(at, inside), lambda s: s["i1"] <= s["i2"])

    rows = F.sequence(F.lit(0), F.lit(N_LAT - 1))
    spans = once(edges, lambda e: F.flatten(F.transform(rows, lambda j: row(e, j))))
    return F.when(n > 0, spans).otherwise(F.array().cast("array<struct<j:int,i1:int,i2:int>>"))


def cell_by_lines(lon: Column, lat: Column) -> Column:
    """Cell of a position by counting the grid lines at or before it; null outside the box."""
    west = [v.LON_WEST + k * v.CELL_DEG for k in range(N_LON)]
    south = [v.LAT_SOUTH + k * v.CELL_DEG for k in range(N_LAT)]
    passed = lambda lines, x: F.size(F.filter(F.array(*[F.lit(line) for line in lines]), lambda line: line <= x))
    inside = (lon < v.LON_EAST) & (lat < v.LAT_NORTH) & (lon >= v.LON_WEST) & (lat >= v.LAT_SOUTH)
    return F.when(inside, cell_name((passed(west, lon) - 1).cast("double"), (passed(south, lat) - 1).cast("double")))

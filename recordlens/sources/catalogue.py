"""Product catalogue pages and position samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = """value array<struct<Id: string, Name: string, ContentLength: bigint,
 ContentDate: struct<Start: string, End: string>, Checksum: array<struct<Algorithm: string, Value: string>>,
 Online: boolean, EvictionDate: string, ModificationDate: string, PublicationDate: string,
 GeoFootprint: struct<type: string, coordinates: string>>>"""

# Identity fields are not part of the schema, so they are never read.
POSITIONS = "features array<struct<geometry: struct<coordinates: array<double>>>>"


def checksum_map(checksums: Column) -> Column:
    """Lower-case algorithm to value; blank values are dropped, the last one of a name stays."""
    kept = F.filter(
        F.coalesce(checksums, F.array().cast("array<struct<Algorithm:string,Value:string>>")),
        lambda c: F.coalesce(c["Value"], F.lit("")) != "",
    )
    named = F.transform(
        kept,
        lambda c: F.struct(F.lower(F.coalesce(c["Algorithm"], F.lit("?"))).alias("key"), c["Value"].alias("value")),
    )
    last = F.filter(
        named,
        lambda c, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda d: d["key"] == c["key"]),
    )
    return F.map_from_entries(last)


def outer_rings(footprint: Column) -> Column:
    """Outer rings of a Polygon or MultiPolygon as arrays of (lon, lat); holes are ignored."""
    text = footprint["coordinates"]
    one = F.slice(F.from_json(text, "array<array<array<double>>>"), 1, 1)
    many = F.transform(F.from_json(text, "array<array<array<array<double>>>>"), lambda poly: F.get(poly, F.lit(0)))
    rings = F.when(footprint["type"] == "Polygon", one).when(footprint["type"] == "MultiPolygon", many)
    rings = F.coalesce(rings, F.array().cast("array<array<array<double>>>"))
    point = lambda q: F.struct(q[0].alias("lon"), q[1].alias("lat"))
    return F.transform(F.filter(rings, lambda r: r.isNotNull()), lambda r: F.transform(r, point))


def scenes(bodies: DataFrame, marker: str = "GRD") -> DataFrame:
    """Products whose name contains ``marker``; platform is the first three characters."""
    p = bodies.select("run_date", F.explode(F.from_json("body", PAGE)["value"]).alias("p"))
    p = p.filter(F.contains(F.col("p.Name"), F.lit(marker)))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return p.select(
        F.col("run_date").alias("night"), F.col("p.Name").alias("name"), text("p.Id").alias("id"),
        F.substring("p.Name", 1, 3).alias("platform"), text("p.ContentDate.Start").alias("start"),
        text("p.ContentDate.End").alias("end"), F.coalesce("p.ContentLength", F.lit(0)).alias("bytes"),
        checksum_map(F.col("p.Checksum")).alias("checksums"), F.col("p.Online").alias("online"),
        F.col("p.EvictionDate").alias("eviction_date"), F.col("p.ModificationDate").alias("modification_date"),
        F.col("p.PublicationDate").alias("publication_date"), outer_rings(F.col("p.GeoFootprint")).alias("rings"),
    )


def positions(bodies: DataFrame) -> DataFrame:
    """(night, lon, lat) of features with at least two coordinates."""
    f = bodies.select(F.col("run_date").alias("night"), F.explode(F.from_json("body", POSITIONS)["features"]).alias("f"))
    c = F.col("f.geometry.coordinates")
    return f.filter(F.size(c) >= 2).select("night", c[0].alias("lon"), c[1].alias("lat"))

"""Response plans, their funding, the country crosswalk and the daily event export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens import vocab as v

PLANS = """data array<struct<id: bigint, revisedRequirements: bigint, origRequirements: bigint,
 planVersion: struct<name: string>, locations: array<struct<iso3: string>>>>"""

FUNDING = """data struct<report3: struct<fundingTotals: struct<objects: array<struct<
 singleFundingObjects: array<struct<id: bigint, name: string, totalFunding: bigint>>>>>>>"""

CROSSWALK = """authored string, entries map<string, struct<fips: string>>,
 revisions array<struct<`date`: string, added: map<string, string>>>"""


def plans(bodies: DataFrame) -> DataFrame:
    """(plan_id, name, iso3, requirements_usd): revised, else original, else 0; zero counts as none."""
    p = bodies.select(F.explode(F.from_json("body", PLANS)["data"]).alias("p")).filter("p.id IS NOT NULL")
    codes = F.transform(
        F.coalesce("p.locations", F.array().cast("array<struct<iso3:string>>")), lambda x: x["iso3"]
    )
    return p.select(
        F.col("p.id").alias("plan_id"), F.coalesce("p.planVersion.name", F.lit("")).alias("name"),
        F.array_sort(F.array_distinct(F.filter(codes, lambda c: c.isNotNull() & (c != "")))).alias("iso3"),
        F.coalesce(
            F.nullif("p.revisedRequirements", F.lit(0)), F.nullif("p.origRequirements", F.lit(0)), F.lit(0)
        ).alias("requirements_usd"),
    )


def funding(bodies: DataFrame) -> DataFrame:
    """(plan_id, funded_usd): the last entry of a plan wins; entries without a plan are skipped."""
    objects = F.from_json("body", FUNDING)["data"]["report3"]["fundingTotals"]["objects"]
    o = bodies.select("doc", F.posexplode(objects).alias("opos", "o"))
    e = o.select("doc", "opos", F.posexplode("o.singleFundingObjects").alias("epos", "e")).filter("e.id IS NOT NULL")
    total = F.coalesce("e.totalFunding", F.lit(0))
    return e.groupBy(F.col("e.id").alias("plan_id")).agg(
        F.max_by(total, F.struct("doc", "opos", "epos")).alias("funded_usd")
    )


def crosswalk(bodies: DataFrame) -> DataFrame:
    """(iso3, fips, valid_from): base entries from their authoring day, revisions from theirs.

    A code that any revision lists counts from its revisions only.
    """
    d = bodies.select(F.from_json("body", CROSSWALK).alias("d"))
    added = d.select(F.explode("d.revisions").alias("r")).select(
        F.explode("r.added").alias("iso3", "fips"), F.col("r.date").alias("valid_from")
    )
    base = d.select(
        F.explode("d.entries").alias("iso3", "e"), F.coalesce("d.authored", F.lit("")).alias("valid_from")
    )
    base = base.select("iso3", F.col("e.fips").alias("fips"), "valid_from")
    return base.join(added.select("iso3").distinct(), "iso3", "left_anti").unionByName(added)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): raw lines of daily export files; a line-based, splittable scan."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def export_rows(lines: DataFrame) -> DataFrame:
    """Add country, mentions, articles and malformed; reads three of the 58 columns.

    Short lines and non-numeric counts are malformed; an empty count is 0.
    """
    cols = F.split("value", "\t", -1)
    rows = lines.withColumn("_c", F.transform(F.array(*[F.get(cols, F.lit(i)) for i in (
        v.EXPORT_MENTIONS, v.EXPORT_ARTICLES, v.EXPORT_COUNTRY)]), lambda c: F.trim(c)))
    rows = rows.withColumn("_n", F.size(cols))
    number = lambda c: F.when(c == "", F.lit(0)).otherwise(c.try_cast("bigint"))
    rows = rows.withColumns({"mentions": number(F.col("_c")[0]), "articles": number(F.col("_c")[1])})
    bad = (F.col("_n") < v.EXPORT_COLUMNS) | F.col("mentions").isNull() | F.col("articles").isNull()
    return rows.withColumns({"country": F.col("_c")[2], "malformed": bad}).drop("value", "_c", "_n")


def code_list(lines: DataFrame) -> DataFrame:
    """(code, name) of a two-column list; other lines are dropped."""
    parts = F.split("value", "\t", -1)
    return lines.filter((F.size(parts) == 2) & (F.get(parts, F.lit(0)) != "")).select(
        F.get(parts, F.lit(0)).alias("code"), F.get(parts, F.lit(1)).alias("name")
    )

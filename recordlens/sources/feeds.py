"""Warning feeds: JSON documents to observations.

Every parser takes ``bodies``: run_date, snapshot, doc (order of the documents of a
night) and body. Schemas are explicit; fields that come in several shapes are read as
text first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens import vocab as v
from recordlens.functions.clock import verbatim_date
from recordlens.functions.text import once
from recordlens.operators.ordered import first_per_key

ALERTS = """features array<struct<properties: struct<eventid: string, eventtype: string, alertlevel: string,
 name: string, eventname: string, country: string, iso3: string,
 affectedcountries: array<struct<iso3: string>>, fromdate: string, todate: string, url: string>>>"""

STORMS = """activeStorms array<struct<id: string, binNumber: string, name: string, classification: string,
 intensity: string, lastUpdate: string>>"""

CAP = """features array<struct<properties: struct<`@id`: string, event: string, severity: string, onset: string,
 effective: string, ends: string, expires: string, areaDesc: string, parameters: struct<VTEC: array<string>>>>>"""

VTEC = (
    r"^/[A-Z]\.([A-Z]{3})\.([A-Z]{4})\.([A-Z]{2})\.([A-Z])\.(\d{4})\.(\d{6})T\d{4}Z-(\d{6})T\d{4}Z/$"
)


def read_documents(spark: SparkSession, path: str, per: str = "file") -> DataFrame:
    """(path, body): one document per file, or one per line for line-delimited feeds."""
    raw = spark.read.text(path, wholetext=per == "file")
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def is_json(body: Column) -> Column:
    return F.try_parse_json(body).isNotNull()


def answered_nights(fetches: DataFrame, mode: str = "parsed") -> DataFrame:
    """(source, run_date) of nights a source answered.

    ``fetches``: source, run_date, http_status, body. ``parsed`` asks for readable JSON;
    ``preserved`` is content with any HTTP 200.
    """
    ok = F.col("http_status") == 200
    if mode == "parsed":
        ok = ok & is_json(F.col("body"))
    return fetches.filter(ok).select("source", "run_date").distinct()


def _features(bodies: DataFrame, schema: str, array: str) -> DataFrame:
    parsed = bodies.withColumn("_d", F.from_json("body", schema))
    return parsed.select("run_date", "snapshot", "doc", F.posexplode(f"_d.{array}").alias("fpos", "f"))


def _text(col) -> Column:
    return F.trim(F.coalesce(col, F.lit("")))


def _first_text(*cols) -> Column:
    """The first non-empty text."""
    return F.coalesce(*[F.when(c != "", c) for c in cols])


def _place(feature, code=None) -> Column:
    """Feed order of a record: document, feature and code position."""
    code = F.lit(0) if code is None else code
    return F.struct(F.col("doc").cast("bigint").alias("doc"), feature.alias("feature"), code.alias("code"))


def alert_observations(bodies: DataFrame) -> DataFrame:
    """Alert episodes of the five hazard types; everything else in the feed is left out."""
    rows = _features(bodies, ALERTS, "features").withColumn("p", F.col("f.properties"))
    p = F.col("p")
    hazards = F.create_map(*[F.lit(x) for kv in v.HAZARD_NAMES.items() for x in kv])
    listed = F.coalesce(p["affectedcountries"]["iso3"], F.array().cast("array<string>"))
    # distinct codes without empty and missing ones; no lambda, so the row stays in compiled code
    codes = F.array_except(F.concat(listed, F.array(_text(p["iso3"]))), F.array(F.lit(""), F.lit(None)))
    codes = F.sort_array(codes)
    ref = F.when(F.startswith(p["url"], F.lit("{")), F.get_json_object(p["url"], "$.report")).otherwise(p["url"])
    known = p["eventid"].isNotNull() & p["eventtype"].isin(*v.HAZARD_NAMES)
    return rows.filter(known).select(
        "run_date", "snapshot", _place(F.col("fpos")).alias("pos"),
        F.concat(F.lit("gdacs-"), F.lower(p["eventtype"]), F.lit("-"), p["eventid"]).alias("id"),
        F.lit("ALERT_EPISODE").alias("kind"), F.lit("GDACS").alias("source"),
        hazards[p["eventtype"]].alias("hazard"),
        _text(_first_text(p["name"], p["eventname"])).alias("what"), _text(p["country"]).alias("where"),
        codes.alias("iso3"), F.coalesce(p["alertlevel"], F.lit("")).alias("severity"),
        F.struct(verbatim_date(p["fromdate"]).alias("from"), verbatim_date(p["todate"]).alias("to")).alias("window"),
        F.coalesce(ref, F.lit("")).alias("source_ref"),
    )


def primary_codes(bodies: DataFrame) -> DataFrame:
    """(id, primary_iso3): each feature's own primary country, for guard and correction."""
    rows = _features(bodies, ALERTS, "features").withColumn("p", F.col("f.properties"))
    fid = F.concat(F.lit("gdacs-"), F.lower("p.eventtype"), F.lit("-"), F.col("p.eventid"))
    return rows.select(fid.alias("id"), F.trim("p.iso3").alias("primary_iso3")).filter("id IS NOT NULL")


def storm_observations(bodies: DataFrame) -> DataFrame:
    """Forecast records of active storms; an empty list is a valid, quiet answer."""
    rows = _features(bodies, STORMS, "activeStorms")
    s = F.col("f")
    sid = _first_text(s["id"], s["binNumber"])
    return rows.filter(sid.isNotNull()).select(
        "run_date", "snapshot", _place(F.col("fpos")).alias("pos"),
        F.concat(F.lit("nhc-"), F.lower(sid)).alias("id"), F.lit("FORECAST").alias("kind"), F.lit("NHC").alias("source"),
        F.lit("tropical cyclone").alias("hazard"),
        F.concat(
            _text(s["name"]), F.lit(" ("), F.trim(F.coalesce(_first_text(s["classification"]), F.lit("storm"))), F.lit(")")
        ).alias("what"),
        F.coalesce(s["binNumber"], F.lit("")).alias("where"),
        F.array().cast("array<string>").alias("iso3"), F.coalesce(s["intensity"], F.lit("")).alias("severity"),
        F.struct(verbatim_date(s["lastUpdate"]).alias("from"), F.lit(None).cast("string").alias("to")).alias("window"),
        F.lit("https://www.nhc.noaa.gov/").alias("source_ref"),
    )


def vtec_id(code: Column) -> Column:
    """Stable id of a warning: office, product, tracking number and year; null if it is none."""
    # All groups by one match; a code of another form is left as it is, in one piece.
    parts = F.split(F.regexp_replace(F.trim(code), VTEC, "$1 $2 $3 $4 $5 $6 $7 vtec"), " ")

    def named(part: Column) -> Column:
        g = lambda i: F.get(part, F.lit(i - 1))
        year = F.when(g(6) == "000000", F.substring(g(7), 1, 2)).otherwise(F.substring(g(6), 1, 2))
        kept = F.startswith(g(8), F.lit("vtec")) & (g(4) == "W") & ~g(1).isin(*v.VTEC_CLOSING_ACTIONS)
        return F.when(
            kept,
            F.concat(F.lit("nws-"), F.lower(g(2)), F.lit("-"), F.lower(g(3)), F.lower(g(4)), F.lit("-"), g(5), F.lit("-"), year),
        )

    return once(parts, named)


def hazard_word(event: Column) -> Column:
    """The issuer's event name without its product word, lower case."""
    products = "|".join(s.strip() for s in v.PRODUCT_SUFFIXES)
    return F.lower(F.regexp_replace(_text(event), rf" (?:{products})$", ""))


def warning_observations(bodies: DataFrame) -> DataFrame:
    """Warnings keyed by tracking number; the first message of a night wins in feed order."""
    rows = _features(bodies, CAP, "features").withColumn("p", F.col("f.properties"))
    codes = rows.select("run_date", "snapshot", "doc", "fpos", "p", F.posexplode("p.parameters.VTEC").alias("cpos", "code"))
    keyed = codes.withColumn("id", vtec_id(F.col("code"))).filter("id IS NOT NULL")
    first = first_per_key(keyed, ["run_date", "id"], [F.col("doc"), F.col("fpos"), F.col("cpos")])
    p = F.col("p")
    return first.select(
        "run_date", "snapshot", _place(F.col("fpos"), F.col("cpos")).alias("pos"), "id",
        F.lit("ALERT_EPISODE").alias("kind"), F.lit("NWS").alias("source"), hazard_word(p["event"]).alias("hazard"),
        _text(p["event"]).alias("what"), _text(p["areaDesc"]).alias("where"), F.array(F.lit("USA")).alias("iso3"),
        F.coalesce(p["severity"], F.lit("")).alias("severity"),
        F.struct(
            verbatim_date(_first_text(p["onset"], p["effective"])).alias("from"),
            verbatim_date(_first_text(p["ends"], p["expires"])).alias("to"),
        ).alias("window"),
        F.coalesce(p["@id"], F.lit("")).alias("source_ref"),
    )


ADAPTERS = {"GDACS": alert_observations, "NHC": storm_observations, "NWS": warning_observations}


def all_observations(bodies_by_source: dict[str, DataFrame]) -> DataFrame:
    """Union of the feeds, each through its adapter."""
    parts = [ADAPTERS[name](bodies) for name, bodies in bodies_by_source.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

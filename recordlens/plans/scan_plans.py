"""Scan and sink queries: documents are derived from the tables, row by row, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens import sinks
from recordlens.functions import grid
from recordlens.operators import reaction as rx
from recordlens.operators.wording import decode_bytes
from recordlens.plans import coverage_plans as cvp
from recordlens.plans.reaction_plans import volume_rows
from recordlens.plans.tables import day_text, spread, table
from recordlens.session import shared_folder
from recordlens.sources import catalogue, feeds, finance, records


def _text_of(col: str):
    return F.col(col).cast("string")


def _null():
    return F.lit(None).cast("string")


def alert_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert document per line item; every document also carries an unknown hazard."""
    li = spread(table(spark, sf_dir, "lineitem"), "l_orderkey").withColumn("_day", day_text("l_shipdate"))
    line, day = F.col("l_linenumber"), F.col("_day")
    code = lambda n: F.concat(F.lit("C"), n.cast("string"))
    hazard = F.element_at(F.array(*[F.lit(h) for h in ("EQ", "TC", "FL", "DR", "WF", "VO", "TS")]), line)
    props = [
        F.when(F.col("l_quantity") > 2, F.col("l_orderkey") * 10 + line).alias("eventid"),
        hazard.alias("eventtype"),
        F.when(F.col("l_returnflag") == "R", "Red").when(F.col("l_returnflag") == "A", "Orange").alias("alertlevel"),
        F.when(F.col("l_tax") > 0.01, F.concat(F.lit(" Event "), _text_of("l_partkey"))).otherwise("").alias("name"),
        F.concat(F.lit("Fallback "), _text_of("l_partkey")).alias("eventname"),
        F.concat(F.lit(" Land "), _text_of("l_suppkey")).alias("country"),
        F.when(F.col("l_discount") > 0.04, code(F.col("l_suppkey") % 25)).otherwise(" ").alias("iso3"),
        F.array(
            F.struct(code(F.col("l_partkey") % 25).alias("iso3")), F.struct(F.lit("").alias("iso3")),
            F.struct(code((F.col("l_partkey") + 1) % 25).alias("iso3")),
        ).alias("affectedcountries"),
        F.concat(day, F.lit("T00:00:00")).alias("fromdate"),
        F.when(F.col("l_linestatus") == "F", F.concat(day, F.lit("T12:00:00"))).otherwise("soon").alias("todate"),
    ]
    other = F.struct(F.lit("1").alias("eventid"), F.lit("XX").alias("eventtype"))
    link = F.concat(F.lit("https://r.test/"), _text_of("l_orderkey"))

    feature = lambda url: F.to_json(F.struct(F.struct(*props, url.alias("url")).alias("properties")))
    first = F.when(F.col("l_linestatus") == "F", feature(F.struct(link.alias("report")))).otherwise(feature(link))
    # The document is put together around its features, so that no text is measured and cut again.
    body = F.concat(F.lit('{"features":['), F.col("_first"), F.lit(","), F.to_json(F.struct(other.alias("properties"))), F.lit("]}"))
    li = li.withColumn("_first", first)
    return li.select(
        day.alias("run_date"), F.concat(F.lit("alerts/"), day).alias("snapshot"),
        (F.col("l_orderkey") * 10 + line).alias("doc"), body.alias("body"),
    )


def alert_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = feeds.alert_observations(alert_bodies(spark, sf_dir))
    return o.select(
        "run_date", "id", F.col("pos.doc").alias("doc"), "kind", "source", "hazard", "what", "where", F.array_join("iso3", ",").alias("iso3"),
        "severity", F.col("window.from").alias("window_from"), F.col("window.to").alias("window_to"), "source_ref",
    )


def storm_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One storm document per order; some storms have no id, a few have none at all."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    storm = F.struct(
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("AL"), _text_of("o_orderkey"))).otherwise("").alias("id"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("BIN"), _text_of("o_custkey"))).alias("binNumber"),
        F.concat(F.lit(" Storm"), _text_of("o_custkey")).alias("name"),
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.substring("o_orderpriority", 3, 20)).alias("classification"),
        F.floor("o_totalprice").cast("string").alias("intensity"),
        day_text("o_orderdate").alias("lastUpdate"),
    )
    return o.select(
        day_text("o_orderdate").alias("run_date"), F.lit("storms").alias("snapshot"), k.alias("doc"),
        F.to_json(F.struct(F.array(storm).alias("activeStorms"))).alias("body"),
    )


def storm_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = feeds.storm_observations(storm_bodies(spark, sf_dir))
    return out.select("run_date", F.col("pos.doc").alias("doc"), "id", "what", "where", "severity", F.col("window.from").alias("window_from"))


def _vtec(action, office, etn, begin, end, sig="W"):
    return F.concat(
        F.lit("/O."), action, F.lit(".K"), office, F.lit(f".FL.{sig}."), etn, F.lit("."), begin, F.lit("T1511Z-"), end, F.lit("T0600Z/")
    )


def warning_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One warning message per event with three codes: a warning, its extension or end, and an advisory."""
    ev = spread(table(spark, sf_dir, "events"), "event_id")
    day = day_text("ts")
    office = F.translate(F.lpad((F.col("user_id") % 100).cast("string"), 3, "0"), "0123456789", "ABCDEFGHIJ")
    etn = F.lpad((F.col("user_id") % 40).cast("string"), 4, "0")
    begin, end = F.date_format("ts", "yyMMdd"), F.date_format(F.date_add("ts", 2), "yyMMdd")
    action = F.when(F.col("event_type") == "error", "CAN").when(F.col("event_type") == "view", "EXT").otherwise("NEW")
    codes = F.array(
        _vtec(action, office, etn, F.when(action == "EXT", "000000").otherwise(begin), end),
        _vtec(F.lit("CON"), office, F.lpad(F.floor(F.col("value")).cast("string"), 4, "0"), begin, end),
        _vtec(F.lit("NEW"), office, etn, begin, end, sig="A"),
        F.lit("no code"),
    )
    name = F.concat(F.initcap("event_type"), F.when(F.col("value") > 50, " Warning").when(F.col("value") > 20, " Watch").otherwise(""))
    props = F.struct(
        F.concat(F.lit("urn:"), _text_of("event_id")).alias("@id"), name.alias("event"),
        F.when(F.col("value") > 60, "Extreme").otherwise("Severe").alias("severity"),
        F.when(F.col("value") > 10, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("onset"),
        F.concat(day, F.lit("T00:00:00")).alias("effective"), F.lit("").alias("ends"),
        F.concat(day, F.lit("T23:00:00")).alias("expires"), F.concat(F.lit("Area "), _text_of("user_id")).alias("areaDesc"),
        F.struct(codes.alias("VTEC")).alias("parameters"),
    )
    return ev.select(
        day.alias("run_date"), F.lit("warnings").alias("snapshot"), F.col("event_id").alias("doc"),
        F.to_json(F.struct(F.array(F.struct(props.alias("properties"))).alias("features"))).alias("body"),
    )


def warning_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = feeds.warning_observations(warning_bodies(spark, sf_dir))
    return out.select(
        "run_date", "id", "hazard", "what", "where", "severity", F.col("window.from").alias("window_from"),
        F.col("window.to").alias("window_to"), "source_ref",
    )


def all_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three feeds as one table of observations."""
    bodies = {"GDACS": alert_bodies(spark, sf_dir), "NHC": storm_bodies(spark, sf_dir), "NWS": warning_bodies(spark, sf_dir)}
    return feeds.all_observations(bodies).select("run_date", "id", "what", "where", "severity", F.col("window.from").alias("window_from"))


def answered_nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetches from events: some fail, some are cut off in the middle."""
    ev = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    f = ev.select(
        F.concat_ws("-", "event_type", _text_of("user_id")).alias("source"), day_text("ts").alias("run_date"),
        F.when(k % 4 == 0, 503).otherwise(200).alias("http_status"),
        F.when(k % 3 == 0, F.substring("props", 1, 3)).otherwise(F.col("props")).alias("body"),
    )
    return feeds.answered_nights(f)


def plan_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    plan = F.struct(
        F.when(F.col("s_acctbal") > 0, k).alias("id"),
        F.when(k % 3 > 0, F.floor("s_acctbal") * (k % 2)).alias("revisedRequirements"),
        F.when(k % 5 > 0, F.floor(F.col("s_acctbal") / 2)).alias("origRequirements"),
        F.struct(F.col("s_name").alias("name")).alias("planVersion"),
        F.array(
            F.struct(F.concat(F.lit("N"), _text_of("s_nationkey")).alias("iso3")),
            F.struct(_null().alias("iso3")),
            F.struct(F.concat(F.lit("N"), (k % 25).cast("string")).alias("iso3")),
        ).alias("locations"),
    )
    out = finance.plans(s.select(F.to_json(F.struct(F.array(plan).alias("data"))).alias("body")))
    return out.withColumn("iso3", F.array_join("iso3", ","))


def funding_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One funding document per order with two entries and one without a plan; the last entry of a plan wins."""
    o = table(spark, sf_dir, "orders")
    entry = lambda pid, total: F.struct(pid.cast("bigint").alias("id"), total.cast("bigint").alias("totalFunding"))
    total = F.floor("o_totalprice")
    objects = F.array(
        F.struct(
            F.array(
                entry(F.col("o_custkey"), total),
                entry(F.lit(None), F.lit(42)),
                entry(F.col("o_custkey"), F.when(F.col("o_orderstatus") != "P", total + 1)),
            ).alias("singleFundingObjects")
        )
    )
    body = F.struct(
        F.struct(F.struct(F.struct(objects.alias("objects")).alias("fundingTotals")).alias("report3")).alias("data")
    )
    return finance.funding(o.select(F.col("o_orderkey").alias("doc"), F.to_json(body).alias("body")))


def crosswalk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One crosswalk document per customer: a base entry, and for some a later revision."""
    c = table(spark, sf_dir, "customer")
    code = F.concat(F.lit("C"), _text_of("c_custkey"))
    revised = F.when(
        F.col("c_mktsegment") == "BUILDING",
        F.array(F.struct(F.lit("2024-02-01").alias("date"), F.create_map(code, F.concat(F.lit("R"), _text_of("c_nationkey"))).alias("added"))),
    )
    body = F.struct(
        F.lit("2024-01-01").alias("authored"),
        F.create_map(code, F.struct(F.concat(F.lit("F"), _text_of("c_nationkey")).alias("fips"))).alias("entries"),
        revised.alias("revisions"),
    )
    return finance.crosswalk(c.select(F.to_json(body).alias("body")))


def export_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a 58-column export written to text files, read back and totalled per day file."""
    li = spread(table(spark, sf_dir, "lineitem"), "l_orderkey")
    cells = [F.lit("")] * 58
    cells[31] = F.when(F.col("l_tax") > 0.07, "n/a").otherwise(F.col("l_linenumber").cast("string"))
    cells[33] = F.when(F.col("l_tax") < 0.01, "").otherwise(F.floor("l_quantity").cast("string"))
    cells[51] = F.when(F.col("l_discount") > 0.01, F.concat(F.lit("F"), (F.col("l_suppkey") % 25).cast("string"))).otherwise(" ")
    full = F.concat_ws("\t", *cells)
    line = F.when(F.col("l_quantity") < 3, "too\tshort").otherwise(full)
    path = shared_folder(spark, "export")
    li.select(F.year("l_shipdate").alias("year"), line.alias("value")).write.partitionBy("year").text(path)
    rows = finance.export_rows(finance.read_export(spark, path))
    rows = rows.withColumn("year", F.regexp_extract("path", r"year=(\d+)", 1))
    return rows.groupBy("year").agg(
        F.count_if(~F.col("malformed")).alias("rows"), F.count_if("malformed").alias("malformed_rows"),
        F.sum(F.when(~F.col("malformed"), F.col("articles"))).alias("articles"),
        F.sum(F.when(~F.col("malformed"), F.col("mentions"))).alias("mentions"),
        F.count_if(~F.col("malformed") & (F.col("country") == "")).alias("unlocated"),
    )


def code_list_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a two-column code list; brand 1 has a third column and brand 2 no code."""
    p = table(spark, sf_dir, "part")
    code = F.when(F.col("p_brand") == "Brand#2", "").otherwise(_text_of("p_partkey"))
    line = F.concat_ws("\t", code, "p_name", F.when(F.col("p_brand") == "Brand#1", "extra"))
    return finance.code_list(p.select(line.alias("value")))


def catalogue_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One catalogue page per vector; every fourth label is another product type."""
    sc = cvp.scenes(spark, sf_dir)
    lab = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    sc = sc.join(lab, "vec_id")
    xy = lambda ring: F.transform(ring, lambda q: F.array(q["lon"], q["lat"]))
    two = F.size("rings") > 1
    poly = F.to_json(F.transform("rings", xy))
    multi = F.to_json(F.transform("rings", lambda r: F.array(xy(r))))
    name = F.when(F.col("label") % 4 == 3, F.replace("name", F.lit("GRD"), F.lit("SLC"))).otherwise(F.col("name"))
    sums = F.array(
        F.struct(F.lit("MD5").alias("Algorithm"), F.concat(F.lit("m"), _text_of("vec_id")).alias("Value")),
        F.struct(F.lit("SHA3").alias("Algorithm"), F.lit("").alias("Value")),
        F.struct(F.lit("BLAKE3").alias("Algorithm"), F.concat(F.lit("b"), _text_of("label")).alias("Value")),
    )
    body = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    _text_of("vec_id").alias("Id"), name.alias("Name"), F.col("vec_id").alias("ContentLength"),
                    F.struct(F.col("start").alias("Start"), F.col("end").alias("End")).alias("ContentDate"),
                    sums.alias("Checksum"), (F.col("label") > 4).alias("Online"),
                    F.struct(
                        F.when(two, "MultiPolygon").otherwise("Polygon").alias("type"),
                        F.when(two, multi).otherwise(poly).alias("coordinates"),
                    ).alias("GeoFootprint"),
                )
            ).alias("value")
        )
    )
    out = catalogue.scenes(sc.select(F.col("night").alias("run_date"), body.alias("body")))
    cells = grid.covered_cells(F.col("rings"))
    return out.select(
        "night", "name", "id", "platform", "start", "end", "bytes", "online",
        F.array_join(F.transform(F.array_sort(F.map_entries("checksums")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("checksums"),
        F.size(cells).cast("bigint").alias("n_cells"),
    )


def position_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position documents with identities beside the points; only the points are read."""
    p = cvp._places(spark, sf_dir)
    point = F.when(F.col("label") == 9, F.array("lon")).otherwise(F.array("lon", "lat"))
    feature = F.struct(
        F.struct(point.alias("coordinates")).alias("geometry"), F.struct(F.col("vec_id").alias("mmsi")).alias("properties")
    )
    body = F.to_json(F.struct(F.array(feature).alias("features")))
    got = catalogue.positions(p.select(F.col("night").alias("run_date"), body.alias("body")))
    cell = grid.cell_of(F.col("lon"), F.col("lat"))
    return got.select("night", cell.alias("cell")).groupBy("night").agg(
        F.count(F.lit(1)).alias("in_feed"), F.count("cell").alias("in_region")
    )


def capture_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One archive answer per event: header, a row, a short row; some bodies are empty or broken."""
    ev = table(spark, sf_dir, "events")
    row = F.array(
        F.date_format("ts", "yyyyMMddHHmmss"), F.concat(F.lit("https://u.test/"), _text_of("user_id")),
        F.when(F.col("event_type") == "error", "-").otherwise("200"), F.concat(F.lit("D"), F.floor("value").cast("string")),
    )
    header = F.array(*[F.lit(x) for x in ("timestamp", "original", "statuscode", "digest")])
    body = F.when(F.col("event_type") == "signup", "").when(F.col("event_type") == "view", "[broken").otherwise(
        F.to_json(F.array(header, row, F.array(F.lit("short"))))
    )
    rows = records.capture_rows(ev.select(F.col("event_id").alias("doc"), body.alias("body")))
    return rows.drop("pos")


def decoded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written in UTF-8 or a one-byte code and decoded again."""
    p = table(spark, sf_dir, "pages")
    western = ~F.col("html").rlike(r"[^\x00-\x7E\xA0-\xFF]")
    data = F.when(western & (F.col("page_id") % 2 == 0), F.encode("html", "ISO-8859-1")).otherwise(F.encode("html", "UTF-8"))
    return p.select("page_id", decode_bytes(data).alias("html"))


def watchlist_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One watchlist document per supplier; what it excludes and where it overlaps."""
    s = table(spark, sf_dir, "supplier")
    url = F.concat(F.lit("u"), (F.col("s_suppkey") % 40).cast("string"))
    body = F.struct(
        F.lit("v1").alias("version"), F.struct(F.array(F.concat(F.lit("u"), _text_of("s_nationkey"))).alias("urls")).alias("excluded"),
        F.array(F.struct(F.col("s_name").alias("slug"), F.array(url).alias("urls"))).alias("institutions"),
    )
    docs = s.select(F.to_json(body).alias("body"))
    listed = records.watchlist_institutions(docs).select("slug", F.explode("urls").alias("url"))
    out = records.watchlist_exclusions(docs).withColumn("excluded", F.lit(True))
    return listed.join(out, "url", "left").select("slug", "url", F.coalesce("excluded", F.lit(False)).alias("excluded"))


def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest documents with two entries per order day and customer segment."""
    o = table(spark, sf_dir, "orders")
    entry = lambda name: F.struct(
        F.concat(F.lit(name + "/"), _text_of("o_orderkey")).alias("file"), F.lit(200).alias("http_status"),
        F.sha2(_text_of("o_orderkey"), 256).alias("sha256"), F.length(_text_of("o_orderkey")).cast("bigint").alias("bytes"),
    )
    body = F.to_json(F.struct(day_text("o_orderdate").alias("run_date"), F.array(entry("a"), entry("b")).alias("entries")))
    out = records.manifest_entries(o.select(body.alias("body")))
    return out.select("run_date", "file", F.col("http_status").cast("bigint").alias("http_status"), "sha256", "bytes")


def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier names written as one file per nation; hash and length of the bytes as they lie there."""
    s = table(spark, sf_dir, "supplier")
    path = shared_folder(spark, "preserved")
    lines = s.select("s_nationkey", "s_suppkey", F.col("s_name").alias("value")).repartition("s_nationkey")
    lines = lines.sortWithinPartitions("s_nationkey", "s_suppkey").drop("s_suppkey")
    lines.write.partitionBy("s_nationkey").text(path)
    got = sinks.manifest_of(spark, path)
    return got.select(
        F.regexp_extract("path", r"s_nationkey=(\d+)", 1).cast("bigint").alias("s_nationkey"), "bytes", "sha256"
    )


def fetch_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer names as one file per nation, with where and when they were fetched; every fifth has no fetch on record."""
    c = table(spark, sf_dir, "customer")
    path = shared_folder(spark, "fetched")
    lines = c.select("c_nationkey", "c_custkey", F.col("c_name").alias("value")).repartition("c_nationkey")
    lines.sortWithinPartitions("c_nationkey", "c_custkey").drop("c_custkey").write.partitionBy("c_nationkey").text(path)
    nation = F.regexp_extract("file", r"c_nationkey=(\d+)", 1).cast("bigint")
    names = sinks.manifest_of(spark, path).select(F.regexp_extract("path", r"(c_nationkey=\d+/[^/]+)$", 1).alias("file"))
    fetches = names.filter(nation % 5 > 0).select(
        "file", F.concat(F.lit("https://feeds.test/"), nation.cast("string")).alias("url"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), nation.cast("int")), "yyyy-MM-dd'T'03:00:00'Z'").alias("retrieved_at"),
        F.when(nation % 7 == 0, 304).otherwise(200).alias("http_status"),
    )
    got = sinks.manifest_of(spark, path, fetches)
    return got.select(nation.alias("nation"), "url", "retrieved_at", F.col("http_status").cast("bigint").alias("http_status"), "sha256", "bytes")


def manifest_nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest files, one for each month of orders, read back with the folder each came from."""
    o = table(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    path = shared_folder(spark, "manifests")
    entry = F.struct(
        _text_of("o_orderkey").alias("file"), F.concat(F.lit("https://feeds.test/"), _text_of("o_orderkey")).alias("url"), F.lit(200).alias("http_status"),
        F.sha2(_text_of("o_orderkey"), 256).alias("sha256"), F.col("o_custkey").cast("bigint").alias("bytes"),
    )
    docs = o.groupBy("month").agg(F.to_json(F.struct(F.first("month").alias("run_date"), F.collect_list(entry).alias("entries"))).alias("value"))  # a document is a month's list
    docs.repartition("month").write.partitionBy("month").text(path)
    got = records.manifest_files(spark, f"{path}/*")
    return got.select(
        F.regexp_extract("origin", r"month=([0-9-]+)/", 1).alias("folder"), "run_date", "file", "url", F.col("http_status").cast("bigint").alias("http_status"), "sha256", "bytes"
    )


def preserved_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New files of the orders against a manifest of the large ones."""
    o = table(spark, sf_dir, "orders")
    e = o.select(_text_of("o_orderkey").alias("file"), F.sha2("o_orderstatus", 256).alias("sha256"), "o_totalprice")
    held = e.filter("o_totalprice > 200000").select("file", "sha256")
    return sinks.preserve_once(e.select("file", "sha256"), held)


def log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines, a file for each day in order, some cut off; read back and numbered."""
    ev = table(spark, sf_dir, "events")
    good = F.to_json(
        F.struct(F.col("event_type").alias("step"), F.lit("machine").alias("actor"), F.struct(day_text("ts").alias("date")).alias("detail"))
    )
    line = F.when(F.col("value") < 2, F.substring(good, 1, 12)).otherwise(good)
    path = shared_folder(spark, "log")
    days = ev.select(line.alias("value"), day_text("ts").alias("day"), "event_id").repartition("day").sortWithinPartitions("day", "event_id")
    days.select("value", "day").write.partitionBy("day").text(path)
    rows = records.log_entries(records.numbered_lines(spark.read.option("recursiveFileLookup", "true").text(path)))
    day = F.regexp_extract("file", "day=([0-9-]+)", 1).alias("day")
    return rows.select(day, "line_no", "unparseable", "step", "run_date")


def append_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily volume committed by day, by a run that is repeated; another run's write of the same days is refused."""
    path = shared_folder(spark, "committed")
    volume = rx.daily_volume(volume_rows(spark, sf_dir))
    for _ in range(2):
        sinks.append_once(volume, path, "day", run="first")
    refused = 0
    try:
        sinks.append_once(volume, path, "day")
    except sinks.AlreadyRecorded:
        refused = 1
    got = records.read_committed(spark, path)
    return got.groupBy(F.col("day").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("articles").alias("articles"), F.lit(refused).cast("bigint").alias("refused")
    )


def append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict-like rows appended twice; the first value of a key stays."""
    path = shared_folder(spark, "verdicts")
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("verdict"))
    sinks.append_new(rows.filter("verdict <> 'P'"), path, "id")
    sinks.append_new(rows.withColumn("verdict", F.lit("late")), path, "id")
    return sinks.held_rows(spark, path, "id")


# --- the same in SQL ---------------------------------------------------------

QUERIES = {
    "alert_feed": alert_feed,
    "storm_feed": storm_feed,
    "warning_feed": warning_feed,
    "all_feeds": all_feeds,
    "answered_nights": answered_nights,
    "plan_scan": plan_scan,
    "funding_scan": funding_scan,
    "crosswalk_scan": crosswalk_scan,
    "export_scan": export_scan,
    "code_list_scan": code_list_scan,
    "catalogue_scan": catalogue_scan,
    "position_scan": position_scan,
    "capture_scan": capture_scan,
    "decoded_pages": decoded_pages,
    "watchlist_scan": watchlist_scan,
    "manifest_scan": manifest_scan,
    "file_manifest": file_manifest,
    "fetch_manifest": fetch_manifest,
    "manifest_nights": manifest_nights,
    "preserved_once": preserved_once,
    "log_scan": log_scan,
    "append_once": append_once,
    "append_new": append_new,
}

ORACLES = {
    "alert_feed": """
      WITH l AS (SELECT *, strftime(l_shipdate, '%Y-%m-%d') AS day, l_orderkey * 10 + l_linenumber AS eid,
        ['EQ','TC','FL','DR','WF','VO','TS'][l_linenumber] AS et FROM lineitem)
      SELECT day AS run_date, 'gdacs-' || lower(et) || '-' || eid AS id, eid AS doc, 'ALERT_EPISODE' AS kind, 'GDACS' AS source,
        CASE et WHEN 'EQ' THEN 'earthquake' WHEN 'TC' THEN 'tropical cyclone' WHEN 'FL' THEN 'flood' WHEN 'DR' THEN 'drought' ELSE 'wildfire' END AS hazard,
        CASE WHEN l_tax > 0.01 THEN 'Event ' ELSE 'Fallback ' END || l_partkey AS what, 'Land ' || l_suppkey AS "where",
        array_to_string(list_sort(list_distinct(['C' || (l_partkey % 25), 'C' || ((l_partkey + 1) % 25)]
          || CASE WHEN l_discount > 0.04 THEN ['C' || (l_suppkey % 25)] ELSE [] END)), ',') AS iso3,
        CASE l_returnflag WHEN 'R' THEN 'Red' WHEN 'A' THEN 'Orange' ELSE '' END AS severity,
        day || 'T00:00:00' AS window_from, CASE WHEN l_linestatus = 'F' THEN day || 'T12:00:00' END AS window_to,
        'https://r.test/' || l_orderkey AS source_ref
      FROM l WHERE l_quantity > 2 AND et IN ('EQ','TC','FL','DR','WF')""",
    "storm_feed": """
      SELECT strftime(o_orderdate, '%Y-%m-%d') AS run_date, o_orderkey AS doc,
        'nhc-' || CASE WHEN o_orderstatus = 'F' THEN 'al' || o_orderkey ELSE 'bin' || o_custkey END AS id,
        'Storm' || o_custkey || ' (' || CASE WHEN o_orderpriority = '5-LOW' THEN 'storm' ELSE substr(o_orderpriority, 3, 20) END || ')' AS what,
        CASE WHEN o_orderstatus <> 'P' THEN 'BIN' || o_custkey ELSE '' END AS "where",
        CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS severity, strftime(o_orderdate, '%Y-%m-%d') AS window_from
      FROM orders WHERE o_orderstatus <> 'P'""",
    "warning_feed": """
      WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, lower(translate(lpad(CAST(user_id % 100 AS VARCHAR), 3, '0'), '0123456789', 'ABCDEFGHIJ')) AS office,
          CASE event_type WHEN 'error' THEN 'CAN' WHEN 'view' THEN 'EXT' ELSE 'NEW' END AS action FROM events),
      c AS (
        SELECT *, 0 AS cpos, 'nws-k' || office || '-flw-' || lpad(CAST(user_id % 40 AS VARCHAR), 4, '0') || '-'
            || CASE WHEN action = 'EXT' THEN strftime(ts + INTERVAL 2 DAY, '%y') ELSE strftime(ts, '%y') END AS id FROM e WHERE action <> 'CAN'
        UNION ALL
        SELECT *, 1, 'nws-k' || office || '-flw-' || lpad(CAST(CAST(floor(value) AS INT) AS VARCHAR), 4, '0') || '-' || strftime(ts, '%y') FROM e),
      f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY day, id ORDER BY event_id, cpos) = 1)
      SELECT day AS run_date, id, event_type AS hazard,
        upper(left(event_type, 1)) || substr(event_type, 2) || CASE WHEN value > 50 THEN ' Warning' WHEN value > 20 THEN ' Watch' ELSE '' END AS what,
        'Area ' || user_id AS "where", CASE WHEN value > 60 THEN 'Extreme' ELSE 'Severe' END AS severity,
        CASE WHEN value > 10 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE day || 'T00:00:00' END AS window_from,
        day || 'T23:00:00' AS window_to, 'urn:' || event_id AS source_ref FROM f""",
    "answered_nights": """
      WITH e AS (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS INT) AS k FROM events)
      SELECT DISTINCT event_type || '-' || user_id AS source, strftime(ts, '%Y-%m-%d') AS run_date FROM e WHERE k % 4 <> 0 AND k % 3 <> 0""",
    "plan_scan": """
      SELECT s_suppkey AS plan_id, s_name AS name, array_to_string(list_sort(list_distinct(['N' || s_nationkey, 'N' || (s_suppkey % 25)])), ',') AS iso3,
        coalesce(nullif(CASE WHEN s_suppkey % 3 > 0 THEN CAST(floor(s_acctbal) AS BIGINT) * (s_suppkey % 2) END, 0),
                 nullif(CASE WHEN s_suppkey % 5 > 0 THEN CAST(floor(s_acctbal / 2) AS BIGINT) END, 0), 0) AS requirements_usd
      FROM supplier WHERE s_acctbal > 0""",
    "funding_scan": """
      SELECT o_custkey AS plan_id, CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice) AS BIGINT) + 1 ELSE 0 END AS funded_usd
      FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""",
    "crosswalk_scan": """
      SELECT 'C' || c_custkey AS iso3, CASE WHEN c_mktsegment = 'BUILDING' THEN 'R' ELSE 'F' END || c_nationkey AS fips,
        CASE WHEN c_mktsegment = 'BUILDING' THEN '2024-02-01' ELSE '2024-01-01' END AS valid_from FROM customer""",
    "export_scan": """
      WITH l AS (SELECT strftime(l_shipdate, '%Y') AS year, l_quantity < 3 OR l_tax > 0.07 AS bad, l_linenumber AS m,
          CASE WHEN l_tax < 0.01 THEN 0 ELSE CAST(floor(l_quantity) AS BIGINT) END AS a, l_discount > 0.01 AS located FROM lineitem)
      SELECT year, count(*) FILTER (NOT bad) AS "rows", count(*) FILTER (bad) AS malformed_rows, CAST(sum(a) FILTER (NOT bad) AS BIGINT) AS articles,
        CAST(sum(m) FILTER (NOT bad) AS BIGINT) AS mentions, count(*) FILTER (NOT bad AND NOT located) AS unlocated FROM l GROUP BY year""",
    "code_list_scan": """SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS name FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2')""",
    "catalogue_scan": cvp._PLACES + """
      SELECT night, name, CAST(vec_id AS VARCHAR) AS id, platform, "start", "end", vec_id AS bytes, label > 4 AS online,
        'blake3=b' || label || ',md5=m' || vec_id AS checksums, (SELECT count(*) FROM hit WHERE hit.vec_id = scene.vec_id) AS n_cells
      FROM scene WHERE label % 4 <> 3""",
    "position_scan": cvp._PLACES + """SELECT pc.night, count(*) AS in_feed, count(cell) AS in_region
      FROM pc JOIN place p ON p.vec_id = pc.vec_id WHERE p.label <> 9 GROUP BY pc.night""",
    "capture_scan": """SELECT event_id AS doc, strftime(ts, '%Y%m%d%H%M%S') AS "timestamp", 'https://u.test/' || user_id AS original,
      CASE WHEN event_type = 'error' THEN '-' ELSE '200' END AS statuscode, 'D' || CAST(floor(value) AS BIGINT) AS digest
      FROM events WHERE event_type NOT IN ('signup', 'view')""",
    "decoded_pages": "SELECT page_id, html FROM pages",
    "watchlist_scan": """SELECT s_name AS slug, 'u' || (s_suppkey % 40) AS url,
      'u' || (s_suppkey % 40) IN (SELECT 'u' || s_nationkey FROM supplier) AS excluded FROM supplier""",
    "manifest_scan": """
      SELECT strftime(o_orderdate, '%Y-%m-%d') AS run_date, unnest(['a/' || o_orderkey, 'b/' || o_orderkey]) AS file, CAST(200 AS BIGINT) AS http_status,
        sha256(CAST(o_orderkey AS VARCHAR)) AS sha256, CAST(length(CAST(o_orderkey AS VARCHAR)) AS BIGINT) AS bytes FROM orders""",
    "file_manifest": """SELECT CAST(s_nationkey AS BIGINT) AS s_nationkey, CAST(sum(length(s_name) + 1) AS BIGINT) AS bytes,
      sha256(string_agg(s_name || chr(10), '' ORDER BY s_suppkey)) AS sha256 FROM supplier GROUP BY s_nationkey""",
    "fetch_manifest": """WITH f AS (SELECT CAST(c_nationkey AS BIGINT) AS nation, CAST(sum(length(c_name) + 1) AS BIGINT) AS bytes,
        sha256(string_agg(c_name || chr(10), '' ORDER BY c_custkey)) AS sha256 FROM customer GROUP BY c_nationkey)
      SELECT nation, CASE WHEN nation % 5 > 0 THEN 'https://feeds.test/' || nation END AS url,
        CASE WHEN nation % 5 > 0 THEN strftime(DATE '2024-01-01' + CAST(nation AS INT), '%Y-%m-%d') || 'T03:00:00Z' END AS retrieved_at,
        CAST(CASE WHEN nation % 5 > 0 THEN CASE WHEN nation % 7 = 0 THEN 304 ELSE 200 END END AS BIGINT) AS http_status, sha256, bytes FROM f""",
    "manifest_nights": """SELECT strftime(o_orderdate, '%Y-%m') AS folder, strftime(o_orderdate, '%Y-%m') AS run_date, CAST(o_orderkey AS VARCHAR) AS file,
        'https://feeds.test/' || o_orderkey AS url, CAST(200 AS BIGINT) AS http_status, sha256(CAST(o_orderkey AS VARCHAR)) AS sha256,
        CAST(o_custkey AS BIGINT) AS bytes FROM orders""",
    "preserved_once": """SELECT CAST(o_orderkey AS VARCHAR) AS file, sha256(o_orderstatus) AS sha256 FROM orders WHERE o_totalprice <= 200000""",
    "log_scan": """SELECT strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY event_id) AS line_no, value < 2 AS unparseable,
      CASE WHEN value >= 2 THEN event_type END AS step, CASE WHEN value >= 2 THEN strftime(ts, '%Y-%m-%d') END AS run_date FROM events""",
    "append_once": """
      WITH v AS (SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN value >= 2 THEN 'F' || (user_id % 25) ELSE '' END AS country,
        CAST(floor(value) AS BIGINT) AS a FROM events)
      SELECT day, count(DISTINCT country) + 1 AS n, CAST(sum(a) * 2 AS BIGINT) AS articles, CAST(1 AS BIGINT) AS refused FROM v GROUP BY day""",
    "append_new": """SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus ELSE 'late' END AS verdict FROM orders""",
}
_COMMON = 'SELECT run_date, id, what, "where", severity, window_from FROM'
ORACLES["all_feeds"] = " UNION ALL ".join(f"{_COMMON} ({ORACLES[name]})" for name in ("alert_feed", "storm_feed", "warning_feed"))

"""Reports over registers and readings: figures, splits, moments, listings, intake."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordlens import vocab as v
from recordlens.functions import clock
from recordlens.functions.rates import rounded, share
from recordlens.operators import register as reg

# --- moments ----------------------------------------------------------------------

# fixed values: how an event is told
MODES = {
    "REVISED": "revision",
    "CORRECTED": "correction",
    "CLOSED_BY_SOURCE": "closure",
    "DISSIPATED": "dissipation",
    "REAPPEARED": "reappearance",
    "NOTARIZED": "notarization",
}


def _lookup(mapping: dict[str, str], col: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, value in mapping.items():
        out = F.when(col == k, value).otherwise(out)
    return out


def moments(events: DataFrame, current: DataFrame, verdicts: DataFrame, *, first_night: str, key: str = "id", night: str = "run_date") -> DataFrame:
    """(id, occurred_at, mode, span, evidence, subject): what happened under watch.

    First sights of the founding night and of records whose window had already passed are
    baseline. ``current`` carries ``first_to``; ``verdicts`` carries ``resolved_at``.
    A revision tells its distance from first sight.
    """
    about = current.select(
        key, "what", "announced_at", "status", "first_to", F.col("window")["to"].alias("window_to")
    )
    rows = events.select(key, F.col(night).alias("occurred_at"), "event", "snapshot").join(about, key)
    past = reg.overdue_kind(
        F.col("status"), F.col("window_to"), F.col("first_to"), F.col("announced_at"), F.col("occurred_at"), "text"
    ).isNotNull()
    founding = clock.day_of(F.col("occurred_at")) <= first_night
    rows = rows.filter(F.col("event").isin(*MODES) & ~((F.col("event") == "NOTARIZED") & (founding | past)))
    span = F.when(F.col("event") == "REVISED", clock.span_words(F.col("announced_at"), F.col("occurred_at")))
    told = rows.select(
        key, "occurred_at", _lookup(MODES, F.col("event")).alias("mode"), span.alias("span"),
        F.coalesce("snapshot", F.lit("register")).alias("evidence"), F.coalesce("what", key).alias("subject"),
    )
    settled = verdicts.filter(F.col("verdict").isin(*v.VERDICTS)).join(about.select(key, "what"), key)
    resolved = settled.select(
        key, F.col("resolved_at").alias("occurred_at"), F.lit("resolution").alias("mode"),
        F.lit(None).cast("string").alias("span"), F.concat(F.lit("verdicts/"), F.col(key)).alias("evidence"),
        F.coalesce("what", key).alias("subject"),
    )
    return told.unionByName(resolved)


def newest(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The newest ``n`` rows by ``order``, all descending: a top-k kept per task."""
    return rows.orderBy(*[F.col(c).desc() for c in order]).limit(n)


# --- figures ----------------------------------------------------------------------


def _nights_on_record(nights: DataFrame) -> DataFrame:
    name = F.lit("nights_on_record")
    if "register" in nights.columns:
        name = F.when(F.col("register").isNull(), name).otherwise(F.concat("register", F.lit("_"), name))
    rows = nights.select(name.alias("key"), "night").distinct()
    return rows.groupBy("key").agg(F.count("night").alias("value"))


def register_figures(current: DataFrame, verdicts: DataFrame, nights: DataFrame, probes: DataFrame, *, as_of: str) -> DataFrame:
    """(key, value, as_of): dated counts of the register as one long table.

    ``current`` has the public ``state`` of open records; ``probes``: answered, catches.
    ``nights`` has the register's nights, and with a column ``register`` those of others,
    counted as ``{register}_nights_on_record``.
    """
    is_open = F.col("status") == v.OPEN
    source = F.lower(F.coalesce("source", F.lit("unknown")))

    def long(df, names):
        pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("bigint").alias("value")) for n in names])
        return df.select(F.inline(pairs))

    base = {
        "futures_under_watch": F.count_if(is_open),
        "futures_window_open": F.count_if(F.col("state") == "window_open"),
        "futures_cold_start": F.count_if(F.col("state") == "cold_start"),
        "futures_drift": F.count_if(F.col("state") == "drift"),
        "futures_notarized_total": F.count(F.lit(1)),
        "sources_in_register": F.countDistinct(source),
    }
    done = {
        "futures_resolved": F.count(F.lit(1)),
        "futures_resolved_under_watch": F.count_if(~F.col("cold_start")),
        "materialized": F.count_if(F.col("verdict") == "MATERIALIZED_AS_ALERT"),
    }
    looked = {
        "continuity_rechecks": F.coalesce(F.sum("answered"), F.lit(0)),
        "continuity_divergences": F.coalesce(F.sum("catches"), F.lit(0)),
    }
    parts = [
        long(current.agg(*[c.alias(n) for n, c in base.items()]), base),
        long(verdicts.agg(*[c.alias(n) for n, c in done.items()]), done),
        _nights_on_record(nights),
        long(probes.agg(*[c.alias(n) for n, c in looked.items()]), looked),
        current.groupBy(F.concat(F.lit("futures_notarized_"), source).alias("key")).agg(F.count(F.lit(1)).alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("as_of", F.lit(as_of))


def composition(current: DataFrame) -> DataFrame:
    """Counts by source and by hazard in one grouping-sets pass."""
    src = current.select(
        F.lower(F.coalesce("source", F.lit("unknown"))).alias("source"), F.col("hazard").alias("hazard")
    )
    src = src.groupBy("source", "hazard").agg(F.count(F.lit(1)).alias("_n"))
    out = src.groupingSets([[F.col("source")], [F.col("hazard")]], F.col("source"), F.col("hazard")).agg(
        F.sum("_n").alias("n"), F.grouping("source").alias("_g")
    )
    by_hazard = F.col("_g") == 1
    return out.select(
        F.when(by_hazard, "hazard").otherwise("source").alias("dimension"),
        F.when(by_hazard, F.col("hazard")).otherwise(F.col("source")).alias("name"), "n",
    )


def severity_splits(current: DataFrame) -> DataFrame:
    """Per hazard: records, share at the top level, share with an instantaneous window."""
    top = F.col("severity").isin(*v.TOP_OF_LADDER)
    instant = F.col("window")["from"].eqNullSafe(F.col("window")["to"])
    counted = current.groupBy("hazard").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(top).alias("top"), F.count_if(instant).alias("instant")
    )
    return counted.withColumn("top_rate", share(F.col("top"), F.col("n"), 4)).withColumn(
        "instant_rate", share(F.col("instant"), F.col("n"), 4)
    )


def severity_cube(current: DataFrame) -> DataFrame:
    """Counts over hazard and severity with all totals."""
    per = current.groupBy("hazard", "severity").agg(F.count(F.lit(1)).alias("_n"))
    return per.cube("hazard", "severity").agg(F.sum("_n").alias("n"))


def state_runs(nights: DataFrame, *, key: str, night: str, state: str) -> DataFrame:
    """Runs of the same state on consecutive recorded nights: (key, state, first, last, nights).

    A running count of changes numbers the runs of each key; a key has one row per night.
    """
    w = Window.partitionBy(key).orderBy(night)
    change = (~F.col(state).eqNullSafe(F.lag(state).over(w)) | F.lag(night).over(w).isNull()).cast("int")
    runs = nights.withColumn("_change", change).withColumn("_run", F.sum("_change").over(w))
    return runs.groupBy(key, "_run", state).agg(
        F.min(night).alias("first_night"), F.max(night).alias("last_night"), F.count(F.lit(1)).alias("nights")
    ).drop("_run")


def idle_sensor(verdicts: DataFrame, *, needed: int) -> DataFrame:
    """Verdict counts; fires when none of the last kind came among ``needed`` or more verdicts."""
    counted = verdicts.agg(
        F.count(F.lit(1)).alias("verdicts"),
        F.count_if(F.col("verdict") == "MATERIALIZED_AS_ALERT").alias("materialized"),
    )
    return counted.withColumn("fired", (F.col("verdicts") >= needed) & (F.col("materialized") == 0))


def plan_gap(reading: DataFrame) -> DataFrame:
    """Distinct countries of records with and without a plan match."""
    rows = reading.select("has_plan_match", F.explode("iso3").alias("code"))
    return rows.groupBy("has_plan_match").agg(F.countDistinct("code").alias("countries"))


def night_table(events: DataFrame, verdicts: DataFrame, rates: DataFrame | None = None, *, night: str = "run_date") -> DataFrame:
    """Per night: first sights, revisions, closures and verdicts; ``rates`` (night, match_rate) beside them.

    A night without a reading has no match rate.
    """
    counted = events.groupBy(night).pivot(
        "event", ["NOTARIZED", "REVISED", "REAPPEARED", "CLOSED_BY_SOURCE", "DISSIPATED"]
    ).count()
    resolved = verdicts.groupBy(F.col("resolved_at").alias(night)).agg(F.count(F.lit(1)).alias("resolved"))
    rows = counted.join(resolved, night, "full").na.fill(0)
    if rates is not None:
        rows = rows.join(rates.select(night, "match_rate"), night, "left")
    return rows.select(
        night,
        F.col("NOTARIZED").alias("notarized"),
        F.col("REVISED").alias("revised"),
        (F.col("CLOSED_BY_SOURCE") + F.col("DISSIPATED")).alias("closed"),
        F.col("REAPPEARED").alias("reopened"),
        "resolved",
        *(["match_rate"] if rates is not None else []),
    )


def hazard_listing(current: DataFrame) -> DataFrame:
    """Open records with the size of their hazard group; listed by size, then name."""
    rows = current.filter(F.col("status") == v.OPEN)
    sizes = rows.groupBy("hazard").agg(F.count(F.lit(1)).alias("group_size"))
    return rows.join(sizes, "hazard")


def display_rank(window_to: Column, run_date: str) -> Column:
    """0 for windows still open, 1 for passed ones, 2 without a window end."""
    return (
        F.when(F.coalesce(window_to, F.lit("")) == "", 2)
        .when(clock.day_of(window_to) >= run_date, 0)
        .otherwise(1)
    )


def featured(current: DataFrame, run_date: str, n: int = 7, *, key: str = "id") -> DataFrame:
    """The open records shown first: soonest open window leads."""
    to = F.col("window")["to"]
    rows = current.filter((F.col("status") == v.OPEN) & (F.col("state") == "window_open"))
    rows = rows.withColumn("rank", display_rank(to, run_date)).withColumn("window_to", to)
    return rows.orderBy("rank", F.coalesce("window_to", F.lit("")), key).limit(n)


def acceptance(events: DataFrame, entries: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: nights with an event, events on controls, and agreement of answers with rules.

    ``events``: night, page, type, category, before_sha256; ``entries``: class, category;
    ``answers``: before_sha256, type.
    """
    counted = events.agg(
        F.countDistinct("night").alias("nights_with_events"),
        F.count_if(F.col("category") == "E").alias("events_on_controls"),
    )
    per_digest = events.groupBy("before_sha256").agg(F.collect_set("type").alias("types"))
    both = answers.filter("type IS NOT NULL").join(per_digest, "before_sha256").agg(
        F.count(F.lit(1)).alias("answered_and_typed"),
        F.count_if(F.array_contains("types", F.col("type"))).alias("agreeing"),
    )
    unver = entries.agg(
        share(F.count_if(F.col("class") == "unverifiable"), F.count(F.lit(1)), 4).alias("unverifiable_share")
    )
    return counted.select(
        "nights_with_events", "events_on_controls",
        both.select("answered_and_typed").scalar().alias("answered_and_typed"),
        both.select("agreeing").scalar().alias("agreeing"),
        unver.scalar().alias("unverifiable_share"),
    )


def unverifiable_by_category(entries: DataFrame) -> DataFrame:
    """(category, entries, unverifiable, unverifiable_share)."""
    lost = F.count_if(F.col("class") == "unverifiable")
    return entries.groupBy("category").agg(
        F.count(F.lit(1)).alias("entries"), lost.alias("unverifiable"), share(lost, F.count(F.lit(1)), 4).alias("unverifiable_share")
    )


# --- answers ------------------------------------------------------------------------


def read_answers(answers: DataFrame, *, text: str = "answer") -> DataFrame:
    """Add type, confidence, reason, error and estimated to a table of raw answers.

    Text that is no JSON object is 'unparsed', a type outside the closed list is
    'out_of_vocabulary'; neither is repaired. Every answer is marked estimated.
    """
    parsed = F.from_json(F.trim(F.col(text)), "type string, confidence string, reason string, _bad string",
                         {"columnNameOfCorruptRecord": "_bad"})
    rows = answers.withColumn("_p", parsed)
    bad = F.col("_p").isNull() | F.col("_p._bad").isNotNull() | ~F.coalesce(F.startswith(F.trim(F.col(text)), F.lit("{")), F.lit(False))
    known = F.coalesce(F.col("_p.type").isin(*v.ANSWER_TYPES), F.lit(False)) & ~bad
    return rows.select(
        *answers.columns,
        F.when(known, F.col("_p.type")).alias("type"),
        F.when(known, F.col("_p.confidence")).alias("confidence"),
        F.when(known, F.coalesce("_p.reason", F.lit(""))).alias("reason"),
        F.when(bad, "unparsed").when(~known, "out_of_vocabulary").alias("error"),
        F.lit(True).alias("estimated"),
    )


def token_costs(usage: DataFrame, *, price_in: float, price_out: float, discount: float, by: list[str] | None = None) -> DataFrame:
    """Tokens in and out and their price per million, discounted."""
    summed = usage.groupBy(*(by or [])).agg(
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
    )
    raw = F.col("input_tokens") / 1_000_000 * price_in + F.col("output_tokens") / 1_000_000 * price_out
    return summed.withColumn("cost_usd", rounded(raw * discount, 6))


# --- watchlist ------------------------------------------------------------------------


def watchlist_problems(institutions: DataFrame, controls: DataFrame, excluded: DataFrame, version: str | None) -> DataFrame:
    """(subject, problem): every structural rule a watchlist breaks.

    ``institutions``: slug, category, strategy, query, urls, probe(at, http_status);
    ``controls``: url, category, probe; ``excluded``: url. Row rules run in the row, the
    others are one aggregate or one semi join each.
    """
    c = F.col

    def row_rules(df, subject, rules):
        found = F.array_compact(F.array(*[F.when(cond, F.lit(msg)) for msg, cond in rules]))
        return df.select(c(subject).cast("string").alias("subject"), F.explode(found).alias("problem"))

    def false_if_null(cond):
        return F.coalesce(cond, F.lit(False))

    single = false_if_null(c("strategy") == "single_url")
    no_urls = F.coalesce(F.size("urls"), F.lit(0)) <= 0
    unprobed = F.coalesce(c("probe")["at"], F.lit("")) == ""
    institution_rules = [
        ("category is not one of A-D", ~false_if_null(c("category").isin(*v.CATEGORIES[:4]))),
        ("unknown strategy", ~false_if_null(c("strategy").isin(*v.STRATEGIES))),
        ("single_url strategy without urls", single & no_urls),
        ("no query target", ~single & (F.coalesce("query", F.lit("")) == "")),
        ("no live probe recorded", unprobed),
        ("probe without a status", ~unprobed & c("probe")["http_status"].isNull()),
    ]
    control_rules = [
        ("control category must be E", ~false_if_null(c("category") == "E")),
        ("control without a live probe", c("probe").isNull() | c("probe")["http_status"].isNull()),
    ]
    parts = [
        row_rules(institutions, "slug", institution_rules),
        row_rules(controls, "url", control_rules),
        institutions.groupBy(c("slug").cast("string").alias("subject")).count().filter("count > 1")
        .select("subject", F.lit("duplicate slug").alias("problem")),
        controls.groupBy(c("url").alias("subject")).count().filter("count > 1")
        .select("subject", F.lit("duplicate control").alias("problem")),
        institutions.select(c("slug").cast("string").alias("subject"), F.explode("urls").alias("url"))
        .join(excluded, "url", "left_semi").select("subject", F.lit("url is excluded").alias("problem")),
        controls.select("url").join(excluded, "url", "left_semi")
        .select(c("url").alias("subject"), F.lit("control is excluded").alias("problem")),
        excluded.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
        .select(F.lit("watchlist").alias("subject"), F.lit("no exclusions named").alias("problem")),
        institutions.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
        .select(F.lit("watchlist").alias("subject"), F.lit("no institutions").alias("problem")),
        controls.agg(F.count(F.lit(1)).alias("n")).filter(c("n") < v.MIN_CONTROLS)
        .select(F.lit("watchlist").alias("subject"), F.lit("too few control pages").alias("problem")),
    ]
    if not version:
        missing = excluded.agg(F.lit("watchlist").alias("subject"), F.lit("missing version").alias("problem"))
        parts.append(missing)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

"""Money and attention beside each open record: overlap joins, crosswalks, baselines, sensors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordlens import vocab as v
from recordlens.functions.rates import median_of, share
from recordlens.operators.ordered import day_index
from recordlens.session import written


def _no_codes() -> Column:
    return F.array().cast("array<string>")


def code_set(codes: Column) -> Column:
    """Sorted distinct codes: the grouping key of records naming the same countries."""
    return F.array_sort(F.array_distinct(F.coalesce(codes, _no_codes())))


def plan_totals(
    records: DataFrame, plans: DataFrame, funding: DataFrame, *, key: str = "id", codes: str = "iso3"
) -> DataFrame:
    """Add plan match, sorted plan ids, and the plans' summed requirements and funding.

    A plan matches when it lists any of the record's countries. Records are reduced to
    their distinct country sets before the overlap join, so a country named by a third of
    all records is joined once per set, not once per record. ``plans``: plan_id, iso3,
    requirements_usd; ``funding``: plan_id, funded_usd (a plan without a row counts 0).
    """
    keyed = records.withColumn("_codes", code_set(F.col(codes)))
    sets = keyed.select("_codes").distinct()
    money = plans.join(funding, "plan_id", "left").select(
        "plan_id",
        F.coalesce("requirements_usd", F.lit(0)).alias("req"),
        F.coalesce("funded_usd", F.lit(0)).alias("fund"),
        F.explode(F.array_distinct("iso3")).alias("_code"),
    )
    pairs = (
        sets.select("_codes", F.explode("_codes").alias("_code"))
        .join(money, "_code")
        .select("_codes", "plan_id", "req", "fund")
        .distinct()
    )
    totals = pairs.groupBy("_codes").agg(
        F.array_sort(F.collect_list("plan_id")).alias("plans"),
        F.sum("req").alias("plan_requirements_usd"),
        F.sum("fund").alias("plan_funded_usd"),
    )
    # One row per distinct set, written: its size is known, and beyond a broadcast both sides
    # are dealt by the set, so that Spark can split one that a third of the records name.
    joined = keyed.join(written(totals, "plan-sets"), "_codes", "left").drop("_codes")
    return (
        joined.withColumn("has_plan_match", F.col("plans").isNotNull())
        .withColumn("plans", F.coalesce("plans", F.array().cast("array<bigint>")))
        .withColumn("plan_requirements_usd", F.coalesce("plan_requirements_usd", F.lit(0)))
        .withColumn("plan_funded_usd", F.coalesce("plan_funded_usd", F.lit(0)))
    )


def overlap_pairs(
    left: DataFrame, right: DataFrame, *, left_key: str, right_key: str, left_codes: str, right_codes: str
) -> DataFrame:
    """Distinct (left, right) pairs whose code arrays share an element.

    A left key's codes are united first, so its row meets each partner once and the pairs,
    many times the records, are never held to find equal ones.
    """
    listed = F.flatten(F.collect_list(F.coalesce(left_codes, _no_codes())))
    keyed = left.groupBy(left_key).agg(code_set(listed).alias("_codes"))
    sets = keyed.select("_codes").distinct().select("_codes", F.explode("_codes").alias("_code"))
    b = right.select(right_key, F.explode(F.array_distinct(right_codes)).alias("_code"))
    # Codes meet as distinct sets; a record then takes the partners of its set.
    partners = sets.join(b, "_code").groupBy("_codes").agg(F.collect_set(right_key).alias("_partners"))
    met = keyed.join(written(partners, "set-partners"), "_codes")
    return met.select(left_key, F.explode("_partners").alias(right_key))


def coverage(records: DataFrame) -> DataFrame:
    """One row: open alert episodes, those with a plan match, and the rate (0.0 if none)."""
    episode = F.col("kind") == "ALERT_EPISODE"
    counted = records.agg(
        F.count_if(episode).alias("open_alert_episodes"),
        F.count_if(episode & F.col("has_plan_match")).alias("with_plan_match"),
    )
    rate = share(F.col("with_plan_match"), F.col("open_alert_episodes"), 4)
    return counted.withColumn("match_rate", F.coalesce(rate, F.lit(0.0)))


def crosswalk_intervals(crosswalk: DataFrame) -> DataFrame:
    """(iso3, fips, valid_from, valid_to): each mapping with the day its successor starts."""
    w = Window.partitionBy("iso3").orderBy("valid_from")
    return crosswalk.withColumn("valid_to", F.lead("valid_from").over(w))


def asof_lookup(facts: DataFrame, crosswalk: DataFrame, *, on: str = "iso3", day: str = "day") -> DataFrame:
    """Add ``fips`` as it stood on the fact's day; null where nothing was mapped yet.

    The small side is turned into validity intervals first, so this is one equi-join with
    a range condition and no ranking of the facts.
    """
    d = crosswalk_intervals(crosswalk).withColumnRenamed("iso3", "_iso3")
    cond = (
        (F.col(on) == F.col("_iso3"))
        & (F.col("valid_from") <= F.col(day))
        & (F.col("valid_to").isNull() | (F.col(day) < F.col("valid_to")))
    )
    return facts.join(d, cond, "left").drop("_iso3", "valid_from", "valid_to")


def mapped_codes(records: DataFrame, crosswalk: DataFrame, *, codes: str = "iso3", day: str = "day") -> DataFrame:
    """Add ``fips`` (sorted distinct) and ``unmapped_iso3`` (in the order of ``codes``).

    Works on distinct (code set, day) pairs and joins the outcome back.
    """
    sets = records.select(F.col(codes).alias("_codes"), F.col(day).alias("_day")).distinct()
    facts = sets.select("_codes", "_day", F.posexplode("_codes").alias("_pos", "_code"))
    looked = asof_lookup(facts, crosswalk, on="_code", day="_day")
    miss = F.when(F.col("fips").isNull(), F.struct("_pos", "_code"))
    grouped = looked.groupBy("_codes", "_day").agg(
        F.array_sort(F.collect_set("fips")).alias("fips"),
        F.transform(F.array_sort(F.collect_list(miss)), lambda s: s["_code"]).alias("unmapped_iso3"),
    )
    out = records.join(
        written(grouped, "mapped-sets"), (F.col(codes) == F.col("_codes")) & (F.col(day) == F.col("_day")), "left"
    ).drop("_codes", "_day")
    return out.withColumn("fips", F.coalesce("fips", _no_codes())).withColumn(
        "unmapped_iso3", F.coalesce("unmapped_iso3", _no_codes())
    )


def daily_volume(rows: DataFrame, *, day: str = "day", country: str = "country") -> DataFrame:
    """Events, articles and mentions per day and country, and the totals of each day.

    scope: 'country', 'unlocated' (blank country) or 'world' (everything of the day). The
    rows are reduced per day and country first; the grouping sets expand only that.
    """
    code = F.trim(F.coalesce(F.col(country), F.lit("")))
    per = rows.groupBy(F.col(day).alias("_day"), code.alias("_code")).agg(
        F.count(F.lit(1)).alias("events"), F.sum("articles").alias("articles"), F.sum("mentions").alias("mentions")
    )
    out = per.groupingSets(
        [[F.col("_day"), F.col("_code")], [F.col("_day")]], F.col("_day"), F.col("_code")
    ).agg(
        *[F.sum(m).alias(m) for m in ("events", "articles", "mentions")], F.grouping("_code").alias("_all")
    )
    scope = F.when(F.col("_all") == 1, "world").when(F.col("_code") == "", "unlocated").otherwise("country")
    return out.select(
        F.col("_day").alias(day),
        scope.alias("scope"),
        F.when(scope == "country", F.col("_code")).alias(country),
        "events",
        "articles",
        "mentions",
    )


def set_volume(
    sets: DataFrame, volume: DataFrame, *, codes: str = "fips", day: str = "day", country: str = "country",
    value: str = "articles",
) -> DataFrame:
    """(codes, day, value) summed over each distinct code set; absent countries add nothing."""
    exploded = sets.select(codes).distinct().select(codes, F.explode(codes).alias(country))
    return (
        exploded.join(volume.select(country, day, value), country)
        .groupBy(codes, day)
        .agg(F.sum(value).alias(value))
    )


def trailing_baseline(
    daily: DataFrame,
    committed: DataFrame,
    *,
    key: str,
    day: str = "day",
    value: str = "articles",
    rows: int = v.BASELINE_DAYS,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Add the exact median over the last ``rows`` committed days before each day.

    Committed days are rows, not calendar days: ``committed`` (one column, ``day``) gives
    them a dense index, and the frame runs over that index. A committed day without a row
    of the key counts as 0; those zeros are filled in by number, so no key-by-day grid is
    built. ``wanted`` (key, day) adds days to report on which the key had no row.
    """
    idx = day_index(committed, day)
    facts = daily.select(key, day, value)
    if wanted is not None:
        facts = facts.unionByName(wanted.select(key, day, F.lit(0).cast(daily.schema[value].dataType).alias(value)))
    facts = facts.groupBy(key, day).agg(F.sum(value).alias(value)).join(idx, day)
    frame = Window.partitionBy(key).orderBy("day_idx").rangeBetween(-rows, -1)
    held = F.collect_list(F.col(value).cast("double")).over(frame)
    facts = facts.withColumn("_held", held)
    expected = F.least(F.col("day_idx"), F.lit(rows))
    zeros = F.array_repeat(F.lit(0.0), (expected - F.size("_held")).cast("int"))
    return facts.select(
        key,
        day,
        value,
        expected.alias("baseline_days"),
        median_of(F.concat("_held", zeros)).alias("baseline_median"),
    )


def attention_entries(
    records: DataFrame, volume: DataFrame, attention_day: str, *, key: str = "id", rows: int = v.BASELINE_DAYS
) -> DataFrame:
    """Articles, share per 10,000, baseline median and ratio for each record's countries.

    ``volume`` is the committed output of :func:`daily_volume`. Records without a mapped
    country get null, never 0. Each country carries its days of the frame as one array, so
    a country set joins one row per country, not one per country and day.
    """
    world = volume.filter((F.col("scope") == "world") & (F.col("day") <= attention_day))
    newest = Window.orderBy(F.col("day").desc())  # one row per committed day
    frame = world.select("day", (F.row_number().over(newest) - 1).alias("slot"), F.col("articles").alias("world"))
    frame = frame.filter(F.col("slot") <= rows)
    slots = F.sequence(F.lit(0), F.lit(rows))
    by_slot = F.map_from_entries(F.collect_list(F.struct("slot", "articles")))
    per_country = (
        volume.filter("scope = 'country'")
        .join(frame.select("day", "slot"), "day")
        .groupBy("country")
        .agg(by_slot.alias("_m"))
        .select("country", F.transform(slots, lambda i: F.coalesce(F.col("_m")[i], F.lit(0))).alias("days"))
    )
    sets = records.select("fips").filter(F.size("fips") > 0).distinct()
    summed = (
        sets.select("fips", F.explode("fips").alias("country"))
        .join(per_country, "country", "left")
        .groupBy("fips")
        .agg(F.collect_list("days").alias("_l"))  # one array per country of the set
        .select(
            "fips",
            F.transform(slots, lambda i: F.aggregate("_l", F.lit(0).cast("bigint"), lambda acc, d: acc + d[i])).alias("_d"),
        )
    )
    known = frame.agg(F.count_if(F.col("slot") > 0)).scalar()
    total = frame.agg(F.max(F.when(F.col("day") == attention_day, F.col("world")))).scalar()
    entry = summed.select(
        "fips", F.col("_d")[0].alias("articles"), F.slice("_d", F.lit(2), known.cast("int")).alias("_w"), total.alias("_world")
    )
    entry = entry.filter("_world IS NOT NULL").select(
        "fips", "articles", "_world", median_of(F.col("_w")).alias("baseline_median")
    )
    entry = entry.select(
        "fips", "articles", share(F.col("articles") * 10_000, F.col("_world"), 1).alias("share_per_10k"),
        "baseline_median", share(F.col("articles"), F.col("baseline_median"), 2).alias("ratio_to_baseline"),
    )
    return records.join(written(entry, "attention-sets"), "fips", "left")


def nightly_reading(
    current: DataFrame,
    plans: DataFrame,
    funding: DataFrame,
    crosswalk: DataFrame,
    volume: DataFrame,
    *,
    run_date: str,
    attention_day: str,
    key: str = "id",
) -> DataFrame:
    """The night's reading: one row per open record with money and attention."""
    open_rows = current.filter(F.col("status") == v.OPEN).select(
        key, "kind", code_set(F.col("iso3")).alias("iso3"), F.lit(run_date).alias("run_date")
    )
    money = plan_totals(open_rows, plans, funding, key=key)
    mapped = mapped_codes(money, crosswalk, day="run_date")
    return attention_entries(mapped, volume, attention_day, key=key)


def percent_words(rate: Column) -> Column:
    return F.format_string("%.0f%%", F.bround(rate * 100, 0))


def match_rate_sensor(readings: DataFrame, *, register: str = "register", day: str = "run_date") -> DataFrame:
    """Deferred before three nights; fires below 25 %, above 50 %, or on a jump over 10 points.

    ``readings``: one row per register and night with ``match_rate``.
    """
    w = Window.partitionBy(register).orderBy(day)
    rows = readings.withColumn("nights_recorded", F.row_number().over(w)).withColumn(
        "_prior", F.lag("match_rate").over(w)
    )
    rate, jump = F.col("match_rate"), F.abs(F.col("match_rate") - F.col("_prior"))
    low, high = F.lit(v.RATE_LOW), F.lit(v.RATE_HIGH)
    reasons = F.array_compact(
        F.array(
            F.when(rate < low, F.concat(F.lit("match rate "), percent_words(rate), F.lit(" below "), percent_words(low))),
            F.when(rate > high, F.concat(F.lit("match rate "), percent_words(rate), F.lit(" above "), percent_words(high))),
            F.when(
                jump > v.RATE_JUMP,
                F.concat(F.lit("match rate moved "), percent_words(jump), F.lit(" from the previous reading")),
            ),
        )
    )
    armed = F.col("nights_recorded") >= v.RATE_NIGHTS_REQUIRED
    return rows.withColumn("_reasons", reasons).select(
        register,
        day,
        "match_rate",
        "nights_recorded",
        F.when(armed, "ARMED").otherwise("DEFERRED").alias("firing"),
        (armed & (F.size("_reasons") > 0)).alias("fired"),
        F.when(armed, F.array_join("_reasons", "; ")).alias("why"),
    )


def latency_sensor(readings: DataFrame, *, register: str = "register", day: str = "run_date") -> DataFrame:
    """Fires when five readings in a row show the same gap to the newest day, each with a
    'not published yet' failure for the day before its run.

    ``readings``: register, run_date, gap_days (null if no day was committed),
    newest_day_failed (boolean).
    """
    n = v.LATENCY_NIGHTS_REQUIRED
    w = Window.partitionBy(register).orderBy(day)
    tail = w.rowsBetween(-(n - 1), 0)
    rows = readings.withColumn("nights_recorded", F.row_number().over(w))
    armed = F.col("nights_recorded") >= n
    same = (F.count("gap_days").over(tail) == n) & (F.min("gap_days").over(tail) == F.max("gap_days").over(tail))
    failed = F.min("newest_day_failed").over(tail)
    fired = F.coalesce(armed & same & failed, F.lit(False))
    return rows.withColumn("fired", fired).select(
        register,
        day,
        "nights_recorded",
        F.when(armed, "ARMED").otherwise("DEFERRED").alias("firing"),
        "fired",
        F.when(F.col("fired"), F.col("gap_days")).alias("gap_days"),
    )


def reaction_series(readings: DataFrame, *, key: str = "id", day: str = "run_date") -> DataFrame:
    """Per record: nights watched, loudest night, and the funding moved in between.

    Reduced by aggregates only, so a record watched for many nights is combined map-side.
    Records that never appeared in a reading have no row.
    """
    rated = F.when(F.col("ratio_to_baseline").isNotNull(), F.struct("ratio_to_baseline", day, "articles"))
    funded = F.col("has_plan_match") & F.col("plan_funded_usd").isNotNull()
    at = F.when(funded, F.col(day))
    out = readings.groupBy(key).agg(
        F.count(F.lit(1)).alias("nights_watched"),
        F.max(rated).alias("_peak"),
        F.min_by("plan_funded_usd", at).alias("money_funded_first_usd"),
        F.max_by("plan_funded_usd", at).alias("money_funded_last_usd"),
        F.max_by("plan_requirements_usd", at).alias("money_requirements_last_usd"),
        F.coalesce(F.max(funded), F.lit(False)).alias("money_plan_match"),
    )
    return out.select(
        key,
        "nights_watched",
        F.col(f"_peak.{day}").alias("peak_date"),
        F.col("_peak.articles").alias("peak_articles"),
        F.col("_peak.ratio_to_baseline").alias("peak_ratio"),
        "money_funded_first_usd",
        "money_funded_last_usd",
        (F.col("money_funded_last_usd") - F.col("money_funded_first_usd")).alias("money_funded_delta_usd"),
        "money_requirements_last_usd",
        "money_plan_match",
    )


def missing_days(
    committed: DataFrame, run_date: str, *, register: str = "register", day: str = "day", backfill: int = 0,
    cap: int | None = None,
) -> DataFrame:
    """(register, day): days still owed before ``run_date``.

    The look-back reaches to the newest committed day (at most ``cap`` days, where a caller
    sets one), and never less than ``backfill``.
    """
    run = F.to_date(F.lit(run_date))
    newest = committed.groupBy(register).agg(F.max(F.to_date(day)).alias("_newest"))
    gap = F.datediff(run, F.col("_newest")) - 1
    reach = F.greatest(F.lit(backfill), gap if cap is None else F.least(gap, F.lit(cap)))
    owed = newest.filter(reach > 0).select(
        register, F.explode(F.sequence(F.date_sub(run, reach), F.date_sub(run, F.lit(1)))).alias("_d")
    )
    owed = owed.select(register, F.date_format("_d", "yyyy-MM-dd").alias(day))
    return owed.join(committed.select(register, day).distinct(), [register, day], "left_anti")

"""Capture histories, deterministic samples, live looks and the rates over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlens import vocab as v
from recordlens.functions import text
from recordlens.functions.rates import rounded, share, wilson
from recordlens.operators.ordered import first_per_key, previous_row


def is_ok(status: Column) -> Column:
    return F.coalesce(status == "200", F.lit(False))


def is_deletion_candidate(status: Column) -> Column:
    return F.coalesce(F.startswith(status, F.lit("4")), F.lit(False))


def collapse_digests(captures: DataFrame, *, page: str = "page") -> DataFrame:
    """Drop captures whose digest equals the one before on the same page.

    Histories are cut by day, so a page captured very often is spread over its days.
    """
    rows = captures.withColumn("_day", F.substring("timestamp", 1, 8))
    rows = previous_row(rows, [page], ["_day"], ["timestamp", "pos"], ["digest"])
    kept = rows.filter(F.col("prev").isNull() | ~F.col("digest").eqNullSafe(F.col("prev.digest")))
    return kept.drop("prev", "_day")


def within_day(captures: DataFrame, day: str) -> DataFrame:
    """Captures up to the end of the completed day; later ones never decide it."""
    return captures.filter(F.col("timestamp") <= day.replace("-", "") + "235959")


def history_class(captures: DataFrame, day: str, *, page: str = "page", pages: DataFrame | None = None) -> DataFrame:
    """What the history says about each page on ``day``.

    changed_candidate with the newest earlier 200 as before; deletion_candidate for a 4xx
    (a candidate only); unchanged without a capture on the day; else unverifiable.
    At most two rows per page and status group leave a task before the shuffle.
    """
    row = F.struct("timestamp", "pos", "statuscode", "digest", "original")
    rows = within_day(captures, day).withColumn("_ok", is_ok(F.col("statuscode")))
    rows = first_per_key(rows, [page, "_ok"], [F.col("timestamp").desc(), F.col("pos").desc()], n=2)
    out = rows.groupBy(page).agg(
        F.max(row).alias("after"),
        F.sort_array(F.collect_list(F.when(F.col("_ok"), row)), asc=False).alias("_oks"),
    )
    if pages is not None:
        out = pages.select(page).distinct().join(out, page, "left")
    after = F.col("after")
    oks = F.coalesce(F.col("_oks"), F.array().cast(out.schema["_oks"].dataType))
    newest_ok = is_ok(after["statuscode"])
    earlier = F.when(newest_ok, F.get(oks, F.lit(1))).otherwise(F.get(oks, F.lit(0)))
    on_day = F.startswith(after["timestamp"], F.lit(day.replace("-", "")))
    candidate = is_deletion_candidate(after["statuscode"])
    archive = F.concat(F.lit("archive_status_"), F.coalesce(after["statuscode"], F.lit("")))
    kind = (
        F.when(after.isNull(), "unverifiable")
        .when(~on_day, "unchanged")
        .when(newest_ok & earlier.isNotNull(), "changed_candidate")
        .when(newest_ok, "unverifiable")
        .when(candidate, "deletion_candidate")
        .otherwise("unverifiable")
    )
    reason = (
        F.when(after.isNull(), "no_capture_in_archive")
        .when(~on_day, "no_new_digest_on_day")
        .when(newest_ok & earlier.isNotNull(), "new_digest")
        .when(newest_ok, "no_earlier_capture")
        .otherwise(archive)
    )
    with_before = on_day & (newest_ok | candidate)
    return out.select(
        page, kind.alias("kind"), reason.alias("reason"), F.when(with_before, earlier).alias("before"), "after"
    )


def hash_sample(
    urls: DataFrame, day: str, *, group: str, url: str = "url", n: int = v.SAMPLE_PER_INSTITUTION,
    excluded: DataFrame | None = None, controls: DataFrame | None = None,
) -> DataFrame:
    """The ``n`` urls of each group with the smallest hash of day and url.

    Exclusions are left out before the draw, control pages after it.
    """
    pool = urls.select(group, url).distinct()
    if excluded is not None:
        pool = pool.join(excluded.select(url), url, "left_anti")
    ranked = pool.withColumn("rank", text.sample_rank(F.lit(day), F.col(url)))
    drawn = first_per_key(ranked, [group], [F.col("rank"), F.col(url)], n=n)
    if controls is not None:
        drawn = drawn.join(controls.select(url), url, "left_anti")
    return drawn


def mark_over_cap(rows: DataFrame, *, night: str, order: list[str], cap: int | None = None) -> DataFrame:
    """Add ``over_cap``: whether a row comes after the first ``cap`` of its night; none does without a cap.

    Nothing is dropped. Only the first rows of each night are ranked (pruned per task);
    the position of the last one inside the cap then marks the rest.
    """
    if cap is None:
        return rows.withColumn("over_cap", F.lit(False))
    last = first_per_key(rows.select(night, *order), [night], [F.col(c) for c in order], n=cap)
    limits = last.groupBy(night).agg(F.max(F.struct(*order)).alias("_limit"))
    return rows.join(limits, night).withColumn("over_cap", F.struct(*order) > F.col("_limit")).drop("_limit")


def live_class(code: Column) -> Column:
    """Class of a live answer; no code at all means unreachable."""
    return (
        F.when(code.isNull(), "unreachable")
        .when((code >= 200) & (code < 300), "ok")
        .when(code == 404, "gone_404")
        .when(code == 410, "gone_410")
        .when(code == 451, "legal_451")
        .when(code.isin(401, 403, 429), "botwall")
        .when((code >= 500) & (code < 600), "server_error")
        .otherwise("other")
    )


def settle_candidates(entries: DataFrame, live: DataFrame, *, page: str = "page") -> DataFrame:
    """Turn deletion candidates into gone or unverifiable after the live look.

    ``live``: page, http_code. Only a live 404 or 410 makes a page gone.
    """
    joined = entries.join(live.select(page, "http_code"), page, "left")
    cls = live_class(F.col("http_code"))
    candidate = F.col("kind") == "deletion_candidate"
    gone = cls.isin(*v.LIVE_GONE)
    settled = (
        F.when(candidate & gone, "gone")
        .when(candidate, "unverifiable")
        .when(F.col("kind") == "changed_candidate", "changed")
        .otherwise(F.col("kind"))
    )
    reason = (
        F.when(candidate & gone, F.concat(F.lit("live "), F.col("http_code").cast("string")))
        .when(candidate, F.concat(F.lit("deletion_candidate_survived_recheck_"), cls))
        .otherwise(F.col("reason"))
    )
    return joined.select(
        page, "kind", settled.alias("class"), reason.alias("reason"),
        F.when(candidate, cls).alias("live_class"),
    )


def class_rates(entries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Class counts, changed rate over the decided, unverifiable rate over the examined."""
    c = F.col("class")
    counted = entries.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("examined"),
        *[F.count_if(c == k).alias(k) for k in ("unchanged", "changed", "unverifiable", "gone")],
    )
    counted = counted.withColumn("decided", F.col("unchanged") + F.col("changed"))
    out = counted
    for name, part, whole in (("changed", "changed", "decided"), ("unverifiable", "unverifiable", "examined")):
        interval = wilson(F.col(part), F.col(whole))
        some = F.col(whole) > 0
        out = out.withColumns(
            {
                f"{name}_rate": share(F.col(part), F.col(whole), 4),
                f"{name}_low": F.when(some, rounded(interval["low"], 4)),
                f"{name}_high": F.when(some, rounded(interval["high"], 4)),
            }
        )
    return out


def unverifiable_reasons(entries: DataFrame) -> DataFrame:
    return (
        entries.filter("class = 'unverifiable'").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    )


def gone_rate(looks: DataFrame, *, cls: str = "live_class", by: list[str] | None = None) -> DataFrame:
    """Gone over decided; walls, server errors and silence leave the denominator, counted."""
    c = F.col(cls)
    counted = looks.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("candidates"),
        *[F.count_if(c == k).alias(k) for k in v.LIVE_CLASSES],
    )
    gone = F.col("gone_404") + F.col("gone_410")
    out = counted.withColumn("gone", gone)
    out = out.withColumn("decided", F.col("ok") + F.col("gone") + F.col("legal_451") + F.col("other"))
    out = out.withColumn("excluded", F.col("botwall") + F.col("server_error") + F.col("unreachable"))
    ci = wilson(F.col("gone"), F.col("decided"))
    some = F.col("decided") > 0
    return out.withColumns(
        {
            "gone_rate": share(F.col("gone"), F.col("decided"), 4),
            "gone_low": F.when(some, rounded(ci["low"], 4)),
            "gone_high": F.when(some, rounded(ci["high"], 4)),
        }
    )

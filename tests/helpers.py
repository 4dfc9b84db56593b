"""Small fixtures shared by the tests."""

OBS = (
    "id string, run_date string, pos bigint, source string, kind string, hazard string, iso3 array<string>, "
    "source_ref string, severity string, window struct<from:string,to:string>, what string, where string, snapshot string"
)


def ob(fid, night, pos=0, *, source="S", kind="ALERT_EPISODE", hazard="flood", iso3=("AAA",), sev="Orange",
       frm="2026-08-01T00:00:00", to="2026-08-20T00:00:00", what="thing", where="here"):
    return (fid, night, pos, source, kind, hazard, list(iso3), "ref", sev, (frm, to), what, where, f"{source}/{night}.json")


def observations(spark, rows):
    return spark.createDataFrame(rows, OBS)


def answered(spark, rows):
    return spark.createDataFrame(rows, "source string, run_date string")


def as_list(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())

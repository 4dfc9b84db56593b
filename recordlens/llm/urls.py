"""Verdicts on URLs: rules first, then logistic regression on hashed character n-grams.

The model is trained on a small table of labelled URLs (url, verdict): the caller's, or
``labelled_urls``, plain words for unwanted and for ordinary hosts in the same few forms of
address. At most ``FIT_ROWS`` labelled rows, dealt by a hash of the URL, are fitted in
numpy; every URL is then scored in Arrow batches with the weights (of fixed size).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordlens.llm.base import MIX, as_bytes, mixed, table

#: The rules, as (host and path, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Labelled rows that are fitted, about; hashed features; lengths of n-grams.
FIT_ROWS, FEATURES, LENGTHS = 20_000, 1 << 17, (2, 3, 4, 5)


#: Words of unwanted hosts and of ordinary ones, for the table to learn from.
UNWANTED = (
    "casino poker bets betting gambling jackpot slots roulette lottery pills pharmacy viagra cialis steroids diet-pills "
    "adult porn xxx sex escort webcam-girls dating-hot spam spammer link-farm ads adserver ad-tracker tracking banner-ads "
    "clickbait popunder payday-loans cheap-loans fake-watches replica warez cracks keygen torrents malware phishing free-money"
).split()
ORDINARY = (
    "weather thought nation theatre library station motion mention season north south eastern western river mountain garden "
    "kitchen recipes school college institute science history museum gallery music concert forum journal review paper reader "
    "writer author books press daily herald tribune report travel hotel airport railway transit city council parliament "
    "justice health hospital clinic doctor nurse animal forest ocean island market store bakery factory engine motor bicycle "
    "software network systems server research energy solar water earth planet star telescope theory number algebra language "
    "grammar translation dictionary archive record notes letter address other within another together better letters"
).split()
ADDRESSES = ("https://www.{}.com/en/12", "http://{}.org/fr/index.html", "https://blog.{}.net/de/345", "https://m.{}.info/es/6/", "http://{}-online.com/en/78?page=2", "https://my-{}.net/", "https://the.{}.example/a/b.html")


def labelled_urls() -> list[tuple[str, str]]:
    """(url, verdict): every word in every form of address."""
    return [(form.format(w), verdict) for words, verdict in ((UNWANTED, "block"), (ORDINARY, "allow")) for w in words for form in ADDRESSES]


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end.

    A null URL and one without :// have an empty host and path.
    """
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matching_rule(rules: tuple = RULES) -> Column:
    """The longest rule (a struct of rule and verdict) that fits host and path, or null.

    A rule fits its own host and every subdomain, if the path starts with the rule's.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(slash + path))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def features(hosts: list[bytes], paths: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the distinct hashed n-grams of every host and path, marked at their ends."""
    rows, found = [], []
    with np.errstate(over="ignore"):
        for kind, texts in enumerate((hosts, paths)):
            joined = np.frombuffer(b"".join(b"\x02" + t + b"\x03" for t in texts), dtype=np.uint8).astype(np.uint64)
            ends = np.cumsum(np.array([len(t) + 2 for t in texts], dtype=np.int64))
            owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
            for n in LENGTHS:
                if len(joined) < n:
                    continue
                h = np.full(len(joined) - n + 1, n * 2 + kind, dtype=np.uint64)
                for i in range(n):
                    h = h * MIX[2] + joined[i : len(joined) - n + 1 + i] + np.uint64(1)
                whole = owner[: len(h)] == owner[n - 1 :]
                rows.append(owner[: len(h)][whole])
                found.append((mixed(h[whole]) % np.uint64(FEATURES)).astype(np.int64))
    both = np.unique(np.concatenate(rows) * FEATURES + np.concatenate(found)) if rows else np.empty(0, dtype=np.int64)
    return both // FEATURES, both % FEATURES


def trained(hosts: list[bytes], paths: list[bytes], blocked: np.ndarray, rounds: int = 60, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the regression, by full-batch gradient steps scaled per feature."""
    w, bias = np.zeros(FEATURES), 0.0
    row, feature = features(hosts, paths)
    n = len(blocked)
    if not n:
        return w, bias
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))  # rows of unit length
    value = scale[row]
    seen, seen_bias = np.full(FEATURES, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(row, w[feature] * value, minlength=n) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - blocked
        g = np.bincount(feature, error[row] * value, minlength=FEATURES) / n + decay * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
        gb = float(error.mean())
        seen_bias += gb * gb
        bias -= rate * gb / seen_bias**0.5
    return w, bias


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, float]:
    """The regression from rows of (url, verdict); other verdicts than block and allow are left out."""
    host, path = host_and_path()
    labelled = labelled.withColumns({"host": host, "path": path}).filter(F.col("verdict").isin("block", "allow"))
    labelled = labelled.select("host", "path", (F.col("verdict") == "block").cast("double").alias("blocked"))
    n = labelled.count()
    share = min(1.0, fit_rows / max(n, 1))
    chosen = labelled.filter(F.pmod(F.xxhash64("host", "path"), F.lit(1 << 20)) < share * (1 << 20))
    rows = chosen.groupBy("host", "path", "blocked").count().orderBy("host", "path", "blocked").limit(fit_rows).toPandas()
    return trained([x.encode() for x in rows["host"]], [x.encode() for x in rows["path"]], rows["blocked"].to_numpy(dtype=np.float64))


def judged(pages: DataFrame, model: tuple[np.ndarray, float], rules: tuple = RULES) -> DataFrame:
    """pages with host, path, rule, verdict and score (the model's probability of a block).

    The rule's verdict stands where a rule fits; otherwise a score over one half blocks.
    Columns of these names are replaced, others stay; every row is judged by itself.
    """
    host, path = host_and_path()
    split = pages.drop("rule", "verdict", "score").withColumns({"host": host, "path": path}).withColumn("_rule", matching_rule(rules))
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                row, feature = features(as_bytes(part.column("host")), as_bytes(part.column("path")))
                n = np.maximum(np.bincount(row, minlength=part.num_rows), 1)
                z = np.bincount(row, w[feature], minlength=part.num_rows) / np.sqrt(n) + bias
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=[*part.schema.names, "score"])

    scored = split.mapInArrow(score, T.StructType([*split.schema.fields]).add("score", T.DoubleType()))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return scored.select(*(c for c in split.columns if c != "_rule"), F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labelled = spark.createDataFrame(labelled_urls(), "url string, verdict string")
    return judged(pages, fit(labelled)).select("page_id", "host", "path", "rule", "verdict", "score")

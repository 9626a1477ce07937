"""Request logs: admission, client keys, header lists and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageloom.functions.text import utrim

# The served paths and the body limit.
PATHS = ("text-to-speech", "speech-to-text", "v1/chat/completions")
MAX_BODY = 12_000_000
FORWARDED = ("content-type",)
PASSED_THROUGH = ("content-type", "content-length")


def client_ip(headers: Column) -> Column:
    direct = F.nullif(utrim(headers["cf-connecting-ip"]), F.lit(""))
    via = F.nullif(utrim(F.substring_index(headers["x-forwarded-for"], ",", 1)), F.lit(""))
    return F.coalesce(direct, via, F.lit("unknown"))


def allowed_headers(headers: Column, names=PASSED_THROUGH) -> Column:
    """Only the named, non-empty headers."""
    return F.map_filter(headers, lambda k, v: k.isin(*names) & (v != ""))


def forward_headers(headers: Column, api_key: Column) -> Column:
    return F.map_concat(allowed_headers(headers, FORWARDED), F.create_map(F.lit("api-subscription-key"), api_key))


def parse_origins(text: Column) -> Column:
    """Comma list to array; null when nothing is left."""
    items = F.filter(F.transform(F.split(text, ","), lambda s: utrim(s)), lambda s: s != "")
    return F.when(F.size(items) > 0, items)


def admission_status(requests: DataFrame, api_key: str, origins: Column | None = None,
                     within_rate: Column | None = None, paths=PATHS, max_body: int = MAX_BODY) -> DataFrame:
    """Adds ``status``: the first failing check in fixed order, or 200 to forward.

    ``within_rate`` is a boolean column such as one from :func:`rate_flags`.
    """
    status = F.when(~F.coalesce(F.col("method") == "POST", F.lit(False)), 405)
    status = status.when(~F.coalesce(F.col("path").isin(*paths), F.lit(False)), 404)
    if origins is not None:
        listed = F.coalesce(F.array_contains(origins, F.col("origin")), F.lit(False))
        status = status.when(origins.isNotNull() & (F.size(origins) > 0) & ~listed, 403)
    status = status.when(F.coalesce("content_length", F.lit(0)) > max_body, 413)
    status = status.when(F.lit(api_key.strip() == ""), 503)
    if within_rate is not None:
        status = status.when(~F.coalesce(within_rate, F.lit(True)), 429)
    return requests.withColumn("status", status.otherwise(200))


def rate_counts(requests: DataFrame, window_seconds: int) -> DataFrame:
    """Requests per client and instant, with the count over the trailing window.

    Equal instants merge map-side. Time is cut into blocks of one window; a row is
    seen by its own block and the next, so a busy client is spread over its blocks
    and every trailing window still sees all of its rows.
    """
    at = F.unix_micros("ts")
    span = window_seconds * 1_000_000
    per = (requests.select(client_ip(F.col("headers")).alias("client_ip"), at.alias("_us"), "ts")
                   .groupBy("client_ip", "_us", "ts").agg(F.count(F.lit(1)).alias("n")))
    home = F.floor(F.col("_us") / span)
    spread = per.withColumn("_home", home).withColumn("_block", F.explode(F.array(home, home + 1)))
    w = W.partitionBy("client_ip", "_block").orderBy("_us").rangeBetween(-span, 0)
    return (spread.withColumn("in_window", F.sum("n").over(w)).where(F.col("_block") == F.col("_home"))
                  .select("client_ip", "ts", "n", "in_window"))


def rate_flags(requests: DataFrame, window_seconds: int, limit: int) -> DataFrame:
    """Requests with ``client_ip``, the trailing count and ``within_rate``."""
    counts = rate_counts(requests, window_seconds).select("client_ip", "ts", "in_window")
    keyed = requests.withColumn("client_ip", client_ip(F.col("headers")))
    return keyed.join(counts, ["client_ip", "ts"]).withColumn("within_rate", F.col("in_window") <= limit)

"""The operators applied to the given tables: ``QUERIES`` by name, and the ``ORACLES`` that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import copies, dac, leaks, lengths, lexical, lines, minhash, mixing, quality, repeats, toxicity, urls, whitening
from pageloom.llm.common import staged_table
from pageloom.plans.stage import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_toxic_segments")
def op1_toxic_segments(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")


@query("op2_length_histogram")
def op2_length_histogram(spark, sf_dir):
    return lengths.suffix_sums(lengths.histogram(table(spark, sf_dir, "documents")))


@query("op3_seed_align")
def op3_seed_align(spark, sf_dir):
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_mixing")
def op4_mixing(spark, sf_dir):
    """Documents in training order, by their first copy; what a document gives is the sum over its copies."""
    mixed = staged_table(mixing.mix(table(spark, sf_dir, "documents")), "mixed-rows")
    row = ("doc_id", "content", "first")
    read = mixing.copies(mixed).groupBy(*(F.col(c).alias(f"c_{c}") for c in row)).agg(
        F.sum("words").alias("words"), F.min("position").alias("position"))
    same = F.col("size") > 0
    for c in row:
        same = same & F.col(c).eqNullSafe(F.col(f"c_{c}"))
    out = mixed.join(read, same, "left").select(
        "doc_id", F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"),
        "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"), "position")
    order = [F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_last()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionByRange(parts, *order).sortWithinPartitions(*order)


@query("op5_token_codes")
def op5_token_codes(spark, sf_dir):
    path = f"{checkpoint_dir(spark).rstrip('/')}/token-codes-{uuid.uuid4().hex}"
    dac.write_tokens(table(spark, sf_dir, "documents"), path)
    return dac.read_tokens(spark, path)


def _rule_sql(host: str, path: str) -> str:
    return (f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')")


def _terms_sql() -> tuple[str, str, str]:
    has = lambda t: f"regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}]){t}($|[^\\p{{L}}\\p{{N}}])')"
    strict = " OR ".join(has(t) for t in urls.STRICT)
    n = " + ".join(f"CAST({has(t)} AS INTEGER)" for t in urls.SOFT)
    weight = " + ".join(f"CASE WHEN {has(t)} THEN {w}::DOUBLE ELSE 0 END" for t, w in urls.SOFT.items())
    return strict, n, weight


def _urls_sql() -> str:
    strict, n, weight = _terms_sql()
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    longest = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {_rule_sql(h, p)} THEN '{h}{p}'" for _, h, p in longest)
    verdict = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in urls.RULES)
    return f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(url, ''), '{upper}', '{lower}') AS low,
         translate(regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)([^?#]*)', 1), '{upper}', '{lower}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
ruled AS (SELECT *, CASE {rule} END AS rule, {strict} AS strict, {n} AS n, {weight} AS weight FROM parts)
SELECT page_id, host, path, rule, CASE rule {verdict} ELSE
  CASE WHEN strict OR (n >= {urls.SOFT_DISTINCT} AND weight >= {urls.SOFT_LIMIT}) THEN 'block' ELSE 'allow' END END AS verdict
FROM ruled"""


@query("op6_line_join")
def op6_line_join(spark, sf_dir):
    """One row per row of the table, with zeros and empty lists where no line holds a word."""
    docs = table(spark, sf_dir, "documents")
    found = lines.repeated_lines(docs)
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_lines", "n_removed", "n_links")]
    lists = [F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c) for c in ("removed", "classes")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    return rows.join(found, ["doc_id", "text_hash"], "left").select("doc_id", *counts, *lists)


@query("op7_url_vocabulary", _urls_sql())
def op7_url_vocabulary(spark, sf_dir):
    judged = urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op9_weak_quality")
def op9_weak_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    stats = quality.with_stats(docs.select("doc_id", "text"), "s", keep=["doc_id"])
    votes = quality.default_rules(F.col("s"))
    narrow = staged_table(stats.select("doc_id", *(F.col(f"s.{c}").alias(c) for c in quality.LONGS[:5]), quality.base_failed(F.col("s")).alias("base_failed"),
                                       F.struct(*(v.cast("byte").alias(k) for k, v in votes.items())).alias("votes")), "quality-votes")
    model = quality.fit_votes(narrow.select("votes.*"), list(votes))
    good = model.posterior({k: F.col(f"votes.{k}") for k in votes})
    return narrow.select("doc_id", *quality.LONGS[:5], "base_failed", (~F.col("base_failed") & (good >= 0.5)).alias("kept"),
                         good.alias("posterior"))


@query("op10_seed_extend")
def op10_seed_extend(spark, sf_dir):
    kept = repeats.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256"))


@query("op8_bayes_minhash")
def op8_bayes_minhash(spark, sf_dir):
    classes = minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)
    return classes.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


@query("op11_qdwh_whitening")
def op11_qdwh_whitening(spark, sf_dir):
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _lexical_sql() -> str:
    found = f"regexp_extract_all(translate(coalesce(text, ''), '{copies.UPPER}', '{copies.LOWER}'), '{_TERM}')"
    return f"""
WITH docs AS (SELECT doc_id, t, CAST(len(t) AS BIGINT) AS n FROM (SELECT doc_id, {found} AS t FROM documents) WHERE len(t) > 0),
whole AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM docs),
held AS (SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM docs) GROUP BY doc_id, n, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
            FROM (SELECT term, count(*) AS df FROM held GROUP BY term), whole),
asked AS (SELECT item_id, term, count(*) AS k FROM (SELECT item_id, unnest({found}) AS term FROM benchmark) GROUP BY item_id, term),
scores AS (SELECT item_id, doc_id, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
           FROM asked JOIN held USING (term) JOIN weights USING (term), whole GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20"""


@query("op12_lexical_blocks", _lexical_sql())
def op12_lexical_blocks(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), limit=20)


_COPIES_SQL = f"""
WITH texts AS (SELECT doc_id, translate(coalesce(text, ''), '{copies.UPPER}', '{copies.LOWER}') AS body FROM documents),
kept AS (SELECT *, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM texts)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(body) AS text_sha256 FROM kept"""


@query("op13_content_hash", _COPIES_SQL)
def op13_content_hash(spark, sf_dir):
    return copies.copy_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), keep="largest")

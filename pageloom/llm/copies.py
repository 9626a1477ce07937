"""Exact duplicates: documents grouped by a 128-bit hash of their content, groups confirmed byte by byte.

DataFrame operations only. Rows of (id, hash) find the hashes that occur twice; only texts with such a hash are
grouped by hash and text, which compares their bytes. That grouping combines copies before it moves them, so a
group that holds a third of all rows is one row a task, and a row is joined to its group's one line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import fresh, staged_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of the map of repeated hashes that is broadcast (4 MB): a fuller map only lets more single texts through.
MAP_BITS = 1 << 25


def normalized(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else changed; null is empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def content_key(text: Column) -> Column:
    """The first 128 bits of the SHA-256 of a text."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _spotted(rows: DataFrame, hashes: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` may be among ``hashes``: all that are, and few others."""
    spot = F.pmod(F.xxhash64(key), F.lit(MAP_BITS))
    bits = hashes.select(spot.alias("spot")).groupBy(F.expr("bitmap_bucket_number(spot)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(spot))").alias("bits"))
    held = rows.withColumn("spot", spot).withColumn("bucket", F.expr("bitmap_bucket_number(spot)")).join(F.broadcast(bits), "bucket")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bitmap_bit_position(spot) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, F.expr("cast(bitmap_bit_position(spot) % 8 as int)")).bitwiseAND(F.lit(1))
    return held.where(bit == 1).drop("spot", "bucket", "bits")


def copy_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "smallest",
                key: Callable[[Column], Column] = content_key) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row per row of ``docs``, by whole texts.

    Texts are equal if they agree after ``normalized``. ``keep`` names which id of a group stays, ``smallest``
    or ``largest``; a null id stays only in a group without any other. Rows that share id and text are one
    document: all of them say ``kept``, and ``without_copies`` returns one. Rows that share an id but not the
    text are judged apart. Null and empty texts form one group. An empty table gives an empty result; other
    columns are not read, so their names may clash. ``key`` is the 128-bit hash: texts that it confuses are
    told apart by their bytes, in one more pass that is made only if there are such texts.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    pick = F.min if keep == "smallest" else F.max
    source = docs.select(F.col(doc_id).alias("id"), normalized(F.col(text)).alias("body"))
    texts = source.select("id", "body", key(F.col("body")).alias("h"))
    rows = staged_table(texts.select("id", "h", F.unhex(F.sha2("body", 256)).alias("sha")), "content-hashes")
    repeated = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    classes = _spotted(texts, repeated, "h").groupBy("h", "body").agg(pick("id").alias("keep"), F.count(F.lit(1)).alias("size"))
    groups = classes.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.first("keep").alias("keep"), F.first("size").alias("size"))
    groups = staged_table(groups.where("n > 1 or size > 1"), "copy-groups")
    confused = groups.where("n > 1").select("h")

    def report(found: DataFrame) -> DataFrame:
        single = F.col("size").isNull()
        return found.select(F.col("id").alias("doc_id"), F.when(single, F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
                            F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
                            (single | F.col("id").eqNullSafe(F.col("keep"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))

    if confused.isEmpty():
        return report(rows.join(groups, "h", "left"))
    alike = texts.join(confused, "h", "left_semi")
    told = alike.groupBy("h", "body").agg(pick("id").alias("keep"), F.count(F.lit(1)).alias("size"))
    apart = alike.withColumn("sha", F.unhex(F.sha2("body", 256))).join(told, ["h", "body"], "left")
    return report(rows.join(confused, "h", "left_anti").join(groups, "h", "left")).unionByName(report(apart))


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "smallest",
                   key: Callable[[Column], Column] = content_key) -> DataFrame:
    """The rows of ``docs`` that stay, one for each group of equal texts, with all their columns as they are."""
    found = copy_groups(docs, doc_id, text, keep, key)
    whole = F.struct(F.col(doc_id), F.sha2(normalized(F.col(text)), 256))
    mark, gone, many = (fresh(docs, x) for x in ("_copy_key", "_copy_gone", "_copy_many"))
    named = found.where("group_size > 1").groupBy(F.struct("doc_id", "text_sha256").alias(mark)).agg(
        F.max(~F.col("kept")).alias(gone), F.lit(True).alias(many))
    left = docs.join(named, whole.eqNullSafe(F.col(mark)), "left").where(~F.coalesce(gone, F.lit(False)))
    once = left.where(F.col(many)).dropDuplicates([mark])
    return left.where(F.col(many).isNull()).unionByName(once).select(*docs.columns)

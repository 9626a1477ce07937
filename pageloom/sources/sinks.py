"""Export sink: versions and their manifest."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions import text as tx


def map_fonts(styled: DataFrame) -> DataFrame:
    """Adds ``family``, the standard font standing in, and ``warning`` for unknown names.

    ``styled`` needs ``font_name, bold, italic``. The twelve fonts are a literal map.
    """
    fonts = F.create_map(*[F.lit(v) for family, bold, italic, name in tx.STANDARD_FONTS
                           for v in (f"{family}|{str(bold).lower()}|{str(italic).lower()}", name)])
    family = tx.font_family(F.col("font_name"))
    key = F.concat_ws("|", family, F.col("bold").cast("string"), F.col("italic").cast("string"))
    warning = F.concat(F.lit("Font '"), F.col("font_name"),
                       F.lit("' substituted with Helvetica; widths/kerning may differ."))
    return (styled.withColumn("family", family).withColumn("standard_font", fonts[key])
                  .withColumn("warning", F.when(~F.col("font_name").rlike(tx.KNOWN_FONT), warning)))


MANIFEST = "version string, written_at timestamp, edits string, warnings string"  # the tables' schemas as JSON


def write_export(edits: DataFrame, warnings: DataFrame, path: str) -> str:
    """Write replayed edits by kind and their warnings as a new version, and return its name.

    Both tables go to a folder of their own; one row of the manifest, committed last in a single file, makes them
    the current export. Readers see the version before or this one, whole; a failed write leaves no row. Earlier
    versions stay, and so do the source tables.
    """
    spark, now = edits.sparkSession, datetime.now(timezone.utc)
    version = f"{now:%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:12]}"
    edits.write.partitionBy("kind").parquet(f"{path}/versions/{version}/edits")
    warnings.write.parquet(f"{path}/versions/{version}/warnings")
    spark.createDataFrame([(version, now, edits.schema.json(), warnings.schema.json())], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return version


def read_export(spark: SparkSession, path: str, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The edits and warnings of a version, by default of the one written last."""
    listed = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    if version is not None:
        listed = listed.where(F.col("version") == version)
    found = listed.orderBy(F.col("written_at").desc(), F.col("version").desc()).first()
    if found is None:
        raise ValueError(f"no such export in {path}")
    at = f"{path}/versions/{found['version']}"
    # With its schema an export without rows, which has no files, can be read as well.
    table = lambda name: spark.read.schema(T.StructType.fromJson(json.loads(found[name]))).parquet(f"{at}/{name}")
    return table("edits"), table("warnings")

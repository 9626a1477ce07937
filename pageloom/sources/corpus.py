"""Table, page-geometry, binary and edit-log sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.schemas import EDIT_EVENT

# Magic bytes in hex.
MAGIC = (("89504E47", "image/png"), ("FFD8FF", "image/jpeg"), ("255044462D", "application/pdf"))


def scan_corpus(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """An immutable source table; filters and columns push down to the file scan."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def page_geometry(raw: DataFrame) -> DataFrame:
    """Page size, right-angle rotation and origin from ``view array<double>`` and ``rotate``."""
    v = F.col("view")
    return raw.select(
        "doc_id", "page_index", (v[2] - v[0]).alias("width_pt"), (v[3] - v[1]).alias("height_pt"),
        F.pmod(F.col("rotate"), F.lit(360)).cast("int").alias("rotation"),
        F.struct(v[0].alias("x"), v[1].alias("y")).alias("box"))


def media_type(content: Column) -> Column:
    """Media type by leading bytes; null when unknown. File names are never consulted."""
    head = F.hex(F.substring(content, 1, 5))
    out = None
    for magic, name in MAGIC:
        hit = F.startswith(head, F.lit(magic))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def sniff_media_type(spark: SparkSession, path: str) -> DataFrame:
    """Media type of binary files, one row per file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", media_type(F.col("content")).alias("media_type"))


def read_edit_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Edit-action log, as a table or as a stream of arriving files."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(EDIT_EVENT).parquet(path)

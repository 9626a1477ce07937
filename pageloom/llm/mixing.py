"""Mixing sources to target weights along a time-varying curriculum.

Every source has a schedule: the rate at which training asks for its words, piecewise
linear in the training time 0..1. The schedule's integral is the source's weight. The
weights share the total demand, no source gives more than ``max_epochs`` times its size,
and what it can't give is shared again by weight. A source's documents stand in a fixed
random order, epoch after epoch; a copy takes the words from ``start`` to ``end`` of its
source's demand, and its training position is the time at which the integrated schedule
has asked for ``start`` words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageloom.llm.common import fresh, in_arrow, staged_table

#: Rows of a source that are ordered in one task.
CELL_ROWS = 50_000
ORDER_SEED = 17


def word_counts(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """``docs`` with the number of words of ``text`` (null: 0) as ``name``."""
    schema = docs.select("*", F.lit(0).cast("long").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            n = [0 if x is None else len(x.encode().split()) for x in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=schema.names)

    return docs.transform(in_arrow, run, schema)


def contract_weight(rank: Column) -> Column:
    """5, 2, 1, repeating, by the source's 0-based rank."""
    return F.element_at(F.array(*(F.lit(float(x)) for x in (5, 2, 1))), (rank % 3 + 1).cast("int"))


def ramps(weight: Column, rank: Column) -> Column:
    """Schedule knots (t, rate) with the integral ``weight``: every other source fades in, the rest fade out."""
    up = F.when(rank % 2 == 0, 0.5).otherwise(1.5)
    knot = lambda t, rate: F.struct(F.lit(t).alias("t"), rate.alias("rate"))
    return F.array(knot(0.0, weight * up), knot(0.5, weight), knot(1.0, weight * (2.0 - up)))


def source_targets(sizes: DataFrame, weight: Callable[[Column], Column] = contract_weight,
                   schedule: Callable[[Column, Column], Column] = ramps, max_epochs: float = 3.0) -> DataFrame:
    """Per source: ``source, rank, source_size, n_rows, weight, target, pieces``.

    ``pieces`` are the schedule's segments with the share of the demand before each. The
    sources, one row each, meet in one task; the documents do not.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    per = per.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    knots = schedule(weight(F.col("rank")), F.col("rank"))
    per = per.withColumn("knots", knots)
    areas = F.transform(F.sequence(F.lit(0), F.size("knots") - 2), lambda i: F.struct(
        F.col("knots")[i]["t"].alias("t"), (F.col("knots")[i + 1]["t"] - F.col("knots")[i]["t"]).alias("dt"),
        F.col("knots")[i]["rate"].alias("r0"), F.col("knots")[i + 1]["rate"].alias("r1")))
    per = per.withColumn("pieces", areas).drop("knots")
    area = lambda p: p["dt"] * (p["r0"] + p["r1"]) / 2
    per = per.withColumn("weight", F.aggregate("pieces", F.lit(0.0), lambda a, p: a + area(p)))
    # The sources that give all they can are the first ones by limit per weight. With these
    # fixed, the rest share what is left; a source is among them if its part would exceed its limit.
    cap, by = F.col("source_size") * float(max_epochs), W.orderBy("ratio", "rank")
    per = per.withColumn("ratio", F.when(F.col("weight") > 0, cap / F.col("weight")).otherwise(F.lit(float("inf"))))
    before = by.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    per = (per.withColumn("demand", F.sum("source_size").over(everything))
              .withColumn("capped", F.coalesce(F.sum(F.when(F.col("weight") > 0, cap)).over(before), F.lit(0.0)))
              .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
              .withColumn("level", F.when((F.col("open") > 0) & (F.col("weight") > 0),
                                          (F.col("demand") - F.col("capped")) / F.col("open")))
              .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)))
    target = F.when(F.col("weight") > 0, F.least(F.coalesce(F.col("level") * F.col("weight"), cap), cap)).otherwise(0.0)
    return per.withColumn("target", target).select("source", "rank", "source_size", "n_rows", "weight", "target", "pieces")


def _prefix_sums(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """The words of a source before each of its documents, in the source's fixed random order.

    A source is cut into cells by the leading bits of the order, so that a source with a
    third of all rows is ordered in many tasks; the cells' totals are summed separately.
    """
    salted = sizes.withColumn("at", F.xxhash64(F.lit(ORDER_SEED), "doc_id"))
    salted = salted.join(targets.select(F.col("source").alias("s2"), "n_rows"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    n_cells = F.ceil(F.col("n_rows") / F.lit(CELL_ROWS))
    # The order's upper 31 bits, 0 to 2^31, scaled to the cells: cells follow each other in the order.
    upper = F.shiftright("at", 33) + F.lit(1 << 30)
    salted = salted.withColumn("cell", F.floor(upper * n_cells / F.lit(float(1 << 31)))).drop("n_rows")
    cells = salted.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    ahead = W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select(F.col("source").alias("s2"), F.col("cell").alias("c2"),
                         F.coalesce(F.sum("cell_size").over(ahead), F.lit(0)).alias("cell_start"))
    inside = W.partitionBy("source", "cell").orderBy("at", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, -1)
    ordered = salted.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return (ordered.join(cells, F.col("source").eqNullSafe(F.col("s2")) & (F.col("cell") == F.col("c2")))
                   .withColumn("first", F.col("cell_start") + F.col("inside")).drop("s2", "c2", "cell", "cell_start", "inside", "at"))


def position(words: Column, target: Column, pieces: Column) -> Column:
    """The time at which the integrated schedule, scaled to ``target``, has asked for ``words``."""
    total = F.aggregate(pieces, F.lit(0.0), lambda a, p: a + p["dt"] * (p["r0"] + p["r1"]) / 2)
    asked = words / target * total

    def step(acc, p):
        area = p["dt"] * (p["r0"] + p["r1"]) / 2
        left = F.greatest(asked - acc["area"], F.lit(0.0))
        # r0 x + (r1 - r0) x^2 / (2 dt) = left, in the form without cancellation
        root = F.sqrt(F.greatest(p["r0"] * p["r0"] + 2 * (p["r1"] - p["r0"]) / p["dt"] * left, F.lit(0.0)))
        x = F.when(p["r0"] + root > 0, 2 * left / (p["r0"] + root)).otherwise(0.0)
        inside = (asked >= acc["area"]) & (asked <= acc["area"] + area)
        return F.struct((acc["area"] + area).alias("area"),
                        F.when(inside & acc["at"].isNull(), p["t"] + F.least(x, p["dt"])).otherwise(acc["at"]).alias("at"))

    start = F.struct(F.lit(0.0).alias("area"), F.lit(None).cast("double").alias("at"))
    return F.when((target > 0) & (total > 0), F.coalesce(F.aggregate(pieces, start, step)["at"], F.lit(1.0)))


def mix(docs: DataFrame, weight: Callable[[Column], Column] = contract_weight,
        schedule: Callable[[Column, Column], Column] = ramps, max_epochs: float = 3.0) -> DataFrame:
    """One row per document: ``doc_id, source, content, size, source_size, target, taken, first, pieces``.

    ``content`` is a hash of text and source, which tells rows of one id apart.
    ``taken`` counts the words the mix takes, repeats included: whole epochs, and the part
    of the last epoch up to the target, whose last document is cut at the word that
    reaches it. A null or empty text has size 0 and takes 0; a null source is a source
    and ranks last; rows with the same id are documents of their own; an empty table
    gives an empty result. Only ``doc_id``, ``text`` and ``source`` are read.
    """
    narrow = docs.select("doc_id", "source", "text", F.xxhash64("text", "source").alias("content"))
    sizes = staged_table(word_counts(narrow, "size").drop("text").withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    targets = source_targets(sizes, weight, schedule, max_epochs)
    placed = _prefix_sums(sizes, targets)
    out = placed.join(targets.select(F.col("source").alias("s2"), "source_size", "target", "pieces"),
                      F.col("source").eqNullSafe(F.col("s2"))).drop("s2", "row")
    words = F.round("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0)
    rest = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), words - full * F.col("source_size") - F.col("first")))
    return out.withColumn("taken", full * F.col("size") + rest)


def copies(mixed: DataFrame) -> DataFrame:
    """One row per copy that training reads: ``doc_id, content, first, epoch, position, words``, from ``mix``'s rows.

    Id, content and ``first`` name the row of ``mix`` that a copy is of. ``words`` is below the document's size for the cut copy of each source.
    """
    taken, size = F.col("taken"), F.col("size")
    reads = F.when(size > 0, F.ceil(taken / size)).otherwise(0)
    out = mixed.where(reads > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), reads.cast("long") - 1)))
    start = F.col("first") + F.col("epoch") * F.col("source_size")
    return (out.withColumn("position", position(start, F.col("target"), F.col("pieces")))
               .withColumn("words", F.least(size, taken - F.col("epoch") * size))
               .select("doc_id", "content", "first", "epoch", "position", "words"))


def mixed_documents(docs: DataFrame, position_column: str | None = None, **how) -> DataFrame:
    """The columns of ``docs``, one row per copy, range-sorted by training position.

    ``position_column`` names a column to add for the position, for readers that sort again.
    A copy counts where at least half of it lies below the target, so texts stay whole
    here; every source comes within half a document of its target. Rows without an id
    are left out, for nothing can name them. Documents without words have no place in
    training and are left out too. Rows of one id with different texts or sources each follow
    their own plan; equal rows follow one, the first by position.
    """
    taken = {c.lower(): fresh(docs, f"_m_{c}") for c in ("id", "content", "epoch", "at", "words", "n")}
    m_id, m_content, m_epoch, m_at, m_words, m_n = taken.values()
    plan = copies(mix(docs, **how).where(F.col("doc_id").isNotNull()))
    sized = word_counts(docs, size := fresh(docs, "_size")).where(F.col("doc_id").isNotNull())
    # Repeated rows have a plan each; one of these, with its number of copies, stands for all of them.
    plan = plan.select(F.col("doc_id").alias(m_id), F.col("content").alias(m_content), F.col("epoch").alias(m_epoch), F.col("position").alias(m_at),
                       F.col("words").alias(m_words)).groupBy(m_id, m_content, m_epoch).agg(F.min_by(F.struct(m_at, m_words), F.struct(m_at, m_words)).alias(m_n))
    plan = plan.select(m_id, m_content, F.col(f"{m_n}.{m_at}").alias(m_at), F.col(f"{m_n}.{m_words}").alias(m_words))
    same = (F.col("doc_id") == F.col(m_id)) & (F.xxhash64("text", "source") == F.col(m_content))
    out = sized.join(plan, same).where(F.col(m_words) * 2 >= F.col(size))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = out.repartitionByRange(parts, m_at, "doc_id").sortWithinPartitions(m_at, "doc_id")
    return out.select(*docs.columns, *([F.col(m_at).alias(position_column)] if position_column else []))

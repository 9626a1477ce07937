"""Streams over a table stored as a folder of files, streams without input, and refused actions."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pageloom.operators import edits
from pageloom.streaming.run import run_available
from workloads import views as v


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """The small tables, with ``events`` as three part files."""
    top = str(tmp_path_factory.mktemp("tables"))
    for name in os.listdir(sf):
        if name != "events.parquet":
            os.symlink(f"{sf}/{name}", f"{top}/{name}")
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(f"{top}/events.parquet")
    return top


@pytest.mark.parametrize("name", ["attempt_stream", "rate_stream"])
def test_streams_read_a_folder(spark, sf, folder, name):
    query = entry.queries()[name]
    key = lambda df: sorted(map(str, df.collect()))
    assert key(query(spark, folder)) == key(query(spark, sf))


def test_replay_of_a_folder(spark, sf, folder):
    query = entry.queries()["replay_stream"]
    assert query(spark, folder).count() == query(spark, sf).count() > 0


def test_stream_without_input(spark, tmp_path):
    spark.range(3).limit(0).write.parquet(str(tmp_path / "none.parquet"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "none.parquet"))
    out = run_available(stream, mode="append")
    assert out.columns == ["id"] and out.count() == 0


def test_replay_refuses_undo(spark, sf):
    log = v.edit_events(spark, sf)
    assert log.where("action = 'undo'").count() > 0
    with pytest.raises(Exception, match="no action undo|no action redo"):
        edits.replay_edits(log).collect()
    assert edits.replay_edits(log.where(~F.col("action").isin("undo", "redo"))).count() > 0

"""Documents to training tokens: quality, near duplicates, decontamination, mixing, token files.

Every stage works on all rows that the one before kept. All but the last return the
columns of ``documents``; mixing repeats a document's row for every copy that training
reads and adds the copy's training position, by which the token files are ordered. No SQL can state the fitted quality model, the alignment or the tokenizer, so
``ORACLE_SQL`` is None; the tests run the stages against brute force.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pageloom.llm import dac, leaks, minhash, mixing, quality
from pageloom.llm.common import staged_table
from pageloom.plans.stage import checkpoint_dir

ORACLE_SQL = None
#: Near duplicates here: five-word shingles, similarity 0.8; 30 bands of 4 miss such a pair with a chance of 1e-7.
NEAR = {"shingle": 5, "percent": 80, "bands": 30, "rows": 4}

#: Column of the training position, from mixing to the token files.
POSITION = "training_position"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.passes(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.without_near_duplicates(docs, **NEAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, position_column=POSITION)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    dac.write_tokens(docs, path, order=POSITION, forget=True)
    return dac.read_tokens(spark, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token_files", write_token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Order-dependent operators as a streaming pass over sorted partitions.

A window on the key lets Spark sort the rows (spilling to disk), and partition them by hash
only where they don't lie together by the key yet; they are then read in Arrow batches. Only the running state of the current key is held, never
the group itself. Input columns pass through untouched; the pass adds columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: A row's number within its key; it reaches the pass and ends there.
NUMBER = "_fold_number"


def sorted_by_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The rows by key and order, with their number in ``NUMBER``: rows that lie together by key are not moved again."""
    return df.withColumn(NUMBER, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def fold_columns(df: DataFrame, keys: list[str], order: list[str | Column], inputs: list[str],
                 start: Callable[[], object], step: Callable[[object, tuple], tuple],
                 added: T.StructType) -> DataFrame:
    """Append ``step(state, inputs_of_row)`` to every row, in order within each key."""
    schema = T.StructType(list(df.schema.fields) + list(added.fields))
    key_cols, types = list(keys), [to_arrow_type(f.dataType) for f in added.fields]
    names = [f.name for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in {*key_cols, *inputs}}
            out: list[list] = [[] for _ in names]
            key_rows = zip(*[cols[k] for k in key_cols])
            for key, row in zip(key_rows, zip(*[cols[c] for c in inputs])):
                if key != current:
                    current, state = key, start()
                for values, value in zip(out, step(state, row)):
                    values.append(value)
            kept = [i for i, name in enumerate(batch.schema.names) if name != NUMBER]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept] + [pa.array(v, t) for v, t in zip(out, types)],
                names=[batch.schema.names[i] for i in kept] + names)

    return sorted_by_key(df, keys, order).mapInArrow(run, schema)


def fold_groups(df: DataFrame, keys: list[str], order: list[str | Column], inputs: list[str],
                start: Callable[[], object], step: Callable[[object, tuple], None],
                finish: Callable[[object], Iterable[tuple]], result: T.StructType,
                batch_rows: int = 4096) -> DataFrame:
    """Emit ``finish(state)`` rows, prefixed by the key, once per key."""
    schema = T.StructType([df.schema[k] for k in keys] + list(result.fields))
    types = [to_arrow_type(f.dataType) for f in schema.fields]
    names, key_cols = schema.names, list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        current, state, pending = None, None, []

        def flush():
            cols = list(zip(*pending)) if pending else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in {*key_cols, *inputs}}
            key_rows = zip(*[cols[k] for k in key_cols])
            for key, row in zip(key_rows, zip(*[cols[c] for c in inputs])):
                if key != current:
                    if current is not None:
                        pending.extend((*current, *r) for r in finish(state))
                        if len(pending) >= batch_rows:
                            yield flush()
                            pending = []
                    current, state = key, start()
                step(state, row)
        if current is not None:
            pending.extend((*current, *r) for r in finish(state))
        if pending:
            yield flush()

    return sorted_by_key(df.select(*dict.fromkeys([*keys, *inputs])), keys, order).mapInArrow(run, schema)

"""Edit replay with undo as a keyed stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pageloom.operators.edits import HISTORY_LIMIT, EditHistory
from pageloom.schemas import EDIT

_VERSION = T.StructType([T.StructField("edits", T.ArrayType(EDIT))])
RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("seq", T.LongType()),
    T.StructField("past_len", T.IntegerType()), T.StructField("future_len", T.IntegerType()),
    T.StructField("edits", T.ArrayType(EDIT))])


def _plain(value):
    """Rows and arrays from the Arrow boundary as plain tuples and dicts."""
    if value is None:
        return None
    if hasattr(value, "asDict"):
        return value.asDict(recursive=True)
    if isinstance(value, dict):
        return value
    return [_plain(v) for v in value] if hasattr(value, "__iter__") and not isinstance(value, str) else value


class ReplayProcessor(StatefulProcessor):
    """Holds one document's live version and at most 100 versions on either side."""

    def __init__(self, limit: int = HISTORY_LIMIT):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.present = handle.getValueState("present", _VERSION)
        self.past = handle.getListState("past", _VERSION)
        self.future = handle.getListState("future", _VERSION)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        history = EditHistory(self.limit)
        if self.present.exists():
            history.present = tuple(_plain(self.present.get()[0]))
            history.past.extend(tuple(_plain(v[0])) for v in self.past.get())
            history.future.extend(tuple(_plain(v[0])) for v in self.future.get())
        events = sorted((e for pdf in rows for e in zip(pdf["seq"], pdf["action"], pdf["ids"], pdf["edits"])), key=lambda e: e[0])
        for _, action, ids, edits in events:
            history.apply(action, list(ids) if ids is not None else (), _plain(edits) or ())
        pack = lambda version: ([tuple(e[f.name] for f in EDIT) for e in version],)
        self.present.update(pack(history.present))
        self.past.clear(), self.future.clear()
        if history.past:
            self.past.put([pack(p) for p in history.past])
        if history.future:
            self.future.put([pack(p) for p in history.future])
        yield pd.DataFrame({"doc_id": [key[0]], "seq": [int(events[-1][0])], "past_len": [len(history.past)],
                            "future_len": [len(history.future)], "edits": [list(history.present)]})

    def close(self) -> None:
        pass


def replay_stream(events: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """Edits of each touched document after every micro-batch.

    Events of a document must arrive in sequence across batches; inside a batch
    they are ordered here. Needs the RocksDB state store.
    """
    return events.groupBy("doc_id").transformWithStateInPandas(
        statefulProcessor=ReplayProcessor(limit), outputStructType=RESULT, outputMode="Update", timeMode="None")


def latest_state(results: DataFrame) -> DataFrame:
    """Newest emitted row of each document."""
    row = F.struct(*[c for c in results.columns if c != "doc_id"])
    return results.groupBy("doc_id").agg(F.max_by(row, "seq").alias("_r")).select("doc_id", "_r.*")


# --- without undo: one entry of state an edit id ------------------------------------

_ID = T.StructType([T.StructField("id", T.StringType())])
_PLACED = T.StructType([T.StructField("add_seq", T.LongType()), T.StructField("add_ord", T.IntegerType()), T.StructField("edit", EDIT)])
_ENTRIES = T.StructType([T.StructField("entries", T.ArrayType(_PLACED))])
CHANGED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("id", T.StringType()),
                        T.StructField("entries", T.ArrayType(_PLACED))])


class EditMap(StatefulProcessor):
    """One document's live edits by id; an event reads and writes only the ids it names."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.edits = handle.getMapState("edits", _ID, _ENTRIES)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = sorted((e for pdf in rows for e in zip(pdf["seq"], pdf["action"], pdf["ids"], pdf["edits"])), key=lambda e: e[0])
        touched: dict[str, tuple[int, list]] = {}

        def entries(name: str) -> list:
            if name in touched:
                return touched[name][1]
            return [(int(a), int(o), _plain(e)) for a, o, e in self.edits.getValue((name,))[0]] if self.edits.containsKey((name,)) else []

        for seq, action, ids, edits in events:
            seq, ids, edits = int(seq), [i for i in ids] if ids is not None else [], _plain(edits) or []
            if action == "reset":
                for name in [*touched, *(k[0] for k in self.edits.keys())]:
                    touched[name] = (seq, [])
            elif action == "update" and edits:
                name = edits[0]["id"]
                if old := entries(name):
                    touched[name] = (seq, [(a, o, edits[0]) for a, o, _ in old])
            elif action in ("add", "remove", "replace"):
                for name in ids if action != "add" else []:
                    touched[name] = (seq, [])
                for order, edit in enumerate(edits if action != "remove" else []):
                    touched[edit["id"]] = (seq, [*entries(edit["id"]), (seq, order, edit)])
            elif action != "update":
                raise ValueError(f"edit_map_stream has no action {action}")
        pack = lambda kept: [(a, o, tuple(e[f.name] for f in EDIT)) for a, o, e in kept]
        for name, (_, kept) in touched.items():
            if kept:
                self.edits.updateValue((name,), (pack(kept),))
            elif self.edits.containsKey((name,)):
                self.edits.removeKey((name,))
        yield pd.DataFrame({"doc_id": [key[0]] * len(touched), "seq": [s for s, _ in touched.values()], "id": list(touched),
                            "entries": [[{"add_seq": a, "add_ord": o, "edit": e} for a, o, e in kept] for _, kept in touched.values()]}, columns=CHANGED.names)

    def close(self) -> None:
        pass


def edit_map_stream(events: DataFrame) -> DataFrame:
    """The ids that each micro-batch changes, with their live edits; none: the id is gone.

    For logs of add, update, remove, replace and reset; undo and redo need :func:`replay_stream`. An update
    rewrites one entry of the state, a reset removes all. Events of a document must arrive in sequence across
    batches; inside a batch they are ordered here. Rows without a document or sequence number are left out.
    """
    known = events.where("doc_id IS NOT NULL AND seq IS NOT NULL")
    return known.groupBy("doc_id").transformWithStateInPandas(
        statefulProcessor=EditMap(), outputStructType=CHANGED, outputMode="Update", timeMode="None")


def live_edits(changes: DataFrame) -> DataFrame:
    """The rows of ``operators.edits.replay_edits`` out of everything the stream has emitted."""
    last = changes.groupBy("doc_id", "id").agg(F.max_by("entries", "seq").alias("_entries"))
    placed = last.select("doc_id", F.explode("_entries").alias("_p"))
    return placed.select("doc_id", "_p.add_seq", "_p.add_ord", "_p.edit.*")

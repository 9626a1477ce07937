"""Streams that decide: which requests are within the rate, and which answer is the current one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pageloom.operators.requests import client_ip

_SEEN = T.StructType([T.StructField("client_ip", T.StringType()), T.StructField("request_id", T.LongType()), T.StructField("us", T.LongType()),
                     T.StructField("waits", T.BooleanType())])
_DUE = T.StructType([T.StructField("ms", T.LongType())])
#: Clients share this many groups in a block of time.
GROUPS = 16
GATED = T.StructType([T.StructField("client_ip", T.StringType()), T.StructField("request_id", T.LongType()), T.StructField("us", T.LongType()),
                      T.StructField("in_window", T.LongType()), T.StructField("within_rate", T.BooleanType())])


class RateGate(StatefulProcessor):
    """The requests of one block of time, and of the block before it, from one group of clients.

    A block is as long as the window. A request waits in its own block and is only counted in the next one, so
    the state of a key is bounded by two windows, and a client's history is spread over its blocks. An instant is
    settled once the watermark has passed it: then no request at or before it can arrive. A key has one timer,
    at its earliest waiting instant or else at its block's end, where its state goes.
    """

    def __init__(self, window_us: int, limit: int):
        self.window_us, self.limit = window_us, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", _SEEN)
        self.due = handle.getValueState("due", _DUE)

    @staticmethod
    def _settles(us: int) -> int:
        """The first watermark, in milliseconds, that settles an instant."""
        return (us + 999) // 1000 + 1

    def _block_end(self, key) -> int:
        return -(-(int(key[1]) + 1) * self.window_us // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        met = [(client, int(request), int(us), bool(waits)) for pdf in rows
               for client, request, us, waits in zip(pdf["client_ip"], pdf["request_id"], pdf["us"], pdf["waits"]) if us > passed]
        if met:
            self.seen.appendList(met)
            at = min([self._settles(us) for _, _, us, waits in met if waits], default=self._block_end(key))
            before = int(self.due.get()[0]) if self.due.exists() else None
            if before is None or at < before:
                if before is not None:
                    self.handle.deleteTimer(before)
                self.handle.registerTimer(at)
                self.due.update((at,))
        yield pd.DataFrame(columns=GATED.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        seen = list(self.seen.get())
        clients, requests = [r[0] for r in seen], [int(r[1]) for r in seen]
        us, waits = np.array([int(r[2]) for r in seen], np.int64), np.array([bool(r[3]) for r in seen], bool)
        settled = waits & (us < passed - 999)
        # A client's instants follow each other, a stretch apart from the next client's that no window crosses.
        codes: dict[str, int] = {}
        at = np.array([codes.setdefault(c, len(codes)) for c in clients], np.int64) * (4 * self.window_us) + (us - int(key[1]) * self.window_us)
        line = np.sort(at)
        counts = np.searchsorted(line, at[settled], "right") - np.searchsorted(line, at[settled] - self.window_us, "left")
        out = [(clients[i], requests[i], int(us[i]), int(n), bool(n <= self.limit)) for i, n in zip(np.flatnonzero(settled).tolist(), counts.tolist())]
        if passed >= self._block_end(key) * 1000 and not (waits & ~settled).any():
            self.seen.clear()
            self.due.clear()
        else:
            waits &= ~settled
            left = [(clients[i], requests[i], int(us[i]), bool(waits[i])) for i in np.flatnonzero(waits | (us >= passed - self.window_us)).tolist()]
            self.seen.put(left) if left else self.seen.clear()
            due = min([self._settles(u) for u in us[waits].tolist()], default=self._block_end(key))
            self.handle.registerTimer(due)
            self.due.update((due,))
        yield pd.DataFrame(out, columns=GATED.names)

    def close(self) -> None:
        pass


def rate_gate_stream(requests: DataFrame, window_seconds: int, limit: int, request_id: str = "request_no", late: str = "10 minutes") -> DataFrame:
    """``client_ip, request_id, us, in_window, within_rate`` of each request, once the watermark has passed it.

    ``in_window`` counts the client's requests of the trailing window, those of the same instant included, as
    :func:`~pageloom.operators.requests.rate_flags` does for a table. Requests that come more than ``late`` behind
    the newest one are neither counted nor answered; those without a time or id are left out. Append mode; needs
    the RocksDB state store. State is kept by block of one window and group of clients, so that a busy client's
    instants are spread over blocks and each is looked at a set number of times for every time its block settles.
    """
    span = window_seconds * 1_000_000
    keyed = requests.where(F.col("ts").isNotNull() & F.col(request_id).isNotNull()).select(
        client_ip(F.col("headers")).alias("client_ip"), F.col(request_id).cast("long").alias("request_id"), F.unix_micros("ts").alias("us"), "ts")
    home = F.expr(f"(us - pmod(us, {span}L)) div {span}L")
    spread = (keyed.withColumn("_group", F.pmod(F.xxhash64("client_ip"), F.lit(GROUPS))).withColumn("_home", home)
                   .withColumn("_block", F.explode(F.array(F.col("_home"), F.col("_home") + 1)))
                   .withColumn("waits", F.col("_block") == F.col("_home")).drop("_home"))
    return spread.withWatermark("ts", late).groupBy("_group", "_block").transformWithStateInPandas(
        statefulProcessor=RateGate(span, limit), outputStructType=GATED, outputMode="Append", timeMode="EventTime")


_REQUEST = T.StructType([T.StructField("request_id", T.LongType())])
_ANSWERS = T.StructType([T.StructField("answers", T.ArrayType(T.StringType()))])
CURRENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("request_id", T.LongType()), T.StructField("answered", T.BooleanType()),
                        T.StructField("answer", T.StringType())])


class CurrentAnswer(StatefulProcessor):
    """The current request of one document, and answers that came before their request did."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", _REQUEST)
        self.early = handle.getMapState("early", _REQUEST, _ANSWERS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = int(self.current.get()[0]) if self.current.exists() else None
        asked, answers = [], {}
        for pdf in rows:
            for request, is_answer, answer in zip(pdf["request_id"].tolist(), pdf["is_answer"].tolist(), pdf["answer"].tolist()):
                if is_answer:
                    answers.setdefault(int(request), []).append(answer if isinstance(answer, str) else None)
                else:
                    asked.append(int(request))
        newest = max([*asked, *([] if now is None else [now])], default=None)
        out = []
        if newest is not None and newest != now:
            self.current.update((newest,))
            out.append((key[0], newest, False, None))
            for k, held in list(self.early.iterator()):
                if int(k[0]) <= newest:
                    answers.setdefault(int(k[0]), []).extend(held[0])
                    self.early.removeKey((int(k[0]),))
        for request, found in answers.items():
            if request == newest:
                out += [(key[0], request, True, a) for a in found]
            elif newest is None or request > newest:
                at = (request,)
                held = list(self.early.getValue(at)[0]) if self.early.containsKey(at) else []
                self.early.updateValue(at, (held + found,))
        yield pd.DataFrame(out, columns=CURRENT.names)

    def close(self) -> None:
        pass


def current_answer_stream(requests: DataFrame, results: DataFrame, answer: str = "answer") -> DataFrame:
    """Per document the request that is current, when it becomes so (``answered`` false), and its answers.

    ``requests`` has ``doc_id, request_id``; a higher id is a newer request. ``results`` adds ``answer``. A stale
    answer never leaves: in a micro-batch requests come first, and an answer to an older one is dropped. An
    answer that comes before its request waits for it. A later request takes back what left before, by its own
    row. Rows without an id are left out. State: a request id per document, and early answers.
    """
    asked = requests.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("request_id").cast("long").alias("request_id"),
                            F.lit(False).alias("is_answer"), F.lit(None).cast("string").alias("answer"))
    told = results.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("request_id").cast("long").alias("request_id"),
                          F.lit(True).alias("is_answer"), F.col(answer).cast("string").alias("answer"))
    both = asked.unionByName(told).where("doc_id IS NOT NULL AND request_id IS NOT NULL")
    return both.groupBy("doc_id").transformWithStateInPandas(
        statefulProcessor=CurrentAnswer(), outputStructType=CURRENT, outputMode="Update", timeMode="None")


def current_answers(emitted: DataFrame) -> DataFrame:
    """``doc_id, request_id, answer``: what stands after everything the stream has emitted."""
    newest = emitted.groupBy("doc_id").agg(F.max("request_id").alias("_newest"))
    return emitted.join(newest, "doc_id").where("answered AND request_id = _newest").select("doc_id", "request_id", "answer")

"""Keyed streams over many micro-batches against their table forms."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.operators import chat, edits, requests
from pageloom.schemas import EDIT
from pageloom.streaming import gates, replay
from pageloom.streaming.run import run_available

START = datetime.datetime(2024, 5, 1, tzinfo=datetime.timezone.utc)


def batches(spark, path, parts, schema):
    """A stream that takes each part as a micro-batch of its own."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{path}/*")


def test_rate_gate_matches_the_table_form(spark, tmp_path):
    rng = random.Random(2)
    schema, at, n, parts = "request_no long, ts timestamp, headers map<string,string>", 0, 0, []
    for _ in range(5):
        rows = []
        for _ in range(40):
            at += rng.choice([0, 0, 1, 5, 40])
            rows.append((n, START + datetime.timedelta(seconds=at - rng.choice([0, 0, 30])), {"cf-connecting-ip": rng.choice("abc")}))
            n += 1
        parts.append(rows)
    late = [(900, START - datetime.timedelta(days=1), {"cf-connecting-ip": "a"}), (901, None, {"cf-connecting-ip": "a"})]
    closing = [(999, START + datetime.timedelta(days=2), {"cf-connecting-ip": "z"})]
    stream = batches(spark, str(tmp_path / "in"), [*parts, late, closing], schema)
    got = run_available(gates.rate_gate_stream(stream, 60, 4, late="60 seconds"), mode="append")
    want = requests.rate_flags(spark.createDataFrame([r for p in parts for r in p], schema), 60, 4)
    key = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    assert key(got, "client_ip", "request_id", "in_window", "within_rate") == key(want, "client_ip", "request_no", "in_window", "within_rate")
    assert {r.within_rate for r in got.collect()} == {True, False}


def test_current_answer_never_lets_a_stale_one_out(spark, tmp_path):
    rng, parts, asked, told = random.Random(5), [], [], []
    for b in range(6):
        rows = []
        for _ in range(12):
            doc, request = rng.randrange(4), b * 20 + rng.randrange(20)
            rows.append((doc, request, False, None))
            asked.append((doc, request))
            if rng.random() < 0.7:  # some answers come before their request, or to an older one
                old = rng.choice([request, request, max(0, request - 25), request + 9])
                rows.append((doc, old, True, f"{doc}-{old}"))
                told.append((doc, old, f"{doc}-{old}"))
        rng.shuffle(rows)
        parts.append(rows)
    parts[-1] += [(9, 1, True, "no request"), (None, 1, True, "x"), (0, None, False, None)]
    stream = batches(spark, str(tmp_path / "in"), parts, "doc_id long, request_id long, is_answer boolean, answer string")
    out = run_available(gates.current_answer_stream(stream.where("NOT is_answer"), stream.where("is_answer")))
    want = chat.latest_wins(spark.createDataFrame(told, "doc_id long, request_id long, answer string"), spark.createDataFrame(asked, "doc_id long, request_id long"))
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", "request_id", "answer").collect())
    assert key(gates.current_answers(out)) == key(want)
    assert out.where("doc_id = 9").count() == 0


def edit(name, k):
    return (name, "text", 0, float(k), 1.0, 2.0, 3.0, k, f"t{k}") if len(EDIT.fields) == 9 else tuple(
        {"id": name, "kind": "text", "page_index": 0, "z": k, "text": f"t{k}"}.get(f.name) for f in EDIT.fields)


def test_edit_map_matches_replay_after_every_batch(spark, tmp_path):
    rng, log = random.Random(8), []
    for seq in range(240):
        names = [rng.choice("abcdef") for _ in range(rng.randrange(1, 3))]
        action = rng.choices(["add", "update", "remove", "replace", "reset"], [6, 5, 2, 3, 0.4])[0]
        ids = names if action in ("remove", "replace") else None
        new = [edit(n, seq * 10 + k) for k, n in enumerate(names)][:1 if action == "update" else 2] if action in ("add", "update", "replace") else None
        log.append((rng.randrange(3), seq, action, ids, new))

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("action", T.StringType()),
                           T.StructField("ids", T.ArrayType(T.StringType())), T.StructField("edits", T.ArrayType(EDIT))])
    parts = [log[i:i + 60] for i in range(0, 240, 60)]
    stream = batches(spark, str(tmp_path / "in"), parts, schema)
    changes = run_available(replay.edit_map_stream(stream)).cache()
    key = lambda df: sorted((r.doc_id, r.add_seq, r.add_ord, r.id, r.z, r.text) for r in df.collect())
    for n in (60, 120, 180, 240):
        want = edits.replay_edits(spark.createDataFrame(log[:n], schema))
        assert key(replay.live_edits(changes.where(F.col("seq") < n))) == key(want)
    refused = batches(spark, str(tmp_path / "bad"), [[(1, 1, "undo", None, None)]], schema)
    with pytest.raises(Exception, match="no action undo"):
        run_available(replay.edit_map_stream(refused))

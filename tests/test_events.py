"""Dates, spans, paint logs, edits, chat and streams on literal inputs."""

import datetime

import pytest
from pyspark.sql import functions as F

from pageloom.functions import colors, dates as fd, geometry as g, text as tx
from pageloom.operators import chat, compare, dates, edits, paint, pixels, requests
from pageloom.plans.order import global_position
from pageloom.schemas import EDIT_EVENT, PAINT_OP
from pageloom.sources import corpus, html, sinks
from pageloom.streaming import replay
from pageloom.streaming.run import run_available
from workloads import views as v


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def found(spark, text):
    seg = [(0, len(text), 40.0, 10.0, 5.0 * len(text), 10.0)]
    df = spark.createDataFrame([(1, text, 40.0, 10.0, 5.0 * len(text), 10.0, seg)],
                               "line_id long, text string, x double, y double, w double, h double, "
                               "segments array<struct<start:int,end:int,x:double,y:double,w:double,h:double>>")
    rows = dates.date_spans(df, "2026-05-17").orderBy("start").collect()
    return [(r.raw, r.start_iso, r.end_iso, r.alt_start_iso) for r in rows]


@pytest.mark.parametrize("text, want", [
    ("Travel dates: 12 Aug 2026 - 23 Aug 2026", [("12 Aug 2026 - 23 Aug 2026", "2026-08-12", "2026-08-23", None)]),
    ("Return 03/04/2026", [("03/04/2026", "2026-04-03", None, "2026-03-04")]),
    ("12 Aug 2026 at 3pm and 14:30", [("12 Aug 2026", "2026-08-12", None, None), ("3pm", "2026-08-12T15:00:00Z", None, None),
                                      ("14:30", "2026-08-12T14:30:00Z", None, None)]),
    ("90 Mins · 11 Nights", []),
    ("28 Dec to 3 Jan", [("28 Dec to 3 Jan", "2026-12-28", "2027-01-03", None)]),
    ("31/02/2026 and 13/25/2026", []),
    ("due 25.12.69 or 25.12.70", [("25.12.69", "2069-12-25", None, None), ("25.12.70", "1970-12-25", None, None)]),
    ("5 sept", [("5 sept", "2026-09-05", None, None)]),
    ("x12 Aug, 12 Aug", [("12 Aug", "2026-08-12", None, None)]),
    ("3:30 pm", [("3:30", "2026-05-17T03:30:00Z", None, None)]),
    ("12am 12pm", [("12am", "2026-05-17T00:00:00Z", None, None), ("12pm", "2026-05-17T12:00:00Z", None, None)]),
])
def test_date_matches(spark, text, want):
    assert found(spark, text) == want


def test_offsets_skip_an_earlier_lookalike(spark):
    text = "x12 Aug, 12 Aug"
    seg = [(0, 15, 0.0, 0.0, 75.0, 10.0)]
    df = spark.createDataFrame([(1, text, 0.0, 0.0, 75.0, 10.0, seg)],
                               "line_id long, text string, x double, y double, w double, h double, "
                               "segments array<struct<start:int,end:int,x:double,y:double,w:double,h:double>>")
    assert dates.date_spans(df, "2026-01-01").first().start == 9


def test_calendar_range(spark):
    lit = F.lit
    r = one(spark, fd.calendar_range(lit("2026-02-28"), lit(None).cast("string"), lit(True)).alias("a"),
            fd.calendar_range(lit("2026-08-12T15:00:00"), lit(None).cast("string"), lit(False)).alias("b"),
            fd.calendar_range(lit("2026-08-12T15:00:00+05:30"), lit("2026-08-12T12:00:00Z"), lit(False)).alias("c"))
    assert (r.a, r.b, r.c) == ("20260228/20260301", "20260812T150000Z/20260812T160000Z", "20260812T093000Z/20260812T120000Z")
    with pytest.raises(Exception, match="invalid ISO date"):
        one(spark, fd.calendar_range(lit("2026-02-30"), lit(None).cast("string"), lit(True)))


def test_viewport_points_round_trip(spark):
    for rotation in (0, 90, 180, 270):
        geo = [F.lit(rotation), F.lit(595.0), F.lit(842.0), F.lit(7.0), F.lit(11.0), 1.7]
        at = g.page_to_viewport(F.lit(123.25), F.lit(456.5), *geo)
        back = g.viewport_to_page(at["x"], at["y"], *geo)
        r = one(spark, back.alias("p")).p
        assert (round(r.x, 8), round(r.y, 8)) == (123.25, 456.5)
    with pytest.raises(Exception, match="positive finite"):
        one(spark, g.scale_point(F.lit(1.0), F.lit(1.0), F.lit(0.0)))


def test_colors(spark):
    arr = lambda *vs: F.array(*[F.lit(float(x)) for x in vs])
    r = one(spark, colors.to_rgb(F.lit("rgb"), arr(255, 0, 51)).alias("a"), colors.to_rgb(F.lit("gray"), arr(0.5)).alias("b"),
            colors.to_rgb(F.lit("cmyk"), arr(0, 1, 0.5, 0.25)).alias("c"), colors.to_rgb(F.lit("rgb"), arr(1, 1)).alias("d"))
    assert tuple(r.a) == (1.0, 0.0, 0.2) and tuple(r.b) == (0.5, 0.5, 0.5) and tuple(r.c) == (0.75, 0.0, 0.25) and r.d is None


def paint_log(spark, ops):
    rows = [(1, 0, i, op, path, [float(a) for a in args]) for i, (op, path, args) in enumerate(ops)]
    return spark.createDataFrame(rows, PAINT_OP)


def test_image_placement_under_nested_state(spark):
    log = paint_log(spark, [("save", [], []), ("transform", [], [100, 0, 0, 50, 20, 30]), ("paintImageXObject", [], []),
                            ("restore", [], []), ("restore", [], []), ("paintFormXObjectBegin", [], [2, 0, 0, 2, 5, 5]),
                            ("paintImageMaskXObjectRepeat", [], [4, 0, 0, 3, 10, 10, 30, 10]), ("paintFormXObjectEnd", [], []),
                            ("paintInlineImageXObjectGroup", [], [7, 0, 0, 7, 1, 2, 8, 0, 0, 8, 3, 4])])
    got = sorted((r.x, r.y, r.w, r.h) for r in paint.image_regions(log).collect())
    assert got == [(1, 2, 7, 7), (3, 4, 8, 8), (20, 30, 100, 50), (25, 25, 8, 6), (65, 25, 8, 6)]


@pytest.mark.parametrize("mode", ["window", "exact"])
def test_rules_merge_before_the_length_filter(spark, mode):
    log = paint_log(spark, [("setLineWidth", [], [1.25]),
                            ("constructPath", ["rectangle"], [20, 80, 55, 2]), ("fill", [], []),
                            ("constructPath", ["rectangle"], [75, 80, 65, 2]), ("fill", [], []),
                            ("constructPath", ["rectangle"], [20, 60, 90, 2]), ("stroke", [], []),
                            ("constructPath", ["moveTo", "lineTo"], [20, 100, 280, 100]), ("stroke", [], []), ("stroke", [], [])])
    rules = paint.long_rules(paint.merge_rules(paint.rule_candidates(paint.rule_paints(log)), mode))
    got = sorted((r.x1, r.x2, r.y1, r.thickness_pt) for r in rules.collect())
    assert got == [(20, 140, 81, 2), (20, 280, 100, 1.25)]


def events(spark, actions):
    edit = lambda i, t: (i, "text", 0, 0.0, 0.0, 1.0, 1.0, 1, t)
    rows = []
    for seq, (action, ids, new) in enumerate(actions):
        rows.append((1, seq, action, ids, [edit(*e) for e in new]))
    return spark.createDataFrame(rows, EDIT_EVENT)


def state(df):
    r = df.first()
    return r.past_len, r.future_len, [(e.id, e.text) for e in r.edits]


def test_undo_redo(spark):
    add = lambda i: ("add", [], [(i, i)])
    base = [add("a"), add("b"), add("c"), ("undo", [], []), ("undo", [], []), ("redo", [], []), ("remove", ["zz"], [])]
    assert state(edits.replay_history(events(spark, base))) == (2, 1, [("a", "a"), ("b", "b")])
    cleared = base + [("update", [], [("a", "A")]), ("redo", [], [])]
    assert state(edits.replay_history(events(spark, cleared))) == (3, 0, [("a", "A"), ("b", "b")])
    assert state(edits.replay_history(events(spark, [add(f"e{i}") for i in range(105)])))[0] == 100
    # Replacing ids that match nothing is still recorded.
    assert state(edits.replay_history(events(spark, [add("a"), ("replace", ["zz"], [])])))[0] == 2


def test_replay_without_undo_matches_the_machine(spark, sf):
    log = v.edit_events(spark, sf).where("action NOT IN ('undo', 'redo')")
    flat = {}
    for r in edits.replay_edits(log).orderBy("add_seq", "add_ord").collect():
        flat.setdefault(r.doc_id, []).append((r.id, r.text))
    folded = {r.doc_id: [(e.id, e.text) for e in r.edits] for r in edits.replay_history(log).collect() if r.edits}
    assert flat == folded


def test_stream_in_small_batches_matches_batch(spark, sf, tmp_path):
    log = v.edit_events(spark, sf)
    for part in range(3):
        log.where(F.floor(F.col("seq") / 400) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(EDIT_EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    got = replay.latest_state(run_available(replay.replay_stream(stream)))
    want = edits.replay_history(corpus.read_edit_events(spark, str(tmp_path / "log")))
    key = lambda df: sorted((r.doc_id, r.past_len, r.future_len, [e.id for e in r.edits]) for r in df.collect())
    assert key(got) == key(want)


def test_unknown_pages_and_kinds_fail(spark, sf):
    log = v.edits(spark, sf)
    with pytest.raises(Exception, match="unknown page"):
        edits.validate_edits(log, log.select("doc_id", "page_index").where("page_index = 0")).collect()
    with pytest.raises(Exception, match="unknown edit kind"):
        edits.split_by_kind(log.withColumn("kind", F.lit("video")))["text"].collect()
    with pytest.raises(ValueError):
        edits.split_by_kind(log, {"text": lambda d: d})


@pytest.mark.parametrize("text, want", [
    ("See [Page 2] now", "See now"), ("a [pages 2-3, 7]  b", "a b"), ("[PAGE 1]", ""), ("none", "none")])
def test_page_markers(spark, text, want):
    assert one(spark, tx.strip_page_markers(F.lit(text)).alias("r")).r == want


def test_html_spans_follow_nested_styles(spark):
    page = '<div style="font-weight:bold">a<span style="font-weight:400">b</span>c</div><p><i>d</i><em style="font-style:normal">e</em></p>f<br>&lt;g'
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    spans = html.styled_spans(df).select(tx.normalize_spans(F.col("spans")).alias("s")).first().s
    assert [(s.text, s.bold, s.italic) for s in spans] == [
        ("a", True, False), ("b", False, False), ("c", True, False), ("\n", False, False), ("d", False, True), ("ef\n<g", False, False)]


def test_media_types(spark, tmp_path):
    for name, data in {"a.jpg": b"\x89PNG123", "b.png": b"\xff\xd8\xff123", "c.txt": b"%PDF-1.7", "d.pdf": b"nothing"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r.media_type for r in corpus.sniff_media_type(spark, str(tmp_path)).collect()}
    assert got == {"a.jpg": "image/png", "b.png": "image/jpeg", "c.txt": "application/pdf", "d.pdf": None}


def test_languages(spark):
    arr = lambda *vs: F.array(*[F.lit(x) for x in vs])
    r = one(spark, chat.resolve_language(arr("xx", "TA-in")).alias("a"), chat.resolve_language(arr("hi-XX", "ta-IN")).alias("b"),
            chat.resolve_language(F.array().cast("array<string>")).alias("c"))
    assert (r.a, r.b, r.c) == ("ta-IN", "hi-IN", "en-IN")


def test_empty_answers_are_rejected(spark):
    df = spark.createDataFrame([(1, "[[NOT_IN_DOCUMENT]]  "), (2, " "), (3, "fine"), (4, "[[NOT_IN_DOCUMENT]] so")], "id long, text string")
    good, bad = chat.split_grounded(df)
    assert sorted((r.id, r.answer, r.grounded) for r in good.collect()) == [(3, "fine", True), (4, "so", False)]
    assert sorted(r.id for r in bad.collect()) == [1, 2]


def test_one_client_with_every_request(spark):
    start = datetime.datetime(2024, 1, 1)
    df = spark.range(5000).select(F.col("id"), (F.lit(start).cast("timestamp") + F.make_dt_interval(secs=F.col("id"))).alias("ts"),
                                  F.create_map(F.lit("cf-connecting-ip"), F.lit("1.1.1.1")).alias("headers"))
    got = {r.id: r.in_window for r in requests.rate_flags(df, 60, 10).collect()}
    assert all(got[i] == min(i, 60) + 1 for i in range(5000))


def test_global_position_is_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    rows = global_position(df, [F.col("k")], "pos").collect()
    assert sorted((r.k, r.pos) for r in rows) == [(k, k + 1) for k in range(1000)]


def test_image_pixels_across_chunks(spark, sf):
    p = v.pixels(spark, sf)
    small = {r.image_id: r.edge_count for r in pixels.edge_ratio(p, chunk=64).collect()}
    whole = {r.image_id: r.edge_count for r in pixels.edge_ratio(p, chunk=1 << 20).collect()}
    assert small == whole


def test_transparent_image_is_white_and_plain(spark):
    p = spark.createDataFrame([(1, x, 0, 9, 9, 9, 0) for x in range(5)], "image_id long, px int, py int, r int, g int, b int, a int")
    assert tuple(pixels.dominant_color(p, ["image_id"]).first()) == (1, 1.0, 1.0, 1.0)
    r = pixels.image_richness(p).first()
    assert (r.color_count, r.dominant_fraction, r.rich) == (0, 0.0, False)


def test_nearest_takes_first_on_ties(spark):
    left = spark.createDataFrame([(1, 10.0), (2, 100.0)], "id long, a double").withColumn("k", F.lit(1))
    right = spark.createDataFrame([(1, 8.0), (2, 12.0), (3, 17.0)], "ord long, b double").withColumn("k", F.lit(1))
    got = compare.nearest_within(left, right, ["k"], "id", "a", "b", "ord", 6.0).collect()
    assert [(r.id, r.ord, r.delta) for r in got] == [(1, 1, -2.0)]


def test_repeated_answers_are_dropped_in_a_stream(spark, tmp_path):
    from pageloom.streaming import logs
    rows = [(1, 7, 0), (1, 7, 5), (1, 8, 9), (2, 7, 3)]
    df = spark.createDataFrame(rows, "doc_id long, request_id long, s int").withColumn("ts", F.timestamp_seconds("s"))
    df.coalesce(1).write.parquet(str(tmp_path / "answers"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "answers"))
    got = run_available(logs.latest_wins_stream(stream), mode="append").collect()
    assert sorted((r.doc_id, r.request_id) for r in got) == [(1, 7), (1, 8), (2, 7)]


def test_exports_are_versions_behind_a_manifest(spark, tmp_path):
    path = str(tmp_path / "export")
    rows = lambda n: spark.range(n).selectExpr("id", "if(id % 2 = 0, 'text', 'line') AS kind")
    warned = spark.createDataFrame([(1, "w")], "doc_id long, warning string")
    first = sinks.write_export(rows(4), warned, path)
    second = sinks.write_export(rows(6), warned.limit(0), path)
    edits_, warnings = sinks.read_export(spark, path)
    assert (edits_.count(), warnings.count(), sorted(edits_.columns)) == (6, 0, ["id", "kind"])
    # A write that fails half-way leaves the current export as it is.
    with pytest.raises(Exception):
        sinks.write_export(rows(9), warned.select(F.raise_error(F.lit("stop")).alias("x")), path)
    assert sinks.read_export(spark, path)[0].count() == 6
    assert sinks.read_export(spark, path, first)[0].count() == 4 and first < second
    sinks.write_export(rows(0), warned.limit(0), path)
    assert sinks.read_export(spark, path)[0].count() == 0
    with pytest.raises(ValueError, match="no such export"):
        sinks.read_export(spark, path, "never")

"""Steps whose work must grow with the input only: busy keys, wide rows, many windows."""

import datetime

from pyspark.sql import functions as F

from pageloom.operators import requests
from pageloom.streaming import gates
from pageloom.streaming.run import run_available

START = datetime.datetime(2024, 5, 1, tzinfo=datetime.timezone.utc)


def test_rate_gate_with_a_busy_client_is_linear(spark, tmp_path):
    """One client with 6,000 instants: each fired timer used to go through all of them."""
    rows = [(i, START + datetime.timedelta(seconds=i * 7, microseconds=i % 3 * 500), {"x": "y"}) for i in range(6000)]
    last = [(9000, START + datetime.timedelta(days=9), {"cf-connecting-ip": "z"})]
    schema = "request_no long, ts timestamp, headers map<string,string>"
    table = spark.createDataFrame(rows + last, schema)
    table.coalesce(1).write.parquet(f"{tmp_path}/in")
    before = datetime.datetime.now()
    got = run_available(gates.rate_gate_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 3600, 400), mode="append")
    assert (datetime.datetime.now() - before).total_seconds() < 120
    want = requests.rate_flags(table.where("request_no < 9000"), 3600, 400)
    key = lambda df, i: sorted(tuple(r) for r in df.select("client_ip", i, "in_window", "within_rate").collect())
    assert key(got, "request_id") == key(want, "request_no")
    assert {r.within_rate for r in got.select("within_rate").distinct().collect()} == {True, False}


def test_words_are_cut_like_the_pattern(spark):
    from pageloom.functions import text as tx
    texts = ["", None, "  a  b\tc　d﻿", *("x" + chr(i) + "y" + chr(i) for i in [*range(1, 0x300), *range(0x1670, 0x1690), *range(0x1FF0, 0x2070), 0x3000, 0xFEFF])]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert df.where(~tx.words(F.col("text")).eqNullSafe(F.regexp_extract_all("text", F.lit(tx.NOT_WS + "+"), F.lit(0)))).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_fold_does_not_move_rows_that_lie_together(spark):
    from pyspark.sql import types as T
    from pageloom.plans.folds import fold_columns
    rows = spark.createDataFrame([(i % 3, i % 2, -i) for i in range(40)], "a long, b long, v long").repartition(5, "a")
    added = T.StructType([T.StructField("n", T.LongType())])

    def step(seen, row):
        seen.append(row[0])
        return (len(seen),)

    out = fold_columns(rows, ["a", "b"], ["v"], ["v"], list, step, added)
    assert plan_of(out).count("Exchange") == 1
    assert out.columns == ["a", "b", "v", "n"]
    got = {}
    for r in out.collect():
        got.setdefault((r.a, r.b), []).append((r.n, r.v))
    assert all([v for _, v in sorted(g)] == sorted(v for _, v in g) for g in got.values()) and sum(map(len, got.values())) == 40


def test_region_samples_are_not_broadcast(spark):
    from pageloom.operators import pixels
    regions = spark.createDataFrame([(1, 1, 0.0, 0.0, 4.0, 4.0, 8, 8)], "region_id long, image_id long, left double, top double, width double, height double, image_w long, image_h long")
    dots = spark.createDataFrame([(1, x, y, x * 9, y * 9, 3, 255) for x in range(8) for y in range(8)], "image_id long, px int, py int, r int, g int, b int, a int")
    out = pixels.region_richness(regions.groupBy(*regions.columns).count(), dots)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
    assert out.collect()[0].region_id == 1


def test_sizes_of_what_was_not_read_are_left_out(spark, sf):
    from pageloom.plans.sizing import expanded_partitions
    made = spark.createDataFrame([(1,)], "a long")
    assert expanded_partitions(made, made.checkpoint()) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_mixing_query_takes_what_the_copies_take_in_training_order(spark, tmp_path):
    from pageloom.llm import queries
    rows = [(i // 2 if i < 8 else i, " ".join(["w"] * (i * 7 % 23)), "en", "abc"[i % 3] if i % 7 else None, 1) for i in range(60)]
    spark.createDataFrame(rows + rows[:6], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op4_mixing(spark, str(tmp_path))
    from pageloom.llm import mixing
    mixed = mixing.mix(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    key = lambda df: sorted(repr(tuple(r)) for r in df.select("doc_id", "size", "source_size", "target", "taken").collect())
    assert key(out) == key(mixed) and out.count() == 66
    order = [r.position for r in out.collect()]
    placed = [p for p in order if p is not None]
    assert placed == sorted(placed) and order[:len(placed)] == placed


def test_metric_wrapping_is_dealt_out(spark):
    """A file of one split was wrapped by one task."""
    from pageloom.functions.metrics import FontWidth
    from pageloom.operators import doctext
    texts = ["", None, "a b" * 40, "x\n\r\n  y\t", "é€ \U0001f600… " * 30]
    docs = spark.createDataFrame([(i, texts[i % 5]) for i in range(60)], "doc_id long, text string").coalesce(1)
    out = doctext.wrap_chunks(docs, 100.0, measure=FontWidth("Helvetica", 10.0))
    assert out.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {}
    for r in out.orderBy("doc_id", "chunk_ord").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert all("".join(got.get(i, [])) == (texts[i % 5] or "").replace("\r\n", "\n").replace("\n", "") for i in range(60))


def test_row_starts_are_the_first_runs_of_rows(spark, tmp_path):
    from pageloom.sources.items import runs_from_text
    texts = ["", None, " ", "one", "w x" * 30, "ab " * 700, "é  \tz\n" * 13]
    spark.createDataFrame([(i % 6 or None, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in")
    how = {"gap": lambda i: F.when(i % 7 == 3, 0.0).otherwise(3.0), "lift": lambda i: (i % 2) * 0.5, "bold": lambda r: r % 8 == 0}
    whole, starts = runs_from_text(docs, **how).where("run_ord % 12 = 0"), runs_from_text(docs, row_starts=True, **how)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(whole.where("doc_id IS NOT NULL")) == rows(starts.where("doc_id IS NOT NULL")) and starts.count() == whole.count() > 60


def test_regions_are_made_once_and_without_the_other_words(spark, sf):
    """Every word of the documents was placed three times for each region query."""
    from workloads import paint_queries, views
    assert "_j" in plan_of(views.regions(spark, sf)).split("Window")[-1] and "= 0" in plan_of(views.regions(spark, sf))
    for made in (paint_queries.dedupe_regions(spark, sf), paint_queries.uncovered_regions(spark, sf)):
        assert "documents.parquet" not in plan_of(made)


def test_guides_stage_rectangles_only_and_pages_are_counted_by_a_split(spark, tmp_path):
    from workloads import layout_queries, views
    texts = ["", None, " \t\n", "one", "a b c", "x\x0by\x0cz\rw  v\n" * 200, " em"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    pages = views.page_counts(spark, str(tmp_path))
    assert "regexp" not in plan_of(pages)
    assert sorted((r.doc_id, r.page_index) for r in pages.collect()) == [(3, 0), (4, 0), (5, 0), (5, 1), (6, 0)]
    assert layout_queries._block_rects(spark, str(tmp_path)).columns == ["doc_id", "page_index", "block_ord", "x", "y", "w", "h"]


def test_lines_are_cut_and_added_up_in_one_pass(spark):
    """Four windows, two sorts and a sorted aggregate went over every word; the column form gives the same lines."""
    import random
    from pageloom.functions.geometry import union_aggs
    from pageloom.operators import layout
    from pageloom.schemas import RUN
    pick, nan = random.Random(3), float("nan")
    odd = lambda v: pick.choice([None, nan, float("inf")]) if pick.random() < 0.03 else v
    words = ["a", " ora ", "(", ",", "12", "3.5", "12\u0085", "  ", "", "\U0001f600b", "/", "x]", "9999999", None]
    rows = []
    for page in range(60):
        for i in range(pick.randrange(1, 70)):
            style = None if pick.random() < 0.03 else (pick.choice(["Times", None]), odd(pick.choice([8.0, 20.0])), pick.random() < 0.5, False, pick.choice([None, (0.0, 0.5, None)]))
            rows.append((pick.choice([page // 2, page // 2, None]), page % 3 or None, len(rows), pick.choice(words),
                         odd(pick.random() * 300), odd(pick.randrange(20) * 1.75), odd(pick.random() * 30), odd(10.0), style))
    runs = spark.createDataFrame(rows, RUN)
    piece = F.when(F.col("space"), F.concat(F.lit(" "), F.col("part"))).otherwise(F.col("part"))
    columns = layout.reading_order(layout.assign_lines(runs).withColumn("_piece", piece).groupBy(*layout.LINE).agg(
        F.expr("listagg(_piece, '') WITHIN GROUP (ORDER BY seg_ord)").alias("text"), *union_aggs(), F.avg("y").alias("baseline_y"),
        F.max_by("style", F.struct(F.length("part"), -F.col("seg_ord"))).alias("style"), F.count(F.lit(1)).alias("n_runs"), F.min("run_ord").alias("first_run_ord")))
    lines = layout.lines(runs)
    assert lines.dtypes == columns.dtypes and "listagg" not in plan_of(lines)
    key = lambda df: sorted(repr(tuple(r)) for r in df.select("doc_id", "page_index", "row_id", "seg", "text", "x", "y", "w", "h", "baseline_y", "style", "n_runs", "first_run_ord", "line_ord").collect())
    want = key(columns)
    assert len(want) > 500 and key(lines) == want
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert key(layout.lines(runs)) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert layout.lines(runs.limit(0)).count() == 0


def test_blocks_hand_over_only_what_is_wanted(spark, sf):
    from workloads import layout_queries
    made = layout_queries.block_lines_exact(spark, sf)
    assert made.columns == ["doc_id", "page_index", "line_ord", "block_ord"]
    assert ", style#" not in plan_of(made).split("MapInArrow")[1].split("\n")[0]


def test_staged_joins_are_sized_by_their_files(spark):
    """Spark's estimate of a join is the product of its sides: staged, it counted as files of that size."""
    from pageloom.plans.sizing import expanded_partitions
    from pageloom.plans.stage import staged
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        side = lambda c: spark.range(0, 2000, numPartitions=2).select(F.col("id").alias("k"), F.concat(F.lit(c * 200), F.col("id").cast("string")).alias(c))
        joined = side("a").join(side("b"), "k")
        made = staged(joined)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert made.count() == 2000
    assert expanded_partitions(made, made.where("k > 5")) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    # 250,000 rows of 1 KB: as many partitions as their files need.
    wide = staged(spark.range(0, 250_000, numPartitions=4).select("id", *(F.rand(i).alias(f"v{i}") for i in range(125))))
    assert 5 <= expanded_partitions(wide) <= 12


def moves(df):
    return [line for line in plan_of(df).splitlines() if "Exchange" in line]


def test_points_and_regions_meet_runs_without_moving_words(spark, sf):
    """Points, runs, regions and hits lie together by document: documents are dealt out for each reader, nothing else moves."""
    from workloads.layout_queries import query  # noqa: F401
    from workloads.registry import QUERIES
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("hit_test", "hit_test_misses", "text_backed_regions"):
            found = moves(QUERIES[name](spark, sf))
            assert found and all("REPARTITION_BY_NUM" in line for line in found), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hits_and_covered_text_against_all_pairs(spark):
    """Runs of all levels, repeated points and regions, null keys, and sides that lie apart."""
    from pageloom.operators import layout, regions
    from pageloom.schemas import PAGE
    rect = "doc_id long, page_index int, {} long, x double, y double, w double, h double"
    runs = [(1, 0, 0, 0.0, 0.0, 50.0, 10.0), (1, 0, 1, 20.0, 0.0, 50.0, 10.0), (1, 0, 2, -9e9, -9e9, 2e10, 2e10), (1, 0, 3, 0.0, 0.0, 3000.0, 700.0),
            (1, 1, 4, 0.0, 0.0, 5.0, 5.0), (None, 0, 5, 0.0, 0.0, 50.0, 10.0), (1, 0, 6, 120.0, 60.0, 20.0, 8.0), (1, 0, 6, 120.0, 60.0, 20.0, 8.0)]
    words = spark.createDataFrame(runs, rect.format("run_ord")).withColumn("text", F.concat(F.lit("w"), F.col("run_ord").cast("string")))
    points = [(1, 0, 1, 30.0, 5.0), (1, 0, 2, 128.0, 64.0), (1, 0, 3, 2500.0, 600.0), (1, 0, 4, 9e8, 1.0), (1, 1, 5, 2.0, 2.0), (1, 1, 6, 7.0, 2.0), (1, 0, 1, 5.0, 5.0),
              (None, 0, 7, 5.0, 5.0), (1, 0, 8, None, 5.0), (2, 0, 9, 0.0, 0.0)]
    got = layout.hit_test(spark.createDataFrame(points, "doc_id long, page_index int, point_id long, px double, py double"), words)
    want = {}
    for d, p, i, px, py in points:
        held = [(w * h, -o) for rd, rp, o, x, y, w, h in runs if None not in (d, px) and (rd, rp) == (d, p) and x <= px <= x + w and y <= py <= y + h]
        want[d, p, i] = min([*held, *want.get((d, p, i), [])], default=None) and [min([*held, *want.get((d, p, i), [])])]
    assert {(r.doc_id, r.page_index, r.point_id): r.run_ord for r in got.collect()} == {k: v and -v[0][1] for k, v in want.items()}
    assert got.count() == len(want)

    boxes = [(1, 0, 1, -5.0, -5.0, 80.0, 30.0), (1, 0, 2, 100.0, 40.0, 60.0, 60.0), (1, 0, 3, -1e10, -1e10, 3e10, 3e10), (1, 1, 4, 900.0, 0.0, 5.0, 5.0),
             (1, 0, 1, -5.0, -5.0, 80.0, 30.0), (1, 0, None, -5.0, -5.0, 80.0, 30.0), (None, 0, 5, -5.0, -5.0, 80.0, 30.0), (1, 0, 6, 0.0, 0.0, -1.0, 9.0)]
    areas = spark.createDataFrame(boxes, rect.format("region_id")).withColumn("kept", F.col("region_id") * 10)
    for inside in (0.6, 0.3):
        out = regions.text_backed_regions(areas, words, paragraph_text=6, inside=inside)
        assert out.columns == [*areas.columns, "has_text", "paragraph", "n_chars"]

        def chars(box):
            d, p, i, x, y, w, h = box
            n = 0
            for bd, bp, bi, bx, by, bw, bh in boxes:
                if None in (d, i) or (bd, bp, bi) != (d, p, i) or bw < 0:
                    continue
                for rd, rp, _, rx, ry, rw, rh in runs:
                    if (rd, rp) == (d, p):
                        both = max(0, min(bx + bw, rx + rw) - max(bx, rx)) * max(0, min(by + bh, ry + rh) - max(by, ry))
                        n += 2 * (both / (rw * rh) >= inside)
            return n

        key = lambda rows: sorted(rows, key=repr)
        assert key([(*r[:3], r.kept, r.has_text, r.paragraph, r.n_chars) for r in out.select(*PAGE, "region_id", "kept", "has_text", "paragraph", "n_chars").collect()]) == key(
            [(*b[:3], b[2] and b[2] * 10, chars(b) > 0, chars(b) > 6, chars(b)) for b in boxes])

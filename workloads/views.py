"""Deterministic input views over the driver tables.

Each view is derived by Spark from whole tables, so its size follows theirs.
``workloads/sql_views.py`` states the same views in SQL for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.operators import layout
from pageloom.schemas import PAGE, RECT
from pageloom.sources.items import runs_from_text

FONTS = ["Helvetica", "ABCDEE+Cambria", "CourierNew", "TimesNewRomanPS-ItalicMT", "Unknown-700"]
AS_OF = "2024-05-17"
RULE_BOX = (612.0, 792.0)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _events(spark: SparkSession, sf: str, events: DataFrame | None) -> DataFrame:
    """The ``events`` table, or what stands in for it: the same rows as a stream."""
    return table(spark, sf, "events") if events is None else events


def runs(spark: SparkSession, sf: str, row_starts: bool = False) -> DataFrame:
    """Words of ``documents`` set on pages: 12 per row, 48 rows per page; with ``row_starts`` the first of each row."""
    doc = F.col("doc_id")
    font = F.element_at(F.array(*[F.lit(f) for f in FONTS]), (doc % 5 + 1).cast("int"))
    col = lambda i: i % 12
    return runs_from_text(
        table(spark, sf, "documents"),
        gap=lambda i: F.when((doc % 5 == 0) & (i % 7 == 3), 0.0).otherwise(3.0),
        shift=lambda i: F.when((doc % 4 == 0) & (col(i) >= 6), 40.0).otherwise(0.0),
        lift=lambda i: (col(i) % 2) * 0.5,
        drop=lambda r: F.floor(r / 8) * 10.0,
        font_name=font,
        bold=lambda r: r % 8 == 0, row_starts=row_starts)


def lines(spark: SparkSession, sf: str, segments: bool = False) -> DataFrame:
    return layout.lines(runs(spark, sf), segments=segments)


def block_lines(spark: SparkSession, sf: str, keep: list[str] | None = None) -> DataFrame:
    return layout.assign_blocks(lines(spark, sf), keep=keep)


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    return layout.blocks(block_lines(spark, sf, ["text", *RECT, "baseline_y", "style"]))


def page_counts(spark: SparkSession, sf: str) -> DataFrame:
    """``(doc_id, page_index)`` of every page, straight from the word counts."""
    # By one split: the pattern's matches cost ten times as much.
    words = F.size(F.array_remove(F.split(F.translate("text", "\t\n\x0b\f\r", " " * 5), " "), ""))
    docs = table(spark, sf, "documents").select("doc_id", words.alias("n")).where("n > 0")
    return docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 576).cast("int"))).alias("page_index"))


def raw_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Page boxes as read from a file: view corners and an unnormalised rotation."""
    off = (F.col("doc_id") % 3) * 4.0
    return page_counts(spark, sf).select(
        "doc_id", "page_index", F.array(off, off * 2, off + 612.0, off * 2 + 792.0).alias("view"),
        ((F.col("doc_id") % 4) * 90 - 360 * (F.col("doc_id") % 2)).cast("int").alias("rotate"))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    from pageloom.sources.corpus import page_geometry
    return page_geometry(raw_pages(spark, sf))


def date_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One text line per order from seven templates, built of two runs."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("line_id"), F.to_date("o_orderdate").alias("d"))
    d2 = F.date_add("d", 11)
    named = lambda c: F.date_format(c, "d MMM yyyy")
    dmy = lambda c: F.date_format(c, "dd/MM/yyyy")
    k = F.col("line_id") % 7
    text = (F.when(k == 0, F.concat(F.lit("Travel date "), named("d")))
            .when(k == 1, F.concat(F.lit("Travel dates: "), named("d"), F.lit(" - "), named(d2)))
            .when(k == 2, F.concat(F.lit("Return "), dmy("d")))
            .when(k == 3, F.concat(F.lit("Stay "), dmy("d"), F.lit(" to "), dmy(d2)))
            .when(k == 4, F.concat(named("d"), F.lit(" at 3pm and 14:30")))
            .when(k == 5, F.lit("90 Mins · 11 Nights")).otherwise("Doors open 18:45"))
    first, n = F.locate(" ", F.col("text")) - 1, F.length("text")
    y = 700.0 - (F.col("line_id") % 40) * 14
    segment = lambda s, e: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), (s * 5.0 + 40).alias("x"),
                                    F.col("y").alias("y"), ((e - s) * 5.0).alias("w"), F.lit(10.0).alias("h"))
    return (o.withColumn("text", text).withColumn("y", y)
             .withColumn("segments", F.array(segment(F.lit(0), first), segment(first + 1, n)))
             .select("line_id", "text", F.lit(40.0).alias("x"), "y", (n * 5.0).alias("w"), F.lit(10.0).alias("h"), "segments"))


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """48 x 48 images out of ``embeddings``: 36 vectors of 64 values per image.

    Images cycle through noise, two flat tones, and tones with sparse noise; every
    97th pixel of each fifth image is transparent.
    """
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "v"))
    idx = (F.col("vec_id") % 36) * 64 + F.col("dim")
    image = F.floor(F.col("vec_id") / 36)
    v = F.col("v").cast("double")
    noise = lambda k: F.pmod(F.floor(v * k), F.lit(256)).cast("int")
    tone = F.when(v > 0, 220).otherwise(20)
    kind = image % 3
    sparse = F.col("idx") % 11 == 0
    channel = lambda k: (F.when(kind == 0, noise(k)).when(kind == 1, tone)
                         .otherwise(F.when(sparse, noise(k)).otherwise(200)))
    return (e.withColumn("idx", idx).select(
        image.alias("image_id"), (F.col("idx") % 48).cast("int").alias("px"), F.floor(F.col("idx") / 48).cast("int").alias("py"),
        channel(1000).alias("r"), channel(3000).alias("g"), channel(7000).alias("b"),
        F.when((image % 5 == 0) & (F.col("idx") % 97 == 0), 0).otherwise(255).alias("a")))


def edge_pictures(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Pixels with a smoothed edge, and the same edge moved by less or more than a pixel; every third image is recoloured."""
    base = pixels(spark, sf)
    slope = (F.col("image_id") % 7 - 3) / F.lit(4.0)

    def side(moved) -> DataFrame:
        cover = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("px") - 24) + (F.col("py") - 24) * slope + moved))
        tone, drawn = F.floor(cover * 255).cast("int"), F.col("image_id") % 3 < 2
        return base.withColumns({c: F.when(drawn, tone).otherwise(F.col(c)) for c in ("r", "g", "b")})

    have = side(F.when(F.col("image_id") % 3 == 0, 0.375).otherwise(1.5))
    shift = F.when((F.col("image_id") % 3 == 2) & ((F.col("px") + F.col("py")) % 5 == 0), 70).otherwise(0)
    return side(F.lit(0.0)), have.withColumn("r", F.col("r") + shift)


def image_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Four overlapping boxes on each image, some reaching over its edge."""
    images = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 36).alias("image_id")).distinct()
    box = images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    return box.select(
        (F.col("image_id") * 4 + F.col("k")).alias("region_id"), "image_id",
        (F.col("k") * 9.0 - 3.5).alias("left"), (F.col("k") * 7.0 + 1.25).alias("top"),
        (12.0 + F.col("image_id") % 7).alias("width"), (10.0 + F.col("k") * 5).alias("height"),
        F.lit(48).cast("long").alias("image_w"), F.lit(48).cast("long").alias("image_h"))


def regions(spark: SparkSession, sf: str) -> DataFrame:
    """An image box at the start of every text row, and a 3 pt square left of it on each third row."""
    r = F.floor(F.col("run_ord") / 12)
    starts = runs(spark, sf, row_starts=True).select(*PAGE, "run_ord", r.alias("row"), "x", "y")
    box = lambda k, x, y, w, h: F.struct(F.lit(k).cast("long").alias("k"), x.alias("x"), y.alias("y"),
                                         F.lit(w).alias("w"), F.lit(h).alias("h"))
    wide = box(0, F.col("x"), F.col("y") - 20, 280.0, 60.0)
    dot = box(1, F.col("x") - 11, F.col("y") + 1.5, 3.0, 3.0)
    both = F.when(F.col("row") % 3 == 0, F.array(wide, dot)).otherwise(F.array(wide))
    return starts.select(*PAGE, "run_ord", F.explode(both).alias("_b")).select(
        *PAGE, (F.col("run_ord") * 2 + F.col("_b.k")).alias("region_id"), "_b.x", "_b.y", "_b.w", "_b.h")


def paint_ops(spark: SparkSession, sf: str) -> DataFrame:
    """A fixed paint program per page, with numbers from the page key."""
    d, p = F.col("doc_id"), F.col("page_index")
    num = lambda *vs: F.array(*[v.cast("double") if hasattr(v, "cast") else F.lit(float(v)) for v in vs])
    k = d % 80
    none, nums = F.array().cast("array<string>"), F.array().cast("array<double>")
    words = lambda *ws: F.array(*[F.lit(w) for w in ws])
    scale = F.when(d % 2 == 0, 1.0).otherwise(255.0)
    tint = num(scale * 0.2, scale * 0.4, scale * 0.6)
    program = [
        ("save", none, nums), ("transform", none, num(100, 0, 0, 50, p + 20, d % 100 + 30)),
        ("paintImageXObject", none, nums), ("save", none, nums),
        ("transform", none, num(0.5, 0, 0, 0.5, 0.25, 0.25)), ("paintImageMaskXObject", none, nums),
        ("restore", none, nums), ("paintInlineImageXObject", none, nums), ("restore", none, nums),
        ("paintImageXObjectRepeat", none, num(12, 8, 400, d % 50 + 10, 450, d % 50 + 10)),
        ("setLineWidth", none, num(1.25)), ("setStrokeRGBColor", none, tint), ("setFillRGBColor", none, tint),
        ("constructPath", words("moveTo", "lineTo"), num(72, 100, k + 222, 100)), ("stroke", none, nums),
        ("constructPath", words("rectangle"), num(k + 223, 99.5, 90, 1)), ("fill", none, nums),
        ("constructPath", words("rectangle"), num(0, 0, 640, 2)), ("fill", none, nums),
        ("constructPath", words("rectangle"), num(300, 300, 50, 1)), ("fill", none, nums),
        ("constructPath", words("moveTo", "lineTo"), num(500, 200, 500, d % 90 + 240)), ("stroke", none, nums),
        ("constructPath", words("rectangle"), num(100, 400, 90, 1)), ("endPath", none, nums), ("fill", none, nums),
        ("setFillGray", none, num(0.5)),
        ("constructPath", words("rectangle"), num(100, 500, 120, 2)), ("fillStroke", none, nums),
    ]
    ops = F.array(*[F.struct(F.lit(o).alias("op"), a.alias("path"), n.alias("args")) for o, a, n in program])
    return page_counts(spark, sf).select(*PAGE, F.posexplode(ops).alias("op_ord", "_o")).select(
        *PAGE, F.col("op_ord").cast("long").alias("op_ord"), "_o.op", "_o.path", "_o.args")


def plain_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Upright 612 x 792 pages with their corner at the origin."""
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return page_counts(spark, sf).select(*PAGE, F.lit(612.0).alias("width_pt"), F.lit(792.0).alias("height_pt"),
                                         F.lit(0).alias("rotation"), zero.alias("box"))


def underline_hints(spark: SparkSession, sf: str) -> DataFrame:
    """A text item over the long rule on pages of each third document."""
    k = F.col("doc_id") % 80
    at = F.when(F.col("doc_id") % 3 == 0, 101.0).otherwise(140.0)
    return page_counts(spark, sf).select(*PAGE, F.lit(75.0).alias("x"), at.alias("baseline_y"),
                                         (k + 238.0).alias("width"), F.lit(10.0).alias("height"))


def _k(props):
    return F.regexp_extract(props, r"(\d+)", 1).cast("long")


def edit_events(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    """Edit actions from ``events``: one log per user, ids reused by ``k mod 10``."""
    e = _events(spark, sf, events).withColumn("k", _k(F.col("props")))
    act = (F.when(F.col("event_id") % 97 == 0, "reset")
           .when(F.col("event_type") == "view", "add").when(F.col("event_type") == "click", "update")
           .when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "purchase", "replace")
           .otherwise(F.when(F.col("k") % 2 == 1, "undo").otherwise("redo")))
    kinds = F.array(*[F.lit(x) for x in ("text", "cover", "image", "line")])
    edit_id = F.concat(F.lit("e"), (F.col("k") % 10).cast("string"))
    edit = F.struct(
        edit_id.alias("id"), F.element_at(kinds, (F.col("k") % 4 + 1).cast("int")).alias("kind"),
        (F.col("k") % 3).cast("int").alias("page_index"), F.col("k").cast("double").alias("x"),
        (F.col("k") * 2.0).alias("y"), (F.col("k") + 10.0).alias("w"), F.lit(5.0).alias("h"),
        F.col("event_id").alias("z"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("text"))
    e = e.withColumn("action", act)
    has_edit = F.col("action").isin("add", "update", "replace")
    has_ids = F.col("action").isin("remove", "replace")
    return e.select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), "action",
        F.when(has_ids, F.array(edit_id)).otherwise(F.array().cast("array<string>")).alias("ids"),
        F.when(has_edit, F.array(edit)).otherwise(F.slice(F.array(edit), 1, 0)).alias("edits"))


def edits(spark: SparkSession, sf: str) -> DataFrame:
    """Edits as a flat log: every edit ever added, with the extra columns of text and cover edits."""
    ev = edit_events(spark, sf).where("action = 'add' OR action = 'replace'")
    e = ev.select("doc_id", F.col("seq").alias("log_pos"), F.explode("edits").alias("_e")).select("doc_id", "log_pos", "_e.*")
    free = F.col("x") % 2 == 0
    text = F.col("kind") == "text"
    return (e.withColumn("z", F.col("log_pos") % 50)
             .withColumn("origin", F.when(text & free, "free"))
             .withColumn("box_id", F.when(text & free & (F.col("x") % 3 == 0), F.concat(F.lit("b"), (F.col("log_pos") % 4).cast("string"))))
             .withColumn("box_text", F.when(text & free & (F.col("x") % 5 == 0), F.concat(F.lit("box "), F.col("text"))))
             .withColumn("box_height", F.when(text & free & (F.col("x") % 4 == 0), 30.0))
             .withColumn("font_size_pt", F.lit(12.0))
             .withColumn("sample_background", F.col("log_pos") % 2 == 0))


def attempts(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    """Provider calls from ``events``: three providers in turn per request."""
    pick = lambda names, c: F.element_at(F.array(*[F.lit(n) for n in names]), (c + 1).cast("int"))
    rid, seq = F.floor(F.col("event_id") / 3), F.col("event_id") % 3
    ok = F.col("event_type") != "error"
    return _events(spark, sf, events).select(
        rid.alias("request_id"), seq.alias("seq"), pick(["primary", "backup", "local"], seq).alias("provider"),
        pick(["translate", "explain", "speak", "transcribe", "discuss"], rid % 5).alias("method"), ok.alias("ok"),
        F.col("value").alias("ms"),
        F.when(~ok, F.concat(F.lit("HTTP "), (F.col("event_id") % 7 + 500).cast("string"))).alias("error"))


def capabilities(spark: SparkSession) -> DataFrame:
    """Which provider supports which method; ``local`` only speaks."""
    full = [(p, m) for p in ("primary", "backup") for m in ("translate", "explain", "speak", "transcribe", "discuss")
            if (p, m) != ("backup", "discuss")]
    return spark.createDataFrame([*full, ("local", "speak")], "provider string, method string")


def requests(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    """Proxy requests from ``events``; instants are UTC and cut to the second."""
    n, u = F.col("event_id"), F.col("user_id")
    ip = F.concat(F.lit("10.0.0."), u.cast("string"))
    base = F.create_map(F.lit("content-type"), F.lit("application/json"), F.lit("cookie"), F.lit("secret"))
    headers = (F.when(u % 3 == 0, F.map_concat(base, F.create_map(F.lit("cf-connecting-ip"), F.concat(F.lit(" "), ip, F.lit(" ")))))
               .when(u % 3 == 1, F.map_concat(base, F.create_map(F.lit("x-forwarded-for"), F.concat(ip, F.lit(", 10.9.9.9")))))
               .otherwise(base))
    paths = F.array(*[F.lit(p) for p in ("text-to-speech", "speech-to-text", "v1/chat/completions", "other")])
    path = F.element_at(paths, (n % 4 + 1).cast("int"))
    # The stored time has no zone; it is taken as UTC whatever the session's zone is.
    instant = F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))
    return _events(spark, sf, events).select(
        n.alias("request_no"), F.date_trunc("second", instant).alias("ts"),
        F.when(n % 11 == 0, "GET").otherwise("POST").alias("method"), path.alias("path"),
        F.concat(F.lit("https://app.example/api/relay/"), path, F.lit("?k=1")).alias("url"),
        F.when(n % 5 == 0, "https://other.example").when(n % 5 == 1, F.lit(None)).otherwise("https://app.example").alias("origin"),
        F.when(n % 13 == 0, F.lit(13_000_000)).when(n % 17 == 0, F.lit(None)).otherwise(1000).cast("long").alias("content_length"),
        headers.alias("headers"))


def chat_turns(spark: SparkSession, sf: str) -> DataFrame:
    """``conversations`` with assistant answers marked as cited or as general knowledge."""
    away = (F.col("role") == "assistant") & (F.col("turn") % 4 == 3)
    cited = (F.col("role") == "assistant") & (F.col("turn") % 4 != 3)
    text = (F.when(away, F.concat(F.lit("[[NOT_IN_DOCUMENT]] "), F.col("text")))
            .when(cited, F.concat(F.col("text"), F.lit(" [Page 2]  [pages 3-4]"))).otherwise(F.col("text")))
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", text.alias("text"))


def preferences(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("xx"), F.lit("TA-in"), F.lit("hi-IN")))
        .when(F.col("doc_id") % 3 == 1, F.array(F.col("lang"), F.lit("hi-XX"))).otherwise(F.array(F.lit("zz"))).alias("requested"))

"""Lines, blocks, regions and bullets on literal inputs, and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from pageloom.functions.geometry import Rect
from pageloom.operators import bullets, doctext, layout, regions
from pageloom.plans.grid import MOST, coarse_levels, grid_pairs, on_grid
from pageloom.schemas import REGION, RUN

STYLE = ("Helvetica", 10.0, False, False, (0.0, 0.0, 0.0))


def run_rows(spark, rows, style=STYLE):
    """rows: (page, text, x, y, w, h)."""
    data = [(1, p, i, t, float(x), float(y), float(w), float(h), style) for i, (p, t, x, y, w, h) in enumerate(rows)]
    return spark.createDataFrame(data, RUN)


def texts(df):
    return [r.text for r in df.orderBy("page_index", "line_ord").collect()]


FRAGMENTS = [(0, "pan", 10, 500, 15, 10), (0, "oramic", 25.2, 500.1, 30, 10), (0, "view", 60, 500, 20, 10),
             (0, "Other column", 130, 500, 55, 10)]


@pytest.mark.parametrize("mode", ["window", "exact"])
def test_fragments_join_and_columns_split(spark, mode):
    assert texts(layout.lines(run_rows(spark, FRAGMENTS), mode)) == ["panoramic view", "Other column"]


def test_punctuation_and_openers_bind(spark):
    rows = [(0, "a", 0, 0, 5, 10), (0, ",", 7, 0, 5, 10), (0, "(", 14, 0, 5, 10), (0, "b", 21, 0, 5, 10), (0, "c", 28, 0, 5, 10)]
    assert texts(layout.lines(run_rows(spark, rows))) == ["a, (b c"]


def test_numbers_stay_apart(spark):
    rows = [(0, "1", 0, 0, 5, 10), (0, "2", 10, 0, 5, 10), (0, "word", 20, 0, 20, 10)]
    assert texts(layout.lines(run_rows(spark, rows))) == ["1", "2 word"]


def test_blocks_keep_short_fields_apart(spark):
    long = "x" * 34
    rows = [(0, long, 40, 500, 170, 10), (0, long, 40, 486, 170, 10), (0, long, 40, 472, 170, 10),
            (0, "Mr. Pratik", 40, 420, 50, 10), (0, "2 Adults", 40, 380, 40, 10)]
    lines = layout.lines(run_rows(spark, rows))
    for mode in ("exact", "window"):
        got = layout.blocks(layout.assign_blocks(lines, mode)).orderBy("block_ord").collect()
        assert [r.n_lines for r in got] == [3, 1, 1]
        assert got[0].line_height_pt == 14.0 and got[1].line_height_pt == 12.0


def brute_blocks(lines):
    """Paragraph grouping straight from its rules, for one page's lines in order."""
    groups = []
    number = lambda t: len(t) <= 6 and all(c in "0123456789.,/-" for c in t) and t != ""
    for i, l in enumerate(lines):
        options = []
        for g in groups:
            p = lines[g[-1]]
            gap, size = p.baseline_y - l.baseline_y, max(p.style.font_size_pt, l.style.font_size_pt)
            if number(p.text) or number(l.text) or gap <= 0.5 or gap > size * 1.85:
                continue
            if p.style.bold != l.style.bold:
                continue
            if not (len(p.text) >= 24 or len(l.text) >= 24 or p.n_runs >= 3 or l.n_runs >= 3):
                continue
            shared = max(0, min(p.x + p.w, l.x + l.w) - max(p.x, l.x))
            if abs(p.x - l.x) > max(9, size) and shared / max(1, min(p.w, l.w)) < 0.7:
                continue
            gaps = [lines[a].baseline_y - lines[b].baseline_y for a, b in zip(g, g[1:])]
            if gaps:
                s = sorted(gaps)
                m = s[len(s) // 2] if len(s) % 2 else (s[len(s) // 2 - 1] + s[len(s) // 2]) / 2
                if abs(gap - m) > max(2, m * 0.35):
                    continue
            options.append((abs(p.x - l.x), groups.index(g)))
        if options:
            groups[min(options)[1]].append(i)
        else:
            groups.append([i])
    return sorted(tuple(g) for g in groups)


def test_exact_blocks_match_brute_force_on_random_pages(spark):
    rng = random.Random(7)
    rows = []
    for page in range(12):
        y = 760.0
        for _ in range(40):
            for col in (40, 300):
                if rng.random() < 0.8:
                    rows.append((page, "w" * rng.choice([3, 12, 30]), col + rng.choice([0, 0, 4, 15]), y, rng.choice([60, 150]), 10))
            y -= rng.choice([14, 14, 14, 15, 18, 25])
    lines = layout.lines(run_rows(spark, rows))
    got = layout.assign_blocks(lines, "exact").orderBy("page_index", "line_ord").collect()
    for page in range(12):
        mine = [r for r in got if r.page_index == page]
        groups = {}
        for i, r in enumerate(mine):
            groups.setdefault(r.block_ord, []).append(i)
        assert sorted(map(tuple, groups.values())) == brute_blocks(mine)


def test_hit_test_prefers_small_then_late(spark):
    runs = run_rows(spark, [(0, "big", 0, 0, 100, 100), (0, "small", 20, 20, 40, 40), (0, "twin", 20, 20, 40, 40)])
    points = spark.createDataFrame([(1, 0, 1, 35.0, 35.0), (1, 0, 2, 200.0, 200.0), (1, 0, 3, 100.0, 100.0)],
                                   "doc_id long, page_index int, point_id long, px double, py double")
    got = {r.point_id: r.text for r in layout.hit_test(points, runs).collect()}
    assert got == {1: "twin", 2: None, 3: "big"}


def test_hit_test_of_wide_and_odd_rectangles(spark):
    inf, nan = float("inf"), float("nan")
    runs = run_rows(spark, [(0, "page", -1e6, -1e6, 2e6, 2e6), (0, "endless", 50, 50, inf, 10), (0, "odd", nan, 0, 10, 10), (0, "plane", -1e300, 0, 2e300, 1)])
    points = spark.createDataFrame([(1, 0, 1, 1e5, 55.0), (1, 0, 2, 10.0, 0.5), (1, 0, 3, nan, 1.0), (1, 0, 4, None, 1.0), (1, 0, 5, 1e200, 0.5), (1, 0, 6, inf, inf),
                                    (2, 0, 1, 10.0, 0.5), (1, 0, 7, 1e5, 1e5)], "doc_id long, page_index int, point_id long, px double, py double")
    got = {(r.doc_id, r.point_id): r.text for r in layout.hit_test(points, runs).collect()}
    assert got == {(1, 1): "page", (1, 2): "page", (1, 3): None, (1, 4): None, (1, 5): "plane", (1, 6): None, (2, 1): None, (1, 7): "page"}


def grid_rects(rng, n):
    def one():
        scale = rng.choice([0.0, 1.0, 30.0, 300.0, 5000.0, 1e6, 1e12])
        return (rng.uniform(-500, 900) * rng.choice([1, 1, 40]), rng.uniform(-500, 900), rng.random() * scale, rng.random() * rng.choice([scale, 5.0]))
    odd = [(0.0, 0.0, float("inf"), 3.0), (float("nan"), 0.0, 1.0, 1.0), (0.0, None, 1.0, 1.0), (5.0, 5.0, -1.0, 1.0), (-1e60, -1e60, 1e61, 1e61), (128.0, 64.0, 128.0, 64.0)]
    return [(i, rng.randrange(2), *r) for i, r in enumerate([one() for _ in range(n)] + odd)]


def grid_touch(a, b):
    def fine(r):
        return all(v is not None and v == v for v in r) and r[2] >= 0 and r[3] >= 0
    return fine(a) and fine(b) and a[0] <= b[0] + b[2] and b[0] <= a[0] + a[2] and a[1] <= b[1] + b[3] and b[1] <= a[1] + a[3]


@pytest.mark.parametrize("large", ["both", "right", "left"])
def test_grid_pairs_against_all_pairs(spark, large):
    rng = random.Random(21)
    left, right = grid_rects(rng, 120), grid_rects(rng, 120)
    if large != "both":
        small = [(i, k, x, y, min(w or 0.0, 90.0), min(h or 0.0, 60.0)) for i, k, x, y, w, h in (left if large == "right" else right)]
        left, right = (small, right) if large == "right" else (left, small)
    schema = "page int, %sx double, %sy double, %sw double, %sh double"
    frame = lambda rows, p: spark.createDataFrame(rows, f"{p}id long, " + schema % (p, p, p, p))
    lr, rr = frame(left, "l_"), frame(right, "r_")
    got = grid_pairs(lr, rr, ["page"], Rect.of("l_"), Rect.of("r_"), large=large).select("l_id", "r_id").collect()
    want = [(a[0], b[0]) for a in left for b in right if a[1] == b[1] and grid_touch(a[2:], b[2:])]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 300
    assert coarse_levels(rr, Rect.of("r_")) == ([2] if large == "left" else [1, 2])
    copies = on_grid(lr, Rect.of("l_"), [1, 2], 1, True).groupBy("l_id").count().agg(F.max("count")).first()[0]
    assert copies <= 2 * MOST + 4 + 1


def test_region_text_threshold(spark):
    region = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 100.0, 100.0)], REGION)
    inside = lambda x: run_rows(spark, [(0, "t" * 161, x, 50, 100, 10)])
    below = regions.text_backed_regions(region, inside(41)).first()
    at = regions.text_backed_regions(region, inside(40)).first()
    assert (below.has_text, below.paragraph, at.has_text, at.paragraph) == (False, False, True, True)
    with pytest.raises(ValueError):
        regions.text_backed_regions(region, inside(0), inside=1.5)


def test_near_equal_regions_keep_the_first_of_a_chain(spark):
    # a ~ b and b ~ c but not a ~ c: b goes, c stays.
    rows = [(1, 0, 1, 0.0, 0.0, 5.0, 5.0), (1, 0, 2, 0.008, 0.0, 5.0, 5.0), (1, 0, 3, 0.016, 0.0, 5.0, 5.0)]
    got = regions.dedupe_regions(spark.createDataFrame(rows, REGION)).collect()
    assert sorted(r.region_id for r in got) == [1, 3]


def test_hot_page_of_copies_is_merged(spark):
    hot = spark.range(30000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("page_index"), F.col("id").alias("region_id"),
                                    *[F.lit(v).alias(c) for c, v in zip("xywh", (1.0, 2.0, 3.0, 4.0))])
    assert [r.region_id for r in regions.dedupe_regions(hot).collect()] == [0]


def test_bullets_claim_each_square_once(spark):
    rows = [(0, "First item that is long enough", 30, 100, 150, 10), (0, "continues on a second line ok", 30, 88, 150, 10),
            (0, "Second item that is long too", 30, 76, 150, 10)]
    lines = layout.assign_blocks(layout.lines(run_rows(spark, rows)))
    squares = spark.createDataFrame([(1, 0, 1, 19.0, 101.5, 3.0, 3.0), (1, 0, 2, 19.0, 77.5, 3.0, 3.0)], REGION)
    marks = bullets.bullet_markers(lines, squares)
    assert sorted((r.line_ord, r.region_id) for r in marks.collect()) == [(1, 1), (3, 2)]
    lists = bullets.bullet_lists(lines, layout.blocks(lines), marks).collect()
    assert len(lists) == 1 and lists[0].n_items == 2
    assert lists[0].editor_text == ("• First item that is long enough continues on a second line ok\n"
                                    "• Second item that is long too")
    one = squares.where("region_id = 1")
    assert bullets.bullet_lists(lines, layout.blocks(lines), bullets.bullet_markers(lines, one)).count() == 0


def test_document_text_cap(spark):
    pages = spark.createDataFrame([(1, 0, "A" * 200), (1, 1, ""), (2, 0, " short ")], "doc_id long, page_index int, text string")
    got = {r.doc_id: r for r in doctext.document_text(pages, max_chars=80).collect()}
    assert len(got[1].full) == 80 and got[1].full.endswith("\n[…document truncated…]")
    assert got[1].char_count == len("[Page 1]\n") + 200 + 2 + len("[Page 2]")
    assert got[2].full == "[Page 1]\nshort"
    parts = {r.doc_id: r.full for r in doctext.document_text(pages, max_chars=80, pages_per_part=1).collect()}
    assert parts[1] == got[1].full
    with pytest.raises(ValueError):
        doctext.document_text(pages, max_chars=10)


def brute_wrap(text, n):
    import re
    out = []
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        cur, done = "", []
        for tok in re.findall(r"\s+|\S+", line):
            if len(cur + tok) <= n:
                cur += tok
                continue
            if cur:
                done.append(cur)
                cur = ""
            while len(tok) > n:
                done.append(tok[:n])
                tok = tok[n:]
            cur = tok
        out += [*done, cur]
    return out


@pytest.mark.parametrize("general", [False, True])
def test_wrapping_matches_brute_force(spark, general):
    rng = random.Random(3)
    docs = ["".join(rng.choice("ab  \n") * rng.choice([1, 1, 2, 13]) for _ in range(60)) for _ in range(30)] + ["x" * 40, " ", "a\r\nb"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    measure = (lambda t: F.length(t) * F.lit(1.0)) if general else doctext.CharWidth(1.0)
    got = {}
    for r in doctext.wrap_chunks(df, 10.0, measure=measure).orderBy("doc_id", "chunk_ord").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert got == {i: brute_wrap(t, 10) for i, t in enumerate(docs) if t}
    with pytest.raises(ValueError):
        doctext.wrap_chunks(df, 0.0)


def test_rows_mode_difference_is_the_running_mean(spark):
    # A slow slope: each step is within tolerance, the whole is not.
    rows = [(0, f"w{i}", 30 * i, 100 - 1.4 * i, 20, 10) for i in range(6)]
    window = layout.assign_rows(run_rows(spark, rows)).select("row_id").distinct().count()
    exact = layout.assign_rows(run_rows(spark, rows), "exact").select("row_id").distinct().count()
    assert window == 1 and exact > 1


def test_running_median():
    import statistics
    import time
    rng = random.Random(4)
    for _ in range(60):
        values, m = [], layout.RunningMedian()
        assert m.value() is None
        for _ in range(rng.randrange(1, 60)):
            values.append(rng.choice([1.0, 2.5, rng.uniform(-5, 5)]))
            m.add(values[-1])
            assert m.value() == statistics.median(values)
    began, state = time.process_time(), layout._Blocks()
    for i in range(60_000):  # one paragraph of very many lines
        state.add((1e7 - 14.0 * i - (i % 3) * 0.1, 40.0, 400.0, 10.0, "s", True, False, 10.0))
    assert state.count == 1 and time.process_time() - began < 5


def test_next_block_below_against_all_pairs(spark):
    rng = random.Random(31)
    block, wanted = [], []
    for page in range(6):
        for k in range(40):
            block.append((1, page, k, float(rng.randrange(0, 500, 20)), float(rng.randrange(0, 700, 10)), float(rng.choice([1, 30, 200, 450])), 10.0))
    lists = [(d, p, k, x, y, w, h, x - 1, y - 1, w + 2, h + 2) for d, p, k, x, y, w, h in block if k % 4 == 0]
    block.append((1, 0, 90, float("inf"), 5.0, 10.0, 10.0))
    brows = spark.createDataFrame(block, "doc_id long, page_index int, block_ord long, x double, y double, w double, h double")
    names = [f"{p}_{c} double" for p in ("list", "cover") for c in "xywh"]
    lrows = spark.createDataFrame(lists, "doc_id long, page_index int, block_ord long, " + ", ".join(names))
    for d, p, k, x, y, w, h, _, cy, _, ch in lists:
        under = [(by + bh, -bk) for _, bp, bk, bx, by, bw, bh in block if bp == p and bk != k and by + bh <= cy + 0.5
                 and min(x + w, bx + bw) - max(x, bx) >= max(2.0, min(w, bw) * 0.2)]
        top, near = max(under, default=(0.0, None))
        wanted.append((p, k, None if near is None else -near, max(0.0, cy + ch - top)))
    got = layout.next_block_below(lrows, brows).select("page_index", "block_ord", "next_block_ord", "available_height_pt").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(wanted, key=repr)

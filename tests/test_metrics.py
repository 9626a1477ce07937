"""Advance widths: wrapping, styled wrapping and fitting against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pageloom.functions import metrics
from pageloom.functions import text as tx
from pageloom.operators import doctext

NAMES = list(metrics.FACES)
CHARS = ["a", "W", "il", "é", "日", "”", " ", "  ", "\n", "\t", "Í", "𝒳", "-"]


def brute_wrap(text, limit, width):
    """``width`` maps a list of (character, style) to thousandths."""
    out, lines, style = [], [[]], iter(range(len(text)))
    for c in text:
        at = next(style)
        if c == "\n":
            lines.append([])
        else:
            lines[-1].append((c, at))
    for line in lines:
        done, cur = [], []
        spelled = "".join(c for c, _ in line)
        for m in re.finditer(r"\s+|\S+", spelled):
            token = line[m.start():m.end()]
            if width(cur + token) <= limit:
                cur = cur + token
                continue
            if cur:
                done.append(cur)
                cur = []
            if width(token) <= limit:
                cur = token
                continue
            for c in token:
                if cur and width([*cur, c]) > limit:
                    done.append(cur)
                    cur = [c]
                else:
                    cur = [*cur, c]
        out += ["".join(c for c, _ in x) for x in [*done, cur]]
    return out


def texts(seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(CHARS) * rng.choice([1, 1, 2, 9]) for _ in range(60)) for _ in range(24)] + [
        "x" * 1500, " ", "a\nb", "W", "\n", "word and " * 900, "one\n\ntwo  "]


def plain_width(font):
    known = metrics.widths(font)
    return lambda chars: sum(known.get(c, metrics.FALLBACK) for c, _ in chars)


@pytest.mark.parametrize("width", [0.3, 7.0, 60.0, 220.0])
def test_wrapping_by_advance_widths(spark, width):
    rows = [(i, t, NAMES[i % 12]) for i, t in enumerate(texts(3))]
    df = spark.createDataFrame(rows, "doc_id long, text string, font string")
    got = {}
    for r in doctext.wrap_chunks(df, width, measure=metrics.FontWidth(F.col("font"), 10.0)).orderBy("doc_id", "chunk_ord").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    for i, t, font in rows:
        assert got[i] == brute_wrap(t, int(width * 100 + 1e-9), plain_width(font)), (i, font)


def test_widths_known_and_at_the_limit(spark):
    # Widths of "Ag" by the published tables; a text exactly as wide as the limit stays on one line.
    assert [metrics.widths(n)["A"] + metrics.widths(n)["g"] for n in ("Helvetica", "Helvetica-Bold", "Times-Roman", "Times-BoldItalic", "Courier")] == [
        1223, 1333, 1222, 1167, 1200]
    assert all(len(x.split()) == 95 + len(metrics.TYPOGRAPHIC) for x in metrics.FACES.values())
    df = spark.createDataFrame([("Ag Ag", 12.0, 1223 * 2 + 278), ("Ag Ag", 12.0, 1223 * 2 + 277), ("", 12.0, 5000), (None, 12.0, 5000), ("Ag", 0.0, 5000), ("Ag", None, 5000)],
                               "text string, size double, units long")
    lines = doctext.wrap_lines(F.col("text"), F.col("units") * F.col("size") / 1000, metrics.FontWidth("Helvetica", F.col("size")))
    assert [r.x for r in df.select(lines.alias("x")).collect()] == [["Ag Ag"], ["Ag ", "Ag"], [], None, None, None]
    got = df.select(metrics.FontWidth("Times-Roman", 10.0)(F.col("text")).alias("w")).first().w
    assert got == pytest.approx((722 + 500) * 2 * 0.01 + 2.5)
    with pytest.raises(ValueError):
        doctext.wrap_lines(F.col("text"), 0.0, metrics.FontWidth("Courier", 10.0))


def test_running_starts_of_long_arrays(spark):
    for n in (0, 1, 127, 128, 129, 1000):
        got = spark.range(1).select(tx.running_starts(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x) if n else F.array().cast("array<int>")).alias("s")).first().s
        assert got == [i * (i + 1) // 2 for i in range(n)]


def test_styled_wrapping_by_advance_widths(spark):
    rng, rows = random.Random(9), []
    for i, t in enumerate(texts(5)):
        cuts = sorted(rng.sample(range(len(t) + 1), min(len(t), 6)))
        parts = [t[a:b] for a, b in zip([0, *cuts], [*cuts, len(t)])]
        rows.append((i, [(p, rng.random() < 0.5, rng.random() < 0.5) for p in parts]))
    df = spark.createDataFrame(rows, "doc_id long, spans array<struct<text:string,bold:boolean,italic:boolean>>")
    got, flags = {}, {}
    for r in doctext.wrap_spans(df, 60.0, measure=metrics.StyledWidth("serif", 10.0)).orderBy("doc_id", "line_ord", "wrap_ord").collect():
        got.setdefault(r.doc_id, []).append(r.text)
        flags.setdefault(r.doc_id, []).extend((c, s.bold, s.italic) for s in r.spans for c in s.text)
    names = {(b, i): n for f, b, i, n in tx.STANDARD_FONTS if f == "serif"}
    tables = {k: metrics.widths(n) for k, n in names.items()}
    for i, spans in rows:
        styled = [(c, b, it) for t, b, it in spans for c in t]
        width = lambda chars: sum(tables[styled[at][1:]].get(c, metrics.FALLBACK) for c, at in chars)  # noqa: B023, E731
        assert got.get(i, []) == brute_wrap("".join(c for c, _, _ in styled), 6000, width), i
        assert flags[i] == [x for x in styled if x[0] != "\n"]


def brute_fit(text, width, height, most, least, font):
    known = plain_width(font)

    def lines(size):
        limit = int(width * 1000 / size)
        limit += (limit + 1) * size / 1000 <= width
        limit -= limit * size / 1000 > width
        return brute_wrap(text, limit, known) if text else []

    def used(size):
        n = len(lines(size))
        return size + (n - 1) * size * 1.2 if n else 0

    most = max(0.1, most)
    least = min(most, max(0.1, least))
    if used(most) <= height + 0.001:
        return most, lines(most)
    low, high, best = least, most, least
    for _ in range(18):
        mid = (low + high) / 2
        if used(mid) <= height + 0.001:
            low = best = mid
        else:
            high = mid
    return best, lines(best)


def test_fitting_text_to_a_box(spark):
    rng = random.Random(12)
    rows = [(i, t, rng.choice([40.0, 120.0, 300.0]), rng.choice([9.0, 60.0, 400.0]), rng.choice([8.0, 24.0]), NAMES[i % 12]) for i, t in enumerate(texts(7)) if len(t) < 800]
    rows += [(90, "", 10.0, 10.0, 9.0, "Courier"), (91, "too long to fit", 20.0, 1.0, 9.0, "Courier"), (92, "a", 10.0, 10.0, 0.0, "Courier")]
    bad = [(95, "x", None, 5.0, 9.0, "Courier"), (96, "x", 5.0, 0.0, 9.0, "Courier"), (97, "x", float("nan"), 5.0, 9.0, "Courier")]
    df = spark.createDataFrame(rows + bad, "id long, text string, width double, height double, max_size_pt double, font string")
    got = {r.id: r for r in doctext.fit_text(df, F.col("font")).collect()}
    for i, text, width, height, most, font in rows:
        size, lines = brute_fit(text, width, height, most, 4.0, font)
        assert got[i].size_pt == size and got[i].lines == lines, (i, font)
        assert got[i].used_height_pt == (pytest.approx(size + (len(lines) - 1) * size * 1.2) if lines else 0)
    assert all(got[i].size_pt is None and got[i].lines is None for i, *_ in bad)

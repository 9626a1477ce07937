"""Each operator on hand-made rows: brute force, round trips, edge cases."""

import collections
import hashlib
import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from pageloom.llm import dac, graph, leaks, lengths, lines, minhash, mixing, quality, queries, repeats, tokens, toxicity, urls
from pageloom.llm.common import covered, grams

WORDS = ["alder", "birch", "cedar", "delta", "ember", "fjord", "grove", "heath", "islet", "jetty", "knoll", "larch", "moor", "nook"]
DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()),
                    T.StructField("_rank", T.StringType())])


def made(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "x", "ing", "s"]) + str(rng.randrange(30)) for _ in range(n))


def rows(seed=3):
    """Copies, near copies, shared passages, nulls, blanks, a very long text, repeated ids and rows."""
    rng = random.Random(seed)
    base = [made(rng, rng.randrange(5, 120)) for _ in range(25)]
    out = [(i, t) for i, t in enumerate(base)]
    for i in range(25, 60):
        w = base[i % 9].split()
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = "edited" + str(rng.randrange(9))
        out.append((i, " ".join(w)))
    passage = made(rng, 30)
    out += [(i, made(rng, 20) + "\n" + passage + " " + made(rng, 9)) for i in range(60, 70)]
    out += [(70, None), (71, ""), (72, " \t\n "), (73, "one"), (74, "two words"), (75, " ".join(["again"] * 40)),
            (76, "ÉTÉ naïve ß \u00a0 x\u2003y " * 8), (77, made(rng, 30_000)), (None, passage), (None, None), (5, base[5]), (6, base[7])]
    return out


def frame(spark, data, sources=("a", "b", None)):
    return spark.createDataFrame([(i, t, "en", sources[(i or 0) % len(sources)], None, "kept", "x") for i, t in data], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, rows()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


# --- helpers -----------------------------------------------------------------------------------

def test_grams_and_coverage():
    h = np.array([1, 2, 3, 1, 2, 3], np.uint64)
    g = grams(h, 3)
    assert g[0] == g[3] and len(set(g.tolist())) == 3 and len(grams(h, 7)) == 0
    assert covered(np.array([0, 1, 0, 0], bool), 2, 5).tolist() == [False, True, True, False, False]


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 7), (None, 3)], "a long, b long")
    assert {r["node"]: r["label"] for r in graph.components(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}
    assert graph.components(links.limit(0)).count() == 0


# --- toxicity ----------------------------------------------------------------------------------

def test_segments_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 25)
        at = sorted(rng.sample(range(n), rng.randrange(0, n + 1)))
        scores = [rng.choice([-2.0, 0.5, 1.5, 4.0]) for _ in at]
        full = [-toxicity.DRIFT] * n
        for i, s in zip(at, scores):
            full[i] = s
        best = max((sum(full[a:b]) for a in range(n) for b in range(a + 1, n + 1)), default=0)
        found = toxicity.maximal_segments(at, scores)
        assert math.isclose(max([s for s, _, _ in found], default=0.0), max(best, 0.0), abs_tol=1e-9)
        for (s, a, b), later in zip(found, [*found[1:], (0, n, n)]):
            assert math.isclose(s, sum(full[a:b])) and b <= later[1]


def toxic_rows():
    rng = random.Random(8)
    data, marks = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = made(rng, 60).split()
        if bad:
            for _ in range(6):
                w[rng.randrange(60)] = rng.choice(["vilest", "cursed", "wretchedly"])
        data.append((i, " ".join(w)))
        marks.append((i, 1, int(bad)))
    return data, marks


def test_toxicity_held_out(spark):
    data, marks = toxic_rows()
    docs = frame(spark, data + [(600, None), (601, ""), (None, "vilest cursed")])
    labels = spark.createDataFrame(marks + [(None, 1, 1), (3, 1, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model, passages=True).collect()}
    assert len(got) == 603
    held = [i for i, _ in data if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((got[i]["score"] >= 0.3) == (i % 5 == 0) for i in held)
    assert 0 <= got[600]["score"] == got[601]["score"] < 0.3
    text = dict(data)[0]
    assert any("vilest" in text[p["start"]:p["end"]] or "cursed" in text[p["start"]:p["end"]] or "wretch" in text[p["start"]:p["end"]]
               for p in got[0]["passages"])


def test_toxicity_without_labels(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert toxicity.score(docs, model).where("score >= 0.3").count() == 0
    assert toxicity.score(empty, model).count() == 0


def test_segments_in_linear_time():
    """Sparse hits that never join, joining ones, and both in turn: the steps grow with the hits."""
    for gap in (40, 3):
        for n in (4_000, 64_000):
            began = time.process_time()
            toxicity.maximal_segments([gap * i for i in range(n)], [5.0 if i % 7 else 0.7 for i in range(n)])
            assert time.process_time() - began < n * 2e-5 + 0.05


# --- clashing names, shared ids ----------------------------------------------------------------

def test_helper_columns_never_clash(spark):
    names = ["_g_id", "_rank", "_twice", "_m_id", "_m_content", "_m_epoch", "_m_at", "_m_words", "_m_n", "_size", "_r_id", "_r_text", "_r_runs", "_text_hash",
             "_line_doc", "_line_row", "_line_cut", "_copy_key", "size", "n", "row", "key", "at", "cell"]
    rng = random.Random(3)
    data = [(i, made(rng, 40) if i % 3 else "one text here\nof several lines and words that come again and again in full", "a") for i in range(12)]
    plain = spark.createDataFrame(data, "doc_id long, text string, source string")
    odd = plain.select("*", *(F.lit(k).alias(c) for k, c in enumerate(names)))
    for fn in (minhash.without_near_duplicates, mixing.mixed_documents, repeats.without_repeats, lines.without_repeated_lines):
        got, want = fn(odd), fn(plain)
        same = plain.columns + [c for c in want.columns if c not in plain.columns]
        assert set(got.columns) == {*odd.columns, *same}
        assert sorted(map(tuple, got.select(same).collect())) == sorted(map(tuple, want.select(same).collect()))
        assert got.select(names).distinct().count() == 1


def test_rows_of_one_id_keep_their_own_lines_and_copies(spark):
    data = [(1, "a b c d e"), (3, "a b c d e\nx y z"), (3, "unique line of its own\nk l m")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in data], "doc_id long, text string, source string")
    got = sorted((r["doc_id"], r["text"]) for r in lines.without_repeated_lines(docs).collect())
    assert got == [(1, "a b c d e"), (3, "unique line of its own\nk l m"), (3, "x y z")]
    same = spark.createDataFrame([(7, "one two three four", "s"), (7, "five six", "s"), (7, "seven", "t"), (7, "seven", "t")], "doc_id long, text string, source string")
    out = [(r["text"], r["source"]) for r in mixing.mixed_documents(same, weight=lambda rank: F.lit(1.0)).collect()]
    taken = mixing.mix(same, weight=lambda rank: F.lit(1.0)).collect()
    for text, source in {(r["text"], r["source"]) for r in same.collect()}:
        n, own = len(text.split()), [r["taken"] for r in taken if r["source"] == source and r["size"] == len(text.split())]
        assert abs(out.count((text, source)) / len(own) - sum(own) / len(own) / n) <= 1.01


# --- tokens ------------------------------------------------------------------------------------

def test_pieces_encode_like_whole_texts():
    with open(tokens.VOCABULARY, encoding="utf-8") as f:
        enc = tokens.Encoder(f.read())
    rng = random.Random(2)
    parts = ["a", "The", " ", "  ", "\n", "\n\n", "\t", "'s", "!", "é", "1", "23", "\xa0", "\x1c", "\x85", ".", "\u3000", "don't", "<|endoftext|>",
             "日本", "\r\n", "ab.", ",", "_", "٣", "ª", "word" * 30]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert enc.encode([text])[0] == enc.whole(text), repr(text)


def test_many_pieces_stay_remembered():
    """350,000 different pieces lie in one generation; texts of no, one and two pieces look them up like long ones."""
    with open(tokens.VOCABULARY, encoding="utf-8") as f:
        enc = tokens.Encoder(f.read())
    texts = ["", "a", "a b", "a b c", "\n", "a\nb", " b", None]
    assert enc.encode(texts) == [enc.whole(t) if t else b"" for t in texts]
    enc.known.merge = enc.known.whole = lambda word: b"xy"
    enc.encode([" ".join(f"{k}a" for k in range(350_000))])
    assert not enc.known.older and len(enc.known) >= 349_999


def test_length_sums(spark, docs, empty):
    enc = tokens.Encoder(open(tokens.VOCABULARY, encoding="utf-8").read())
    sizes = [len(enc.tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t in rows()]
    sums = lengths.suffix_sums(lengths.histogram(docs)).cache()
    for r in sums.collect():
        k = r["length"]
        assert r["n_docs"] == sizes.count(k)
        assert r["docs_at_least"] == sum(x >= k for x in sizes) and r["tokens_at_least"] == sum(x for x in sizes if x >= k)
        assert r["docs_up_to"] == sum(x <= k for x in sizes) and r["tokens_up_to"] == sum(x for x in sizes if x <= k)
        assert r["truncated_total"] == sum(min(x, k) for x in sizes)
    for r in lengths.at_limits(sums, [0, 7, 64, 1_000_000]).collect():
        assert r["truncated_total"] == sum(min(x, r["context_limit"]) for x in sizes)
        assert r["docs_longer"] == sum(x > r["context_limit"] for x in sizes)
    assert lengths.quantile(sums, 0.5).first()[0] == sorted(sizes)[math.ceil(0.5 * len(sizes)) - 1]
    assert lengths.suffix_sums(lengths.histogram(empty)).count() == 0


def test_token_codes_round_trip(spark, docs, empty, tmp_path):
    path = str(tmp_path / "codes")
    dac.write_tokens(docs, path, shard_tokens=500)
    enc = tokens.Encoder(open(tokens.VOCABULARY, encoding="utf-8").read())
    data = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    got = dac.read_tokens(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [i for i, _ in data]
    crc = lambda t: zlib.crc32(np.array([*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
    assert sorted((r["doc_id"] or -1, r["ids_crc32"]) for r in got) == sorted((-1 if i is None else i or -1, crc(t)) for i, t in data)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    dac.write_tokens(empty, str(tmp_path / "none"))
    assert dac.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_shard_random_access():
    rng = np.random.default_rng(4)
    parts = [rng.choice([3, 255, 256, 70_000, 2**31 + 5, 2**32 - 1], n).astype(np.uint32) for n in (0, 1, 511, 512, 513, 2000)]
    shard = dac.Shard(dac.pack_shard([4, None, 6, 7, 8, 9], parts, 4))
    flat = np.concatenate(parts)
    assert shard.doc_ids == [4, None, 6, 7, 8, 9]
    assert [shard.token(i) for i in range(len(flat))] == flat.tolist()
    assert all((shard.document(k) == p).all() for k, p in enumerate(parts))
    with pytest.raises(ValueError):
        dac.Shard(b"nope" + bytes(40))


# --- decontamination ---------------------------------------------------------------------------

def test_alignment_against_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        a = np.array([rng.randrange(5) for _ in range(rng.randrange(1, 9))], np.uint64)
        b = np.array([rng.randrange(5) for _ in range(rng.randrange(1, 12))], np.uint64)
        best, h = 0, np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
                best = max(best, h[i, j])
        score, start, stop = leaks.align(a, b)
        assert score == best and 0 <= start <= stop <= len(b)


def test_leaks(spark, docs, empty):
    rng = random.Random(6)
    items = {k: made(rng, 40) for k in range(6)}
    cut = items[3].split()
    edited = [w if i % 7 else "changed" for i, w in enumerate(cut)]
    data = [(1, made(rng, 200)), (2, made(rng, 50) + " " + items[0] + " " + made(rng, 50)), (3, made(rng, 70) + " " + " ".join(edited)),
            (4, items[1].upper() + "!"), (5, " ".join(items[2].split()[:6]) + " " + made(rng, 60)), (6, None), (None, items[0]), (7, ""),
            *((i, items[4] + " " + made(rng, 5)) for i in range(10, 40))]
    tests = spark.createDataFrame([*items.items(), (90, None), (None, "x y z"), (91, ""), (92, "tiny one")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(frame(spark, data), tests).collect()}
    assert got == {(2, 0), (3, 3), (4, 1), *((i, 4) for i in range(10, 40))}
    kept = leaks.without_leaks(frame(spark, data), tests)
    assert kept.columns == DOC.names and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 5, 6, 7]
    assert leaks.find_leaks(empty, tests).count() == 0
    assert leaks.find_leaks(docs, tests.limit(0)).count() == 0


def brute_leaks(data, items):
    """(doc, item) -> the best alignment of the whole item in the whole document, of those that are enough."""
    coded, out = {}, {}
    code = lambda t: np.array([coded.setdefault(w, len(coded)) for w in leaks.normal_words(t)], np.uint64)
    for i, t in data:
        for k, x in items.items():
            own, there = code(x), code(t)
            score = leaks.align(own, there)[0]
            if leaks.enough(score, len(own), leaks.SHARE, leaks.VERBATIM):
                out[i, k] = max(score, out.get((i, k), 0))
    return out


def found_leaks(spark, data, items):
    got = leaks.find_leaks(frame(spark, data), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert len({(r["doc_id"], r["item_id"]) for r in got}) == len(got)
    return {(r["doc_id"], r["item_id"]): r["score"] for r in got}


def test_edited_and_partial_leaks_against_brute_force(spark):
    """Copies of which most n-grams, or all but the most frequent ones, are gone."""
    rng = random.Random(61)
    items = {0: made(rng, 40), 1: made(rng, 40), 2: made(rng, 59), 3: made(rng, 59), 4: made(rng, 44), 5: made(rng, 16)}
    edited = lambda t, k: " ".join(f"edit{i}" if i % k == k - 1 else w for i, w in enumerate(t.split()))
    inside = lambda t: made(rng, rng.randrange(0, 90)) + " " + t + " " + made(rng, rng.randrange(0, 90))
    w2, w3, w4 = (items[k].split() for k in (2, 3, 4))
    gaps = " ".join([*w3[:12], made(rng, 20), *w3[12:22], made(rng, 20), *w3[22:32], made(rng, 20), *w3[32:42], made(rng, 20), *w3[42:54]])
    data = [(1, inside(edited(items[0], 5))), (2, inside(edited(items[1], 4))), (3, inside(" ".join(w2[20:45]))), (4, inside(gaps)),
            (5, inside(" ".join(w4[:18]))), (6, inside(edited(items[5], 4))), (8, inside(" ".join(w2[:8]))),
            *((i, inside(" ".join(w4[25:44]))) for i in range(20, 60)), *((i, inside(" ".join(w2[50:56]))) for i in range(60, 90))]
    want = brute_leaks(data, items)
    assert {(1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (20, 4), (59, 4)} <= set(want) and not {(8, 2), (60, 2)} & set(want)
    assert found_leaks(spark, data, items) == want


def test_leaks_of_long_items_against_brute_force(spark):
    """A long item leaks by what the whole item needs, wherever a quote lies in it, and not by its last words."""
    rng = random.Random(62)
    items = {0: made(rng, 257), 1: made(rng, 260), 2: made(rng, 700), 3: made(rng, 256)}
    w0, w1, w2 = (items[k].split() for k in (0, 1, 2))
    inside = lambda t: made(rng, rng.randrange(0, 90)) + " " + t + " " + made(rng, rng.randrange(0, 90))
    data = [(1, inside(w0[256])), (2, inside(" ".join(w1[256:260]))), (3, inside(" ".join(w1[246:266]))), (4, inside(" ".join(w2[500:524]))),
            (5, inside(items[2])), (6, inside(items[0])), (7, inside(" ".join(w2[500:512]))), (8, inside(" ".join(w2[250:262] + w2[270:282])))]
    want = brute_leaks(data, items)
    assert set(want) == {(3, 1), (4, 2), (5, 2), (6, 0), (8, 2)}
    assert found_leaks(spark, data, items) == want


# --- mixing ------------------------------------------------------------------------------------

def test_mix(spark, docs, empty):
    size = {}
    for i, t in rows():
        s = ("a", "b", None)[(i or 0) % 3]
        size[s] = size.get(s, 0) + len((t or "").encode().split())
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, sum(size.values())
    target, free = {}, set(order)
    while True:  # share, cap, share again
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            break
        target.update({s: 3.0 * size[s] for s in over})
        free -= over
    target.update(share)
    for s in order:
        mine = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == size[s] and math.isclose(r["target"], target[s]) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= 1
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in mine)
    key = lambda r: (r["doc_id"] or -1, r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(empty).count() == 0


def test_positions_invert_the_schedule(spark):
    pieces = F.array(*(F.struct(F.lit(a).alias("t"), F.lit(0.5).alias("dt"), F.lit(b).alias("r0"), F.lit(c).alias("r1"))
                       for a, b, c in ((0.0, 0.5, 1.0), (0.5, 1.0, 1.5))))
    at = spark.range(0, 101).select(F.col("id"), mixing.position(F.col("id"), F.lit(100.0), pieces).alias("t")).collect()
    for r in at:  # the integral of 0.5 + t
        assert math.isclose((0.5 * r["t"] + r["t"] ** 2 / 2) * 100, r["id"], abs_tol=1e-6)


def test_mixed_documents(spark, docs, empty):
    out = mixing.mixed_documents(docs)
    assert out.columns == DOC.names and out.where("doc_id is null").count() == 0
    assert max(r["count"] for r in out.groupBy("doc_id", "text").count().collect()) <= 6
    assert mixing.mixed_documents(empty).count() == 0


def test_pipeline_files_are_in_training_order(spark, docs, tmp_path):
    mixed = corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).cache()
    assert mixed.columns == [*DOC.names, corpus_pipeline.POSITION]
    want = [r["doc_id"] for r in mixed.orderBy(corpus_pipeline.POSITION, "doc_id").collect()]
    got = [r["doc_id"] for r in corpus_pipeline.write_token_files(spark, mixed, str(tmp_path)).orderBy("start").collect()]
    assert got == want and got != sorted(got)


# --- lines -------------------------------------------------------------------------------------

def line_rows():
    rng = random.Random(9)
    pool = [made(rng, rng.randrange(1, 14)) for _ in range(40)]
    out = []
    for i in range(50):
        some = [rng.choice(pool) for _ in range(rng.randrange(1, 6))]
        w = some[0].split()
        if len(w) > 6:
            w[rng.randrange(len(w))] = "swap"
            some.append("  " + "\t".join(w))
        out.append((i, "\n".join([*some, "", "  "])))
    return out + [(60, None), (61, ""), (None, pool[0]), (3, pool[1])]


def test_lines_against_brute_force(spark, empty):
    data = line_rows()
    all_lines = [(i, k, frozenset(x.split(" ") if False else x.replace("\t", " ").split())) for i, t in data if i is not None
                 for k, x in enumerate((t or "").split("\n")) if x.strip()]
    first = {}
    for i, k, s in all_lines:
        first[s] = min(first.get(s, (i, k)), (i, k))
    near = {s: [o for o in first if o != s and 100 * len(s & o) >= 80 * len(s | o)] for s in first}
    # One result a text of an id: repeated rows are reported once, rows of one id with different texts apart.
    want = collections.defaultdict(list)
    for i, t in sorted({x for x in data if x[0] is not None and (x[1] or "").strip()}):
        mine = [(k, frozenset(x.replace("\t", " ").split())) for k, x in enumerate(t.split("\n")) if x.strip()]
        want[i].append([len(mine), sum((i, k) > min([first[s], *(first[o] for o in near[s])]) for k, s in mine), sum(len(near[s]) for _, s in mine)])
    got = collections.defaultdict(list)
    for r in lines.repeated_lines(frame(spark, data)).collect():
        got[r["doc_id"]].append([r["n_lines"], r["n_removed"], r["n_links"]])
    order = lambda found: {i: sorted(x) for i, x in found.items()}
    assert order(got) == order(want) and sum(w[2] for x in want.values() for w in x) > 0
    kept = lines.without_repeated_lines(frame(spark, data))
    assert kept.columns == DOC.names and kept.count() == len(data)
    assert lines.repeated_lines(empty).count() == 0


def test_line_join_query_gives_every_document(spark, tmp_path):
    data = [(1, "a b c d e\nx y"), (2, "x y\nf g h"), (3, None), (4, " \n"), (5, "e d c b a"), (None, "x y")]
    frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_line_join"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None}
    assert {i: r["removed"] for i, r in got.items()} == {1: [], 2: [0], 3: [], 4: [], 5: [0], None: []}
    assert [got[i]["n_lines"] for i in (1, 2, 3, 4, 5)] == [2, 2, 0, 0, 1] and got[3]["classes"] == []
    a, b, c = got[1]["classes"], got[2]["classes"], got[5]["classes"]
    assert a[1]["class_id"] == b[0]["class_id"] and a[0]["class_id"] == c[0]["class_id"] != b[1]["class_id"]
    assert (b[0]["first_doc"], b[0]["first_line"], c[0]["first_doc"], c[0]["first_line"]) == (1, 1, 1, 0)


def test_long_similar_lines_move_once_a_word(spark, monkeypatch):
    """Long lines around one template meet under their first common word; their sets do not move once a pair."""
    rng = random.Random(4)
    words = [f"{'x' * rng.randrange(1, 9)}{k}" for k in range(3000)]
    data, white = [], [" ", "  ", "\t", "\x0b", "\f", "\r"]
    for n in (20, 64, 65, 150, 300):
        base = rng.sample(words, n)
        for _ in range(12):
            w = list(base)
            for at in rng.sample(range(n), rng.randrange(0, n // 8)):
                w[at] = rng.choice(words)
            data.append(rng.choice(["", " "]) + "".join(x + rng.choice(white) for x in w))
    # No two of these are similar, but all share the word that stands first in the order.
    data += ["first" * 9 + " " + " ".join(rng.sample(words, 110)) for _ in range(40)]
    data = list(enumerate(data))
    sets = [frozenset(t.split()) for _, t in data]
    near = [[j for j, o in enumerate(sets) if o != s and 100 * len(s & o) >= 80 * len(s | o)] for s in sets]
    made_rows = {}
    monkeypatch.setattr(lines, "frequent_words", lambda docs, text: [])
    monkeypatch.setattr(lines, "staged_table", lambda df, name: made_rows.setdefault(name, df.cache()))
    got = {r["doc_id"]: (r["n_links"], r["n_removed"]) for r in lines.repeated_lines(frame(spark, data)).collect()}
    same = [min(j for j, o in enumerate(sets) if o == s) for s in sets]
    assert got == {i: (len({sets[j] for j in near[i]}), int(min([same[i], *near[i]]) < i)) for i, _ in data}
    seats = made_rows["line-seats"].collect()
    assert len(seats) < sum(map(len, near)) / 4 and len({r["key"] for r in seats}) <= 60


# --- urls --------------------------------------------------------------------------------------

def test_urls(spark):
    data = [(1, "https://www.Example.com/en/a?x#y"), (2, "http://m.example.com/en/1"), (3, "http://a.net/es/"), (4, "http://net"), (5, None),
            (6, "nothing"), (7, "http://x.org/casino"), (8, "http://x.org/casinos"), (9, "http://x.org/loan-poker"), (10, "http://x.org/loan"),
            (11, "http://x.com/casino"), (12, "http://x.com"), (13, "http://notexample.com/en/"), (14, ""), (15, "a://B?c"), (16, "http://x.org/loan/loan")]
    got = {r["page_id"]: r for r in urls.judge_urls(spark.createDataFrame([(*r, "old") for r in data], "page_id long, url string, rule string")).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert got[2]["rule"] == "example.com/en/" and got[2]["verdict"] == "block" and got[3]["rule"] == "net/es/"
    assert got[4]["rule"] is None and (got[4]["host"], got[4]["path"]) == ("net", "")
    assert (got[5]["host"], got[5]["path"], got[5]["verdict"]) == ("", "", "allow") and got[15]["host"] == "b"
    assert [got[k]["verdict"] for k in (7, 8, 9, 10, 11, 12, 16)] == ["block", "allow", "block", "allow", "allow", "allow", "allow"]
    assert got[13]["rule"] == "com/" and got[12]["rule"] is None


# --- near duplicates ---------------------------------------------------------------------------

def brute_components(data, size, percent):
    sets = {}
    for i, t in data:
        w = (t or "").encode().lower().split()
        s = frozenset(tuple(w[a:a + size]) for a in range(max(1, len(w) - size + 1))) if w else frozenset()
        if i is not None:
            sets.setdefault(i, []).append(s)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, docs, empty, size, percent):
    got = minhash.near_duplicates(docs, shingle=size, percent=percent, bands=30, rows=4).collect()
    assert len(got) == len(rows())
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == brute_components(rows(), size, percent)
    assert minhash.near_duplicates(empty, shingle=size, percent=percent).count() == 0


def test_large_group_of_near_copies(spark):
    """Copies that are close to their origin but often not to each other: no link may be lost."""
    rng = random.Random(12)
    base = made(rng, 150).split()
    data = [(0, " ".join(base))]
    for i in range(1, 400):
        w = list(base)
        for k in rng.sample(range(150), rng.randrange(0, 16)):
            w[k] = f"new{i}x{k}"
        data.append((i, " ".join(w)))
    rng.shuffle(data)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, data), shingle=3, percent=85).collect()}
    assert got == brute_components(data, 3, 85)


def test_bayesian_bounds_and_intersections():
    needed = [minhash.least_matches(n, 0.85, minhash.MISS) for n in (24, 48, 72, 96, 120)]
    assert needed == sorted(needed) and 0 < needed[0] < 24 and needed[-1] < 0.85 * 120
    rng = np.random.default_rng(3)
    a, b = ([np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in sizes] for sizes in ((10, 4000, 6000), (5000, 300)))
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert minhash.intersections(a, b).tolist() == want


def test_without_near_duplicates(docs):
    kept = minhash.without_near_duplicates(docs, shingle=3, percent=85)
    ids = [r["doc_id"] for r in kept.collect()]
    want = brute_components(rows(), 3, 85)
    assert kept.columns == DOC.names
    assert sorted(i for i in ids if i is not None) == sorted({i for i in want if want[i] == i}) and ids.count(None) == 2


# --- quality -----------------------------------------------------------------------------------

def brute_stats(text):
    w = [x.decode() for x in (text or "").encode().split()]
    seen, dup = set(), 0
    for x in (text or "").split("\n"):
        if x.strip(quality.SEPARATORS):
            dup += x in seen
            seen.add(x)
    times = collections.Counter(tuple(w[a:a + 8]) for a in range(len(w) - 7))
    hit = {k for a in range(len(w) - 7) if times[tuple(w[a:a + 8])] > 1 for k in range(a, a + 8)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_quality_stats_and_filter(spark, docs, empty):
    data = rows() + [(90, "a b\na b\n" + made(random.Random(1), 30)), (91, "w#1 " * 40), (92, ("p q r s t u v w x " * 5))]
    got = quality.with_stats(frame(spark, data), "_s").select("doc_id", "text", "_s.*").collect()
    for r in got:
        assert tuple(r[c] for c in quality.LONGS[:5]) == brute_stats(r["text"]), r["doc_id"]
    kept = quality.passes(docs)
    assert kept.columns == DOC.names and not {70, 71, 72, 73, 74, 75} & {r["doc_id"] for r in kept.collect()}
    assert {0, 60} <= {r["doc_id"] for r in kept.collect()} or kept.count() > 20
    assert quality.passes(empty).count() == 0


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(7)
    good = rng.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.9])
    votes = np.where(rng.random((20_000, 4)) < right, np.where(good, 1, -1)[:, None], np.where(good, -1, 1)[:, None])
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit(patterns, counts, list("abcd"))
    assert abs(model.prior - 0.8) < 0.03
    assert all(abs(model.accuracy()[r] - a) < 0.03 for r, a in zip("abcd", right))


# --- repeats -----------------------------------------------------------------------------------

def test_repeats_against_brute_force(spark, docs, empty):
    data = rows() + [(100, "the end " * 30), (101, "the end " * 25), (102, made(random.Random(2), 14) + " " + " ".join(rows()[0][1].split()))]
    got = repeats.without_repeats(frame(spark, data)).collect()
    digest = lambda r: (r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_words"].encode()).hexdigest())
    want = repeats.removed_by_brute_force([r for r in data if r[0] is not None])
    assert sorted(digest(r) for r in got if r["doc_id"] is not None) == sorted(want)
    assert sum(w[2] for w in want) > 0 and all(r["n_removed"] == 0 for r in got if r["doc_id"] is None)
    assert repeats.without_repeats(empty).count() == 0

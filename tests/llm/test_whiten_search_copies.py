"""Whitening, ranked search and exact duplicates against brute force, with their edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm import copies, lexical, queries, whitening
from workloads.check import compare

# --- whitening ---------------------------------------------------------------------------------

VECTOR = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("whitened", T.StringType()),
                       T.StructField("_steps", T.StringType()), T.StructField("x", T.LongType()), T.StructField("at", T.LongType())])


def vectors(spark, data):
    return spark.createDataFrame([(i, v, "w", "s", 1, None) for i, v in data], VECTOR)


@pytest.mark.parametrize("matrix", [
    np.diag([5.0, 4, 3, 2, 1]), np.eye(4), np.zeros((3, 3)), np.array([[2.0]]), np.diag([1, 1e-8, 1e-12, 1e-15]), np.ones((6, 6)),
    np.diag([1e6] + [1.0] * 20), np.array([[2.0, 1], [1, 2]])])
def test_components_of_special_matrices(matrix):
    values, columns = whitening.spectral_components(matrix, 4)
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:4], atol=1e-14 * max(1, np.linalg.norm(matrix)), rtol=0)
    assert np.abs(columns.T @ columns - np.eye(columns.shape[1])).max() < 1e-14
    assert np.linalg.norm(matrix @ columns - columns * values) <= 1e-13 * max(np.linalg.norm(matrix), 1)


def test_components_of_random_matrices():
    rng = np.random.default_rng(5)
    for n in (2, 3, 7, 20, 64, 130):
        x = rng.normal(size=(3 * n, n)) @ rng.normal(size=(n, n))
        v = np.cov(x.T)
        values, columns = whitening.spectral_components(v, n)
        want, basis = np.linalg.eigh(v)
        assert np.allclose(values, want[::-1], atol=1e-13 * np.linalg.norm(v), rtol=0)
        assert np.abs(v @ columns - columns * values).max() < 1e-13 * np.linalg.norm(v)
    assert np.allclose(whitening.polar_sign(np.diag([3.0, -1e-9, -7])), np.diag([1, -1, -1]), atol=1e-12)


def brute_whitening(data, k=4):
    """Exact steps and sums, a plain eigendecomposition."""
    fine = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in data if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in fine})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    mean = np.array(s) / n
    cov = (np.array(fit) - mean).T @ (np.array(fit) - mean) / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return n, [(i, sum((n * a - b) ** 2 for a, b in zip(x, s)), (np.array(x) - mean) @ v / np.sqrt(e)) for i, x in fine], e / np.trace(cov)


def test_whitening_against_brute_force(spark):
    rng = np.random.default_rng(8)
    base = (rng.normal(size=(150, 9)) @ rng.normal(size=(9, 9)) / 5).astype(np.float32)
    data = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    data += [(200 + i, data[3][1]) for i in range(90)] + [(3, data[3][1]), (None, data[4][1]), (400, None), (401, [1.0] * 8 + [None]),
             (402, [float("nan")] * 9), (403, [float("-inf")] + [0.0] * 8), (404, [-0.0] * 9)]
    rows = whitening.whitened_components(vectors(spark, data)).collect()
    n, want, shares = brute_whitening(data)
    got = {}
    for r in rows:
        assert r["n"] == n and abs(r["explained"] - shares[r["component"] - 1]) < 1e-12 and 0 <= r["identity_error"] < 1e-10
        got.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
    assert len(rows) == 4 * len(want)
    sign = {}
    for i, deviation, white in want:
        for c in range(4):
            found = got[(i, deviation)][c + 1][0]
            sign.setdefault(c, 1 if found * white[c] > 0 else -1)
            assert math.isclose(found, sign[c] * white[c], rel_tol=1e-9, abs_tol=1e-9)


def test_whitening_edges(spark):
    assert whitening.whitened_components(vectors(spark, [])).count() == 0
    assert whitening.whitened_components(vectors(spark, [(1, None), (2, [None])])).count() == 0
    assert whitening.whitened_components(vectors(spark, [(1, []), (2, [])])).count() == 0
    assert whitening.whitened_components(vectors(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).count() == 0
    flat = whitening.whitened_components(vectors(spark, [(1, [0.5, 1.0, 0.0]), (2, [1.5, 1.0, 0.0]), (1, [0.5, 1.0, 0.0])])).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in sorted(flat)] == [
        (1, 1, 2, 256 ** 2, 1.0, 1.0), (1, 1, 2, 256 ** 2, 1.0, 1.0), (2, 1, 2, 256 ** 2, 1.0, 1.0)]
    with pytest.raises(ValueError, match="one length"):
        whitening.whitened_components(vectors(spark, [(1, [0.5]), (2, [1.5, 1.0])]))
    table = vectors(spark, [(1, [0.5, 2.0]), (2, [1.5, 1.0]), (3, [0.1, 0.0]), (4, None)])
    model, _ = whitening.fit(table)
    out = whitening.project(table, model)
    assert set(out.columns) == {*table.columns, "deviation"} and out.count() == 3 and out.schema["whitened"].dataType.simpleString() == "array<double>"
    assert whitening.project(table, None).count() == 0


def test_deviation_beyond_doubles(spark):
    data = [(i, [float(np.float32(32 * (i + 1) + 0.37)), 0.0]) for i in range(300)]
    n, want, _ = brute_whitening(data, 1)
    rows = whitening.whitened_components(vectors(spark, data)).where("component = 1").collect()
    assert {r["vec_id"]: r["deviation"] for r in rows} == {i: d for i, d, _ in want} and max(d for _, d, _ in want) > 2 ** 53


# --- ranked search -----------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEM = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("doc_id", T.StringType()), T.StructField("item", T.LongType())])
DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("item_id", T.LongType()),
                    T.StructField("score", T.StringType()), T.StructField("rank", T.StringType()), T.StructField("_copy_key", T.StringType())])


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_search(docs, items, limit=20):
    bags = [(i, Counter(TERM.findall(low(t)))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    count, total, df = len(bags), sum(n for _, _, n in bags), Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in {(i, t) for i, t in items if t}:
        asked, scored = Counter(TERM.findall(low(text))), []
        for i, b, n in bags:
            m = 100 - 25 + 25 * n * count // total
            s = sum(k * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10 ** 9 * b[t] // (1000 * b[t] + 12 * m)) for t, k in asked.items() if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:limit], 1)]
    return sorted(out, key=repr)


def corpus(rng, n):
    common, rare = [f"w{i}" for i in range(12)], [f"R{i}é" for i in range(300)]
    out = []
    for i in range(n):
        words = rng.choices(common, k=rng.randrange(3, 60)) + rng.choices(rare, k=rng.randrange(0, 12))
        rng.shuffle(words)
        out.append((i, rng.choice([" ", ", ", "\n"]).join(words)))
    out += [(n + i, out[5][1]) for i in range(40)] + [(n + 50, None), (n + 51, ""), (n + 52, " -_-\x00 "), (n + 53, "w1 " * 40_000 + "r7É r7é"), (None, out[5][1]), (5, out[5][1])]
    return out


def doc_rows(spark, data):
    return spark.createDataFrame([(i, t, 7, "s", None, "c") for i, t in data], DOC)


def item_rows(spark, data):
    return spark.createDataFrame([(i, t, "d", 0) for i, t in data], ITEM)


@pytest.mark.parametrize("seeds, chunk, block, items", [(4096, 1024, 32, 2000), (40, 64, 4, 2000), (25, 16, 2, 8)])
def test_search_against_brute_force(spark, monkeypatch, seeds, chunk, block, items):
    rng = random.Random(seeds)
    for name, value in (("SEEDS", seeds), ("CHUNK", chunk), ("BLOCK", block), ("ITEMS", items)):
        monkeypatch.setattr(lexical, name, value)
    docs = corpus(rng, 400)
    asked = [(i, " ".join(rng.choices([f"w{k}" for k in range(12)], k=6) + rng.choices([f"r{k}é" for k in range(300)], k=4))) for i in range(20)]
    asked += [(3, asked[3][1]), (30, None), (31, ""), (32, "nowhere to be found"), (33, docs[5][1]), (None, "R1é w1"), (34, "w1 w1 W1"), (35, "r7É")]
    got = lexical.search(doc_rows(spark, docs), item_rows(spark, asked)).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute_search(docs, asked)


def test_blocks_are_skipped_and_bounds_hold():
    rng = np.random.default_rng(2)
    shares = rng.integers(1, 300_000, (512, 40)) * (rng.random((512, 40)) < 0.05)
    shares[:, 0] = rng.integers(400_000, 700_000, 512)
    for topic in range(16):  # a sixteenth of the documents holds the topic's two terms
        shares[topic::16, 1 + 2 * topic:3 + 2 * topic] = rng.integers(500_000, 900_000, (32, 2))
    chunk = lexical.Chunk(shares.astype(np.int32), np.arange(512), np.zeros(512, bool))
    for term in range(40):
        held, starts = chunk.blocks(term)
        assert sorted(held) == np.flatnonzero(shares[:, term]).tolist() and starts[0] == 0 and (np.diff(starts) > 0).all()
    asked = [(np.arange(3), np.array([5, 4, 3])), (np.array([0, 9, 10]), np.array([9, 2, 2]))]
    scores = [shares[:, at] @ w for at, w in asked]
    for reach in (np.array([1, 1]), np.array([sorted(s)[-20] for s in scores])):
        ranker = lexical.Ranker(512, 1, asked, shares.max(0), reach, 20)
        best = [lexical._Best(r, 20) for r in reach]
        seen, scored = chunk.search(ranker, best, lexical._lists(ranker))
        for b, s in zip(best, scores):
            order = np.lexsort((np.arange(512), -s))[:20]
            assert b.ids.tolist() == order[s[order] > 0].tolist() and b.scores.tolist() == s[order][s[order] > 0].tolist()
    assert scored < seen


def test_search_edges(spark):
    docs, items = doc_rows(spark, [(1, "a b"), (2, None)]), item_rows(spark, [(1, "a")])
    none = doc_rows(spark, [])
    for d, i in ((none, items), (docs, items.limit(0)), (docs, item_rows(spark, [(1, None), (2, "-")])), (doc_rows(spark, [(1, None)]), items)):
        assert lexical.search(d, i).count() == 0 and lexical.search(d, i).columns == ["item_id", "rank", "doc_id", "score"]
    assert [tuple(r) for r in lexical.search(docs, items).collect()] == [(1, 1, 1, 287 * (10 ** 9 // (1000 + 12 * 100)))]


# --- exact duplicates --------------------------------------------------------------------------

def copy_rows(rng):
    base = ["".join(rng.choice("abAB é\n") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    data = [(i, rng.choice(base)) for i in range(300)] + [(300 + i, "hot TEXT") for i in range(150)] + [(450 + i, "Hot Text") for i in range(20)]
    data += [(500, None), (501, ""), (502, None), (503, "É"), (504, "é"), (505, "x" * 2_000_000), (506, "X" * 2_000_000), (None, "hot text"), (None, "alone"), (7, "own"), (7, "OWN"), (7, "other")]
    return data


def brute_copies(data, pick):
    groups = {}
    for i, t in data:
        groups.setdefault(low(t), []).append(i)
    out = []
    for i, t in data:
        ids = groups[low(t)]
        known = [x for x in ids if x is not None]
        keep = pick(known) if known else None
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep, pick", [("smallest", min), ("largest", max)])
def test_copies_against_brute_force(spark, keep, pick):
    data = copy_rows(random.Random(4))
    docs = doc_rows(spark, data)
    got = copies.copy_groups(docs, keep=keep)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute_copies(data, pick)
    left = copies.without_copies(docs, keep=keep)
    assert left.columns == docs.columns
    want = Counter((r[0], r[4]) for r in set(brute_copies(data, pick)) if r[3])
    assert Counter((r["doc_id"], hashlib.sha256(low(r["text"]).encode()).hexdigest()) for r in left.collect()) == want


@pytest.mark.parametrize("key", [lambda t: F.length(t), lambda t: F.lit(1), lambda t: F.substring(F.md5(t), 1, 1)])
def test_texts_with_one_hash_are_told_apart(spark, key):
    data = copy_rows(random.Random(6))[:330]
    got = copies.copy_groups(doc_rows(spark, data), keep="largest", key=key)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute_copies(data, max)


def test_copies_edges(spark):
    assert copies.copy_groups(doc_rows(spark, [])).count() == 0 and copies.without_copies(doc_rows(spark, [])).count() == 0
    with pytest.raises(ValueError, match="smallest or largest"):
        copies.copy_groups(doc_rows(spark, []), keep="first")
    plan = copies.copy_groups(doc_rows(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- registered queries ------------------------------------------------------------------------

@pytest.mark.parametrize("name", ["op12_lexical_blocks", "op13_content_hash"])
def test_query_matches_sql(spark, sf, name):
    ok, message = compare(spark, sf, name, queries.QUERIES[name], queries.ORACLES[name])
    assert ok, message


def test_whitening_query_against_brute_force(spark, sf):
    data = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    n, want, shares = brute_whitening(data)
    got = {(r["vec_id"], r["component"]): r for r in queries.QUERIES["op11_qdwh_whitening"](spark, sf).collect()}
    assert len(got) == 4 * len(want)
    sign = [1 if got[(want[0][0], c + 1)]["whitened"] * want[0][2][c] > 0 else -1 for c in range(4)]
    for i, deviation, white in want:
        for c in range(4):
            r = got[(i, c + 1)]
            assert r["deviation"] == deviation and r["n"] == n and math.isclose(r["explained"], shares[c], rel_tol=1e-10)
            assert math.isclose(r["whitened"], sign[c] * white[c], rel_tol=1e-7, abs_tol=1e-9)

"""Toxicity by maximum-scoring segments over token log-odds.

Training. A token's share of toxic documents has a Dirichlet prior: that of its prefix,
which in turn has the overall share as prior. The log-odds against the overall share,
where they are certain enough, are the token's score; every other token costs ``DRIFT``.

Scoring. One linear pass (Ruzzo and Tompa) finds all maximal segments. Scores of segments
in clean text follow an extreme-value law (Karlin and Altschul): a segment of score S in
a text of n tokens is expected K n exp(-lambda S) times. What the significant segments
have beyond that adds up to the document's evidence, and a logistic curve fitted to
labelled documents that the scores have not seen turns it into a probability.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageloom.llm.common import grams, in_arrow, kept_in_worker, mixed, slices, staged_table, word_hasher

WORD = re.compile(r"\w+")
#: Lengths of the prefixes that stand for unseen words; the longest one with a score counts.
PREFIXES = (5, 6, 7)
#: Cost of a token without a score; highest score; how many standard errors make a score certain among very many words.
DRIFT, HIGHEST, CERTAIN = 0.25, 6.0, 5.0
#: Documents' worth of the priors of a prefix and of a word.
PRIOR_PREFIX, PRIOR_WORD = 10.0, 2.0
#: Bounds of the classifier: labelled rows that it is fitted on, and scored tokens and prefixes it keeps.
MAX_ROWS, MAX_FEATURES = 60_000, 100_000
#: A segment is significant if at most this many are expected in clean text of the same length.
EXPECTED = 0.05


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def maximal_segments(at: list[int], scores: list[float], drift: float = DRIFT) -> list[tuple[float, int, int]]:
    """All maximal scoring segments ``(score, first, end)`` of a text whose tokens ``at`` score and all others cost ``drift``.

    A stack of candidates with the sums left of and up to each; a candidate joins the last
    one whose left sum is smaller, if that one's right sum is smaller too. Linear time: a
    candidate knows the last one with a smaller left sum, so those between are passed over,
    and where there is none, all that stand before are final.
    """
    done: list[tuple[float, int, int]] = []
    stack: list[tuple[float, float, int, int, int]] = []  # left sum, right sum, first, end, last one with a smaller left sum
    total, end = 0.0, 0
    for i, s in zip(at, scores):
        total -= drift * (i - end)
        end = i + 1
        left, total = total, total + s
        if s <= 0:
            continue
        first, k = i, len(stack) - 1
        while True:
            while k >= 0 and stack[k][0] >= left:
                k = stack[k][4]
            if k < 0:
                done.extend((r - a, f, e) for a, r, f, e, _ in stack)
                stack = []
            if k < 0 or stack[k][1] >= total:
                stack.append((left, total, first, i + 1, k))
                break
            left, _, first, _, before = stack[k]
            del stack[k:]
            k = before
    return done + [(r - a, f, e) for a, r, f, e, _ in stack]


class _Scores(dict):
    """Score of a word, 0 where it has none: its own, else its prefix's."""

    def __init__(self, features: dict[str, float]):
        self.features = features

    def __missing__(self, word: str) -> float:
        s = self.features.get(word)
        if s is None:
            s = next((self.features[f"^{word[:k]}"] for k in PREFIXES[::-1] if len(word) > k and f"^{word[:k]}" in self.features), 0.0)
        if len(self) >= 300_000:
            self.clear()
        if len(word) <= 64:
            self[word] = s
        return s


def scan(text: str | None, scores: _Scores) -> tuple[int, list[float], list[tuple[float, int, int]]]:
    """Number of tokens, the scores that aren't 0, and the maximal segments."""
    words = words_of(text)
    values = np.fromiter(map(scores.__getitem__, words), np.float64, len(words))
    at = np.flatnonzero(values)
    found = values[at].tolist()
    return len(words), found, maximal_segments(at.tolist(), found) if len(at) else []


@dataclass
class Model:
    features: dict[str, float]
    rate: float = 1.0  # lambda
    size: float = 1.0  # K
    base: float = -4.0
    slope: float = 1.0

    def evidence(self, n: int, segments: Iterable[float]) -> float:
        """What the significant segments score beyond the extreme-value law of clean text of ``n`` tokens."""
        expected = math.log(self.size * max(n, 1))
        return sum(x for x in (self.rate * s - expected for s in segments) if x > -math.log(EXPECTED))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + self.slope * np.log1p(evidence))))


def _training(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, max_rows: int) -> DataFrame:
    """``text, toxic, fold`` of the labelled rows that may be learnt from; at most about ``max_rows``.

    Copies and most near copies count once, for they say nothing new about a word: a row
    stays if no other of its class with the same least 5-word gram, by any of three
    hashes, comes before it.
    """
    marks = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(doc_id)))
    marks = marks.groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    n = marks.count()
    share = min(1.0, max_rows / max(n, 1))
    marks = marks.where(F.pmod(F.xxhash64(F.lit(5), "_id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    # Bounded by max_rows, and so small enough to send to every task.
    rows = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("text")).join(F.broadcast(marks), F.col("_doc") == F.col("_id"))
    fold = F.when(F.crc32(F.col("_doc").cast("string")) % 4 == 3, 1).otherwise(0)
    rows = rows.where(F.col("text").isNotNull()).select("text", "toxic", fold.alias("fold"), F.xxhash64("text").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        hasher, salts = word_hasher(), [np.uint64(x) for x in (0, 0x5555555555555555, 0x3333333333333333)]
        for batch in slices(batches, "text", 4 << 20):
            least = []
            for value in batch.column("text").to_pylist():
                h = hasher(value.lower().encode().split())
                g = grams(h, min(5, len(h))) if len(h) else np.zeros(1, np.uint64)
                least.append([int(mixed(g ^ s).min().astype(np.int64)) for s in salts])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.list_(pa.int64()))], names=[*batch.schema.names, "least"])

    rows = staged_table(rows.transform(in_arrow, run, "text string, toxic int, fold int, h long, least array<long>"), "toxicity-sample")
    place = F.struct("h", "fold")
    narrow = rows.select("h", "toxic", "fold", "least").withColumn("place", place)
    for k in range(3):
        narrow = narrow.withColumn(f"first{k}", F.min("place").over(W.partitionBy("toxic", F.col("least")[k])))
    kept = narrow.where(" and ".join(f"place = first{k}" for k in range(3))).select("h", "toxic", "fold").distinct()
    return rows.join(kept, ["h", "toxic", "fold"], "left_semi").groupBy("h", "toxic", "fold").agg(F.first("text").alias("text")).drop("h")


def _document_counts(rows: DataFrame) -> DataFrame:
    """``feature, n1, n0``: toxic and clean documents with each word and prefix (``^`` before it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in slices(batches, "text", 16 << 20):
            n: tuple[Counter, Counter] = Counter(), Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = set(words_of(text))
                n[toxic != 0].update(words)
                n[toxic != 0].update({f"^{w[:k]}" for w in words for k in PREFIXES if len(w) > k})
            names = [*(n[0].keys() | n[1].keys())]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([n[1][x] for x in names], pa.int64()),
                                              pa.array([n[0][x] for x in names], pa.int64())], names=["feature", "n1", "n0"])

    counted = rows.select("text", "toxic").transform(in_arrow, run, "feature string, n1 long, n0 long")
    return counted.groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def log_odds(counts: DataFrame, toxic: int, clean: int, max_features: int) -> dict[str, float]:
    """Scores of the words and prefixes whose log-odds are certain, the most certain ones first if there are too many."""
    share = (toxic + 0.5) / (toxic + clean + 1.0)
    n1, n0 = F.col("n1"), F.col("n0")
    odds = lambda q: F.log(q / (1 - q)) - math.log(share / (1 - share))
    prefix = counts.where("feature like '^%'").withColumn("q", (n1 + PRIOR_PREFIX * share) / (n1 + n0 + PRIOR_PREFIX))
    words = counts.where("feature not like '^%'").withColumn("p", F.concat(F.lit("^"), F.substring("feature", 1, PREFIXES[0])))
    words = words.join(prefix.select(F.col("feature").alias("p"), F.col("q").alias("pq")), "p", "left")
    prior = F.coalesce("pq", F.lit(share))
    words = words.withColumn("q", (n1 + PRIOR_WORD * prior) / (n1 + n0 + PRIOR_WORD))
    both = prefix.select("feature", "q", F.lit(share).alias("p"), F.lit(PRIOR_PREFIX).alias("w"), "n1", "n0").union(
        words.select("feature", "q", prior.alias("p"), F.lit(PRIOR_WORD).alias("w"), "n1", "n0"))
    error = F.sqrt(1 / (n1 + F.col("w") * F.col("p")) + 1 / (n0 + F.col("w") * (1 - F.col("p"))))
    both = both.withColumn("s", odds(F.col("q"))).withColumn("z", F.abs("s") / error)
    kept = both.where((F.col("z") >= CERTAIN) & (F.col("s") > 0))
    rows = kept.orderBy(F.col("z").desc(), "feature").limit(max_features).collect()
    return {r["feature"]: min(r["s"], HIGHEST) for r in rows}


def _scans(rows: DataFrame, features: dict[str, float]) -> list:
    """Per labelled row, for calibration: ``toxic, n, scores, segments``. The rows are bounded by ``MAX_ROWS``."""
    sent = rows.sparkSession.sparkContext.broadcast(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        scores = _Scores(sent.value)
        for batch in slices(batches, "text", 4 << 20):
            done = [scan(x, scores) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.list_(pa.float64())),
                 pa.array([[s[0] for s in d[2]] for d in done], pa.list_(pa.float64()))], names=["toxic", "n", "scores", "segments"])

    return rows.select("text", "toxic").transform(in_arrow, run, "toxic int, n long, scores array<double>, segments array<double>").collect()


def calibrate(model: Model, scans: list) -> Model:
    """Extreme-value parameters from the clean rows, then the logistic curve from all."""
    clean = [r for r in scans if not r["toxic"]]
    tokens = sum(r["n"] for r in clean) + 1
    values = np.array([s for r in clean for s in r["scores"]] + [HIGHEST])  # one more hit than seen, so that the law is defined
    rest = max(tokens - len(values), 1)
    low, high = 0.0, 20.0
    for _ in range(80):  # sum of p exp(lambda s) = 1
        mid = (low + high) / 2
        if (np.exp(mid * values).sum() + rest * math.exp(-mid * DRIFT)) / tokens < 1:
            low = mid
        else:
            high = mid
    model.rate = max(low, 0.05)
    level = 1.0
    seen = sum(s >= level for r in clean for s in r["segments"]) + 1
    model.size = max(seen / (tokens * math.exp(-model.rate * level)), 1e-6)
    x = np.log1p([model.evidence(r["n"], r["segments"]) for r in scans]) if scans else np.zeros(0)
    y = np.array([float(r["toxic"] != 0) for r in scans])
    w = np.array([-3.0, 1.0])
    for _ in range(50):  # Newton steps with a weak prior
        p = 1 / (1 + np.exp(-np.clip(w[0] + w[1] * x, -30, 30)))
        grad = np.array([(p - y).sum(), ((p - y) * x).sum()]) + 0.01 * (w - np.array([-3.0, 1.0]))
        v = p * (1 - p)
        hess = np.array([[v.sum(), (v * x).sum()], [(v * x).sum(), (v * x * x).sum()]]) + 0.01 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    model.base, model.slope = float(w[0]), max(float(w[1]), 0.01)
    return model


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> Model:
    """Fit on the labelled rows whose crc32 of the id, modulo 4, isn't 2: remainders 0 and 1 give scores, 3 calibrates.

    Repeated texts count once. Rows without an id, a label or a text are not learnt from;
    without any labelled row every document gets the same low score.
    """
    rows = staged_table(_training(docs, labels, doc_id, text, label, max_rows), "toxicity-training")
    sizes = {r["toxic"] != 0: r["count"] for r in rows.where("fold = 0").groupBy("toxic").count().collect()}
    counts = _document_counts(rows.where("fold = 0"))
    features = log_odds(counts, sizes.get(True, 0), sizes.get(False, 0), max_features)
    return calibrate(Model(features), _scans(rows.where("fold = 1"), features))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", passages: bool = False) -> DataFrame:
    """Per row: ``doc_id, score, evidence``, and with ``passages`` the significant ones as (score, start, end) in characters.

    Every whole text is scanned once. Null and empty texts have no evidence and get the
    score of that. Rows are scored alone, so copies and ties score alike; an empty table
    gives an empty result. Only the two named columns are read.
    """
    sent = docs.sparkSession.sparkContext.broadcast((asdict(model), uuid.uuid4().hex))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        fields, key = sent.value
        m = Model(**fields)
        scores = kept_in_worker(f"toxic_{key}", lambda: _Scores(m.features))
        for batch in slices(batches, "text", 4 << 20):
            evidence, found = [], []
            for value in batch.column("text").to_pylist():
                n, _, segments = scan(value, scores)
                evidence.append(m.evidence(n, (s[0] for s in segments)))
                if passages:
                    spans = [w.span() for w in WORD.finditer(value.lower())] if evidence[-1] else []
                    limit = math.log(m.size * max(n, 1)) - math.log(EXPECTED)
                    found.append([{"score": s, "start": spans[a][0], "end": spans[b - 1][1]} for s, a, b in segments if m.rate * s > limit])
            cols = [batch.column("doc_id"), pa.array(m.probability(np.array(evidence))), pa.array(evidence, pa.float64())]
            if passages:
                cols.append(pa.array(found, pa.list_(pa.struct([("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["doc_id", "score", "evidence", *["passages"] * passages]
    extra = ", passages array<struct<score:double,start:long,end:long>>" if passages else ""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).transform(
        in_arrow, run, f"doc_id {dict(docs.dtypes)[doc_id]}, score double, evidence double{extra}")

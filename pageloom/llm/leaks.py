"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every test item is cut into word n-grams, and all of them are seeds, however frequent: a
copy with many edits may keep none but common ones. Documents with a seed meet the item,
and the passage around the seeds is aligned with the item: equal words score 2, replaced,
missing or added ones -1. A passage is a leak if the alignment reaches a share of the
item's own score, or is as good as a long verbatim quote. An alignment without n words
in a row that are equal has no seed and is not found.

A Bloom filter of fixed size, broadcast, holds back most of the documents' n-grams; the
joins decide. Words are compared in lower case without marks at their ends.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import fresh, grams, in_arrow, mixed, slices, staged_table, word_hasher

NGRAM = 3
MATCH, MISS = 2, -1
#: A leak reaches this share of the item's own score, or the score of this many words in a row.
SHARE, VERBATIM = 0.5, 13
#: Bits of the filter: 4 MB, whatever the number of items.
FILTER_BITS = 1 << 25
#: Bytes of items and passages whose alignments a task remembers.
KNOWN_BYTES = 16 << 20
_MARKS = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))


def normal_words(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII marks at their ends; words of marks alone are dropped."""
    return [w for w in (x.strip(_MARKS) for x in (text or "").lower().encode().split()) if w]


def _filter(seeds: np.ndarray) -> np.ndarray:
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for shift in (0, 25):
        at = (seeds >> np.uint64(shift)) & np.uint64(FILTER_BITS - 1)
        np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
    return bits


def _maybe(bits: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    at = seeds & np.uint64(FILTER_BITS - 1)
    found = np.flatnonzero(bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
    at = (seeds[found] >> np.uint64(25)) & np.uint64(FILTER_BITS - 1)
    return found[(bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]


def item_grams(items: DataFrame, item_id: str, text: str, n: int) -> DataFrame:
    """``item, n_item, words, gram``: one row per distinct gram of an item, the first with the hashes of all its words."""
    narrow = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("item"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        hasher = word_hasher()
        for batch in batches:
            rows = []
            for item, value in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                h = hasher(normal_words(value))
                size = min(n, len(h))  # an item of fewer words than n is one gram
                for i, g in enumerate(np.unique(grams(h, size)).view(np.int64).tolist() if size else []):
                    rows.append((item, len(h), None if i else h.tobytes(), g))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.int64()))],
                                             names=["item", "n_item", "words", "gram"])

    return narrow.transform(in_arrow, run, "item long, n_item int, words binary, gram long")


def _document_grams(docs: DataFrame, bits, sizes: list[int]) -> DataFrame:
    """``doc, text_hash, n_words, gram, at``: first and all places of the grams that the filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        hasher, table = word_hasher(), np.frombuffer(bits.value, np.uint8)
        for batch in slices(batches, "text", 2 << 20):
            keys, hashes = [], []
            for key, value in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                keys.append(key)
                hashes.append(hasher(normal_words(value)))
            if not keys:
                continue
            n = np.array([len(h) for h in hashes])
            flat, doc = np.concatenate(hashes), np.repeat(np.arange(len(n)), n)
            start = np.cumsum(n) - n
            for size in sizes:
                g = grams(flat, size)
                hit = _maybe(table, g)
                hit = hit[doc[hit] == doc[hit + size - 1]] if len(hit) else hit
                for a in range(0, len(hit), 50_000):
                    h = hit[a:a + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([keys[i] for i in doc[h]], pa.int64()), pa.array(g[h].view(np.int64)),
                         pa.array((h - start[doc[h]]).astype(np.int32))], names=["doc", "gram", "at"])

    return docs.transform(in_arrow, run, "doc long, gram long, at int")


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: its score, and its first and last word (exclusive) in ``passage``.

    Linear gap costs let a row of the matrix be finished by a running maximum.
    """
    m = len(passage)
    score, origin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    best, ramp = (0, 0, 0), np.arange(m + 1)
    for w in item:
        step = np.where(passage == w, MATCH, MISS)
        diagonal, above = score[:-1] + step, score[1:] + MISS
        new = np.maximum(np.maximum(diagonal, above), 0)
        source = np.where(diagonal >= above, origin[:-1], origin[1:])
        source = np.where(new == 0, ramp[1:], source)
        new, source = np.concatenate([[0], new]), np.concatenate([[0], source])
        lifted = new - MISS * ramp
        lead = np.maximum.accumulate(lifted)
        at = np.maximum.accumulate(np.where(lifted == lead, ramp, 0))
        run = lead + MISS * ramp
        better = run > new
        score, origin = np.where(better, run, new), np.where(better, source[at], source)
        top = int(score.argmax())
        if score[top] > best[0]:
            best = (int(score[top]), int(origin[top]), top)
    return best


def enough(score: int, n_item: int, share: float, verbatim: int) -> bool:
    return score >= needed(n_item, share, verbatim)


def needed(n_item: int, share: float, verbatim: int) -> float:
    return MATCH * min(share * n_item, verbatim) if n_item >= NGRAM else MATCH * n_item


def reach(n_item: int, share: float, verbatim: int) -> int:
    """The most words of a document that an alignment can span and still score enough."""
    return n_item + max(0, int(MATCH * n_item - needed(n_item, share, verbatim))) // -MISS


def best_possible(item: np.ndarray, passage: np.ndarray) -> int:
    """No alignment scores more: a match for every word that the item has, a miss for every other in between."""
    total = np.concatenate([[0], np.cumsum(np.where(np.isin(passage, item), MATCH, MISS))])
    return int((total - np.minimum.accumulate(total)).max())


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
               item_text: str = "text", n: int = NGRAM, share: float = SHARE, verbatim: int = VERBATIM) -> DataFrame:
    """One row per leaked item in a document: ``doc_id, item_id, part, score, share, start, stop``.

    ``score`` is the best alignment's, ``share`` is it by the item's own score, and words
    ``start`` up to ``stop`` of the document's normalised words are the passage. Items are
    aligned whole, however long, so ``part`` is always 0. Items of
    fewer than ``n`` words leak where they stand whole. Documents and items without an id
    or words have no part in this; rows that share an id are searched together and give
    the best of their passages; equal items each give rows; an empty table on either side
    gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    grams_ = staged_table(item_grams(items, item_id, item_text, n), "item-grams")
    narrow = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    # The filter's bits come from the item grams partition by partition; it has a fixed size.
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in _filter_parts(grams_).toLocalIterator():
        at = row["byte"]
        bits[at] |= row["value"] & 0xFF
    sent = spark.sparkContext.broadcast(bits.tobytes())
    places = staged_table(_document_grams(narrow, sent, list(range(1, n + 1))), "gram-places")
    return _aligned(narrow, places, grams_, share, verbatim).select(
        F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.lit(0).alias("part"), "score", "share", "start", "stop")


def _filter_parts(grams_: DataFrame) -> DataFrame:
    """The filter's bytes that are not zero; at most its size."""
    g = F.col("gram")
    spots = F.array(*(F.shiftrightunsigned(g, s).bitwiseAND(F.lit(FILTER_BITS - 1)) for s in (0, 25)))
    spots = grams_.select(F.explode(spots).alias("spot")).distinct()
    return spots.groupBy(F.shiftright("spot", 3).alias("byte")).agg(
        F.bit_or(F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), (F.col("spot") % 8 + 1).cast("int"))).alias("value"))


def _aligned(docs: DataFrame, places: DataFrame, seeds: DataFrame, share: float, verbatim: int) -> DataFrame:
    """Align every item with the passages of a document around its seeds."""
    # Where an item's seeds lie in a document, in stretches of the item's length. The exact join drops what passed the filter by chance.
    where = places.join(seeds.select("item", "n_item", "gram"), "gram")
    cell = F.floor(F.col("at") / F.col("n_item")).cast("int")
    hits = where.select("doc", "item", "n_item", cell.alias("cell")).distinct()
    windows = hits.groupBy("doc").agg(F.collect_set(F.struct("item", "n_item", "cell")).alias("cells"))
    wholes = seeds.where(F.col("words").isNotNull()).select("item", "n_item", "words").distinct()
    passages = docs.join(windows, "doc")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        """The words of every stretch and as many on both sides as an alignment can reach; stretches that overlap are one passage."""
        hasher = word_hasher()
        for batch in slices(batches, "text", 2 << 20):
            rows, held = [], 0
            for doc, value, cells in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), batch.column("cells").to_pylist()):
                h = hasher(normal_words(value))
                by: dict[tuple, list[int]] = {}
                for c in cells:
                    by.setdefault((c["item"], c["n_item"]), []).append(c["cell"])
                for (item, size), at in by.items():
                    more, spans = reach(size, share, verbatim), []
                    for c in sorted(at):
                        a, b = max(0, c * size - more), min(len(h), (c + 1) * size + more)
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = b
                        elif a < b:
                            spans.append([a, b])
                    rows += [(doc, item, size, a, h[a:b].tobytes()) for a, b in spans]
                    held += sum(8 * (b - a) for a, b in spans)
                    if held >= 2 << 20:
                        yield made(rows)
                        rows, held = [], 0
            if rows:
                yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                                          names=["doc", "item", "n_item", "first", "passage"])

    stretches = passages.transform(in_arrow, cut, "doc long, item long, n_item int, first int, passage binary").join(wholes, ["item", "n_item"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        known: dict[tuple[bytes, bytes], tuple[int, int, int]] = {}
        held = 0
        for batch in batches:
            rows = []
            for doc, item, first, passage, words in zip(*(batch.column(c).to_pylist() for c in ("doc", "item", "first", "passage", "words"))):
                own = np.frombuffer(words, np.uint64)
                there = np.frombuffer(passage, np.uint64)
                if not enough(best_possible(own, there), len(own), share, verbatim):
                    continue
                if (words, passage) not in known:
                    held += len(words) + len(passage)
                    if held > KNOWN_BYTES:
                        known.clear()
                        held = len(words) + len(passage)
                    known[words, passage] = align(own, there)
                value, a, b = known[words, passage]
                if enough(value, len(own), share, verbatim):
                    rows.append((doc, item, value, value / (MATCH * len(own)), first + a, first + b))
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=["doc", "item", "score", "share", "start", "stop"])

    scored = stretches.transform(in_arrow, score, "doc long, item long, score int, share double, start int, stop int")
    best = scored.groupBy("doc", "item").agg(F.max(F.struct("score", "share", (-F.col("start")).alias("s"), "stop")).alias("b"))
    return best.select("doc", "item", "b.score", "b.share", (-F.col("b.s")).alias("start"), "b.stop")


def without_leaks(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` in which no item leaked; rows without an id stay. All columns pass through."""
    gone = find_leaks(docs, items, **how).select(F.col("doc_id").alias(key := fresh(docs, "_leaked"))).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(key), "left_anti")

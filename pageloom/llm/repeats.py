"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of every 9 neighbouring 5-word grams the one with the least
hash is an anchor, so each window of 13 words holds one, and equal windows hold equal
ones at equal places. A document sends each anchor with the hashes of its extensions to
both sides: one for every 13-word window that chose the anchor. Anchors of equal hash
meet in one partition, where equal extensions find the smallest document that has them.
Neighbouring windows join to maximal repeats; the words they cover are removed.

A task first settles its own rows in batches, and sends a window once a batch, from the
batch's smallest document. So a passage that a third of all documents share arrives
once a batch, not once a document, and no pairs of documents are formed. Windows travel
as packed arrays, one row for each batch and partition, with 56 bits of a window's hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.common import STEP, covered, fresh, grams, in_arrow, mixed, slices, word_hasher

WIDTH, ANCHOR = 13, 5
#: Bytes of text that a task settles at a time.
BATCH_BYTES = 8 << 20
#: Per partition, a batch's windows: runs of neighbours, the documents they are in, and the hashes. Without
#: ``hashes``, the starts of windows of one document that are settled already.
SENT = "part int, doc_id long, text_hash long, starts binary, docs binary, hashes binary"


def _window_anchors(h: np.ndarray, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window: the hash of its anchor, and a key of the anchor with its extensions."""
    seeds = grams(h, anchor)
    least = seeds[: len(h) - width + 1].copy()
    for j in range(1, width - anchor + 1):
        np.minimum(least, seeds[j:j + len(least)], out=least)
    return least, mixed(least * STEP ^ grams(h, width)) & ~np.uint64(0xFF)


def _runs(sorted_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of consecutive numbers."""
    cut = np.flatnonzero(np.diff(sorted_starts) != 1) + 1
    first = np.concatenate([[0], cut])
    return sorted_starts[first], np.diff(np.concatenate([first, [len(sorted_starts)]]))


_RUN = np.dtype([("start", "<u4"), ("n", "<u2")])
_DOC = np.dtype([("id", "<i8"), ("text", "<i8"), ("runs", "<u4")])


def _packed(key: np.ndarray, doc: np.ndarray, at: np.ndarray, ids: np.ndarray, text_hash: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Windows in text order as runs of neighbours, documents with their number of runs, and 7 bytes a window."""
    n = np.arange(len(key))
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)])
    start = np.flatnonzero(new)
    new |= (n - np.repeat(start, np.diff(np.append(start, len(n))))) % 0xFFFF == 0  # longer runs are cut
    start = np.flatnonzero(new)
    runs = np.empty(len(start), _RUN)
    runs["start"], runs["n"] = at[start], np.diff(np.append(start, len(n)))
    used, count = np.unique(doc[start], return_counts=True)
    docs = np.empty(len(used), _DOC)
    docs["id"], docs["text"], docs["runs"] = ids[used], text_hash[used], count
    columns = [np.ascontiguousarray(docs[c]).tobytes() for c in docs.dtype.names]
    return runs.tobytes(), b"".join(columns), np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 1:]).tobytes()


def _unpacked(starts: bytes, docs: bytes, hashes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, document id, text hash and start of every window."""
    runs, n = np.frombuffer(starts, _RUN), len(docs) // _DOC.itemsize
    ids, text, count = (np.frombuffer(docs, t, n, n * o) for t, o in (("<i8", 0), ("<i8", 8), ("<u4", 16)))
    length = runs["n"].astype(np.int64)
    key = np.zeros((len(hashes) // 7, 8), np.uint8)
    key[:, 1:] = np.frombuffer(hashes, np.uint8).reshape(-1, 7)
    first = np.repeat(runs["start"].astype(np.int64) - (np.cumsum(length) - length), length)
    doc = np.repeat(np.repeat(np.arange(n), count), length)
    return key.view("<u8").ravel().astype(np.uint64), ids[doc], text[doc], first + np.arange(len(key))


def repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
                     anchor: int = ANCHOR) -> DataFrame:
    """Runs of windows that also start in a document with a smaller id: ``doc_id, text_hash, start, n_windows``.

    ``start`` is the run's first word. A run covers the words up to ``start + n_windows +
    width - 1``; runs of a document may touch each other. Rows without an id or text take
    no part. ``text_hash`` tells apart rows that share an id.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        hasher = word_hasher()

        def settled(keys: list[int], texts: list[bytes]) -> Iterable[pa.RecordBatch]:
            hashes = [hasher(t.split()) for t in texts]
            where = [i for i, h in enumerate(hashes) if len(h) >= width]
            if not where:
                return
            sizes = np.array([len(hashes[i]) for i in where])
            h = np.concatenate([hashes[i] for i in where])
            ids = np.array([keys[i] for i in where], np.int64)
            text_hash = np.array([xxhash.xxh64_intdigest(texts[i]) for i in where], np.uint64).view(np.int64)
            del hashes
            seed, key = _window_anchors(h, width, anchor)
            doc = np.repeat(np.arange(len(where)), sizes)
            at = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            inside = np.flatnonzero(doc[:len(seed)] == doc[width - 1:])
            seed, key, doc, at = seed[inside], key[inside], doc[inside], at[inside]
            # Order by window, then by document id; a window goes out from its batch's smallest document, from each place there.
            order = np.lexsort((at, ids[doc], key))
            sorted_key, sorted_id = key[order], ids[doc[order]]
            first = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
            least = np.repeat(sorted_id[first], np.diff(np.append(np.flatnonzero(first), len(order))))
            local = order[sorted_id > least]
            sent = order[sorted_id == least]
            yield from _rows_of_settled(np.sort(local), doc, at, ids, text_hash)
            # The rest goes to the anchors' partitions, windows in text order.
            part = (seed[sent] % np.uint64(parts)).astype(np.int64)
            by = np.lexsort((sent, part))
            sent, part = sent[by], part[by]
            cuts = np.searchsorted(part, np.arange(parts + 1))
            for p in range(parts):
                rows = sent[cuts[p]:cuts[p + 1]]
                if len(rows):
                    yield _batch([p], [None], [None], *([x] for x in _packed(key[rows], doc[rows], at[rows], ids, text_hash)))

        keys, texts, held = [], [], 0
        for batch in slices(batches, "text", BATCH_BYTES):
            for k, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                keys.append(k)
                texts.append(t)
                held += len(t)
                if held >= BATCH_BYTES:
                    yield from settled(keys, texts)
                    keys, texts, held = [], [], 0
        yield from settled(keys, texts)

    def _batch(*columns) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                          names=["part", "doc_id", "text_hash", "starts", "docs", "hashes"])

    def _rows_of_settled(rows, doc, at, ids, text_hash) -> Iterable[pa.RecordBatch]:
        """One row per document with settled windows; ``rows`` in text order, a document's together."""
        if not len(rows):
            return
        d = doc[rows]
        cuts = np.append(np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])), len(rows))
        some = [(int(text_hash[d[a]] % parts), int(ids[d[a]]), int(text_hash[d[a]]), at[rows[a:b]].astype("<u4").tobytes(), None, None)
                for a, b in zip(cuts, cuts[1:])]
        for i in range(0, len(some), 1000):
            yield _batch(*zip(*some[i:i + 1000]))

    def meet(table: pa.Table) -> pa.Table:
        """All that was sent to one partition: the windows that a smaller document has too."""
        rows = table.to_pylist()
        out = [(r["doc_id"], r["text_hash"], np.frombuffer(r["starts"], "<u4").astype(np.int64)) for r in rows if r["hashes"] is None]
        rows = [r for r in rows if r["hashes"] is not None]
        if rows:
            key, ids, hashes, at = (np.concatenate(x) for x in zip(*(_unpacked(r["starts"], r["docs"], r["hashes"]) for r in rows)))
            order = np.argsort(key, kind="stable")
            k = key[order]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            least = np.repeat(np.minimum.reduceat(ids[order], first), np.diff(np.append(first, len(k))))
            hit = np.sort(order[ids[order] > least])
            if len(hit):
                i, t, a = ids[hit], hashes[hit], at[hit]
                by = np.lexsort((a, t, i))
                i, t, a = i[by], t[by], a[by]
                cuts = np.append(np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (t[1:] != t[:-1])])), len(i))
                out += [(int(i[x]), int(t[x]), a[x:y]) for x, y in zip(cuts, cuts[1:])]
        made: list[list] = [[], [], [], []]
        for i, t, a in out:
            start, length = _runs(np.unique(a))
            made[0] += [i] * len(start)
            made[1] += [t] * len(start)
            made[2] += start.tolist()
            made[3] += length.tolist()
        return pa.table([pa.array(x, k) for x, k in zip(made, (pa.int64(), pa.int64(), pa.int64(), pa.int64()))],
                        names=["doc_id", "text_hash", "start", "n_windows"])

    return narrow.transform(in_arrow, send, SENT).groupBy("part").applyInArrow(
        meet, "doc_id long, text_hash long, start long, n_windows long")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
                    anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with ``n_words, n_removed, kept_words``: the kept words joined by one space.

    A word goes if a window that covers it has a word sequence that also starts in a
    document with a smaller id, judged on the input. Rows that share an id don't count as
    each other's source; equal rows are treated alike. A null text has no words; a row
    without an id keeps all its words. Columns of ``docs`` with the three names are
    replaced; an empty table gives an empty result.
    """
    runs = repeated_windows(docs, doc_id, text, width, anchor)
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("n_words", "n_removed", "kept_words") and c not in (doc_id, text)))
    name, r_id, r_text, r_runs = (fresh(docs, c) for c in ("_text_hash", "_r_id", "_r_text", "_r_runs"))
    runs = runs.groupBy(F.col("doc_id").alias(r_id), F.col("text_hash").alias(r_text)).agg(
        F.collect_list(F.struct("start", "n_windows")).alias(r_runs))
    hashed = text_hashes(docs, name, text)
    joined = hashed.join(runs, (F.col(doc_id) == F.col(r_id)) & (F.col(name) == F.col(r_text)), "left").drop(r_id, r_text, name)
    schema = docs.select("*", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"),
                         F.lit("").alias("kept_words")).schema
    others = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in slices(batches, text, 8 << 20):
            n_words, n_removed, kept = [], [], []
            for value, spans in zip(batch.column(text).to_pylist(), batch.column(r_runs).to_pylist()):
                words = (value or "").encode().split()
                n_words.append(len(words))
                if spans:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for s in spans:
                        edge[s["start"]] += 1
                        edge[s["start"] + s["n_windows"] + width - 1] -= 1
                    words = [w for w, gone in zip(words, (np.cumsum(edge[:-1]) > 0).tolist()) if not gone]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(n_words, pa.int64()),
                                              pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=schema.names)

    return joined.transform(in_arrow, cut, schema)


def text_hashes(docs: DataFrame, name: str, text: str) -> DataFrame:
    """``docs`` with the 64-bit hash of the text's bytes (null: null), as the anchors carry it."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            values = [None if t is None else xxhash.xxh64_intdigest(t.encode()) for t in batch.column(text).to_pylist()]
            values = [None if v is None else v - (1 << 64) if v >> 63 else v for v in values]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.int64())], names=schema.names)

    return docs.transform(in_arrow, run, schema)


def removed_by_brute_force(rows: list[tuple[int, str | None]], width: int = WIDTH) -> list[tuple[int, int, int, str]]:
    """``doc_id, n_words, n_removed, kept_sha256`` for small tables, straight from the definition; for tests."""
    least: dict[tuple, int] = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for a in range(len(w) - width + 1):
            k = tuple(w[a:a + width])
            least[k] = min(least.get(k, i), i)
    out = []
    for i, w in split:
        hit = np.array([least[tuple(w[a:a + width])] < i for a in range(len(w) - width + 1)], bool)
        gone = covered(hit, width, len(w)) if len(w) else np.empty(0, bool)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return out

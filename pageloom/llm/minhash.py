"""MinHash near-duplicates with sequential Bayesian verification.

Copies with equal shingle sets are one class from the start. Signatures of class
representatives are cut into bands; representatives that share a band are candidates.
Signatures are compared batch by batch: with ``m`` of ``n`` hashes equal and a uniform
prior, the similarity's posterior is Beta(m + 1, n - m + 1), and a pair is dropped as
soon as the chance that it reaches the threshold is below ``MISS``. What survives is
verified on the full sets.

No pairs of a group are listed. First every representative is compared with the most
central one it meets in any band; the links found give components. After that only pairs
from different components of a bucket are open: they are compared block by block, each
straggler with the members of its bucket's largest component, and stragglers with each
other, so a component's many inner links are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageloom.llm.common import STEP, fresh, grams, in_arrow, mixed, slices, staged_table, word_hasher
from pageloom.llm.graph import components

#: 24 bands of 5 hashes miss a pair at similarity 0.85 with a chance of 8e-7.
BANDS, ROWS = 24, 5
HASHES, BATCH = BANDS * ROWS, 24
#: Chance at which the Bayesian test may drop a pair that reaches the threshold.
MISS = 1e-9
#: Shingles of a block of sets that are compared with another block.
BLOCK_SHINGLES = 40_000


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, n + 1, dtype=np.uint64)
    a, b = mixed(k * STEP), mixed(k * STEP + np.uint64(1))
    return (a >> np.uint64(32)).astype(np.uint32)[:, None], ((b >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)[:, None]


def shingle_set(text: bytes, size: int, hasher) -> np.ndarray:
    """Sorted hashes of the distinct shingles; fewer words than ``size``: the whole sequence as one."""
    h = hasher(text.lower().split())
    return np.unique(grams(h, min(size, len(h)))) if len(h) else h


def signature(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least of every hash over the set."""
    x, out = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32), None
    for i in range(0, len(x), 1 << 14):
        least = ((x[None, i:i + (1 << 14)] ^ family[0]) * family[1]).min(axis=1)
        out = least if out is None else np.minimum(out, least)
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    parts = sig.reshape(-1, rows).astype(np.uint64)
    out = np.arange(1, len(parts) + 1, dtype=np.uint64)
    for j in range(rows):
        out = mixed(out * STEP + parts[:, j])
    return out.view(np.int64)


def least_matches(n: int, threshold: float, miss: float) -> int:
    """The fewest equal hashes of ``n`` at which P(similarity >= threshold) is still ``miss`` or more."""
    x = (np.arange(20_000) + 0.5) / 20_000
    for m in range(n + 1):
        density = m * np.log(x) + (n - m) * np.log1p(-x)
        weight = np.exp(density - density.max())
        if weight[x >= threshold].sum() >= miss * weight.sum():
            return m
    return n + 1


def open_pairs(a: np.ndarray, b: np.ndarray, needed: list[tuple[int, int]], open_: np.ndarray) -> np.ndarray:
    """Sequential test of all pairs of two signature blocks; stops when none is open."""
    matches = np.zeros(open_.shape, np.int32)
    done = 0
    for n, least in needed:
        for k in range(done, n):
            matches += a[:, k][:, None] == b[:, k][None, :]
        done, open_ = n, open_ & (matches >= least)
        if not open_.any():
            break
    return open_


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of two lists of sets."""
    out = np.zeros((len(a), len(b)), np.float64)
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(flat_a, flat_b)
    rows_a = np.repeat(np.arange(len(a)), [len(x) for x in a])
    rows_b = np.repeat(np.arange(len(b)), [len(x) for x in b])
    for i in range(0, len(shared), 4096):
        part = shared[i:i + 4096]
        made = []
        for flat, rows, n in ((flat_a, rows_a, len(a)), (flat_b, rows_b, len(b))):
            at = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            hit = part[at] == flat
            m = np.zeros((n, len(part)), np.float32)
            m[rows[hit], at[hit]] = 1
            made.append(m)
        out += made[0] @ made[1].T
    return out


def _similar(inter: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (size_a + size_b - inter)


def sketches(docs: DataFrame, doc_id: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """Per row: ``node, n, hi, lo, bands``; the set's 128-bit digest and its band keys (none without words)."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("node"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        hasher, family = word_hasher(), _family(bands * rows)
        for batch in slices(batches, "text", 2 << 20):
            made: list[list] = [[], [], [], []]
            for t in batch.column("text").to_pylist():
                s = shingle_set(t, size, hasher)
                d = np.frombuffer(xxhash.xxh128_digest(s.tobytes()), np.int64)
                for values, v in zip(made, (len(s), d[0], d[1], band_keys(signature(s, family), rows) if len(s) else [])):
                    values.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), *map(pa.array, made, kinds)], names=["node", "n", "hi", "lo", "bands"])

    return narrow.transform(in_arrow, run, "node long, n long, hi long, lo long, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, size: int, hashes: int) -> DataFrame:
    """``rep, n, sig, shingles`` of the wanted documents, whole."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("rep"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        hasher, family = word_hasher(), _family(hashes)
        for batch in slices(batches, "text", 2 << 20):
            sets = [shingle_set(t, size, hasher) for t in batch.column("text").to_pylist()]
            keep = np.array([len(s) > 0 for s in sets])
            sets = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep").filter(pa.array(keep)), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([signature(s, family).tobytes() for s in sets], pa.binary()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "n", "sig", "shingles"])

    return narrow.join(wanted, "rep", "left_semi").transform(in_arrow, run, "rep long, n long, sig binary, shingles binary")


def _tests(percent: int, hashes: int) -> list[tuple[int, int]]:
    return [(n, least_matches(n, percent / 100, MISS)) for n in range(BATCH, hashes + 1, BATCH)]


def verified_pairs(pairs: DataFrame, sets: DataFrame, percent: int, hashes: int) -> DataFrame:
    """The rows ``a, b`` of ``pairs`` that reach ``percent``."""
    side = lambda s: sets.select(*(F.col(c).alias(f"{s}_{c}") for c in ("rep", "n", "sig", "shingles")))
    both = pairs.join(side("b"), F.col("b") == F.col("b_rep")).join(side("a"), F.col("a") == F.col("a_rep"))
    needed = _tests(percent, hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in slices(batches, "b_shingles", 2 << 20):
            col = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            a, b = (np.stack([np.frombuffer(x, np.uint32) for x in col[c]]) for c in ("a_sig", "b_sig"))
            alive, done, matches = np.ones(len(a), bool), 0, np.zeros(len(a), np.int64)
            for n, least in needed:
                matches[alive] += (a[alive, done:n] == b[alive, done:n]).sum(1)
                done, alive = n, alive & (matches >= least)
            out = []
            for i in np.flatnonzero(alive):
                x, y = (np.frombuffer(col[c][i], np.uint64) for c in ("a_shingles", "b_shingles"))
                both_n = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both_n >= percent * (len(x) + len(y) - both_n):
                    out.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([col[c][i] for i in out], pa.int64()) for c in ("a", "b")], names=["a", "b"])

    return both.select("a", "b", "a_sig", "b_sig", "a_shingles", "b_shingles").transform(in_arrow, run, "a long, b long")


_MEMBER = "array<struct<rep:long,comp:long,sig:binary,shingles:binary>>"


def _blocks(rows: DataFrame, keys: list[str], block: str) -> DataFrame:
    """``rows`` packed by ``keys`` into blocks of about ``BLOCK_SHINGLES``; ``n_blocks`` tells how many a key has."""
    total = rows.groupBy(*keys).agg(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)).cast("int").alias("n_blocks"))
    placed = rows.join(total, keys).withColumn(block, F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int"))
    return placed.groupBy(*keys, block, "n_blocks").agg(
        F.collect_list(F.struct("rep", "comp", "sig", "shingles")).alias("members"))


def _linked(pairs: DataFrame, percent: int, hashes: int) -> DataFrame:
    """Links between the sets of ``left`` and ``right`` in different components.

    A link that joins nothing new within its two blocks is not reported.
    """
    needed = _tests(percent, hashes)

    def of(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        return (np.array([r["rep"] for r in rows]), np.array([r["comp"] for r in rows]),
                np.stack([np.frombuffer(r["sig"], np.uint32) for r in rows]), [np.frombuffer(r["shingles"], np.uint64) for r in rows])

    def links(left: list[dict], right: list[dict]) -> list[tuple[int, int]]:
        (rep_a, comp_a, sig_a, sets_a), (rep_b, comp_b, sig_b, sets_b) = of(left), of(right)
        size_a, size_b = np.array([len(x) for x in sets_a]), np.array([len(x) for x in sets_b])
        near = 100 * np.minimum(size_a[:, None], size_b[None]) >= percent * np.maximum(size_a[:, None], size_b[None])
        near = open_pairs(sig_a, sig_b, needed, near & (comp_a[:, None] != comp_b[None]))
        rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if not len(rows):
            return []
        inter = intersections([sets_a[i] for i in rows], [sets_b[i] for i in cols])
        near = near[np.ix_(rows, cols)] & _similar(inter, size_a[rows][:, None], size_b[cols][None], percent)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(near)):
            x, y = find(int(comp_a[rows[i]])), find(int(comp_b[cols[j]]))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((int(rep_a[rows[i]]), int(rep_b[cols[j]])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = links(batch.column("left")[i].as_py(), batch.column("right")[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return pairs.select("left", "right").transform(in_arrow, run, "a long, b long")


def _block_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Every left block of a key with every right block of it, dealt by the right block."""
    right = right.select(*keys, F.col("r_block"), F.col("n_blocks").alias("r_blocks"), F.col("members").alias("right"))
    counts = right.select(*keys, "r_blocks").distinct()
    spread = left.join(counts, keys).withColumn("r_block", F.explode(F.sequence(F.lit(0), F.col("r_blocks") - 1)))
    return spread.select(*keys, "l_block", "r_block", F.col("members").alias("left")).join(right, [*keys, "r_block"])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``.

    Documents whose shingle sets overlap by ``percent`` of their union are linked;
    ``component_id`` is the smallest id that links reach, the document's own included.
    Texts without words (null, empty, blank) have no shingles and are linked with nothing.
    Rows that share an id are one document with several texts. A row without an id is
    linked with nothing and has no component. Equal rows are in one component; an empty
    table gives an empty result. Only the two named columns are read. A pair at the
    threshold is missed by all bands with a chance of (1 - similarity ** rows) ** bands.
    """
    hashes = bands * rows
    sketch = staged_table(sketches(docs, doc_id, text, shingle, bands, rows), "sketches")
    usable = sketch.where(F.col("node").isNotNull() & (F.col("n") > 0))
    classes = usable.groupBy("hi", "lo").agg(F.min("node").alias("rep"), F.first("bands").alias("bands"))
    keyed = staged_table(classes.select("rep", F.explode("bands").alias("key")), "bands")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
    met = staged_table(keyed.join(shared, "key"), "buckets")

    # The most central representative of each bucket: the one that meets most others in all its bands.
    degree = met.groupBy("rep").agg(F.sum(F.col("met") - 1).alias("degree"))
    rank = F.struct("degree", (-F.col("rep")).alias("minus"))
    ranked = met.join(degree, "rep").withColumn("rank", rank)
    centre = ranked.groupBy("key").agg(F.max("rank").alias("top"))
    best = ranked.join(centre, "key").groupBy("rep", "rank").agg(F.max("top").alias("top")).where("top > rank")
    star = staged_table(best.select((-F.col("top.minus")).alias("a"), F.col("rep").alias("b")), "star")
    sets = staged_table(full_sets(docs, met.select("rep").distinct(), doc_id, text, shingle, hashes), "sets")
    links = staged_table(verified_pairs(star, sets, percent, hashes), "star-links")

    comp = staged_table(components(links), "components")
    labelled = met.join(comp, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("label", "rep").alias("comp"))
    labelled = staged_table(labelled, "labelled")
    parts = labelled.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"))
    largest = parts.groupBy("key").agg(F.max(F.struct("size", "comp"))["comp"].alias("main"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    straggling = staged_table(labelled.join(largest, "key").where(F.col("comp") != F.col("main")), "stragglers")

    # Stragglers against the members of the largest component they meet. A single pair that was compared is settled.
    toward = straggling.select("rep", "comp", "main").distinct()
    alone = labelled.select("rep", "comp").distinct().groupBy("comp").agg(F.count(F.lit(1)).alias("members"))
    toward = toward.join(alone.select(F.col("comp").alias("main"), "members"), "main")
    known = star.select("a", "b").union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = known.select(F.col("a").alias("main"), F.col("b").alias("rep"), F.lit(1).cast("long").alias("members"))
    toward = staged_table(toward.join(known, ["main", "rep", "members"], "left_anti").drop("members"), "toward")
    left = _blocks(toward.join(sets, "rep"), ["main"], "l_block")
    inside = labelled.select("rep", "comp").distinct().join(toward.select(F.col("main").alias("comp")).distinct(), "comp", "left_semi")
    right = _blocks(inside.join(sets, "rep").withColumn("main", F.col("comp")), ["main"], "r_block")
    found = _linked(_block_pairs(left, right, ["main"]), percent, hashes)

    # Stragglers of a bucket against each other, where they are of several components.
    several = straggling.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
    among = straggling.join(several, "key", "left_semi").select("key", "rep", "comp").join(sets, "rep")
    blocks = _blocks(among, ["key"], "l_block")
    pairs = _block_pairs(blocks, blocks.withColumnRenamed("l_block", "r_block"), ["key"]).where("l_block <= r_block")
    found = found.union(_linked(pairs, percent, hashes))

    final = components(links.union(staged_table(found, "later-links")))
    labels = classes.select("hi", "lo", "rep").join(final, F.col("rep") == F.col("node"), "left").select(
        F.col("hi").alias("h2"), F.col("lo").alias("l2"), F.coalesce("label", "rep").alias("label"))
    out = sketch.join(labels, (F.col("hi") == F.col("h2")) & (F.col("lo") == F.col("l2")) & (F.col("n") > 0) & F.col("node").isNotNull(), "left")
    return out.select(F.col("node").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("label", "node").alias("component_id"))


def without_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, one row an id.

    Rows without an id stay as they are: nothing links them. All columns pass through.
    """
    classes = near_duplicates(docs, **how)
    other = fresh(docs, "_g_id")
    gone = classes.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(other)).distinct()
    kept = docs.join(gone, F.col("doc_id") == F.col(other), "left_anti")
    # Repeated ids are rare; only their rows are ranked.
    again = classes.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(other))
    rank, twice = fresh(docs, "_rank"), fresh(docs, "_twice")
    marked = kept.join(again.withColumn(twice, F.lit(True)), F.col("doc_id") == F.col(other), "left").drop(other)
    single, repeated = marked.where(F.col(twice).isNull()), marked.where(F.col(twice).isNotNull())
    order: list[Column] = [F.col(c).cast("string") for c in docs.columns]
    repeated = repeated.withColumn(rank, F.row_number().over(W.partitionBy("doc_id").orderBy(*order))).where(F.col(rank) == 1)
    return single.select(*docs.columns).union(repeated.select(*docs.columns))

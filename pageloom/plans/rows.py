"""Text lines of sorted runs in one pass: Arrow batches in, one row per line out.

Spark partitions the runs by page and sorts them by falling baseline (spilling to disk); the pass
holds the runs of one text row, cuts the rows and their columns apart, and adds the lines up.
Nulls and NaN count as in Spark's columns: nulls are passed over, NaN is above every number.

Spark takes the size of every Arrow column after every row, and of nested ones most slowly, so numbers
go over as two arrays; the style is taken apart and put together again for the lines only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


class Doubles:
    """A column of doubles: ``v`` with NaN for nulls, and which entries are ``null``."""

    def __init__(self, v: np.ndarray, null: np.ndarray):
        self.v, self.null = v, null

    def __getitem__(self, at) -> "Doubles":
        return Doubles(self.v[at], self.null[at])

    def __add__(self, other: "Doubles") -> "Doubles":
        with np.errstate(invalid="ignore"):
            return Doubles(self.v + other.v, self.null | other.null)

    def __sub__(self, other: "Doubles") -> "Doubles":
        with np.errstate(invalid="ignore"):  # infinite ones
            return Doubles(self.v - other.v, self.null | other.null)

    def or_least(self) -> np.ndarray:
        """Plain numbers for a maximum, which nulls leave alone."""
        return np.where(self.null, -np.inf, self.v)

    def above(self, bound: np.ndarray) -> np.ndarray:
        return ~self.null & ((self.v > bound) | (np.isnan(self.v) & ~np.isnan(bound)))

    def lowest(self, starts: np.ndarray) -> "Doubles":
        return Doubles(np.fmin.reduceat(self.v, starts), np.logical_and.reduceat(self.null, starts))

    def highest(self, starts: np.ndarray) -> "Doubles":
        return Doubles(np.maximum.reduceat(self.or_least(), starts), np.logical_and.reduceat(self.null, starts))

    def mean(self, group: np.ndarray, groups: int) -> "Doubles":
        there = ~self.null
        n = np.bincount(group[there], minlength=groups)
        total = np.bincount(group[there], weights=self.v[there], minlength=groups)
        return Doubles(total / np.maximum(n, 1), n == 0)

    def array(self) -> pa.Array:
        return pa.array(self.v, pa.float64(), mask=self.null)


def _true(column: pa.Array) -> np.ndarray:
    return column.fill_null(False).to_numpy(zero_copy_only=False)


def _numbers(column: pa.ListArray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of arrays of one length, a column for each place, and which of them are null."""
    flat = column.flatten()
    null = flat.is_null().to_numpy(zero_copy_only=False)
    return flat.fill_null(0).to_numpy(zero_copy_only=False).reshape(rows, -1), null.reshape(rows, -1)


class Packing:
    """Columns of any type as an array of longs, an array of doubles, and the rest as they are."""

    def __init__(self):
        self.longs: list[Column] = []
        self.doubles: list[Column] = []
        self.others: list[Column] = []

    def add(self, column: Column, kind: T.DataType) -> tuple:
        """What ``unpacked`` needs to find the column again."""
        if isinstance(kind, T.StructType):
            self.longs.append(column.isNull().cast("long"))
            flag = len(self.longs) - 1
            return "struct", flag, [(f.name, self.add(column[f.name], f.dataType)) for f in kind.fields]
        if isinstance(kind, T.DoubleType):
            held, name = self.doubles, "doubles"
        elif isinstance(kind, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            held, name, column = self.longs, "longs", column.cast("long")
        else:
            held, name = self.others, "others"
        held.append(column)
        return name, len(held) - 1, to_arrow_type(kind)

    def columns(self) -> list[Column]:
        return [F.array(*self.longs).alias("_longs"), F.array(*self.doubles).alias("_doubles"),
                *(c.alias(f"_other{i}") for i, c in enumerate(self.others))]


def unpacked(where: tuple, at: np.ndarray, batch: pa.RecordBatch, longs: tuple, doubles: tuple) -> pa.Array:
    """Rows ``at`` of a packed column."""
    name, i, more = where
    if name == "struct":
        names, parts = zip(*((n, unpacked(w, at, batch, longs, doubles)) for n, w in more))
        return pa.StructArray.from_arrays(parts, names=names, mask=pa.array(longs[0][at, i] == 1))
    if name == "others":
        return batch.column(f"_other{i}").take(pa.array(at))
    v, null = longs if name == "longs" else doubles
    return pa.array(v[at, i], mask=null[at, i]).cast(more)


def line_pass(keys: list[str], style: tuple, white: str, number: str, closing: str, opening: str,
              names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]:
    """The pass over packed runs sorted by ``keys``, falling ``y``, ``x`` and ``run_ord``.

    The longs begin with ``run_ord`` and the run's number in this order, from 1; the doubles with ``x, y, w, h``
    and the font size. A row starts where the drop to the previous run exceeds the tolerance; a line ends at a
    column gap or between two standalone numbers. ``names`` orders the columns of the result.
    """

    def double(doubles: tuple, i: int) -> Doubles:
        v, null = doubles
        return Doubles(np.where(null[:, i], np.nan, v[:, i]), null[:, i])

    def whole_rows(table: pa.RecordBatch, opens: np.ndarray, row_ids: np.ndarray) -> pa.RecordBatch:
        row = np.cumsum(opens) - 1
        longs, doubles = (_numbers(table.column(c), len(row)) for c in ("_longs", "_doubles"))
        x, y, w, h, size = (double(doubles, i) for i in range(5))
        # Within a row by x, nulls first; equal ones stay as they came, higher runs first.
        order = np.lexsort((x.v, ~x.null, row))
        x, y, w, h, size, row = x[order], y[order], w[order], h[order], size[order], row[order]
        part = pc.utf8_trim(table.column("text").take(pa.array(order)), white)
        n = len(row)
        inside = np.zeros(n, bool)
        inside[1:] = row[1:] == row[:-1]
        before = np.maximum(np.arange(n) - 1, 0)
        right = x + w
        gap = x - right[before]
        gap.null = gap.null | ~inside
        big = np.maximum(size[before].or_least(), size.or_least())
        small = np.where(size[before].null & size.null, -np.inf, np.fmin(size[before].v, size.v))
        is_number = _true(pc.match_substring_regex(part, number))
        numbers = is_number & is_number[before] & gap.above(np.maximum(3.0, size.or_least() * 0.4))
        cut = inside & (gap.above(np.maximum(18.0, big * 1.75)) | numbers)
        told = ~part.is_null().to_numpy(zero_copy_only=False)
        binds = _true(pc.match_substring_regex(part, closing)) | _true(pc.match_substring_regex(part, opening))[before]
        space = inside & ~cut & gap.above(np.maximum(0.75, small * 0.08)) & ~binds & told & told[before]

        head = ~inside | cut
        starts = np.flatnonzero(head)
        line = np.cumsum(head) - 1
        cuts = np.cumsum(cut)
        seg = cuts[starts] - cuts[np.flatnonzero(~inside)][row[starts]]
        piece = pc.binary_join_element_wise(pc.if_else(pa.array(space), " ", ""), part, "")
        ends = np.append(starts[1:], n)
        # Null texts have no piece; a line of nothing else is null.
        offsets = np.concatenate(([0], np.cumsum(told)))[np.append(starts, n)]
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), piece.filter(pa.array(told))), "")
        text = pc.if_else(pa.array(np.diff(offsets) > 0), joined, pa.scalar(None, pa.string()))
        length = pc.utf8_length(part).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        longest = np.maximum.reduceat(length, starts)
        # The first of the longest: the runs that reach the length, and the first of them in each line.
        reach = np.flatnonzero(length == longest[line])
        first = reach[np.searchsorted(reach, starts)]
        unnumbered = longs[1][order, 0]
        lowest_ord = np.minimum.reduceat(np.where(unnumbered, np.iinfo(np.int64).max, longs[0][order, 0]), starts)
        left, low = x.lowest(starts), y.lowest(starts)
        made = {
            **{k: table.column(k).take(pa.array(order[starts])) for k in keys}, "row_id": pa.array(row_ids[row[starts]], pa.int64()), "seg": pa.array(seg, pa.int64()),
            "text": text, "x": left.array(), "y": low.array(), "w": (right.highest(starts) - left).array(),
            "h": ((y + h).highest(starts) - low).array(), "baseline_y": y.mean(line, len(starts)).array(),
            "style": unpacked(style, order[first], table, longs, doubles), "n_runs": pa.array(ends - starts, pa.int64()),
            "first_run_ord": pa.array(lowest_ord, pa.int64(), mask=np.logical_and.reduceat(unnumbered, starts)),
        }
        return pa.RecordBatch.from_arrays([made[c] for c in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []     # the runs of the open row
        held_id, last_y = 0, None           # its row_id; the last y seen
        for batch in batches:
            if not batch.num_rows:
                continue
            new_page = _numbers(batch.column("_longs"), batch.num_rows)[0][:, 1] == 1
            doubles = _numbers(batch.column("_doubles"), batch.num_rows)
            y, size = double(doubles, 1), double(doubles, 4)
            above = y[np.maximum(np.arange(len(y.v)) - 1, 0)]
            if last_y is not None:
                above.v[0], above.null[0] = last_y
            last_y = y.v[-1], y.null[-1]
            drop = above - y
            opens = new_page | drop.null | drop.above(np.maximum(1.5, size.or_least() * 0.18))
            at = np.flatnonzero(opens)
            if not len(at):
                held.append(batch)
                continue
            # Rows count from 0 on each page; the open row goes on counting.
            counted = np.cumsum(opens)
            ids = (counted - np.maximum.accumulate(np.where(new_page, counted, -held_id)))[at]
            last = at[-1]
            if held or last:
                done = pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks().to_batches()
                marks = np.zeros(sum(b.num_rows for b in held) + last, bool)
                marks[at[:-1] + (len(marks) - last)] = True
                rows = ids[:-1]
                if held:
                    marks[0], rows = True, np.concatenate(([held_id], rows))
                yield whole_rows(done[0], marks, rows)
            held, held_id = [batch.slice(last)], int(ids[-1])
        if held:
            done = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield whole_rows(done, np.arange(done.num_rows) == 0, np.array([held_id]))

    return run

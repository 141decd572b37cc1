"""Pairs of members of two blocks judged in arrays: what rows of ``plans.blocks.blocks_met`` hold, within a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from caseweave.plans.blocks import blocks_met

#: Pairs that are judged at once, and rows of a batch that goes back to Spark.
PAIRS_AT_ONCE, BATCH_ROWS = 250_000, 50_000


class Sets:
    """Sizes of the common parts of two blocks' arrays without repeats; nulls in them are equal to each other."""

    def __init__(self, left: pa.Array, right: pa.Array):
        self.size_l, self.size_r = (pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (left, right))
        values = pa.concat_arrays([left.flatten(), right.flatten()]).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.r_[0, np.cumsum(self.size_l)]
        self.codes = values[: self.first[-1]]
        codes_r = values[self.first[-1] :]
        order = np.argsort(codes_r, kind="stable")
        self.rows_r = np.repeat(np.arange(len(right)), self.size_r)[order]
        self.times = np.bincount(codes_r, minlength=int(values.max()) + 1 if len(values) else 1)
        self.starts = np.cumsum(self.times) - self.times

    def common(self, lo: int, hi: int) -> np.ndarray:
        n = len(self.size_r)
        codes = self.codes[self.first[lo] : self.first[hi]]
        times = self.times[codes]
        if not times.any():
            return np.zeros((hi - lo, n), np.int64)
        rows = np.repeat(np.arange(hi - lo), self.size_l[lo:hi])
        ends = np.cumsum(times)
        at = np.repeat(self.starts[codes] - ends + times, times) + np.arange(ends[-1])
        return np.bincount(np.repeat(rows * n, times) + self.rows_r[at], minlength=(hi - lo) * n).reshape(hi - lo, n)

    def jaccard(self, lo: int, hi: int) -> np.ndarray:
        common = self.common(lo, hi)
        if np.count_nonzero(common) * 8 > common.size:
            return common / np.maximum(self.size_l[lo:hi, None] + self.size_r - common, 1)
        out = np.zeros(common.shape)
        rows, others = np.nonzero(common)
        have = common[rows, others]
        out[rows, others] = have / (self.size_l[lo + rows] + self.size_r[others] - have)
        return out


class Values:
    """Equal values of two blocks; a null equals none."""

    def __init__(self, left: pa.Array, right: pa.Array):
        codes = pc.fill_null(pa.concat_arrays([left, right]).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        self.left, self.right = codes[: len(left)], codes[len(left) :]

    def known(self, lo: int, hi: int) -> np.ndarray:
        return (self.left[lo:hi, None] >= 0) & (self.right >= 0)

    def equal(self, lo: int, hi: int) -> np.ndarray:
        return (self.left[lo:hi, None] == self.right) & (self.left[lo:hi, None] >= 0)


class Numbers:
    """Distances of numbers of two blocks; nulls have none."""

    def __init__(self, left: pa.Array, right: pa.Array):
        (self.left, self.known_l), (self.right, self.known_r) = ((x.to_numpy(zero_copy_only=False).astype(float), pc.is_valid(x).to_numpy(zero_copy_only=False)) for x in (left, right))

    def known(self, lo: int, hi: int) -> np.ndarray:
        return self.known_l[lo:hi, None] & self.known_r

    def near(self, lo: int, hi: int, span: float) -> np.ndarray:
        """1 less the distance over ``span``, at least 0; 0 for nulls."""
        with np.errstate(invalid="ignore"):
            return 1 - np.fmin(np.abs(self.left[lo:hi, None] - self.right) / span, 1.0)


def _judged(batches: Iterator[pa.RecordBatch], judge: Callable, names: list[str]) -> Iterator[pa.RecordBatch]:
    made, waiting = [], 0

    def batch_of(parts: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays(column) for column in zip(*parts)], ["a", "b", *names])

    for batch in batches:
        xs, ys = batch.column("x"), batch.column("y")
        for k in range(batch.num_rows):
            x, y = xs[k].values, ys[k].values
            same = not len(y)
            y = x if same else y
            ids = pa.concat_arrays([x.field("m"), y.field("m")])
            rank = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            rank_l, rank_r = rank[: len(x)], rank[len(x) :]
            seen, scores = Sets(x.field("before"), y.field("before")), judge(x, y)
            step = max(1, PAIRS_AT_ONCE // max(len(y), 1))
            for lo in range(0, len(x), step):
                hi = min(len(x), lo + step)
                fresh = seen.common(lo, hi) == 0
                if same:
                    fresh &= rank_l[lo:hi, None] < rank_r
                kept, columns = scores(lo, hi)
                rows, others = np.nonzero(fresh if kept is None else fresh & kept)
                if not len(rows):
                    continue
                left, right = rows + lo, others + len(x)
                first = rank[left] < rank[right]
                made.append([ids.take(pa.array(np.where(first, left, right))), ids.take(pa.array(np.where(first, right, left))), *[pa.array(c[rows, others]) for c in columns]])
                waiting += len(rows)
                if waiting >= BATCH_ROWS:
                    yield batch_of(made)
                    made, waiting = [], 0
    if made:
        yield batch_of(made)


def judged_pairs(rows: DataFrame, keys: str, member: str, carried: list[str], judge: Callable, names: list[str], block_rows: int = 2_000) -> DataFrame:
    """(a, b, *names), a < b: pairs of rows with a common key, once each, with the columns of doubles that ``judge`` gives them where their blocks meet.

    ``keys``: a column of arrays of strings. ``judge`` takes the structs of two blocks and gives a function of a range of the left one's rows, which returns which pairs stay (None: all) and the columns, as arrays of left by right rows.
    A pair counts at the least key that both members have: each member brings the keys before the one that it is met at.
    """
    sorted_keys = rows.withColumn("_keys", F.array_sort(F.array_distinct(F.array_compact(keys))))
    met = sorted_keys.select(F.posexplode("_keys").alias("_at", "_key"), member, *carried, "_keys").withColumn("before", F.slice("_keys", F.lit(1), F.col("_at")))
    blocks = blocks_met(met, ["_key"], member, ["before", *carried], block_rows)
    kind = rows.schema[member].dataType
    schema = StructType([StructField("a", kind), StructField("b", kind), *[StructField(n, DoubleType()) for n in names]])
    return blocks.select("x", "y").mapInArrow(lambda batches: _judged(batches, judge, names), schema)

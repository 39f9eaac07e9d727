"""Windows over ordered rows of a series. Every window function is partitioned by the series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tiling(counts: DataFrame, series: str, n: int, size: int) -> DataFrame:
    """(series, begin, keep_from, keep_count): windows of `size` rows side by side, and a tail window over the last rows that keeps only what is not covered.

    `counts` has one row for each series with its number of rows in column `n`. Fewer rows than `size` give none.
    """
    rows = F.col(n)
    full = F.floor(rows / size).cast("long")
    starts = F.transform(F.sequence(F.lit(0).cast("long"), full - 1), lambda k: F.struct((k * size).alias("begin"), (k * size).alias("keep_from"), F.lit(size).cast("long").alias("keep_count")))
    tail = F.array(F.struct((rows - size).alias("begin"), (full * size).alias("keep_from"), (rows - full * size).alias("keep_count")))
    windows = F.when(rows % size == 0, starts).otherwise(F.concat(starts, tail))
    return counts.where(rows >= size).select(series, F.explode(windows).alias("w")).select(series, "w.*")


def sliding(df: DataFrame, series: str, order: str, size: int, stride: int, begin: str, end: str, first: Column | int = 0) -> DataFrame:
    """(series, order, begin, end): windows of `size` rows every `stride` rows from row `first` on, whole ones only."""
    w = Window.partitionBy(series).orderBy(order).rowsBetween(0, size - 1)
    first = first if isinstance(first, Column) else F.lit(first)
    spread = df.withColumns({"window_end": F.last(end).over(w), "rows": F.count(F.lit(1)).over(w)})
    chosen = (F.col("rows") == size) & (F.col(order) >= first) & (F.pmod(F.col(order) - first, F.lit(stride)) == 0)
    return spread.where(chosen).select(series, order, F.col(begin).alias("begin"), F.col("window_end").alias("end"))


def carried(df: DataFrame, series: str, order: str, value: Column, name: str, before: str | None = None) -> DataFrame:
    """Adds the last value that is not null up to each row. Rows before the first take it too if `before` is "first", else null."""
    w = Window.partitionBy(series).orderBy(order)
    out = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if before == "first":
        out = F.coalesce(out, F.first(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return df.withColumn(name, out)


def islands(df: DataFrame, series: str, order: str, cut: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows; a run begins where `cut` holds."""
    return df.withColumn(name, F.sum(cut.cast("long")).over(Window.partitionBy(series).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def active_chains(df: DataFrame, series: str, order: str, active: Column, hole: Column, event: Column, name: str = "chain") -> DataFrame:
    """The active rows with the number of their chain, from 0. Neighbouring active rows part where there is a hole from the one to the other, either included, or an event strictly between them.

    Holes and events are counted up once along the series, and the counts of neighbours differ by what lies between. Null flags are false.
    """
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    w = Window.partitionBy(series).orderBy(order)
    counted = df.withColumns({"__hole": flag(hole), "__event": flag(event), "__active": F.coalesce(active, F.lit(False))})
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumns({"__holes": F.sum("__hole").over(upto), "__events": F.sum("__event").over(upto)}).where("__active")
    before_hole = F.lag(F.col("__holes") - F.col("__hole")).over(w)
    cut = (F.col("__holes") > before_hole) | (F.col("__events") - F.col("__event") > F.lag("__events").over(w))
    return islands(counted.withColumn("__cut", F.coalesce(cut, F.lit(False))), series, order, F.col("__cut"), name).drop("__hole", "__event", "__active", "__holes", "__events", "__cut")


def without_trailing_repeats(df: DataFrame, series: str, order: str, head: Column, content: list[str]) -> DataFrame:
    """Rows of each series without the blocks at its end that repeat the one before them; a block runs from a `head` row to the next.

    Two blocks are equal if they have as many rows with the same content in the same order. A block is known by its length and two sums of
    64-bit hashes of each row's content with its place in the block, so its rows aren't gathered. Rows before the first head are a block too.
    """
    numbered = islands(df, series, order, F.coalesce(head, F.lit(False)), "__block")
    place = F.row_number().over(Window.partitionBy(series, "__block").orderBy(order))
    values = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in content]
    hashed = numbered.withColumn("__place", place)
    sums = [F.sum(F.xxhash64(F.lit(k), "__place", *values).cast("decimal(38,0)")).alias(f"__h{k}") for k in (1, 2)]
    blocks = hashed.groupBy(series, "__block").agg(F.count(F.lit(1)).alias("__rows"), *sums)
    w = Window.partitionBy(series).orderBy("__block")
    known = F.struct("__rows", "__h1", "__h2")
    differs = blocks.withColumn("__known", known).withColumn("__new", F.coalesce(~F.col("__known").eqNullSafe(F.lag("__known").over(w)), F.lit(True)).cast("long"))
    later = F.sum("__new").over(Window.partitionBy(series).orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1))
    # A block goes if it repeats the one before it and so do all blocks after it.
    gone = differs.withColumn("__later", F.coalesce(later, F.lit(0))).where("__new = 0 AND __later = 0").select(F.col(series).alias("__s"), F.col("__block").alias("__b"))
    return numbered.join(gone, F.col(series).eqNullSafe(F.col("__s")) & (F.col("__block") == F.col("__b")), "left_anti").drop("__block")


def ranked(df: DataFrame, key: str, *more: str, name: str = "rank", block: int = 1 << 14) -> DataFrame:
    """Adds each row's place from 0 in order of a whole-number key and further columns, without a task that sees all rows.

    Ranks inside blocks of the key are put end to end by the blocks' counts, and those by the counts of blocks of
    blocks, of which there is one for every `block` squared values that the key spans.
    """
    inner = df.withColumn("__b", F.floor(F.col(key) / block))
    counts = inner.groupBy("__b").agg(F.count(F.lit(1)).alias("__n")).withColumn("__c", F.floor(F.col("__b") / block))
    total = counts.groupBy("__c").agg(F.sum("__n").alias("__m"))
    ahead = total.select("__c", (F.sum("__m").over(Window.partitionBy(F.lit(0)).orderBy("__c")) - F.col("__m")).alias("__ahead"))
    before = counts.withColumn("__sum", F.sum("__n").over(Window.partitionBy("__c").orderBy("__b")) - F.col("__n"))
    before = before.join(ahead, "__c").select("__b", (F.col("__sum") + F.col("__ahead")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__b").orderBy(key, *more)) - 1
    return inner.withColumn("__place", place).join(before, "__b").withColumn(name, (F.col("__before") + F.col("__place")).cast("long")).drop("__b", "__place", "__before")


def runs(batches: Iterator[pa.RecordBatch], series: str) -> Iterator[tuple[object, pa.RecordBatch]]:
    """(series, rows) of each stretch of rows of one series, in batches that are sorted by it and have none without it."""
    for batch in batches:
        names = batch.column(series).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        heads = np.flatnonzero(np.diff(names, prepend=np.nan))
        for at, stop in zip(heads.tolist(), [*heads[1:].tolist(), batch.num_rows]):
            yield batch.column(series)[at].as_py(), batch.slice(at, stop - at)


def by_series(df: DataFrame, series: str, *order: str) -> DataFrame:
    """Rows dealt by series and sorted, for passes that keep a small state."""
    return df.where(F.col(series).isNotNull()).repartition(series).sortWithinPartitions(series, *order)


class Chunker:
    """Chunks of one series, decided as its rows come; rows before the open chunk's start are let go."""

    def __init__(self, size: int, stride: float, fps: float):
        self.size, self.stride, self.fps = size, stride, fps
        self.order, self.begin, self.end = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)

    def extend(self, order: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        self.order, self.begin, self.end = (np.concatenate(x) for x in ((self.order, order), (self.begin, begin), (self.end, end)))

    def decided(self, whole: bool, length: int | None = None, annotated: bool = True) -> Iterator[tuple[int, int, int, int]]:
        """(first, last, start frame, end frame) of the chunks that the rows so far decide, or of all that are left if the series is `whole`."""
        while len(self.order):
            start = int(self.begin[0] * self.fps)
            limit = (start + self.size) / self.fps
            over = np.flatnonzero(self.end[1:] > limit)
            following = np.flatnonzero(self.begin[1:] >= self.begin[0] + self.stride)
            if not whole and not (len(over) and len(following)):
                return
            last = int(over[0]) if len(over) else len(self.order) - 1
            stop = int(self.end[last] * self.fps)
            yield int(self.order[0]), int(self.order[last]), start, stop if length is None else min(stop, length)
            # A tail without an annotated end that the stride steps over gets chunks of its own.
            tail = last + 1 if last < len(self.order) - 1 and not annotated else len(self.order)
            following = int(following[0]) + 1 if len(following) else tail
            self.order, self.begin, self.end = self.order[following:], self.begin[following:], self.end[following:]


def budget_pass(df: DataFrame, series: str, order: str, begin: str, end: str, size: int, stride: float, fps: float, length: str | None = None, annotated: str | None = None) -> DataFrame:
    """The chunks of `reach.budget_chunks` for series that one task can pass: one sorted pass that holds the rows from the open chunk's start on."""
    extra = [c for c in (length, annotated) if c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_series, facts = None, None, (None, True)

        def table(name, found) -> pa.RecordBatch:
            columns = [pa.array([name] * len(found), kind), *(pa.array(c, pa.int64()) for c in (zip(*found) if found else [()] * 4))]
            return pa.RecordBatch.from_arrays(columns, names=[series, "first", "last", "start_frame", "end_frame"])

        for head, rows in runs(batches, series):
            kind = rows.column(series).type
            if open_series is not None and head != now:
                yield table(now, list(open_series.decided(True, *facts)))
                open_series = None
            if open_series is None:
                now, open_series = head, Chunker(size, stride, fps)
            facts = (rows.column(length)[0].as_py() if length else None, rows.column(annotated)[0].as_py() if annotated else True)
            open_series.extend(*(rows.column(c).to_numpy() for c in (order, begin, end)))
            yield table(now, list(open_series.decided(False, *facts)))
        if open_series is not None:
            yield table(now, list(open_series.decided(True, *facts)))

    rows = df.select(series, F.col(order).cast("long").alias(order), *(F.col(c).cast("double").alias(c) for c in (begin, end)), *extra)
    return by_series(rows, series, order).mapInArrow(run, f"`{series}` {rows.schema[series].dataType.simpleString()}, first long, last long, start_frame long, end_frame long")

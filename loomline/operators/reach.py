"""Rules that look back at the row they kept last, over series of any length.

"Keep a row that is far enough from the last one kept" links each row to its successor, and what is kept is what the first
row reaches. In a block the links are followed by doubling; what is left of the block is a monotone step function, from the value kept
last before it to the value kept last after it. Such functions compose (`stretches.scanned`), so each block learns what was
kept last before it, and marks its own rows. A function has a step for each row within one gap of its first row at most, less those that lead
to the same end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stretches import in_blocks, scanned
from .windows import budget_pass

Kept = Callable[[DataFrame], DataFrame]


class Rule:
    """Far enough is a difference of `gap` at least or, `by_sum`, at least the sum of the last one kept and the gap; the two can round differently."""

    def __init__(self, gap: float, by_sum: bool = False):
        self.gap, self.by_sum = gap, by_sum

    def following(self, x: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The first place in x, which ascends, that is far enough from each of `last`."""
        at = np.searchsorted(x, last + self.gap)
        if self.by_sum:
            return at
        while True:
            early = (at > 0) & (x[np.maximum(at - 1, 0)] - last >= self.gap)
            late = (at < len(x)) & (x[np.minimum(at, len(x) - 1)] - last < self.gap)
            if not (early.any() or late.any()):
                return at
            at = at - early + (late & ~early)

    def ends(self, x: np.ndarray) -> np.ndarray:
        """The last row of x that each of its rows reaches."""
        n = len(x)
        links = np.maximum(self.following(x, x), np.arange(n) + 1)
        to = np.where(links < n, links, np.arange(n))
        while True:
            further = to[to]
            if (further == to).all():
                return to
            to = further

    def function(self, x: np.ndarray) -> np.ndarray:
        """A block's step function: entry values, then the values kept last, one after the other."""
        return self.lean(x, x[self.ends(x)])

    def lean(self, x: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Without steps that no value before the first can enter by, or that lead where the next one leads."""
        stop = min(int(self.following(x, x[:1])[0]) + 1, len(x))
        x, end = x[:stop], end[:stop]
        use = np.append(end[1:] != end[:-1], True)
        return np.concatenate((x[use], end[use]))

    def after(self, last: np.ndarray, function: np.ndarray) -> np.ndarray:
        x, end = function.reshape(2, -1)
        at = self.following(x, last)
        return np.where(at < len(x), end[np.minimum(at, len(x) - 1)], last)

    def both(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """One function after the other; a value that no step of the first lets in goes on to the second."""
        x, end = first.reshape(2, -1)
        more, last = second.reshape(2, -1)
        return self.lean(np.concatenate((x, more)), np.concatenate((self.after(end, second), last)))

    def kept(self, x: np.ndarray, last: float) -> np.ndarray:
        """Places of the rows kept in a block."""
        links, out = np.maximum(self.following(x, x), np.arange(len(x)) + 1), []
        at = int(self.following(x, np.array([last]))[0])
        while at < len(x):
            out.append(at)
            at = int(links[at])
        return np.array(out, np.int64)


def kept_blocks(df: DataFrame, series: str, value: str, order: list[str], rule: Rule, kept: Kept) -> tuple[DataFrame, DataFrame]:
    """Blocks of `df` (stretches.in_blocks), and (series, block, state): what was kept last before each of them, as an array of one value."""
    kind = df.schema[series].dataType.simpleString()
    blocks = kept(in_blocks(df, series, order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = batch.column(value).flatten().to_numpy(), np.concatenate(([0], np.cumsum(batch.column(value).value_lengths().to_numpy())))
            items = [rule.function(x[a:b]) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(series), batch.column("block"), pa.array(items, pa.list_(pa.float64()))], names=[series, "block", "item"])

    items = kept(blocks.select(series, "block", value).mapInArrow(run, f"`{series}` {kind}, block long, item array<double>"))
    start = items.select(series).distinct().withColumn("state", F.array(F.lit(float("-inf"))))
    return blocks, scanned(items, series, start, rule.both, rule.after, False)


def thin(df: DataFrame, series: str, value: str, gap: float, kept: Kept) -> DataFrame:
    """Values of a series of which each is at least `gap` after the last one kept, and the first. Rows without a series or value go; of equal values one stays, if any."""
    rule = Rule(gap)
    rows = df.select(series, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull())
    blocks, before = kept_blocks(rows, series, value, [value], rule, kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(value)
            x, at = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            last = batch.column("state").flatten().to_numpy()
            places = [a + rule.kept(x[a:b], s) for a, b, s in zip(at, at[1:], last)]
            owner = np.repeat(np.arange(batch.num_rows), [len(p) for p in places])
            yield pa.RecordBatch.from_arrays([batch.column(series).take(pa.array(owner)), pa.array(x[np.concatenate(places)] if places else x[:0])], names=[series, value])

    return blocks.join(before.drop(series), "block").select(series, value, "state").mapInArrow(run, rows.schema)


def first_over(blocks: DataFrame, series: str, order: str, end: str, asked: DataFrame, kept: Kept) -> DataFrame:
    """(series, first, limit, over): for each question (series, first, limit) the least order after `first` whose `end` is above `limit`, or null.

    A question is looked up in the block of its row (`block`), then among the highest ends of the range's later blocks, then among those of the series' later
    ranges and the blocks of the one found; each question reads two blocks. A range's blocks and a series' ranges are passed in descending order, holding those that no later one tops.
    """
    number = blocks.schema[order].dataType.elementType.simpleString()
    ends = kept(blocks.select(series, "block", F.shiftright("block", 32).alias("range"), F.array_max(end).alias("top")))
    tops = ends.groupBy(series, "range").agg(F.max("top").alias("top"))

    def lookup(questions: DataFrame, arrays: DataFrame) -> DataFrame:
        """Questions with the first order in their block that answers them."""
        names = questions.columns
        own = questions.join(arrays.select("block", F.col(order).alias("__order"), F.col(end).alias("__end")), "block")
        both = F.filter(F.arrays_zip(F.col("__order").alias("o"), F.col("__end").alias("e")), lambda z: (z["o"] > F.col("first")) & (z["e"] > F.col("limit")))
        return own.withColumn("over", F.get(both, F.lit(0))["o"]).select(*names, "over")

    def next_above(table: DataFrame, questions: DataFrame, keys: list[str], place: str) -> DataFrame:
        """Questions with the first `place` after their own, within `keys`, whose top is above their limit; null if there is none."""
        rows = table.select(*keys, place, "top", F.lit(None).cast("double").alias("limit"), F.lit(None).cast(number).alias("first"))
        rows = rows.unionByName(questions.select(*keys, place, F.lit(None).cast("double").alias("top"), "limit", "first"))
        at = rows.schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, stack = None, []  # (top, place) in descending order of top: those that no earlier place in the pass tops
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in at.names]
                out = []
                for r, row in enumerate(zip(*columns)):
                    *key, where, top, limit, _ = row
                    if key != now:
                        now, stack = key, []
                    if top is not None:
                        while stack and stack[-1][0] <= top:
                            stack.pop()
                        stack.append((top, where))
                    else:
                        lo, hi = 0, len(stack)
                        while lo < hi:  # tops fall towards the end of the stack, so the last one above the limit is the nearest
                            mid = (lo + hi) // 2
                            lo, hi = (mid + 1, hi) if stack[mid][0] > limit else (lo, mid)
                        out.append((r, stack[lo - 1][1] if lo else None))
                rows_ = batch.take(pa.array([r for r, _ in out], pa.int64()))
                yield pa.RecordBatch.from_arrays([*map(rows_.column, [*keys, place, "limit", "first"]), pa.array([p for _, p in out], pa.int64())], names=[*keys, place, "limit", "first", "found"])

        schema = ", ".join([f"`{c}` {at[c].dataType.simpleString()}" for c in [*keys, place, "limit", "first"]] + ["found long"])
        # In descending order a question comes before its own place, so that only later ones are on the stack.
        return rows.repartition(*keys).sortWithinPartitions(*keys, F.desc(place), F.col("top").isNotNull()).select(*at.names).mapInArrow(run, schema)

    asked = asked.withColumn("range", F.shiftright("block", 32))
    own = kept(lookup(asked, blocks))
    inside = kept(next_above(ends, own.where("over IS NULL"), [series, "range"], "block"))
    far = kept(next_above(tops, inside.where("found IS NULL"), [series], "range"))
    # In the range found, any block from the first on may hold it: the question stands before all of the range's blocks.
    arrived = far.where("found IS NOT NULL").select(series, F.col("found").alias("range"), (F.shiftleft("found", 32) - 1).alias("block"), "limit", "first")
    placed = next_above(ends, arrived, [series, "range"], "block").drop("block")
    both = inside.where("found IS NOT NULL").select(series, "limit", "first", F.col("found").alias("block")).unionByName(placed.select(series, "limit", "first", F.col("found").alias("block")))
    late = lookup(both, blocks)
    none = far.where("found IS NULL").select(series, "limit", "first", F.lit(None).cast(number).alias("over"))
    return own.where("over IS NOT NULL").select(series, "first", "limit", "over").unionByName(late.select(series, "first", "limit", "over")).unionByName(none.select(series, "first", "limit", "over"))


def budget_chunks(df: DataFrame, series: str, order: str, begin: str, end: str, size: int, stride: float, fps: float, kept: Kept, length: str | None = None, annotated: str | None = None) -> DataFrame:
    """(series, first, last, start_frame, end_frame): chunks that grow while a row's end stays within `size` frames of the chunk's first frame.

    A chunk's first frame is the one that holds its first row's begin. The next chunk opens at the first row
    that starts at least `stride` seconds after this chunk's first row; where there is none, rows that the last
    chunk left out get chunks of their own if the series' end is not annotated. End frames are cut at the series' `length` in
    frames. Both are columns, the same in all rows of a series. Rows are numbered by `order` without gaps and their begins ascend.

    Rows at which chunks open are found by `Rule`, and a chunk's end by `first_over`. Only rows from the last opening on, which lie within one stride, are passed one by one.
    """
    extra = [c for c in (length, annotated) if c]
    rows = kept(df.select(series, F.col(order).cast("long").alias(order), *(F.col(c).cast("double").alias(c) for c in (begin, end)), *extra))
    rule = Rule(stride, by_sum=True)
    blocks, before = kept_blocks(rows, series, begin, [order], rule, kept)
    kind = rows.schema[series].dataType.simpleString()

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(begin)
            x, at = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            last = batch.column("state").flatten().to_numpy()
            places = [a + rule.kept(x[a:b], s) for a, b, s in zip(at, at[1:], last)]
            owner, place = pa.array(np.repeat(np.arange(batch.num_rows), [len(p) for p in places])), np.concatenate(places) if places else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(series).take(owner), batch.column("block").take(owner), batch.column(order).flatten().take(pa.array(place)), pa.array(x[place])], names=[series, "block", "first", begin])

    openings = blocks.join(before.drop(series), "block").select(series, "block", order, begin, "state").mapInArrow(open_, f"`{series}` {kind}, block long, first long, `{begin}` double")
    start = F.floor(F.col(begin) * fps)
    openings = kept(openings.withColumn("start_frame", start.cast("long")).withColumn("limit", (F.col("start_frame") + size) / F.lit(fps)))
    final = openings.groupBy(series).agg(F.max("first").alias("final"))
    regular = kept(openings.join(final, series).where("first < final").drop("final"))
    over = first_over(blocks, series, order, end, regular.select(series, "block", "first", "limit"), kept)
    ends = rows.groupBy(series).agg(F.max(order).alias("__last"))
    closed = over.join(ends, series).select(series, "first", F.coalesce(F.col("over") - 1, "__last").alias("last"))
    # The row that ends a chunk, by its number.
    closing = rows.select(series, F.col(order).alias("last"), F.col(end).alias("__end"), *extra)
    whole = closed.join(closing, [series, "last"]).join(regular.select(series, "first", "start_frame"), [series, "first"])
    frame = F.floor(F.col("__end") * fps).cast("long")
    whole = whole.select(series, "first", "last", "start_frame", (F.least(frame, F.col(length)) if length else frame).alias("end_frame"))
    late = blocks.join(final, series).where(F.element_at(order, -1) >= F.col("final"))
    late = late.select(series, "final", F.inline(F.arrays_zip(*(F.col(c) for c in (order, begin, end, *extra))))).where(F.col(order) >= F.col("final")).drop("final")
    return whole.unionByName(budget_pass(late, series, order, begin, end, size, stride, fps, length, annotated))

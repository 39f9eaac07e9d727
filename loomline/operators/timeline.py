"""Points, intervals and frames on a time axis."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import ratio


def in_intervals(points: DataFrame, intervals: DataFrame, series: str, time: str, begin: str, end: str, key: str) -> DataFrame:
    """Points with the key of the interval [begin, end) of their series that holds them, or null.

    Intervals of a series may not overlap. Both sides are put in one order of time and the last interval
    begun is carried on, so the cost is one sort, whatever the number of intervals.
    """
    opened = intervals.select(series, F.col(begin).alias("at"), F.lit(0).alias("kind"), F.struct(F.col(key).alias("k"), F.col(end).alias("e")).alias("open"))
    both = points.select(series, F.col(time).alias("at"), F.lit(1).alias("kind"), F.struct(*points.columns).alias("p")).unionByName(opened, allowMissingColumns=True)
    w = Window.partitionBy(series).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("open", F.last("open", ignorenulls=True).over(w)).where("kind = 1")
    return held.select("p.*", F.when(F.col("at") < F.col("open.e"), F.col("open.k")).alias(key))


def near(left: DataFrame, right: DataFrame, series: str, left_time: str, right_time: str, tolerance: float) -> DataFrame:
    """Pairs at most `tolerance` apart: times meet by their cell of that width and its neighbours."""
    cell = lambda c: F.floor(F.col(c) / tolerance)
    cells = right.withColumn("cell", F.explode(F.array(*(cell(right_time) + d for d in (-1, 0, 1)))))
    return left.withColumn("cell", cell(left_time)).join(cells, [series, "cell"]).where(F.abs(F.col(left_time) - F.col(right_time)) <= tolerance).drop("cell")


def trusted_intervals(intervals: DataFrame, beats: DataFrame, series: str, tolerance: float = 1e-3) -> DataFrame:
    """Adds `trusted` to intervals (series, number, begin, end, overfull, begin_known, end_known) by the beats (series, sec, head, grounded, place) of their series.

    An interval is trusted if both its edges are known, it isn't overfull, it holds beats and all of them are grounded, and a grounded head lies
    within the tolerance of either edge. In the first interval an opening beat whose place isn't the first stands for the head (a pickup), and the last needs
    none at its end. A beat just before an edge, within the tolerance, belongs to the interval behind it.
    """
    spans = intervals.select(series, "number", "begin", "end")
    placed = in_intervals(beats.withColumn("__at", F.col("sec") + tolerance), spans, series, "__at", "begin", "end", "number").where(F.col("number").isNotNull())
    inner = placed.groupBy(series, "number").agg(F.bool_and("grounded").alias("__grounded"), F.min_by("place", "sec").alias("__place"))
    heads = beats.where("head AND grounded").select(series, "sec")
    at_edge = lambda edge, name: near(heads, spans.select(series, "number", edge), series, "sec", edge, tolerance).select(series, "number").distinct().withColumn(name, F.lit(True))
    ends = spans.groupBy(series).agg(F.min("number").alias("__first"), F.max("number").alias("__last"))
    met = intervals.join(inner, [series, "number"], "left").join(at_edge("begin", "__begins"), [series, "number"], "left").join(at_edge("end", "__ends"), [series, "number"], "left").join(ends, series)
    pickup = (F.col("number") == F.col("__first")) & F.coalesce(F.col("__place") > 0, F.lit(False))
    begins = F.coalesce("__begins", F.lit(False)) | pickup
    ends_well = F.coalesce("__ends", F.lit(False)) | (F.col("number") == F.col("__last"))
    trusted = F.col("begin_known") & F.col("end_known") & ~F.col("overfull") & F.coalesce("__grounded", F.lit(False)) & begins & ends_well
    return met.select(*intervals.columns, trusted.alias("trusted"))


def clamped(grid: DataFrame, points: DataFrame, series: str, time: str, value: str) -> DataFrame:
    """(series, time, value) of distinct grid rows: interpolated between points, and the first or last point's value outside of them."""
    ends = points.groupBy(series).agg(F.min_by(value, time).alias("__low"), F.max_by(value, time).alias("__high"), F.min(time).alias("__from"))
    inner = interpolated(grid.select(series, time).distinct(), points, series, time, value)
    outer = F.when(F.col(time) < F.col("__from"), F.col("__low")).otherwise(F.col("__high"))
    return inner.join(ends, series).select(series, time, F.coalesce(value, outer).alias(value))


def interval_cycles(intervals: DataFrame, beats: DataFrame, grid: DataFrame, series: str, slack: float = 0.01) -> DataFrame:
    """(series, number, begin, end, trusted, low, span, violation): the whole cycles at which intervals begin and what they span, by a grid of points (series, sec, cycle).

    Edges take the grid's interpolated cycle, rounded half to even. A closing edge behind the last point lies one cycle after it. Where the first edge lies before
    the first point, or the first beat inside is not the first of its bar (`place` above 0, a pickup), it lies that beat's place before that beat; without a
    beat one cycle before the second edge. An edge of a trusted interval further than `slack` from a whole cycle is `off_grid`, and a trusted interval has to span something.
    """
    edges = intervals.select(series, F.col("begin").alias("sec")).unionByName(intervals.select(series, F.col("end").alias("sec")))
    first = Window.partitionBy(series).orderBy("number")
    spans = intervals.withColumns({"__first": F.row_number().over(first) == 1, "__last": F.lead("number").over(first).isNull()})
    opening = spans.where("__first").select(series, "begin", "end")
    inside = beats.join(opening, series).where((F.col("sec") >= F.col("begin")) & (F.col("sec") < F.col("end")))
    anchor = inside.groupBy(series).agg(F.min(F.struct("sec", "place")).alias("a")).select(series, F.col("a.sec").alias("__anchor"), F.col("a.place").alias("__place"))
    times = clamped(edges.unionByName(anchor.select(series, F.col("__anchor").alias("sec"))), grid, series, "sec", "cycle")
    at = lambda time, name: times.select(series, F.col("sec").alias(time), F.col("cycle").alias(name))
    points = grid.groupBy(series).agg(F.min("sec").alias("__from"), F.max("sec").alias("__upto"), F.max_by("cycle", "sec").alias("__top"))
    met = spans.join(at("begin", "__b"), [series, "begin"]).join(at("end", "__e"), [series, "end"]).join(points, series)
    met = met.join(anchor.join(at("__anchor", "__c"), [series, "__anchor"]), series, "left")
    closing = F.when(F.col("__last") & (F.col("end") > F.col("__upto")), F.col("__top") + 1).otherwise(F.col("__e"))
    met = met.withColumn("__e", closing)
    moved = F.col("__first") & ((F.col("begin") < F.col("__from")) | F.coalesce(F.col("__place") > 0, F.lit(False)))
    met = met.withColumn("__b", F.when(moved, F.coalesce(F.col("__c") - F.col("__place"), F.col("__e") - 1)).otherwise(F.col("__b")))
    low, high = F.rint("__b"), F.rint("__e")
    off = (F.abs(F.col("__b") - low) > slack) | (F.abs(F.col("__e") - high) > slack)
    wrong = F.when(F.col("trusted") & off, "off_grid").when(F.col("trusted") & (high <= low), "no_span")
    return met.select(series, "number", "begin", "end", "trusted", low.cast("long").alias("low"), (high - low).cast("long").alias("span"), wrong.alias("violation"))


def cycle_curve(frames: DataFrame, cycles: DataFrame, grid: DataFrame, series: str) -> DataFrame:
    """(series, sec, number, fraction): how far each frame is through the interval that it lies in, 0 in one that isn't trusted or has a violation.

    Frames before the first interval count to it, and those behind the last to that. `cycles` are from `interval_cycles`.
    """
    values = clamped(frames, grid, series, "sec", "cycle")
    opened = cycles.withColumn("__far", F.lit(float("inf"))).withColumn("__open", F.struct("number", "low", "span", (F.col("trusted") & F.col("violation").isNull()).alias("good")))
    held = in_intervals(values, opened, series, "sec", "begin", "__far", "__open")
    first = opened.groupBy(series).agg(F.min_by("__open", "begin").alias("__first"))
    held = held.join(first, series).withColumn("__open", F.coalesce("__open", "__first"))
    part = F.when(F.col("__open.good"), (F.col("cycle") - F.col("__open.low")) / F.col("__open.span")).otherwise(0.0)
    return held.select(series, "sec", F.col("__open.number").alias("number"), part.alias("fraction"))


def tolerance_counts(df: DataFrame, series: str, time: str, side: str, sides: tuple[str, str], tolerance: float) -> DataFrame:
    """(series, predicted, hits, targets, found): rows of either side, and how many of them have a row of the other side within the tolerance.

    Each row is given the last time of the other side up to its own and the first one from its own on, so no pairs are built.
    """
    in_time = Window.partitionBy(series)
    up = in_time.orderBy(time).rangeBetween(Window.unboundedPreceding, 0)
    down = in_time.orderBy(F.desc(time)).rangeBetween(Window.unboundedPreceding, 0)
    of = [F.when(F.col(side) == s, F.col(time)) for s in sides]
    seen = df.withColumns({"__before_0": F.max(of[0]).over(up), "__before_1": F.max(of[1]).over(up)})
    seen = seen.withColumns({"__after_0": F.min(of[0]).over(down), "__after_1": F.min(of[1]).over(down)})
    near = lambda k: F.coalesce(F.least(F.col(time) - F.col(f"__before_{k}"), F.col(f"__after_{k}") - F.col(time)) <= tolerance, F.lit(False))
    first, second = (F.col(side) == s for s in sides)
    return seen.groupBy(series).agg(F.count_if(first).alias("predicted"), F.count_if(first & near(1)).alias("hits"), F.count_if(second).alias("targets"), F.count_if(second & near(0)).alias("found"))


def log_sum_exp(df: DataFrame, keys: list[str], x: str, name: str) -> DataFrame:
    """ln of the sum of exp(x) of each group, for x of any size: sums over unit steps of x combine before the shuffle, and meet around the group's highest step."""
    step = F.floor(x)
    steps = df.groupBy(*keys, step.alias("__step")).agg(F.sum(F.exp(F.col(x) - step)).alias("__sum"))
    top = F.max("__step").over(Window.partitionBy(*keys))
    return steps.withColumn("__top", top).groupBy(*keys).agg((F.first("__top") + F.log(F.sum(F.col("__sum") * F.exp(F.col("__step") - F.col("__top"))))).alias(name))


def interpolated(grid: DataFrame, points: DataFrame, series: str, time: str, value: str, lead: float = 0.0) -> DataFrame:
    """Grid rows with the value between the last point at or before them and the next one, its rate, and whether there are both.

    A row less than `lead` before the first point belongs to the first segment. Ties in time: the last point counts.
    """
    at_point = Window.partitionBy(series).orderBy(time)
    segment = F.struct(F.col(time).alias("t"), F.col(value).alias("v"), F.lead(time).over(at_point).alias("t1"), F.lead(value).over(at_point).alias("v1"))
    p = points.select(series, F.col(time).alias("at"), F.lit(0).alias("kind"), segment.alias("p"))
    both = grid.select(series, F.col(time).alias("at"), F.lit(1).alias("kind")).unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy(series).orderBy("at", "kind")
    held = F.last("p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if lead:
        first = F.first("p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        held = F.coalesce(held, F.when(first["t"] - F.col("at") < lead, first))
    both = both.withColumn("p", held).where("kind = 1")
    rate = (F.col("p.v1") - F.col("p.v")) / (F.col("p.t1") - F.col("p.t"))
    return both.select(series, F.col("at").alias(time), (F.col("p.v") + rate * (F.col("at") - F.col("p.t"))).alias(value), rate.alias("rate"), F.col("p.t1").isNotNull().alias("valid"))


class FreeTargets:
    """Sorted targets; those taken are stepped over by links to their nearest free neighbours."""

    def __init__(self, times: list[float]):
        self.order = sorted(range(len(times)), key=lambda k: (times[k], k))
        self.times = [times[k] for k in self.order]
        n = len(times)
        self.up, self.down = list(range(n + 1)), list(range(n + 1))  # down is shifted by one: 0 is before all

    @staticmethod
    def find(link: list[int], at: int) -> int:
        root = at
        while link[root] != root:
            root = link[root]
        while link[at] != root:
            link[at], at = root, link[at]
        return root

    def take(self, time: float, tolerance: float) -> bool:
        """Takes the nearest free target within the tolerance, of equally near ones the first in the given order."""
        at = bisect_left(self.times, time)
        above, below = self.find(self.up, at), self.find(self.down, at) - 1
        near = [k for k in (below, above) if 0 <= k < len(self.times) and abs(time - self.times[k]) <= tolerance]
        # Targets of one time stand in their order, but from below the last of them comes first.
        if below in near:
            first = self.find(self.up, bisect_left(self.times, self.times[below]))
            near[near.index(below)] = first
        if not near:
            return False
        one = min(near, key=lambda k: (abs(time - self.times[k]), self.order[k]))
        self.up[one], self.down[one + 1] = one + 1, one
        return True


def match_events(df: DataFrame, series: str, tolerance: float) -> DataFrame:
    """Greedy one-to-one matching in each series of rows (side 'p' or 't', time, place): hits, precision, recall and F1.

    Predictions in order of place take the nearest target within the tolerance that is not used yet, the
    first on a tie. A series is cut where neighbouring times lie further apart than the tolerance, over which no
    match can reach; each choice depends on those before, so a piece is one group, in time n log n.
    """
    in_time = Window.partitionBy(series).orderBy("time", "side", "place")
    gap = (F.col("time") - F.lag("time").over(in_time) > tolerance).cast("long")
    pieces = df.withColumn("gap", F.coalesce(gap, F.lit(0))).withColumn("piece", F.sum("gap").over(in_time.rowsBetween(Window.unboundedPreceding, 0)))
    piece = Window.partitionBy(series, "piece")
    both = pieces.withColumn("mixed", F.min("side").over(piece) != F.max("side").over(piece))

    def match(group: pd.DataFrame) -> pd.DataFrame:
        p, t = (group[group.side == s].sort_values("place")["time"].to_list() for s in "pt")
        free = FreeTargets(t)
        return pd.DataFrame({series: group[series].iloc[:1], "hits": [sum(free.take(x, tolerance) for x in p)]})

    kind = df.schema[series].dataType.simpleString()
    hits = both.where("mixed").select(series, "piece", "side", "time", "place").groupBy(series, "piece").applyInPandas(match, f"`{series}` {kind}, hits long").groupBy(series).agg(F.sum("hits").alias("hits"))
    counts = df.groupBy(series).agg(F.count_if(F.col("side") == "p").alias("p"), F.count_if(F.col("side") == "t").alias("t"))
    found = counts.join(hits, series, "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    precision, recall = ratio("hits", "p"), ratio("hits", "t")
    return found.select(series, "hits", precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"))

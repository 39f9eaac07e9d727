"""Links within the lists of an inverted index, without expanding a list into pairs.

A list is searched breadth-first: the members not reached yet are compared with one that is, so a list
of m gives at most m - 1 links, and a dense one is used up in a few steps. Lists that are too long are
cut by a hash of the member into parts, of which every two form a list, so that no link is lost and no task
holds more. With more than `FEW` parts that would be too many rows: such parts are searched alone first. What these
links connect need not be compared again, so of such a list the members outside its largest component then
meet all its parts, and each other. A dense list of n members so costs about n rows, whatever its length; one whose
members are linked to few others costs up to n * n / limit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .components import connected_components

FEW, LINKS = 64, 1 << 20
Near = Callable[[int, np.ndarray], np.ndarray]


def spanning(n: int, near: Near) -> list[tuple[int, int]]:
    """A spanning forest of the links between n members: each is reached from another that `near` accepts."""
    out, left = [], np.arange(n)
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            one = front.pop()
            hit = near(one, left)
            if hit.any():
                reached = left[hit].tolist()
                out += [(one, x) for x in reached]
                front += reached
                left = left[~hit]
    return out


def with_links(group: np.ndarray, start: np.ndarray, end: np.ndarray, near: Near) -> np.ndarray:
    """Which of the lists, from `start` to `end` each, have a link at all; member after member is compared with those behind it, in all lists at once."""
    found, which, stop, at, far = np.zeros(len(start), bool), np.repeat(np.arange(len(start)), end - start), np.repeat(end, end - start), np.arange(len(group)), 0
    while len(at):
        far += 1
        at = at[(at + far < stop[at]) & ~found[which[at]]]
        found[which[at[near(at, at + far)]]] = True
    return np.flatnonzero(found)


def search(rows: DataFrame, near_of: Callable[[pa.RecordBatch], Near], at_once: bool = False) -> DataFrame:
    """(a, b): enough links between the keys of each list to connect all that are linked in it. `rows`: list, key, and what `near_of` needs.

    `at_once`: what `near_of` gives also compares many pairs, so that lists without a link are passed over together.
    """

    def links(batch: pa.RecordBatch) -> pa.RecordBatch:
        group, key = batch.column("list").to_numpy(), batch.column("key").to_numpy()
        edges = np.flatnonzero(np.diff(group))
        pairs = [np.zeros((0, 2), np.int64)]
        start, end = np.concatenate(([0], edges + 1)), np.concatenate((edges + 1, [len(group)]))
        some = with_links(group, start, end, near_of(batch)) if at_once else slice(None)
        for a, b in zip(start[some], end[some]):
            if b - a > 1:
                found = np.array(spanning(b - a, near_of(batch.slice(a, b - a))), np.int64).reshape(-1, 2)
                pairs.append(key[a:b][found])
        pairs = np.concatenate(pairs)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None  # pieces of the list that may go on in the next batch
        for batch in batches:
            group = batch.column("list").to_numpy()
            if not len(group):
                continue
            if held and group[0] != last:
                yield links(pa.concat_batches(held))
                held = []
            last = group[-1]
            cut = int(np.searchsorted(group, last))
            if cut:
                yield links(pa.concat_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield links(pa.concat_batches(held))

    return rows.repartition("list").sortWithinPartitions("list", "key").mapInArrow(run, "a long, b long").distinct()


def forest(links: DataFrame) -> DataFrame:
    """(a, b): links that connect what `links` do. A task ties each node to the root of its tree, for every LINKS links that it reads, so lists that connect the same nodes count once there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above, read = {}, 0

        def root(x: int) -> int:
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        def ties() -> pa.RecordBatch:
            tied = [(x, y) for x in above if (y := root(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([t[k] for t in tied], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                above.setdefault(a, a)
                above.setdefault(b, b)
                x, y = root(a), root(b)
                above[max(x, y)] = min(x, y)
            read += batch.num_rows
            if read >= LINKS:
                yield ties()
                above.clear()
                read = 0
        yield ties()

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def linked(rows: DataFrame, group: str, near_of: Callable[[pa.RecordBatch], Near], weight: Column, limit: int, sizes: DataFrame | None = None, at_once: bool = False) -> DataFrame:
    """(a, b): enough links to connect all keys that are linked in a common list. `rows`: the list's name, key, and what `near_of` needs; a part weighs at most about `limit`.

    `sizes`: each list's name and its weight w, if that is known more cheaply. `at_once`: see `search`.
    """
    parts = lambda w: F.greatest(F.ceil(2 * w / limit), F.lit(1)).cast("int")
    part = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    payload = [c for c in rows.columns if c != group]
    sizes = rows.groupBy(group).agg(F.sum(weight).alias("w")) if sizes is None else sizes
    sizes = sizes.withColumnRenamed(group, "named")
    rows, group = rows.withColumnRenamed(group, "named"), "named"
    every = lambda n: F.sequence(F.lit(0), n - 1)
    two = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), F.least(i, j).alias("i"), F.greatest(i, j).alias("j"))
    long = checkpointed(sizes.where(F.col("w") > limit).select(group, parts(F.col("w")).alias("parts")))
    if long.isEmpty():
        return search(rows.select(F.col(group).alias("list"), *payload), near_of, at_once)
    cut = rows.join(long, group, "left").withColumn("part", F.coalesce(part(F.col("parts")), F.lit(0)))
    pairs = F.transform(every(F.col("parts")), lambda k: two(1, k, F.col("part")))
    alone = F.array(two(1, F.col("part"), F.col("part")))
    dealt = cut.withColumn("pair", F.explode(F.when(F.coalesce("parts", F.lit(1)).between(2, FEW), pairs).otherwise(alone)))
    found = search(dealt.select(F.xxhash64(group, "pair").alias("list"), *payload), near_of, at_once)
    long = long.where(F.col("parts") > FEW)
    if long.isEmpty():
        return found
    found = checkpointed(found)
    roots = connected_components(found).withColumnRenamed("node", "key")
    members = rows.join(long.select(group), group).join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")).withColumn("w", weight)
    roots = members.groupBy(group, "root").agg(F.sum("w").alias("w"))
    heads = roots.groupBy(group).agg(F.max_by("root", "w").alias("main"), F.max("w").alias("most"), F.sum("w").alias("all")).where(F.col("all") > F.col("most"))
    heads = checkpointed(heads.select(group, "main", parts(F.col("most")).alias("p"), parts(F.col("all") - F.col("most")).alias("q")))
    met = members.join(heads, group)
    own, other = F.transform(every(F.col("q")), lambda j: F.struct(F.lit(0).alias("kind"), part(F.col("p")).alias("i"), j.alias("j"))), part(F.col("q"))
    across = F.transform(every(F.col("p")), lambda i: F.struct(F.lit(0).alias("kind"), i.alias("i"), other.alias("j")))
    among = F.transform(every(F.col("q")), lambda k: two(1, k, other))
    lists = F.when(F.col("root") == F.col("main"), own).otherwise(F.concat(across, among))
    again = met.withColumn("pair", F.explode(lists)).select(F.xxhash64(group, "pair").alias("list"), *payload)
    return found.unionByName(search(again, near_of, at_once)).distinct()

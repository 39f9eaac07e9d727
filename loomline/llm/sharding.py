"""Sharding by a k-d tree over metadata, with DataFrame functions only.

A node of the tree that is to become k shards is cut along its widest dimension, at the place
where k // 2 shares of its bytes lie on one side. Cuts of all nodes of a level are found together:
a histogram of `BINS` bins for each node, then one of the bin that holds the cut, until what lies in
that bin is at most `EXACT` of a shard or one group. Of a histogram only the bin that holds the cut reaches the driver, one row
for each node; bounds of nodes go to the tasks as a broadcast table of one row a node. Law: `bytes`.

A row's place along a dimension is the measure and, for ties, a hash of its group (equal texts), so
that a group stays whole. The dimensions are measures of the text, as `lang` and `source` may differ between
equal texts, and none is its size: shards of large documents alone could not be evened out. What a cut leaves one side short of, because documents are large, is made up in
`ROUNDS` rounds by small documents of the other side, in order of their group. A group is split, by a hash of the id,
only if it leaves a cut short of more than `HEAVY` of a shard, or if a cut is still short of more than `LOOSE` of one after
these rounds and it is the heaviest group of the other side; equal rows stay together.

Nulls in a measure count as zero, a null text as empty. Long texts are measured whole. An empty table
gives no rows. Slots number a shard's rows from 0, in order of a hash of the id and the id; a shard's rows
are numbered in `LANES` parts that are put end to end. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, documents

SHARDS, BINS, EXACT, LOOSE, HEAVY, ROUNDS, LANES, OVERHEAD = 40, 512, 0.0005, 0.005, 0.5, 2, 64, 16
UNIT = 1 << 28  # a dimension's measures are whole numbers below this


def measured(df: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32) and three dimensions of the text: its bytes beyond one a character, its mean line, its blanks."""
    text = F.coalesce("text", F.lit(""))
    size, chars = F.octet_length(text), F.length(text)
    without = lambda c: F.length(F.replace(text, F.lit(c), F.lit("")))
    scaled = lambda x: F.least(F.floor(x * UNIT), F.lit(UNIT - 1)).cast("long")
    return df.select(
        "doc_id",
        (size + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        scaled((size - chars) / F.greatest(size, F.lit(1))).alias("d0"),
        scaled(F.log1p(size / (chars - without("\n") + 1)) / 32).alias("d1"),
        scaled((chars - without(" ")) / F.greatest(size, F.lit(1))).alias("d2"),
    )


def given(spark: SparkSession, rows: list[tuple], **columns: str) -> DataFrame:
    """A table of rows that the driver knows, as one literal that Spark parses: no Python runs in tasks."""
    listed = json.dumps([dict(zip(columns, row, strict=True)) for row in rows])
    kind = ", ".join(f"{name}: {type_}" for name, type_ in columns.items())
    return spark.range(1).select(F.inline(F.from_json(F.lit(listed), f"array<struct<{kind}>>")))


def by_node(df: DataFrame, names: str, values: dict[int, tuple], how: str = "inner") -> DataFrame:
    """Rows with what is said of their node; `names` are the columns, whole numbers."""
    said = given(df.sparkSession, [(node, *row) for node, row in values.items()], node="int", **dict.fromkeys(names.split(), "long"))
    return df.join(F.broadcast(said), "node", how)


def find_cuts(df: DataFrame, wanted: dict[int, float], exact: float) -> dict[int, int]:
    """For each node a bound: rows whose `key` is at most it weigh as near the wanted weight as may be. `df`: node, key, size."""
    ends = df.groupBy("node").agg(F.min("key").alias("low"), F.max("key").alias("high")).collect()
    span = {r.node: (r.low, r.high) for r in ends if r.node in wanted}
    before, done = dict.fromkeys(span, 0), {n: -1 for n in wanted if n not in span}
    while span:
        said = {n: (low, high, (high - low) // BINS + 1) for n, (low, high) in span.items()}
        inside = by_node(df, "low high step", said).where((F.col("key") >= F.col("low")) & (F.col("key") <= F.col("high")))
        bins = inside.groupBy("node", F.call_function("div", F.col("key") - F.col("low"), F.col("step")).cast("int").alias("bin"))
        weighed = bins.agg(F.sum("size").alias("w"), F.min("key").alias("first"), F.max("key").alias("last"))
        weighed = weighed.withColumn("total", F.sum("w").over(Window.partitionBy("node").orderBy("bin")))
        goals = given(df.sparkSession, [(n, before[n], float(wanted[n])) for n in span], node="int", before="long", wanted="double")
        reached = F.when(F.col("before") + F.col("total") >= F.col("wanted"), F.struct("bin", "first", "last", "w", "total"))
        met = weighed.join(F.broadcast(goals), "node").groupBy("node").agg(F.min(reached).alias("cut"), F.max("last").alias("end")).collect()
        for n in set(span) - {r.node for r in met}:
            done[n] = span.pop(n)[1]
        for r in met:
            n, cut = r.node, r.cut
            if cut is None:
                done[n] = r.end
                del span[n]
                continue
            total = before[n] + cut.total - cut.w  # of what lies before the bin
            if cut.first == cut.last or cut.w <= exact:
                done[n] = cut.last if total + cut.w - wanted[n] <= wanted[n] - total else cut.first - 1
                del span[n]
            else:
                span[n], before[n] = (cut.first, cut.last), total
    return done


def first_sides(keyed: DataFrame, wanted: dict[int, float], shard: float) -> DataFrame:
    """Adds `left`, the side of each row of a node that is cut; a group too heavy to stay whole is divided by the hash of its rows."""
    cut = find_cuts(keyed.select("node", "key", "size"), wanted, EXACT * shard)
    sides = by_node(keyed, "cut", {n: (c,) for n, c in cut.items()})
    near = sides.groupBy("node").agg(F.sum(F.when(F.col("key") <= F.col("cut"), F.col("size")).otherwise(0)).alias("left"), F.min(F.when(F.col("key") > F.col("cut"), F.col("key"))).alias("next")).collect()
    split = {}
    for r in near:
        short = wanted[r.node] - r.left
        group = cut[r.node] if short < 0 else r.next
        if abs(short) > HEAVY * shard and group is not None:
            split[r.node] = (group, short)
    inner = {}
    if split:
        heavy = by_node(keyed, "group", {n: (g,) for n, (g, _) in split.items()}).where("key = group").select("node", F.col("h").alias("key"), "size")
        weights = {r.node: r.w for r in heavy.groupBy("node").agg(F.sum("size").alias("w")).collect()}
        inner = find_cuts(heavy, {n: weights[n] + short if short < 0 else short for n, (_, short) in split.items()}, EXACT * shard)
    told = {n: (c, split[n][0] if n in inner else -1, inner.get(n, -1)) for n, c in cut.items()}
    told = {n: (g - 1 if g >= 0 else c, g, i) for n, (c, g, i) in told.items()}
    return by_node(keyed, "cut group inner", told).withColumn("left", (F.col("key") <= F.col("cut")) | ((F.col("key") == F.col("group")) & (F.col("h") <= F.col("inner")))).drop("cut", "inner")


def shortages(sides: DataFrame, wanted: dict[int, float], least: float) -> dict[int, int]:
    """How much each node's left side lacks (or has too much, if negative), where it is more than `least`."""
    sums = {r.node: r.w for r in sides.groupBy("node").agg(F.sum(F.when(F.col("left"), F.col("size")).otherwise(0)).alias("w")).collect()}
    return {n: int(w - sums[n]) for n, w in wanted.items() if n in sums and abs(w - sums[n]) > least}


def moved(told: DataFrame, moves: Column, key: str, short: dict[int, int], exact: float, columns: list[str]) -> DataFrame:
    """Rows of which those that may move change sides, in order of `key`, until what is short is made up as nearly as may be."""
    bound = find_cuts(told.where(moves).select("node", F.col(key).alias("key"), "size"), {n: abs(s) for n, s in short.items()}, exact)
    over = by_node(told, "bound", {n: (b,) for n, b in bound.items()}, "left")
    changed = F.coalesce(moves & (F.col(key) <= F.col("bound")), F.lit(False))
    return checkpointed(over.withColumn("left", F.col("left") != changed).select(columns))


def evened(sides: DataFrame, wanted: dict[int, float], shard: float, group: str) -> DataFrame:
    """Rows with `left`, after documents of the heavier side have moved over to make up what the cut left short."""
    heavier = F.col("left") == (F.col("short") < 0)
    for _ in range(ROUNDS):
        if not (short := shortages(sides, wanted, EXACT * shard)):
            return sides
        # Rows that are small against what is missing, and no part of a group that was split. Equal texts have one key.
        told = by_node(sides, "short", {n: (s,) for n, s in short.items()}, "left")
        sides = moved(told, heavier & (2 * F.col("size") <= F.abs("short")) & (F.col("key") != F.col("group")), group, short, EXACT * shard, sides.columns)
    if short := shortages(sides, wanted, LOOSE * shard):
        told = by_node(sides, "short", {n: (s,) for n, s in short.items()}, "left")
        groups = told.where(heavier).groupBy("node", group).agg(F.sum("size").alias("w")).groupBy("node").agg(F.max_by(group, "w").alias("heaviest")).collect()
        told = by_node(told, "heaviest", {r.node: (r.heaviest,) for r in groups}, "left")
        sides = moved(told, heavier & (F.col(group) == F.col("heaviest")), "h", short, EXACT * shard, sides.columns)
    return sides


def kd_shards(rows: DataFrame, dims: list[str], shards: int, weight: str = "size", group: str = "text_crc32", row: str = "doc_id") -> DataFrame:
    """Adds `shard` to skinny rows. Dimensions are longs below UNIT, the group a long below 2**32."""
    kept = rows.columns
    state = checkpointed(rows.withColumn("node", F.lit(0)).withColumn("h", F.shiftrightunsigned(F.xxhash64(row), 2)))
    parts = [shards]
    while max(parts) > 1:
        ends = [f(d).alias(f"{name}_{d}") for d in dims for name, f in (("min", F.min), ("max", F.max))]
        extents = {r.node: r for r in state.groupBy("node").agg(F.sum(weight).alias("w"), *ends).collect()}
        cut = {n: r for n, r in extents.items() if parts[n] > 1}
        if not cut:
            break
        told, following = {}, []
        for n, k in enumerate(parts):
            if n in extents:
                axis = max(range(len(dims)), key=lambda d: (extents[n][f"max_{dims[d]}"] - extents[n][f"min_{dims[d]}"], -d))
                told[n] = (axis, len(following), int(k > 1))
            following += [k // 2, k - k // 2] if k > 1 else [1]
        wanted = {n: r.w * (parts[n] // 2) / parts[n] for n, r in cut.items()}
        shard = min(r.w / parts[n] for n, r in cut.items())
        known = by_node(state, "axis first two", told)
        keyed = known.where("two = 1").withColumn("key", F.get(F.array(*dims), F.col("axis").cast("int")) * F.lit(1 << 32) + F.col(group)).withColumn("size", F.col(weight))
        sides = evened(checkpointed(first_sides(keyed, wanted, shard)), wanted, shard, group)
        side = (F.col("first") + F.when(F.col("left"), 0).otherwise(1)).cast("int")
        placed = sides.select(*kept, "h", side.alias("node"))
        if len(cut) < len(extents):
            placed = placed.unionByName(known.where("two = 0").select(*kept, "h", F.col("first").cast("int").alias("node")))
        state = checkpointed(placed)
        parts = following
    return state.withColumnRenamed("node", "shard").drop("h", *dims)


def numbered(df: DataFrame, shard: str = "shard", row: str = "doc_id") -> DataFrame:
    """Adds `slot`, which counts the rows of each shard from 0 without gaps."""
    laned = df.withColumn("lane", F.pmod(F.xxhash64(row), F.lit(LANES)).cast("int"))
    counts = laned.groupBy(shard, "lane").count()
    offsets = counts.select(shard, "lane", (F.sum("count").over(Window.partitionBy(shard).orderBy("lane")) - F.col("count")).alias("before"))
    place = F.row_number().over(Window.partitionBy(shard, "lane").orderBy(row)) - 1
    return laned.withColumn("place", place).join(F.broadcast(offsets), [shard, "lane"]).withColumn("slot", (F.col("before") + F.col("place")).cast("long")).drop("lane", "place", "before")


def shard_documents(df: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot). Give the number of shards, or the bytes that a shard should have."""
    rows = measured(df)
    if target_bytes:
        shards = max(1, -(-(rows.agg(F.sum("size")).head()[0] or 0) // target_bytes))
    return numbered(kd_shards(rows, ["d0", "d1", "d2"], shards))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    return shard_documents(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )

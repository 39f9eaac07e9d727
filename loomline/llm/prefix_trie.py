"""Prefix trie of conversations: which beginnings are shared, by how many, and what sharing them saves.

A turn is known by two 64-bit hashes of its role and text, a conversation by the sequence of its turns. The sequences are
range-partitioned and sorted in order of (sequence, conversation), so that a range of rows holds each subtree whole but for those at its
borders, and equal sequences may lie in several ranges. A task reads its range in blocks of about `CELLS` cells. A block becomes matrices
with a column for each depth, padded where a conversation has ended, and is brought in order by a lexsort of the columns. A
mask of where a cell differs from the one above it, OR-accumulated from left to right, marks the beginnings of nodes; at every depth, from the deepest up,
`reduceat` over these aggregates members, children, leaves and saved bytes of the nodes' subtrees.

Only nodes on the path of a block's first or last row can go on in another block. They are written with what their block knows about them, keyed by a
128-bit digest of their sequence, and recombine by an aggregation. What such nodes add to one another's subtrees is a
difference of running sums over their preorder, taken inside each range; the totals of ranges (one row for each partition) pass
through the driver. The ids of conversations that end at such a node come as one text for each block and are hashed in order, block by block.

Turns are ordered by number, null first; turns of one number by their hashes, and rows that repeat count each. A null role or text is
empty. Rows without a conversation belong to none and are left out. Hashes and sizes of one conversation's turns (about 40 bytes a turn) have to
fit in a task's memory; texts are hashed before any shuffle and go no further. Other columns are ignored; an empty table gives no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, skew_join, written

CELLS = 1 << 19
GROUPS, LONGEST_HEAD = 5, 9
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = (
    "conv_id long, depth long, parent_conv_id long, parent_key binary, key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, own_bytes long, "
    "ends string, block long, first_row long, last_row long"
)


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the hashes and sizes of each conversation's turns in their order. `turns`: conv_id, turn, role, text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    one = F.struct("turn", F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(7), text, role).alias("b"), F.octet_length(text).cast("long").alias("bytes"))
    return turns.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Sequences of which the first turns, fewer than nine by a checksum of the id, are those of the first conversation of its group of five."""
    own, _ = written(sequences(turns))
    head = (F.crc32(F.col("conv_id").cast("string")) % LONGEST_HEAD).cast("int")
    base = own.select(F.col("conv_id").alias("base"), F.col("turns").alias("theirs"))
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUPS).join(base, "base", "left")
    rest = F.slice("turns", head + 1, F.greatest(F.size("turns") - head, F.lit(0)))
    return both.select("conv_id", F.when(F.col("theirs").isNull(), rest).otherwise(F.concat(F.slice("theirs", F.lit(1), head), rest)).alias("turns"))


def path_keys(a: np.ndarray, b: np.ndarray) -> list[bytes]:
    """A digest of every beginning of one sequence, the empty one first."""
    keys = [bytes(16)]
    for x, y in zip(a.tolist(), b.tolist()):
        keys.append(hashlib.blake2b(keys[-1] + x.to_bytes(8, "little", signed=True) + y.to_bytes(8, "little", signed=True), digest_size=16).digest())
    return keys


def padded(values: np.ndarray, length: np.ndarray, inside: np.ndarray, fill: int) -> np.ndarray:
    out = np.full(inside.shape, fill, np.int64)
    out[inside] = values
    return out


def block_nodes(conv: np.ndarray, length: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, block: int) -> pa.RecordBatch:
    """All nodes of a block of conversations (their ids and lengths, and hashes and sizes of their turns one after the other), those that may go on in other blocks with a key."""
    # Column d holds the turns at depth d; column 0 stands for the root.
    depth = np.arange(int(length.max(initial=0)) + 1)
    inside = (depth <= length[:, None]) & (depth > 0)
    least = np.iinfo(np.int64).min
    a, b, size = padded(a, length, inside, least), padded(b, length, inside, least), padded(size, length, inside, 0)
    order = np.lexsort((conv, *(x[:, d] for d in depth[:0:-1] for x in (b, a))))
    conv, length, a, b, size = conv[order], length[order], a[order], b[order], size[order]
    n_rows, last = len(conv), len(conv) - 1
    inside = depth <= length[:, None]
    change = np.ones(inside.shape, bool)
    change[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (inside[1:] != inside[:-1])
    begins = np.logical_or.accumulate(change, axis=1)
    begins[1:, 0] = False
    node = begins & inside
    keys = {0: path_keys(a[0, 1 : length[0] + 1], b[0, 1 : length[0] + 1]), last: path_keys(a[last, 1 : length[last] + 1], b[last, 1 : length[last] + 1])}
    ids = [str(c) for c in conv.tolist()]
    leaves, saved = np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64)  # of closed nodes as deep as this or deeper, by the row at which they begin
    levels = []
    for d in depth[::-1].tolist():
        at = np.flatnonzero(begins[:, d])
        n_convs = np.diff(at, append=n_rows)
        real = inside[at, d]
        border = real & ((at == 0) | (at + n_convs == n_rows))
        children = np.add.reduceat(node[:, d + 1], at, dtype=np.int64) if d < depth[-1] else np.zeros(len(at), np.int64)
        closed = real & ~border
        leaves[at[closed & (children == 0)]] += 1
        saved[at[closed]] += (n_convs[closed] - 1) * size[at[closed], d]
        if levels:  # children on the border are counted when they recombine
            below = levels[-1]
            group = np.searchsorted(at, below["at"][below["border"]], side="right") - 1
            np.subtract.at(children, group, 1)
        levels.append(
            dict(at=at, n_convs=n_convs, real=real, border=border, children=children, least=np.minimum.reduceat(conv, at), ends=np.add.reduceat(length == d, at, dtype=np.int64), leaves=np.add.reduceat(leaves, at), saved=np.add.reduceat(saved, at), size=size[at, d], depth=d)
        )
    levels = levels[::-1]
    columns: dict[str, list] = {name.split()[0]: [] for name in NODE.split(", ")}
    for d, level in enumerate(levels):
        at, border, real = level["at"], level["border"], level["real"]
        n = int(real.sum())
        stop = at + level["n_convs"]
        row_of = np.where(at == 0, 0, last)
        columns["conv_id"].append(level["least"][real])
        columns["depth"].append(np.full(n, d))
        columns["n_convs"].append(level["n_convs"][real])
        columns["n_children"].append(level["children"][real])
        columns["n_leaves"].append(level["leaves"][real])
        columns["saved_tokens"].append(level["saved"][real])
        columns["own_bytes"].append(level["size"][real])
        columns["block"].append(np.full(n, block))
        columns["first_row"].append(at[real])
        columns["last_row"].append(stop[real] - 1)
        columns["key"] += [keys[r][d] if open_ else None for r, open_ in zip(row_of[real].tolist(), border[real].tolist())]
        joined = [",".join(ids[s : s + e]) if e else "" for s, e in zip(at[real].tolist(), level["ends"][real].tolist())]
        columns["ends"] += [j if open_ else hashlib.sha256(j.encode()).hexdigest() if j else NOTHING for j, open_ in zip(joined, border[real].tolist())]
        if d:
            above = levels[d - 1]
            parent = np.searchsorted(above["at"], at[real], side="right") - 1
            known = ~above["border"][parent]
            columns["parent_conv_id"] += [c if k else None for c, k in zip(above["least"][parent].tolist(), known.tolist())]
            columns["parent_key"] += [None if k else keys[0 if p == 0 else last][d - 1] for p, k in zip(above["at"][parent].tolist(), known.tolist())]
        else:
            columns["parent_conv_id"] += [None] * n
            columns["parent_key"] += [None] * n
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    arrays = [pa.array(np.concatenate(v) if v and isinstance(v[0], np.ndarray) else v, kinds[name.split()[1]]) for v, name in zip(columns.values(), NODE.split(", "))]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def range_nodes(paths: DataFrame) -> DataFrame:
    """Nodes of all blocks of `paths` (conv_id, turns), with partial results and a key for those at a block's borders."""
    ids = F.flatten(F.transform("turns", lambda t: F.array(t["a"], t["b"])))
    rows = paths.select("conv_id", ids.alias("ids"), F.transform("turns", lambda t: t["bytes"]).alias("bytes"))
    limit = CELLS

    def nodes(batch: pa.RecordBatch, block: int) -> pa.RecordBatch:
        ids, size = batch.column("ids"), batch.column("bytes")
        flat = ids.flatten().to_numpy()
        return block_nodes(batch.column("conv_id").to_numpy(), size.value_lengths().to_numpy().astype(np.int64), flat[::2], flat[1::2], size.flatten().to_numpy(), block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held, n_rows, deepest = [], 0, 1
        for batch in batches:
            length, start = batch.column("bytes").value_lengths().to_numpy(), 0
            widest = np.maximum.accumulate(length + 1)
            for k in range(batch.num_rows):  # a block ends where one more row would make it too large
                if (n_rows + 1) * max(deepest, int(length[k]) + 1) > limit and n_rows:
                    held.append(batch.slice(start, k - start))
                    yield nodes(pa.concat_batches(held), block)
                    block, held, n_rows, deepest, start = block + 1, [], 0, 1, k
                n_rows, deepest = n_rows + 1, max(deepest, int(length[k]) + 1)
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if n_rows:
            yield nodes(pa.concat_batches(held), block)

    return rows.repartitionByRange("ids", "conv_id").sortWithinPartitions("ids", "conv_id").mapInArrow(run, NODE)


def hashed_ends(open_nodes: DataFrame) -> DataFrame:
    """(key, ends_sha256): of each node the digest of its blocks' texts one after the other, which are read in order and not held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for key, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
                if key == last:
                    digest.update(b"," + ends.encode())
                    continue
                if last is not None:
                    done.append((last, digest.hexdigest()))
                last, digest = key, hashlib.sha256(ends.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done])], names=["key", "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])

    some = open_nodes.where(F.col("ends") != "").select("key", "block", "ends")
    return some.repartition("key").sortWithinPartitions("key", "block").mapInArrow(run, "key binary, ends_sha256 string")


def recombined(open_nodes: DataFrame) -> tuple[DataFrame, str]:
    """(key, parent_key and a node's results) of the nodes at borders, whole; a table in the shared folder and its path."""
    spark = open_nodes.sparkSession
    place = lambda row: F.struct("block", F.col(row).alias("row"))
    merged = open_nodes.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), F.first("own_bytes").alias("own_bytes"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        F.min(place("first_row")).alias("first"), F.max(place("last_row")).alias("last"),
    )
    merged, path = written(merged)
    inner = merged.where(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("open"))
    whole = merged.join(inner, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("open", F.lit(0)))
    whole = whole.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("value", (F.col("n_convs") - 1) * F.col("own_bytes"))
    whole, whole_path = written(whole)
    part = F.shiftright("block", 32)
    begin = whole.select("key", "first.block", "first.row", "depth", F.lit(True).alias("begins"), "leaf", "value")
    end = whole.select("key", "last.block", "last.row", F.lit(1 << 62).alias("depth"), F.lit(False).alias("begins"), F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("value"))
    both, before, sums = begin.union(end).withColumn("part", part), [], (0, 0)
    for p, leaf, value in both.groupBy("part").agg(F.sum("leaf"), F.sum("value")).orderBy("part").collect():
        before.append((p, *sums))
        sums = sums[0] + leaf, sums[1] + value
    before = spark.createDataFrame(before, "part long, leaf_before long, value_before long")
    running = Window.partitionBy("part").orderBy("block", "row", "depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marks = both.withColumn("leaves", F.sum("leaf").over(running)).withColumn("values", F.sum("value").over(running)).join(F.broadcast(before), "part")
    marks = marks.withColumn("leaves", F.col("leaves") + F.col("leaf_before")).withColumn("values", F.col("values") + F.col("value_before"))
    difference = lambda to, own: F.max(F.when(~F.col("begins"), F.col(to))) - F.max(F.when(F.col("begins"), F.col(to) - F.col(own)))
    subtree = marks.groupBy("key").agg(difference("leaves", "leaf").alias("more_leaves"), difference("values", "value").alias("more_value"))
    out = whole.join(subtree, "key").withColumn("n_leaves", F.col("n_leaves") + F.col("more_leaves")).withColumn("saved_tokens", F.col("saved_tokens") + F.col("more_value"))
    out = out.join(hashed_ends(open_nodes), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    out, out_path = written(out.select("key", "parent_key", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
    discard(spark, path)
    discard(spark, whole_path)
    return out, out_path


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(paths: DataFrame) -> DataFrame:
    """One row for each node of the trie of `paths` (conv_id, turns: an array of structs a, b, bytes), with its parent's smallest member."""
    nodes, _ = written(range_nodes(paths))
    border, _ = recombined(nodes.where(F.col("key").isNotNull()))
    names = border.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("named"))
    inner = nodes.where(F.col("key").isNull()).withColumnRenamed("ends", "ends_sha256")
    root = F.lit(bytes(16))
    top = border.where(F.col("key") == root).select("conv_id").head()
    whole = inner.where(F.col("parent_key").isNull()).select(*COLUMNS)
    under_root = inner.where(F.col("parent_key") == root).withColumn("parent_conv_id", F.lit(top.conv_id if top else None).cast("long")).select(*COLUMNS)
    under = skew_join(inner.where(F.col("parent_key") != root).drop("parent_conv_id"), names, "parent_key").withColumnRenamed("named", "parent_conv_id").select(*COLUMNS)
    open_ = border.join(names, "parent_key", "left").withColumnRenamed("named", "parent_conv_id").select(*COLUMNS)
    return whole.unionByName(under_root).unionByName(under).unionByName(open_)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefix_trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


ORACLE_OP13 = """
WITH own AS (
  SELECT conv_id, list(md5(coalesce(role, '') || chr(0) || coalesce(text, '')) ORDER BY turn NULLS FIRST) AS t, list(strlen(coalesce(text, '')) ORDER BY turn NULLS FIRST) AS n
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), head AS (
  SELECT o.*, CAST(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % 9 AS INT) AS h FROM own o
), path AS (
  SELECT o.conv_id, coalesce(b.t[1:o.h], []) || o.t[o.h + 1:] AS t, coalesce(b.n[1:o.h], []) || o.n[o.h + 1:] AS n FROM head o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5
), member AS (
  SELECT conv_id, UNNEST(range(0, len(t) + 1)) AS depth, t, n FROM path
), keyed AS (
  SELECT conv_id, depth, md5(array_to_string(t[1:depth], ',')) AS node, CASE WHEN depth > 0 THEN md5(array_to_string(t[1:depth - 1], ',')) END AS parent, coalesce(n[depth], 0) AS bytes, depth = len(t) AS is_end FROM member
), node AS (
  SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends_sha256
  FROM keyed GROUP BY depth, node
), child AS (
  SELECT depth - 1 AS depth, parent AS node, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL
), full_node AS (
  SELECT a.*, coalesce(c.n, 0) AS n_children FROM node a LEFT JOIN child c ON a.depth = c.depth AND a.node = c.node
), subtree AS (
  SELECT k.depth, k.node, count(*) FILTER (WHERE y.n_children = 0) AS n_leaves, sum((y.n_convs - 1) * y.bytes) AS saved FROM full_node y JOIN keyed k ON k.conv_id = y.conv_id AND k.depth <= y.depth GROUP BY ALL
)
SELECT a.conv_id, a.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, a.n_convs::BIGINT AS n_convs, a.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, a.ends_sha256
FROM full_node a JOIN subtree s ON a.depth = s.depth AND a.node = s.node LEFT JOIN node p ON p.depth = a.depth - 1 AND p.node = a.parent
"""

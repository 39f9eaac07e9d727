"""Best state sequences of series of any length, by blocks of rows that meet in an associative product.

Rows lie in blocks of one series over many tasks (`stretches`). A block is a max-plus matrix: the best score from each state before it to each state after it. Matrices are
multiplied within each task's range and then from range to range, which gives the scores before each block; from these the block's
own recurrence says which state each way out of it came from. Such maps compose just as matrices multiply, from the
last block to the first, and pick one of the block's ways out. Nothing but a matrix or a map for each block goes from task to task in order.

Scores are whole multiples of 2**-30, so sums don't depend on how they are grouped, and equal scores are equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stretches import in_blocks, scanned, together

UNIT, LARGEST, NEVER = 1 << 30, 1 << 12, -(1 << 60)


def whole_scores(gains: np.ndarray) -> np.ndarray:
    """Multiples of the unit; beyond plus or minus `LARGEST` scores count as that, and missing ones as the least."""
    gains = np.clip(np.nan_to_num(gains, nan=-LARGEST, posinf=LARGEST, neginf=-LARGEST), -LARGEST, LARGEST)
    return np.rint(gains * UNIT).astype(np.int64)


def levelled(scores: np.ndarray, axis: int | tuple[int, ...]) -> np.ndarray:
    """Scores relative to the best; differences alone decide, so numbers stay small however long a series is."""
    scores = scores - scores.max(axis=axis, keepdims=True)
    return np.where(scores < NEVER // 2, NEVER, scores)


def stepped(total: np.ndarray, penalty: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores before a row's gains, the leading state, and which states are entered from it; staying wins ties, and the first leads among equals."""
    leader = total.argmax(axis=-1)
    bar = np.take_along_axis(total, leader[..., None], -1) - penalty
    return np.maximum(total, bar), leader, bar > total


def matrices(gains: np.ndarray, length: np.ndarray, opening: np.ndarray, penalty: int) -> np.ndarray:
    """For each block (blocks, rows, states): the best score from each state before it to each after it. In an `opening` block nothing comes before its first row."""
    n, rows, k = gains.shape
    total = np.where(np.eye(k, dtype=bool), 0, NEVER)[None].repeat(n, 0)
    for t in range(rows):
        before = stepped(total, penalty)[0] if t else np.where(opening[:, None, None], total, stepped(total, penalty)[0])
        total = np.where((t < length)[:, None, None], before + gains[:, t, None, :], total)
    return levelled(total, (1, 2))


def ways(gains: np.ndarray, length: np.ndarray, opening: np.ndarray, start: np.ndarray, penalty: int) -> tuple[np.ndarray, np.ndarray]:
    """For each block and state after it: the state before the block, and the states of its rows, (blocks, states) and (blocks, rows, states)."""
    n, rows, k = gains.shape
    total, leaders, entered = start.copy(), np.zeros((rows, n), np.int64), np.zeros((rows, n, k), bool)
    for t in range(rows):
        before, leaders[t], entered[t] = stepped(total, penalty)
        if not t:
            before[opening], entered[t, opening] = total[opening], False
        total = np.where((t < length)[:, None], before + gains[:, t], total)
    state = np.arange(k)[None].repeat(n, 0)
    path = np.zeros((n, rows, k), np.uint8)
    for t in range(rows - 1, -1, -1):
        inside = (t < length)[:, None]
        path[:, t] = state
        state = np.where(inside & np.take_along_axis(entered[t], state, 1), leaders[t][:, None], state)
    return state, path


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two matrices in a row each, the one of both after one another."""
    k = int(len(a) ** 0.5)
    return levelled((a.reshape(k, k, 1) + b.reshape(1, k, k)).max(axis=1), (0, 1)).ravel()


def applied(scores: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    return levelled((scores[:, None] + matrix.reshape(len(scores), -1)).max(axis=0), 0)


def composed(later: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    return earlier[later]


def padded_blocks(batch: pa.RecordBatch, states: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Gains of blocks as (blocks, rows, states), relative to the best of each row and with zeros at the end, and the blocks' rows."""
    gains = np.stack([whole_scores(batch.column(s).flatten().to_numpy(zero_copy_only=False)) for s in states], axis=1)
    length = batch.column(states[0]).value_lengths().to_numpy()
    out = np.zeros((batch.num_rows, int(length.max(initial=0)), len(states)), np.int64)
    out[np.arange(out.shape[1]) < length[:, None]] = gains - gains.max(axis=1, keepdims=True)
    return out, length


def steady_states(df: DataFrame, series: str, order: str, states: list[str], penalty: float, kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(series, order, state): the best sequence of states for rows with a log likelihood for each state, when a change costs `penalty`.

    Staying wins ties, and the first state wins among equals. Rows of a series with one place are taken in order of their scores. An infinite penalty
    gives the best constant state. Rows without a series are left out. `kept` writes a table that is read several times.
    """
    k = len(states)
    cost = int(round(penalty * UNIT)) if penalty < LARGEST << 16 else 1 << 59
    kinds = {c: df.schema[c].dataType.simpleString() for c in (series, order)}
    head = f"`{series}` {kinds[series]}, block long"
    rows = df.select(series, order, *(F.col(s).cast("double").alias(s) for s in states))
    blocks = kept(in_blocks(rows, series, [order, *states]))
    opening = blocks.groupBy(series).agg(F.min("block").alias("opening"))
    blocks = kept(blocks.join(opening, series).withColumn("opening", F.col("block") == F.col("opening")))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in together(batches):
            found = matrices(*padded_blocks(batch, states), batch.column("opening").to_numpy(zero_copy_only=False), cost).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(series), batch.column("block"), pa.array(list(found), pa.list_(pa.int64()))], names=[series, "block", "item"])

    items = kept(blocks.select(series, "block", "opening", *states).mapInArrow(weigh, f"{head}, item array<long>"))
    level = opening.select(series, F.array_repeat(F.lit(0).cast("long"), k).alias("state"))
    scores = kept(scanned(items, series, level, product, applied, False))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in together(batches):
            gains, length = padded_blocks(batch, states)
            start = batch.column("state").flatten().to_numpy().reshape(-1, k)
            back, path = ways(gains, length, batch.column("opening").to_numpy(zero_copy_only=False), start, cost)
            paths = [p[:n].T.tobytes() for p, n in zip(path, length.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(series), batch.column("block"), pa.array(list(back), pa.list_(pa.int64())), batch.column(order), pa.array(paths, pa.binary())], names=[series, "block", "item", order, "paths"])

    with_scores = blocks.join(scores.select("block", "state"), "block").select(series, "block", "opening", *states, "state", order)
    routes = kept(with_scores.mapInArrow(follow, f"{head}, item array<long>, `{order}` array<{kinds[order]}>, paths binary"))
    # The state in which a series ends: the first of the best after its last block.
    newest = items.join(items.groupBy(series).agg(F.max("block").alias("block")), [series, "block"]).join(scores.select("block", "state"), "block")
    after = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.array_max(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get("state", i) + F.get("item", i * k + j))))
    ends = newest.withColumn("after", after).select(series, F.array((F.array_position("after", F.array_max("after")) - 1)).alias("state"))
    exits = scanned(routes.select(series, "block", "item"), series, ends, composed, lambda state, item: item[state], True)
    chosen = routes.select("block", order, "paths").join(exits, "block")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in together(batches):
            length = batch.column(order).value_lengths().to_numpy()
            exit_ = batch.column("state").flatten().to_pylist()
            path = b"".join(p[s * n : (s + 1) * n] for p, s, n in zip(batch.column("paths").to_pylist(), exit_, length.tolist()))
            owner = batch.column(series).take(pa.array(np.repeat(np.arange(batch.num_rows), length)))
            yield pa.RecordBatch.from_arrays([owner, batch.column(order).flatten(), pa.array(states).take(pa.array(np.frombuffer(path, np.uint8)))], names=[series, order, "state"])

    return chosen.select(series, order, "paths", "state").mapInArrow(name, f"`{series}` {kinds[series]}, `{order}` {kinds[order]}, state string")

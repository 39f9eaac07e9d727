"""Series of any length in blocks of rows over many tasks, and states that go through the blocks in order.

Rows are dealt by ranges of (series, order), so a long series lies in many tasks; each cuts its rows into blocks of one series. What a block
does to a state is an item of its own, and items combine: first within each range, then the state goes from range to
range, and then from block to block inside each range. No task reads more than one series' items in one range, or one item a range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

ROWS, TOGETHER = 256, 512

Combine = Callable[[np.ndarray, np.ndarray], np.ndarray]


def folded(items: DataFrame, keys: list[str], order: str, descending: bool, combine: Combine, start: str | None, last: bool) -> DataFrame:
    """In order of `order` within `keys`: the state before each item (keys, order, state), or only what remains after the last one (keys, state).

    Without `start`, a column with the first state, the first item is it. The pass holds one state.
    """
    names = [*keys, order]
    kinds = ", ".join(f"`{c}` {items.schema[c].dataType.simpleString()}" for c in (keys if last else names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        final: dict[str, list] = {c: [] for c in [*keys, "state"]}

        def flushed() -> None:
            if now is not None:
                for c, x in zip(keys, now):
                    final[c].append(x)
                final["state"].append(state)

        for batch in batches:
            out = []
            columns = {c: batch.column(c).to_pylist() for c in keys}
            item = batch.column("item")
            flat, at = item.flatten().to_numpy(), np.concatenate(([0], np.cumsum(item.value_lengths().to_numpy())))
            first = batch.column(start).to_pylist() if start else None
            for r, key in enumerate(zip(*columns.values())):
                value = flat[at[r] : at[r + 1]]
                if key != now:
                    flushed()
                    now, state = key, np.array(first[r], flat.dtype) if start else None
                out.append(state)
                state = value if state is None else combine(state, value)
            if not last:
                yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(out, item_type)], names=[*names, "state"])
        if last:
            flushed()
            types = [items_schema.field(c).type for c in keys]
            yield pa.RecordBatch.from_arrays([*(pa.array(final[c], t) for c, t in zip(keys, types)), pa.array(final["state"], item_type)], names=[*keys, "state"])

    items_schema = to_arrow_schema(items.schema)
    item_type, item_kind = items_schema.field("item").type, items.schema["item"].dataType.simpleString()
    sort = F.desc(order) if descending else F.asc(order)
    dealt = items.repartition(*keys).sortWithinPartitions(*keys, sort)
    return dealt.select(*names, "item", *([start] if start else [])).mapInArrow(run, f"{kinds}, state {item_kind}")


def scanned(items: DataFrame, series: str, start: DataFrame, combine: Combine, step: Combine, descending: bool) -> DataFrame:
    """(series, block, state): the state before each block of its series when `start` (series, state) goes in at one end. `items`: series, block, item.

    Items are combined within each range (the upper half of a block's number), then the state goes from range to range, and then from block to block in each range.
    """
    ranged = items.withColumn("range", F.shiftright("block", 32))
    wholes = folded(ranged, [series, "range"], "block", descending, combine, None, True).withColumnRenamed("state", "item")
    between = folded(wholes.join(start.withColumnRenamed("state", "start"), series), [series], "range", descending, step, "start", False)
    placed = ranged.join(between.withColumnRenamed("state", "start"), [series, "range"])
    return folded(placed, [series, "range"], "block", descending, step, "start", False).drop("range")


def in_blocks(df: DataFrame, series: str, order: list[str], rows: int | None = None) -> DataFrame:
    """(series, block, ...): the rows of each block as arrays, one for each other column, in order of `order`; numbers of blocks follow the order.

    The upper half of a block's number is that of its range. Rows without a series are left out.
    """
    others, size = [c for c in df.columns if c != series], rows or ROWS
    kind = lambda c: df.schema[c].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held = None

        def table(found: pa.RecordBatch, cuts: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            n = len(cuts) - 1
            numbers = pa.array(np.arange(number, number + n))
            number += n
            offsets = pa.array(cuts.astype(np.int32))
            return pa.RecordBatch.from_arrays([found.column(series).take(pa.array(cuts[:-1])), numbers, *(pa.ListArray.from_arrays(offsets, found.column(c)) for c in others)], names=[series, "block", *others])

        for batch in batches:
            batch = pa.concat_batches([held, batch]) if held is not None else batch
            names = batch.column(series).dictionary_encode().indices.to_numpy()
            heads = np.concatenate(([0], np.flatnonzero(np.diff(names)) + 1, [len(names)]))
            cuts = np.unique(np.concatenate([heads, *(np.arange(a, b, size) for a, b in zip(heads, heads[1:]))]))
            # The last block may go on in the next batch.
            if len(cuts) > 2:
                yield table(batch.slice(0, int(cuts[-2])), cuts[:-1])
            held = batch.slice(int(cuts[-2])) if len(cuts) > 1 else None
        if held is not None and held.num_rows:
            yield table(held, np.array([0, held.num_rows]))

    schema = ", ".join([f"`{series}` {kind(series)}", "block long", *(f"`{c}` array<{kind(c)}>" for c in others)])
    some = df.select(series, *others).where(F.col(series).isNotNull())
    return some.repartitionByRange(series, *order).sortWithinPartitions(series, *order).mapInArrow(run, schema)


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            yield batch.slice(at, TOGETHER)

"""Edit distance between sequences of symbols, and rates that keep failed pairs apart."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import ratio


def symbol_distance(a: Sequence, b: Sequence) -> int:
    """Insertions, deletions and replacements of whole symbols that turn one sequence into the other.

    A column of the table of distances is kept as the bits of two whole numbers, its rises and its falls, so a step costs a
    few operations on numbers of len(a) bits.
    """
    start, stop = 0, 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    while stop < min(len(a), len(b)) - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    a, b = sorted((a[start : len(a) - stop], b[start : len(b) - stop]), key=len)
    if not a:
        return len(b)
    places: dict = {}
    for k, symbol in enumerate(a):
        places.setdefault(symbol, []).append(k)
    found = {}
    for symbol, at in places.items():  # bits through bytes: a shift for each place would copy the number each time
        bits = bytearray(len(a) // 8 + 1)
        for k in at:
            bits[k >> 3] |= 1 << (k & 7)
        found[symbol] = int.from_bytes(bits, "little")
    every, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    rises, falls, distance = every, 0, len(a)
    for symbol in b:
        equal = found.get(symbol, 0)
        diagonal = (((equal & rises) + rises) ^ rises) | equal | falls
        right_rises = falls | (every & ~(diagonal | rises))
        right_falls = rises & diagonal
        distance += bool(right_rises & last) - bool(right_falls & last)
        right_rises, right_falls = (right_rises << 1 | 1) & every, right_falls << 1 & every
        rises = right_falls | (every & ~(diagonal | right_rises))
        falls = right_rises & diagonal
    return distance


def with_edits(pairs: DataFrame, predicted: str, reference: str, status: Column | None = None) -> DataFrame:
    """Adds status, edits, total_symbols and rate to pairs of arrays, which are dropped. A pair without one of its sides is `missing`, one whose `status` so far isn't success keeps that; both are not scored.

    Nothing to compare is a rate of 0. Null symbols equal each other.
    """
    given = F.coalesce(status, F.lit("success")) if status is not None else F.lit("success")
    known = F.when(given != "success", given).when(F.col(predicted).isNull() | F.col(reference).isNull(), "missing").otherwise("success")
    rest = [c for c in pairs.columns if c not in (predicted, reference, "status", "edits", "total_symbols", "rate")]
    rows = pairs.select(*rest, predicted, reference, known.alias("status"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edits, total = [], []
            for a, b, s in zip(*(batch.column(c).to_pylist() for c in (predicted, reference, "status"))):
                edits.append(symbol_distance(a, b) if s == "success" else None)
                total.append(len(a) + len(b) if s == "success" else None)
            yield pa.RecordBatch.from_arrays([*map(batch.column, [*rest, "status"]), pa.array(edits, pa.int64()), pa.array(total, pa.int64())], names=[*rest, "status", "edits", "total_symbols"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*rest).schema.fields)
    scored = rows.mapInArrow(run, f"{kinds}, status string, edits long, total_symbols long")
    return scored.withColumn("rate", F.when(F.col("status") == "success", ratio("edits", "total_symbols")))


def edit_rates(scored: DataFrame, *keys: str) -> DataFrame:
    """The mean of the rates and the rate of the sums over scored pairs, with the pairs counted by what became of them; rates are null where nothing was scored."""
    good = F.col("status") == "success"
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(good).alias("n_success"), F.count_if(F.col("status") == "missing").alias("n_missing"), F.count_if(~good & (F.col("status") != "missing")).alias("n_failed"),
        F.avg("rate").alias("macro_rate"), F.when(F.count_if(good) > 0, ratio(F.sum("edits"), F.sum("total_symbols"))).alias("corpus_rate"), F.sum("edits").alias("edits"), F.sum("total_symbols").alias("symbols"),
    )

"""Removal of repeated byte strings by suffix arrays.

Texts are UTF-8 bytes; null counts as empty. Every byte covered by a string of `LENGTH` bytes that also starts
elsewhere, in the same text or another, goes; strings are judged on the input, and none crosses texts.

**Dealing.** A window (the `LENGTH` bytes from a position) belongs to the list of its minimiser, the least hash among its
substrings of k bytes. Equal windows have equal minimisers, so each list can be searched alone. Successive windows of a text with one
minimiser form a piece (of up to `LONGEST` windows), so a window is in one piece of one list. Lists with one piece go, if it has its
minimiser in one place only, so that no two of its own windows can be equal. Of pieces equal in all their bytes (a class) the first and the last are searched, and what is found holds for the class. A list of
more than `LIST` windows is dealt anew, its pieces taken as texts, by longer minimisers (`LEVELS`); the last are whole windows, of which one
list holds a single class, so no list stays large and nothing is cut off.

**Two-stage sorting** (`suffix_order`). Lists are sorted together, up to about `LIST` windows at once. Of the suffixes at windows only those smaller than
their successor are sorted directly, by their first `LENGTH` bytes. The others are induced: buckets of first bytes are scanned in ascending order, and
each suffix met puts the one a byte before it, if larger, at the end of that one's bucket's front part. Where a piece's
last windows depend on later suffixes, those up to the first directly sorted one take part. The common prefixes of adjacent
windows are then computed, and windows that share `LENGTH` bytes with a neighbour are repeated.

Rows equal in id and text are copies like any others, so both lose what is long enough. Of one id's several texts each is a
text of its own. A null id is an id. Windows of long texts are read in overlapping stretches. An empty table gives an empty one.
Columns of the input stay; `kept` (the bytes that are left) and `spans` (the removed runs, ends exclusive) replace columns so named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, INVERSE, checkpointed, discard, documents, keep_types, mix, power, skew_join, slices, span_hash, text_bytes, written

LENGTH = 200
LEVELS = (32, 96, 160, LENGTH)
LIST, LONGEST, STRETCH = 1 << 18, 4096, 1 << 21
RUNS = "array<struct<start:long,stop:long>>"


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` successive values."""
    size = 1
    while 2 * size <= width:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def substring_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes from each position."""
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power(len(data), BASE), out=running[1:])
    return mix((running[k:] - running[:-k]) * power(len(data) + 1, INVERSE)[: len(data) + 1 - k])


def find_pieces(data: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, content hash, start, number of windows, and whether the minimiser occurs again, of each piece; `row` tells the texts apart."""
    hashes = substring_hashes(data, k)
    least = sliding_least(hashes, LENGTH - k + 1)
    whole = row[: len(least)] == row[LENGTH - 1 :]
    same = np.zeros(len(least) + 1, bool)
    same[1:-1] = whole[1:] & whole[:-1] & (least[1:] == least[:-1])
    start, stop = np.flatnonzero(whole & ~same[:-1]), np.flatnonzero(whole & ~same[1:]) + 1
    parts = -(-(stop - start) // LONGEST)
    first = np.cumsum(parts) - parts
    start = np.repeat(start, parts) + LONGEST * (np.arange(int(parts.sum())) - np.repeat(first, parts))
    stop = np.minimum(np.repeat(stop, parts), start + LONGEST)
    if not len(start):
        return least[:0], least[:0], start, stop, start > 0
    length = stop - start + LENGTH - k
    first = np.cumsum(length) - length
    at = np.repeat(start - first, length) + np.arange(int(length.sum()))
    times = np.add.reduceat(hashes[at] == np.repeat(least[start], length), first, dtype=np.int32)
    return least[start], span_hash(data, start, stop + LENGTH - 1), start, stop - start, times > 1


def pieces(texts: DataFrame, k: int) -> DataFrame:
    """(h, c, id, start, size, again): list, class, place, number of windows and whether the minimiser occurs again, of all pieces of `texts` (id, text)."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "text")):
            data, offsets = text_bytes(batch.column("text").cast(pa.binary()).view(pa.string()))
            for lo in range(0, max(len(data) - LENGTH + 1, 0), STRETCH):
                hi = min(lo + STRETCH + LENGTH - 1, len(data))
                first, last = np.searchsorted(offsets, [lo, hi - 1], side="right") - 1
                inside = np.clip(offsets[first : last + 2], lo, hi)
                row = np.repeat(np.arange(first, last + 1), np.diff(inside))
                h, c, start, size, again = find_pieces(data[lo:hi], row, k)
                of = row[start]
                columns = [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), batch.column("id").take(pa.array(of)), pa.array(start + lo - offsets[of]), pa.array(size.astype(np.int32)), pa.array(again)]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "c", "id", "start", "size", "again"])

    return texts.select("id", "text").mapInArrow(run, f"h long, c long, id {kind}, start long, size int, again boolean")


def ranges(start: np.ndarray, stop: np.ndarray, n: int) -> np.ndarray:
    """A mask of n places that lie in one of the ranges."""
    depth = np.bincount(start, minlength=n + 1) - np.bincount(stop, minlength=n + 1)
    return np.cumsum(depth)[:n] > 0


def suffix_order(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The places in the ranges [start, stop), in order of the suffixes there, equal or not in their first LENGTH bytes only."""
    n = len(data)
    step = np.append(np.sign(np.diff(data.astype(np.int16))), -1)  # what follows the end is smaller than any byte
    settled = np.minimum.accumulate(np.where(step != 0, np.arange(n), n - 1)[::-1])[::-1]
    smaller = step[settled] > 0  # than its successor
    following = np.minimum.accumulate(np.where(smaller, np.arange(n), n - 1)[::-1])[::-1]
    wanted = ranges(start, stop, n)
    taking_part = wanted | ranges(stop - 1, following[stop - 1] + 1, n)
    direct = np.flatnonzero(taking_part & smaller)
    padded = np.concatenate((data, np.zeros(LENGTH, np.uint8)))
    heads = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, LENGTH)[direct])
    heads = pa.FixedSizeBinaryArray.from_buffers(pa.binary(LENGTH), len(direct), [None, pa.py_buffer(heads)])
    direct = direct[pc.array_sort_indices(heads).to_numpy()]
    at = np.searchsorted(data[direct], np.arange(257))
    larger = taking_part & ~smaller
    front: list[list[np.ndarray]] = [[] for _ in range(256)]
    if larger[n - 1]:
        front[data[n - 1]].append(np.array([n - 1]))
    order = []

    def induce(place: np.ndarray, byte: int) -> np.ndarray:
        """Puts the larger suffixes one byte before these in their buckets; those of the same bucket are returned."""
        order.append(place)
        before = place[place > 0] - 1
        before = before[larger[before]]
        bucket = data[before]
        by = np.argsort(bucket, kind="stable")
        before, bucket = before[by], bucket[by]
        edges = np.flatnonzero(np.diff(bucket)) + 1
        same = before[:0]
        for part in np.split(before, edges):
            if len(part):
                if data[part[0]] == byte:
                    same = part
                else:
                    front[data[part[0]]].append(part)
        return same

    for byte in range(256):
        place = np.concatenate(front[byte]) if front[byte] else direct[:0]
        while len(place):
            place = induce(place, byte)
        if at[byte] < at[byte + 1]:
            induce(direct[at[byte] : at[byte + 1]], byte)
    order = np.concatenate(order) if order else direct
    return order[wanted[order]]


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each suffix but the first shares with the one before it, counted up to LENGTH."""
    padded = np.concatenate((data, np.zeros(LENGTH + 8, np.uint8)))
    words = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    a, b = order[:-1], order[1:]
    shared, left = np.zeros(len(a), np.int64), np.arange(len(a))
    for k in range(0, LENGTH, 8):
        differing = words[a[left] + k] ^ words[b[left] + k]
        done = differing != 0
        lowest = differing[done] & (~differing[done] + np.uint64(1))
        shared[left[done]] = k + np.bitwise_count(lowest - np.uint64(1)) // 8
        left = left[~done]
    shared[left] = LENGTH
    return shared


def repeated_runs(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start, stop) of the runs of repeated windows, relative to their piece; pieces begin at `begin` in the data and have `size` windows."""
    order = suffix_order(data, begin, begin + size)
    again = np.flatnonzero(common_prefixes(data, order) >= LENGTH)
    place = np.unique(np.concatenate((order[again], order[again + 1])))
    piece = np.searchsorted(begin, place, side="right") - 1
    new = np.flatnonzero((np.diff(place, prepend=-2) > 1) | (np.diff(piece, prepend=-1) > 0))
    last = (np.append(new[1:], len(place)) - 1)[: len(new)]
    return piece[new], place[new] - begin[piece[new]], place[last] + 1 - begin[piece[new]]


def run_lists(owner: np.ndarray, start: np.ndarray, stop: np.ndarray, n: int) -> pa.ListArray:
    runs = pa.StructArray.from_arrays([pa.array(start.astype(np.int64)), pa.array(stop.astype(np.int64))], names=["start", "stop"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), runs)


def sorted_lists(cut: DataFrame) -> DataFrame:
    """(h, c, runs): the repeated windows of each piece that has some. `cut`: h, c, content."""
    limit = LIST

    def search(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column("content").view(pa.string()))
        piece, start, stop = repeated_runs(data, offsets[:-1], np.diff(offsets) - LENGTH + 1)
        found = pa.RecordBatch.from_arrays([batch.column("h"), batch.column("c"), run_lists(piece, start, stop, batch.num_rows)], names=["h", "c", "runs"])
        return found.filter(pc.greater(pc.list_value_length(found.column("runs")), 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None  # whole lists, but for the last one
        for batch in batches:
            h = batch.column("h").to_numpy()
            sizes = np.cumsum(pc.binary_length(batch.column("content")).to_numpy(zero_copy_only=False) - LENGTH + 1)
            heads = np.flatnonzero(np.concatenate(([last is None or h[0] != last], h[1:] != h[:-1])))
            done, before = 0, 0
            for k in heads.tolist():
                upto = int(sizes[k - 1]) if k else 0
                if size + upto - before >= limit:
                    held.append(batch.slice(done, k - done))
                    yield search(pa.concat_batches(held))
                    held, size, done, before = [], 0, k, upto
            held.append(batch.slice(done))
            size += int(sizes[-1]) - before
            last = h[-1]
        if held:
            yield search(pa.concat_batches(held))

    return cut.select("h", "c", "content").repartition("h").sortWithinPartitions("h").mapInArrow(run, f"h long, c long, runs {RUNS}")


def contents(texts: DataFrame, spots: DataFrame) -> DataFrame:
    """(h, c, which, hot, content): the bytes of the pieces at `spots` (h, c, which, hot, id, start, size)."""
    of_text = spots.groupBy("id").agg(F.collect_list(F.struct("h", "c", "which", "hot", "start", "size")).alias("spots"))
    once = texts.groupBy("id").agg(F.first("text").alias("text"))  # rows equal in id are equal in text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "text", 1 << 18)):
            data, offsets = text_bytes(batch.column("text").cast(pa.binary()).view(pa.string()))
            spot = batch.column("spots")
            row = np.repeat(np.arange(batch.num_rows), spot.value_lengths().to_numpy())
            spot = spot.flatten()
            h, c, which, hot, start, size = spot.flatten()
            begin = offsets[row] + start.to_numpy()
            raw = data.tobytes()
            content = [raw[a:b] for a, b in zip(begin.tolist(), (begin + size.to_numpy() + LENGTH - 1).tolist())]
            yield pa.RecordBatch.from_arrays([h, c, which, hot, pa.array(content, pa.binary())], names=["h", "c", "which", "hot", "content"])

    return once.join(of_text, "id").select("text", "spots").mapInArrow(run, "h long, c long, which int, hot boolean, content binary")


def united(found: DataFrame, *keys: str) -> DataFrame:
    """One row for each key, with all its runs in order; those that meet or overlap are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs")
            row = np.repeat(np.arange(batch.num_rows), runs.value_lengths().to_numpy())
            start, stop = (c.to_numpy() for c in runs.flatten().flatten())
            first = np.searchsorted(row, np.arange(batch.num_rows))
            reach = stop.copy()
            for a, b in zip(first.tolist(), np.append(first[1:], len(row)).tolist()):
                np.maximum.accumulate(reach[a:b], out=reach[a:b])
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (start[1:] > reach[:-1])
            head = np.flatnonzero(new)
            last = (np.append(head[1:], len(row)) - 1)[: len(head)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, keys), run_lists(row[head], start[head], reach[last], batch.num_rows)], names=[*keys, "runs"])

    gathered = found.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_set("runs"))).alias("runs"))
    return gathered.mapInArrow(run, keep_types(found.select(*keys), f"runs {RUNS}"))


def repeats(texts: DataFrame, level: int = 0) -> DataFrame:
    """(id, runs): the starts of repeated windows of each of `texts` (id, text) that has some, as runs; rows equal in id are equal in text. A table in the shared folder."""
    spark = texts.sparkSession
    every, every_path = written(pieces(texts, LEVELS[level]))
    several = every.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.bool_or("again").alias("again")).where("n > 1 OR again").select("h")
    kept, kept_path = written(skew_join(every.drop("again"), several, "h"))
    discard(spark, every_path)
    place = F.struct("id", "start")
    classes = kept.groupBy("h", "c").agg(F.min(place).alias("one"), F.max(place).alias("other"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    two = F.when(F.col("n") > 1, F.array("one", "other")).otherwise(F.array("one"))
    chosen, chosen_path = written(classes.select("h", "c", "size", F.posexplode(two).alias("which", "at")).select("h", "c", "which", "at.id", "at.start", "size"))
    hot = checkpointed(chosen.groupBy("h").agg(F.sum("size").alias("windows")).where(F.col("windows") > LIST).select("h", F.lit(True).alias("hot")))
    again = level + 1 < len(LEVELS) and not hot.isEmpty()
    spots = chosen.join(hot, "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False))) if again else chosen.withColumn("hot", F.lit(False))
    cut, cut_path = written(contents(texts, spots))
    found = sorted_lists(cut.where(~F.col("hot")))
    if again:
        below = repeats(cut.where("hot").select(F.struct("h", "c", "which").alias("id"), F.col("content").alias("text")), level + 1)
        found = found.unionByName(below.select("id.h", "id.c", "runs"))
    found = united(found, "h", "c")
    moved = F.transform("runs", lambda r: F.struct((F.col("start") + r["start"]).alias("start"), (F.col("start") + r["stop"]).alias("stop")))
    out, _ = written(united(skew_join(kept, found, ["h", "c"]).select("id", moved.alias("runs")), "id"))
    for path in (kept_path, chosen_path, cut_path):
        discard(spark, path)
    return out


def without(data: bytes, runs: list[dict] | None) -> tuple[bytes, list[tuple[int, int]]]:
    """A text's bytes without what repeated windows cover, and the maximal runs that went. `runs`: starts of windows, in order."""
    spans: list[list[int]] = []
    for run in runs or ():
        a, b = run["start"], run["stop"] + LENGTH - 1
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    parts, at = [], 0
    for a, b in spans:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]]), [(a, b) for a, b in spans]


def dedup_bytes(df: DataFrame) -> DataFrame:
    """The input with `kept`, the bytes of `text` that are left, and `spans`, the runs of bytes removed."""
    mark = F.struct("doc_id", F.xxhash64("text").alias("mark"))
    runs = repeats(df.select(mark.alias("id"), "text")).select(F.struct(F.col("id"), F.col("runs")).alias("found"))
    rest = [c for c in df.columns if c not in ("kept", "spans")]
    keyed = df.select(F.struct(*rest).alias("row"), mark.alias("id"))
    joined = skew_join(keyed, runs.select("found.id", F.col("found.runs").alias("runs")), "id", "left").select(*(F.col("row")[c].alias(c) for c in rest), F.col("runs").alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "text")):
            found = [without((t or "").encode(), r) for t, r in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            spans = [[{"start": a, "stop": b} for a, b in s] for _, s in found]
            columns = [pa.array([k for k, _ in found], pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([*map(batch.column, rest), *columns], names=[*rest, "kept", "spans"])

    return joined.mapInArrow(run, keep_types(df.select(*rest), "kept binary", f"spans {RUNS}"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated strings of 200 bytes."""
    found = dedup_bytes(documents(spark, sf_dir).select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", (F.octet_length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_OP12 = """
WITH doc AS (
  SELECT doc_id, coalesce(hex(encode(text)), '') AS h FROM documents
), win AS (
  SELECT doc_id, UNNEST(range(0, (length(h) // 2 - 199)::BIGINT)) AS p, h FROM doc WHERE length(h) >= 400
), hashed AS (
  SELECT doc_id, p, md5_number(substring(h, 2 * p + 1, 400)) AS w FROM win
), again AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY w) AS n FROM hashed) WHERE n > 1
), island AS (
  SELECT doc_id, p, sum((p - before > 200 OR before IS NULL)::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM again)
), span AS (
  SELECT doc_id, k, min(p) AS a, max(p) + 200 AS b FROM island GROUP BY doc_id, k
), gap AS (
  SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a, k) AS b FROM (SELECT * FROM span UNION ALL SELECT doc_id, -1, 0, 0 FROM doc)
), kept AS (
  SELECT doc_id, string_agg(substring(h, 2 * a + 1, 2 * (coalesce(b, length(h) // 2) - a)), '' ORDER BY a) AS h FROM gap JOIN doc USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, ((length(d.h) - length(k.h)) // 2)::BIGINT AS n_removed,
  (SELECT count(*) FROM span s WHERE s.doc_id = d.doc_id)::BIGINT AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM doc d JOIN kept k USING (doc_id)
"""

"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

A text's fingerprint has a bit set where over half the XXH64 hashes (seed 42) of its runs of
`size` words have it. Two fingerprints at most `DISTANCE` = 4 bits apart differ in at most four of
their eight bytes, so they share at least `SHARED` = 4 of the (position, byte) postings. The lists of single
postings would hold a 256th of all fingerprints each, so the index holds `INDEXED` = 3 positions at a time: a list holds the fingerprints
with the same three bytes in the same three positions. Of a pair that meets in a list all shared
positions are counted, pairs with fewer than the guaranteed four go, and the rest is verified by the number of differing bits.

Lists are searched without expanding them into pairs (`lists`). Links of all lists are joined into components.
Copies of one text share a fingerprint and enter the index once. Rows come back to their component by joins that adaptive
execution can deal to several tasks for a frequent key.

Null and empty texts have fingerprint zero, linked like any other. Fewer words than `size`: all
of them form one run. Long texts are hashed whole. Rows that repeat share everything. A null id is
never a component's name unless all of its ids are null. An empty table gives no rows. Columns of the
input stay, but the text and columns named fp or component_id, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, documents, keep_types, slices, skew_join
from .components import connected_components
from .lists import Near, linked

SEED, DISTANCE, SHARED, INDEXED, LIST = 42, 4, 4, 3, 1024


def fingerprint(words: list[bytes], size: int) -> int:
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: max(0, len(words) - size)] + 1).tolist()]
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(text[a:b], SEED) for a, b in zip(starts, ends[min(size, len(words)) - 1 :].tolist())])
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * np.add.reduce(bits, axis=0, dtype=np.int32) > len(bits)).tobytes(), "big")


def with_fingerprint(df: DataFrame, size: int = 4, text: str = "text", name: str = "fp", keep_text: bool = False) -> DataFrame:
    """Adds the fingerprint as a signed long; the text itself is dropped unless it is asked for."""
    kept = [c for c in df.columns if c != name and (keep_text or c != text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, text)):
            found = [fingerprint((t or "").encode().lower().split(), size) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(np.array(found, np.uint64).view(np.int64))], names=[*kept, name])

    return df.mapInArrow(run, keep_types(df.select(*kept), f"`{name}` long"))


def index(distinct: DataFrame) -> DataFrame:
    """(posting, fp): three byte positions and their bytes, in one long, for every choice of positions."""
    sets = list(combinations(range(8), INDEXED))
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(255) for p in range(8)]
    keys = []
    for k, chosen in enumerate(sets):
        key = F.lit(k).cast("long")
        for p in chosen:
            key = F.shiftleft(key, 8).bitwiseOR(byte[p])
        keys.append(key)
    return distinct.select("fp", F.explode(F.array(*keys)).alias("posting"))


def shared_bytes(differing: np.ndarray) -> np.ndarray:
    """How many positions agree, of fingerprints with these differing bits."""
    return (differing.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def near_bits(batch: pa.RecordBatch) -> Near:
    """Whether two members share SHARED bytes, by count, and then differ in at most DISTANCE bits."""
    fp = batch.column("key").to_numpy().view(np.uint64)

    def near(one: int, left: np.ndarray) -> np.ndarray:
        differing = fp[left] ^ fp[one]
        out = shared_bytes(differing) >= SHARED
        out[out] = np.bitwise_count(differing[out]) <= DISTANCE
        return out

    return near


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): enough links between distinct fingerprints to connect all that are linked."""
    # By a hash of its own and a number, so that neither the planner nor adaptive execution puts the few bytes that become 56 times as many in a few tasks.
    spread = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    return linked(index(spread).withColumnRenamed("fp", "key"), "posting", near_bits, F.lit(1), LIST)


def near_duplicates(df: DataFrame, size: int = 4) -> DataFrame:
    """(the input's columns but the text, fp, component_id): the least id of the documents reachable by links."""
    marked = checkpointed(with_fingerprint(df.drop("component_id"), size))
    groups = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(groups.select("fp"))).withColumnRenamed("node", "fp")
    classes = checkpointed(groups.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = skew_join(classes.select("fp", "root"), least, "root").drop("root")
    return skew_join(marked, named, "fp")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of at most four bits."""
    found = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

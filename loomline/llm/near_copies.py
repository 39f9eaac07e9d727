"""Near copies: texts whose sets of five-word runs have a Jaccard similarity of `LIKE` or more, by SimHash.

At 0.8 two fingerprints differ in 15 of 100 bits (0.1515; 0.164 for sets of four and five runs), too many for 64 bits and an
index of unchanged bytes. Fingerprints therefore have `BYTES` bytes, and every link is verified on the sets themselves:

1. A bit of a set's fingerprint is set where the hashes of its runs, read as weights -3, -1, 1 or 3, add up to more
   than zero. The first sixteen bytes are its bits, every two of the others one of `POSTINGS` postings.
   Sets that meet in a posting and differ in at most `BITS` bits are candidates. By calculation a pair at exactly 0.8 is missed in about two of a
   million cases (three of 100,000 with four and five runs); a nearer one less often.
2. Components of candidates are formed. They are coarser than those of near copies, so a set has to be
   compared within its own only, and goes there once.
3. In each of them the sets are searched breadth-first: of a pair the equal bytes of the whole fingerprints are counted, pairs with fewer
   than `SHARED` go (one of ten million at 0.8), the rest is verified by exact Jaccard similarity. Components of these links are formed.

Lists are searched without expanding them into pairs (`lists`), in parts of at most `LIST` sets and `LIST_TERMS` runs.
Equal sets enter once.

Letters A-Z count as a-z. Null counts as empty. Fewer words than five: all of them form one run. Texts without words equal
each other. Rows that repeat share everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, checkpointed, discard, keep_types, mix, skew_join, slices, text_bytes, written
from .components import connected_components
from .fingerprints import bags
from .lists import Near, forest, linked

LIKE = (4, 5)  # the least similarity, as a fraction of whole numbers
POSTINGS, BITS, SHARED = 192, 40, 56
BYTES = 16 + 2 * POSTINGS
LANES, BLOCK = 0x0303030303030303, 85  # eight numbers of two bits; as many of them add up to 255 at most
LIST, LIST_TERMS = 1024, 1 << 21


def sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of all texts, sorted in each; where each text's terms begin; and a hash of each set."""
    capital = (data >= 65) & (data <= 90)
    term, _, first = bags(data + 32 * capital.astype(np.uint8), offsets)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(term), dtype=np.uint64)))[first]
    size = np.diff(first).astype(np.uint64)
    return term, first, np.where(size > 0, mix(np.diff(total) + size), np.uint64(0))


def simhashes(term: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fingerprint of each set, shape (sets, BYTES); zeros for an empty set."""
    out = np.zeros((len(first) - 1, BYTES), np.uint8)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return out
    n = np.diff(first)[full]
    blocks = -(-n // BLOCK)
    at = np.cumsum(blocks) - blocks
    starts = np.repeat(first[:-1][full] - BLOCK * at, blocks) + BLOCK * np.arange(blocks.sum())
    steps = mix(np.arange(1, BYTES // 4 + 1, dtype=np.uint64) * np.uint64(BASE))
    draws, part, sums = np.empty_like(term), np.empty_like(term), np.empty((len(starts), 4), np.uint64)
    for k in range(BYTES // 4):
        # mix(term ^ steps[k]), in place: fresh memory costs more than the steps
        np.bitwise_xor(term, steps[k], out=draws)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            np.bitwise_xor(draws, np.right_shift(draws, np.uint64(shift), out=part), out=draws)
            np.multiply(draws, np.uint64(factor), out=draws)
        for lane in range(4):
            np.bitwise_and(np.right_shift(draws, np.uint64(2 * lane), out=part), np.uint64(LANES), out=part)
            np.add.reduceat(part, starts, out=sums[:, lane])
        total = np.add.reduceat(sums.view(np.uint8), at, axis=0, dtype=np.int64)
        out[full, 4 * k : 4 * k + 4] = np.packbits(2 * total > 3 * n[:, None], axis=1)
    return out


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def fixed(prints: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(BYTES), len(prints), [None, pa.py_buffer(np.ascontiguousarray(prints))]).cast(pa.binary())


def prints_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("prints").to_pylist()), np.uint8).reshape(-1, BYTES)


def sketched(df: DataFrame) -> DataFrame:
    """(doc_id, mark, key, prints) of each row: a hash of its text, that of its set, and its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "text")):
            term, first, key = sets(*text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), longs(key), fixed(simhashes(term, first))], names=["doc_id", "mark", "key", "prints"])

    return df.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, keep_types(df.select("doc_id"), "mark long", "key long", "prints binary"))


def posting_ids(prints: np.ndarray) -> np.ndarray:
    """Postings of each fingerprint, shape (sets, POSTINGS): the place of two bytes and their values."""
    return np.ascontiguousarray(prints[:, 16:]).view("<u2").astype(np.int64) + (np.arange(POSTINGS, dtype=np.int64) << 16)


def posted(distinct: DataFrame) -> DataFrame:
    """(key, x, y, posting): the bits of each set, once for each of its postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = prints_of(batch)
            bits = np.ascontiguousarray(prints[:, :16]).view(np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(prints) + 1, dtype=np.int32) * POSTINGS), pa.array(posting_ids(prints).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), longs(bits[:, 0]), longs(bits[:, 1]), listed], names=["key", "x", "y", "postings"])

    found = distinct.mapInArrow(run, "key long, x long, y long, postings array<long>")
    return found.select("key", "x", "y", F.explode("postings").alias("posting"))


def crowded(distinct: DataFrame) -> DataFrame:
    """(posting, w): how many sets have a posting. A set that is alone with it in its Arrow batch isn't counted, so few postings leave their task; a list may be longer by one for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            posting, n = np.unique(posting_ids(prints_of(batch)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(posting[n > 1]), pa.array(n[n > 1])], names=["posting", "w"])

    return distinct.select("prints").mapInArrow(run, "posting long, w long").groupBy("posting").agg(F.sum("w").alias("w"))


def with_terms(df: DataFrame) -> DataFrame:
    """(key, terms): the set of each row's text, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "text")):
            term, first, key = sets(*text_bytes(batch.column("text")))
            terms = [term[a:b].tobytes() for a, b in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays([longs(key), pa.array(terms, pa.binary())], names=["key", "terms"])

    return df.select("text").mapInArrow(run, "key long, terms binary")


def alike_bits(x: np.ndarray, y: np.ndarray) -> Near:
    """Whether two members differ in at most BITS bits; also of many pairs at once."""
    return lambda one, left: np.bitwise_count(x[left] ^ x[one]).astype(np.int64) + np.bitwise_count(y[left] ^ y[one]) <= BITS


def alike(prints: np.ndarray, terms: list[np.ndarray]) -> Near:
    """Whether two members with at least SHARED equal bytes, by count, have a Jaccard similarity of LIKE or more."""
    size = np.array([len(t) for t in terms])
    least, whole = LIKE

    def near(one: int, left: np.ndarray) -> np.ndarray:
        n = size[left]
        hit = whole * np.minimum(n, size[one]) >= least * np.maximum(n, size[one])
        hit[hit] = (prints[left[hit]] == prints[one]).sum(axis=1) >= SHARED
        own = terms[one]
        for at in np.array_split(np.flatnonzero(hit), int(n[hit].sum()) // LIST_TERMS + 1):
            if len(at):
                other = np.concatenate([terms[k] for k in left[at]]) if len(own) else np.zeros(0, np.uint64)
                place = np.minimum(np.searchsorted(own, other), max(len(own) - 1, 0))
                same = np.concatenate(([0], np.cumsum(own[place] == other)))[np.concatenate(([0], np.cumsum(n[at])))]
                same = np.diff(same)
                hit[at] = whole * same >= least * (n[at] + len(own) - same)
        return hit

    return near


def by_bits(batch: pa.RecordBatch) -> Near:
    return alike_bits(*(batch.column(c).to_numpy().view(np.uint64) for c in "xy"))


def by_terms(batch: pa.RecordBatch) -> Near:
    return alike(prints_of(batch), [np.frombuffer(t, np.uint64) for t in batch.column("terms").to_pylist()])


def near_copies(df: DataFrame) -> DataFrame:
    """(doc_id, mark, key, component_id, kept) of each row of (doc_id, text): the hash of its text, the least id of the documents reachable by links, and whether it is the one that stands for them.

    Of several texts with that id the one with the least hash does. Rows equal in id and text stand together; a row without an id stands for itself.
    """
    marked = checkpointed(sketched(df))
    # Rows of one key have one set, so whichever of them stays has the same fingerprint.
    distinct = checkpointed(marked.where("key <> 0").select("key", "prints").dropDuplicates(["key"]))
    # Every posting has links of its own between the same sets. Read back from a table they come in few tasks, each of which keeps a forest of them.
    links, path = written(linked(posted(distinct), "posting", by_bits, F.lit(1), LIST, crowded(distinct), at_once=True))
    coarse = connected_components(forest(links))
    discard(df.sparkSession, path)
    bits = checkpointed(skew_join(marked.drop("mark"), coarse.withColumnRenamed("node", "key"), "key"))
    texts = df.select("doc_id", "text").join(bits.select(F.col("doc_id").alias("id")).distinct(), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    found = checkpointed(with_terms(texts).dropDuplicates(["key"]).join(bits.drop("doc_id").dropDuplicates(["key"]), "key"))
    # A set weighs as one member, or more if it is large, so that a part holds at most LIST sets and LIST_TERMS terms.
    weight = F.greatest(F.lit(1), F.ceil(F.octet_length("terms") * LIST / (8 * LIST_TERMS)))
    roots = connected_components(linked(found, "root", by_terms, weight, LIST)).withColumnRenamed("node", "key")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark"))).alias("first")
    classes = checkpointed(marked.groupBy("key").agg(first).join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")))
    least = classes.groupBy("root").agg(F.min("first").alias("first"))
    named = skew_join(classes.select("key", "root"), least, "root").drop("root")
    found = skew_join(marked.select("doc_id", "mark", "key"), named, "key")
    kept = F.col("doc_id").isNull() | ((F.col("doc_id") == F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark")))
    return found.select("doc_id", "mark", "key", F.col("first.doc_id").alias("component_id"), kept.alias("kept"))

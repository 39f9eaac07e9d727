"""Ranked lexical search: a hybrid of term-at-a-time and document-at-a-time evaluation.

A term is a maximal run of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased. One
pass over the documents counts the items' terms in each of them and writes these counts; document
frequencies and lengths come from that table and cover all documents. Its partitions are then searched in segments
of about `SEGMENT` postings. In a segment every term has a list of documents with their share of the score, and an
item is answered in two steps:

* Term at a time: the shortest lists, a quarter of the segment's documents long together, are added up
  into accumulators. The accumulators are then one more list, bounded by the largest of them.
* Document at a time: the accumulators and the long lists are walked side by side over windows of `WINDOW`
  documents. Every list has a bound in every window. Lists whose bounds sum to less than the least score
  that counts can't bring in a document, so only the others propose candidates; the rest is looked up for the
  candidates, highest bound first, as long as these can still reach that score. A window none of whose lists can is skipped.

The best `k` of an item go on from segment to segment within a task, and tasks' best are merged in two levels.
Nothing is approximate: a candidate is dropped only if its score is below that of k others.

Items come in blocks of about `ITEM_BYTES` of text, so that what is broadcast (a block's terms with their
weights) is bounded; each block is a search of its own over all documents. Items are told apart by id: the terms of rows
with one id are united, and a null id is an item too. A document is a row: rows that repeat are ranked each, a null id comes after
the others of equal score, and ties beyond that are broken arbitrarily among rows that look alike. Null
and empty texts have no terms: such documents are not counted and such items have no rows. Other columns are ignored;
empty tables give no rows. Texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, discard, documents, slices, span_hash, text_bytes, word_spans, written

TOP, SEGMENT, WINDOW, ITEM_BYTES, SALT = 50, 1 << 21, 4096, 1 << 22, 64
IS_TERM = np.zeros(256, bool)
IS_TERM[128:] = True
IS_TERM[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def distinct_terms(text: str | None) -> set[bytes]:
    data, offsets = text_bytes(pa.array([text], pa.string()))
    data = LOWER[data]
    starts, ends, _ = word_spans(data, offsets, IS_TERM)
    raw = data.tobytes()
    return {raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())}


@dataclass
class Vocabulary:
    """The terms of a block of items, in order of their hashes, and each item's terms by number."""

    items: list[tuple[int | None, np.ndarray]]
    hashes: np.ndarray
    data: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[int | None, set[bytes]]]) -> Vocabulary:
        terms = sorted(set().union(*(t for _, t in items)))
        data = np.frombuffer(b"".join(terms), np.uint8)
        at = np.concatenate(([0], np.cumsum([len(t) for t in terms], dtype=np.int64))).astype(np.int64)
        hashes = span_hash(data, at[:-1], at[1:])
        order = np.argsort(hashes)
        number = dict(zip((terms[k] for k in order), range(len(terms))))
        lengths = np.diff(at)[order]
        flat = np.frombuffer(b"".join(terms[k] for k in order), np.uint8)
        return cls([(i, np.array(sorted(number[t] for t in found), np.int64)) for i, found in items], hashes[order], flat, np.concatenate(([0], np.cumsum(lengths))))

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which spans are terms, and of these the terms' numbers. Equal hashes are verified byte by byte."""
        number = np.minimum(np.searchsorted(self.hashes, own := span_hash(data, starts, ends)), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[number] == own) & (self.at[number + 1] - self.at[number] == ends - starts))
        number, length = number[hit], (ends - starts)[hit]
        if not len(hit):
            return hit, number
        heads = np.cumsum(length) - length
        step = np.arange(int(length.sum())) - np.repeat(heads, length)
        same = np.logical_and.reduceat(data[np.repeat(starts[hit], length) + step] == self.data[np.repeat(self.at[number], length) + step], heads)
        return hit[same], number[same]


def term_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n, terms, counts): of each document with a term, the number of its terms with repeats, and the vocabulary's in it."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in (s for b in batches for s in slices(b, "text")):
            data, offsets = text_bytes(batch.column("text"))
            data = LOWER[data]
            starts, ends, first = word_spans(data, offsets, IS_TERM)
            hit, number = known.find(data, starts, ends)
            row = np.searchsorted(first, hit, side="right") - 1
            both, count = np.unique(row * len(known.hashes) + number, return_counts=True)
            lists = pa.array(np.searchsorted(both // len(known.hashes), np.arange(batch.num_rows + 1)).astype(np.int32))
            terms = pa.ListArray.from_arrays(lists, pa.array((both % len(known.hashes)).astype(np.int32)))
            counts = pa.ListArray.from_arrays(lists, pa.array(count.astype(np.int64)))
            n = np.diff(first)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), terms, counts], names=["doc_id", "n", "terms", "counts"]).filter(pa.array(n > 0))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


@dataclass
class Statistics:
    """Over all documents: those with a term, their terms, and each vocabulary term's weight."""

    n_docs: int
    n_terms: int
    weight: np.ndarray

    @classmethod
    def of(cls, counts: DataFrame, size: int) -> Statistics:
        n, total = counts.agg(F.count(F.lit(1)), F.sum("n")).head()
        df = np.zeros(size, np.int64)
        for r in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each term of the block
            df[r["term"]] = r["count"]
        return cls(n, total or 0, np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64))

    def length(self, n: np.ndarray) -> np.ndarray:
        """The measure of documents of n terms, rounded down exactly."""
        if int(n.max(initial=0)) * self.n_docs < 1 << 56:
            return 50 + 50 * n * self.n_docs // self.n_terms
        return np.array([50 + 50 * x * self.n_docs // self.n_terms for x in n.tolist()], np.int64)


@dataclass
class Best:
    """The k best documents of an item so far."""

    k: int
    score: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    doc: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    null: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    least: int = 1  # a document with a lower score is not among them

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = np.concatenate((self.score, score)), np.concatenate((self.doc, doc)), np.concatenate((self.null, null))
        order = np.lexsort((doc, null, -score))[: self.k]
        self.score, self.doc, self.null = score[order], doc[order], null[order]
        if len(order) == self.k:
            self.least = max(1, int(self.score[-1]))


class Segment:
    """Inverted lists of some documents, in the order in which these came."""

    def __init__(self, batch: pa.RecordBatch, statistics: Statistics):
        self.doc, self.null = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        n, terms, counts = batch.column("n").to_numpy(), batch.column("terms"), batch.column("counts")
        size, term, tf = terms.value_lengths().to_numpy(), terms.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy()
        m = np.repeat(statistics.length(n), size)
        order = np.argsort(term, kind="stable")
        self.place = np.repeat(np.arange(len(n)), size)[order]
        self.share = (statistics.weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m)))[order]
        self.at = np.searchsorted(term[order], np.arange(len(statistics.weight) + 1))
        self.edges = np.append(np.arange(0, len(n), WINDOW), len(n))
        self.sums = np.zeros(len(n), np.int64)
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def windows(self, place: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each window of documents begins in a list, and the list's bound in it."""
        cut = np.searchsorted(place, self.edges)
        bound = np.zeros(len(cut) - 1, np.int64)
        full = np.flatnonzero(np.diff(cut))
        bound[full] = np.maximum.reduceat(share, cut[full])
        return cut, bound

    def accumulated(self, lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Term at a time: documents of any of the lists in their order, and the sums of their shares."""
        for place, share in lists:
            self.sums[place] += share
        place = np.flatnonzero(self.sums)
        share = self.sums[place]
        self.sums[place] = 0
        return place, share

    def search(self, terms: np.ndarray, best: Best) -> None:
        """Adds the documents that belong to the best for these terms."""
        terms = terms[self.at[terms + 1] > self.at[terms]]
        if not len(terms):
            return
        length = self.at[terms + 1] - self.at[terms]
        terms = terms[np.argsort(length, kind="stable")]
        n_short = int(np.searchsorted(np.cumsum(np.sort(length)), max(len(self.doc) // 4, 1), side="right"))
        lists = [(self.place[self.at[t] : self.at[t + 1]], self.share[self.at[t] : self.at[t + 1]]) for t in terms.tolist()]
        for t, own in zip(terms[n_short:].tolist(), lists[n_short:]):
            if t not in self.blocks:
                self.blocks[t] = self.windows(*own)
        blocks = [self.blocks[t] for t in terms[n_short:].tolist()]
        if n_short:
            lists = [self.accumulated(lists[:n_short]), *lists[n_short:]]
            blocks = [self.windows(*lists[0]), *blocks]
        cuts, bounds = [c for c, _ in blocks], np.stack([b for _, b in blocks])
        for w in range(bounds.shape[1]):
            self.walk(w, lists, cuts, bounds[:, w], best)

    def walk(self, w: int, lists: list[tuple[np.ndarray, np.ndarray]], cuts: list[np.ndarray], bounds: np.ndarray, best: Best) -> None:
        """Document at a time through one window."""
        order = np.argsort(bounds, kind="stable")
        reach = np.cumsum(bounds[order])
        if reach[-1] < best.least:
            return
        n_rest = int(np.searchsorted(reach, best.least))  # this many lists together stay below the least score
        lo = int(self.edges[w])
        sums, seen = np.zeros(self.edges[w + 1] - lo, np.int64), np.zeros(self.edges[w + 1] - lo, bool)
        for k in order[n_rest:].tolist():
            (place, share), (a, b) = lists[k], cuts[k][w : w + 2]
            at = place[a:b] - lo
            sums[at] += share[a:b]
            seen[at] = True
        found = np.flatnonzero(seen)
        score = sums[found]
        for r in range(n_rest - 1, -1, -1):
            can = score + reach[r] >= best.least
            found, score = found[can], score[can]
            if not len(found):
                return
            (place, share), (a, b) = lists[order[r]], cuts[order[r]][w : w + 2]
            if a < b:
                at = np.minimum(np.searchsorted(place[a:b], found + lo), b - a - 1)
                score = score + np.where(place[a:b][at] == found + lo, share[a:b][at], 0)
        good = score >= best.least
        if good.any():
            found = found[good] + lo
            best.add(score[good], self.doc[found], self.null[found])


def found_in(counts: DataFrame, vocabulary: Vocabulary, statistics: Statistics, k: int) -> DataFrame:
    """(item, doc_id, score): each task's k best documents of every item."""
    shared = counts.sparkSession.sparkContext.broadcast((vocabulary.items, statistics))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, known = shared.value
        best = [Best(k) for _ in items]
        held, postings = [], 0

        def searched() -> None:
            segment = Segment(pa.concat_batches(held), known)
            for (_, terms), own in zip(items, best):
                segment.search(terms, own)

        for batch in batches:
            start = 0
            size = np.cumsum(batch.column("terms").value_lengths().fill_null(0).to_numpy())
            while start < batch.num_rows:
                before = int(size[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(size, before + SEGMENT - postings, side="right")))
                held.append(batch.slice(start, stop - start))
                postings += int(size[stop - 1]) - before
                start = stop
                if start < batch.num_rows or postings >= SEGMENT:
                    searched()
                    held, postings = [], 0
        if held:
            searched()
        number = np.repeat(np.arange(len(items)), [len(b.score) for b in best])
        doc = pa.array(np.concatenate([b.doc for b in best]), mask=np.concatenate([b.null for b in best]))
        yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), doc, pa.array(np.concatenate([b.score for b in best]))], names=["item", "doc_id", "score"])

    return counts.mapInArrow(run, "item int, doc_id long, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item, first among the results of some tasks, then of all."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SALT)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).drop("part")


def item_blocks(items: DataFrame) -> Iterator[Vocabulary]:
    """The items in order of their ids, in blocks of about ITEM_BYTES of text; of each id the terms of all its rows."""
    block, size, last = [], 0, object()
    for r in items.select("item_id", "text").orderBy("item_id").toLocalIterator():
        if r.item_id != last:
            if size >= ITEM_BYTES:
                yield Vocabulary.of(block)
                block, size = [], 0
            block.append((r.item_id, set()))
            last = r.item_id
        block[-1][1].update(distinct_terms(r.text))
        size += len(r.text or "")
    if block:
        yield Vocabulary.of(block)


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents (doc_id, text) with the highest scores above 0 for each item (item_id, text)."""
    spark, out = docs.sparkSession, []
    for vocabulary in item_blocks(items):
        if not len(vocabulary.hashes):
            continue
        counts, path = written(term_counts(docs, vocabulary))
        top = best_of(found_in(counts, vocabulary, Statistics.of(counts, len(vocabulary.hashes)), k), k)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(vocabulary.items)], "item int, item_id long")
        out.append(checkpointed(top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")))
        discard(spark, path)
    whole = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for part in out:
        whole = whole.union(part)
    return whole


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


TERMS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_OP11 = f"""
WITH doc AS (
  SELECT doc_id, {TERMS_SQL} AS terms FROM documents
), total AS (
  SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM doc WHERE len(terms) > 0
), item AS (
  SELECT DISTINCT item_id, term FROM (SELECT item_id, UNNEST({TERMS_SQL}) AS term FROM benchmark)
), tf AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, UNNEST(terms) AS term FROM doc) WHERE term IN (SELECT term FROM item) GROUP BY doc_id, term
), weight AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, n_docs
), share AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(terms) * n_docs) // n_terms))) AS share
  FROM tf JOIN weight USING (term) JOIN doc USING (doc_id), total
), scored AS (
  SELECT item_id, doc_id, sum(share)::BIGINT AS score FROM item JOIN share USING (term) GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY rank <= 50
"""

"""Document fingerprints by consistent weighted sampling.

A text is a bag of runs of five words (all its words, if there are fewer), each weighted by how
often it occurs. For each of the `SLOTS` places of a signature a distinct term has 64 bits of its own, and from these two gamma variates r and c
of shape 2 and a uniform b. A term of weight w is sampled at the level t, the greatest whole number up to ln w / r + b, and the term with the least
ln c - r (t - b) - r is the slot's sample, together with its level. Two bags agree in a slot with
probability equal to their generalised Jaccard similarity. Work and memory grow with the distinct terms, whatever they weigh.

The variates are quantiles at 2**16 steps; the outermost steps, which decide in texts of very many terms, are divided into as many again.

32 bits of a hash of the term and its level make up the slot. No words: every slot is zero, which equals only itself.

Null counts as the empty text. Equal texts have equal fingerprints. Rows that repeat, and ties
in the id, are kept; the next document is then the next row in order of id and text. Long texts are read whole. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, documents, keep_types, mix, slices, span_hash, text_bytes, windows_hash, word_spans

SHINGLE, SLOTS = 5, 128
BLOCK_ROWS, COARSE, MOST_BLOCKS = 4000, 4096, 1 << 20  # rows in a range of ids, ranges of the first cut, and of all


def bags(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms and weights of all texts, one text after the other, and where each text's terms begin."""
    starts, ends, first = word_spans(data, offsets)
    words = span_hash(data, starts, ends)
    runs = windows_hash(words, SHINGLE)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = text[: len(runs)] == text[SHINGLE - 1 :]
    n_words = np.diff(first)
    few = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    short = np.array([windows_hash(words[first[k] : first[k + 1]], n_words[k])[0] ^ np.uint64(n_words[k]) for k in few], np.uint64)
    owner = np.concatenate((text[: len(runs)][inside], few))
    term = np.concatenate((runs[inside], short))
    order = np.lexsort((term, owner))
    owner, term = owner[order], term[order]
    new = np.ones(len(term), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(new)
    return term[at], np.diff(np.append(at, len(term))), np.searchsorted(owner[at], np.arange(len(first)))


def gamma_quantiles(share: np.ndarray) -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2, from the share below (up to one half) or, given as negative, above."""
    upper = share < 0
    x = np.where(upper, 1 - np.log(np.where(upper, -share, 0.5)), np.sqrt(2 * np.abs(share)))
    for _ in range(60):  # 1 - (1 + x) exp(-x) is the share below x
        off = np.where(upper, -(1 + x) * np.exp(-x) - share, -np.expm1(-x) - x * np.exp(-x) - share)
        x = np.maximum(x - off / (x * np.exp(-x)), x / 2)
    return x


STEPS = 1 << 16
_middle = (np.arange(STEPS) + 0.5) / STEPS
_all = gamma_quantiles(np.where(_middle < 0.5, _middle, _middle - 1))
RATE, LOG_SCALE = _all.astype(np.float32), np.log(_all).astype(np.float32)
RATE_TAIL, LOG_SCALE_TAIL = gamma_quantiles(-_middle / STEPS).astype(np.float32), np.log(gamma_quantiles(_middle / STEPS)).astype(np.float32)


def signatures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprints of texts, shape (texts, SLOTS), 32-bit integers."""
    term, weight, first = bags(data, offsets)
    out = np.zeros((len(offsets) - 1, SLOTS), np.uint32)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return out
    heads = first[:-1][full]
    salts = mix(np.arange(1, 2 * SLOTS + 1, dtype=np.uint64) * np.uint64(BASE))
    name = mix(term).astype(np.uint32)
    heavy = np.flatnonzero(weight > 1)
    log_weight = np.log(weight[heavy])
    # A sample's rank, as the bits of a positive float, above its name: the greatest of these pairs is the least sample.
    pair = np.empty((len(term), 2), np.uint32)
    pair[:, 0] = name
    rank = pair[:, 1].view(np.float32)
    for slot in range(SLOTS):
        bits = (term ^ salts[slot]) * (salts[SLOTS + slot] | np.uint64(1))
        parts = bits.view(np.uint16).reshape(-1, 4)
        log_scale, rate = np.take(LOG_SCALE, parts[:, 3], mode="clip"), np.take(RATE, parts[:, 2], mode="clip")
        for tail, step, values in ((LOG_SCALE_TAIL, parts[:, 3] == 0, log_scale), (RATE_TAIL, parts[:, 2] == STEPS - 1, rate)):
            outer = np.flatnonzero(step)
            if len(outer):
                values[outer] = tail[(mix(bits[outer]) & np.uint64(STEPS - 1)).astype(np.int64)]
        shift = (parts[:, 1].astype(np.float32) + np.float32(0.5)) * np.float32(1 / STEPS)
        if len(heavy):
            level = np.floor(log_weight / rate[heavy] + shift[heavy])
            shift[heavy] -= level
            pair[heavy, 0] = mix(term[heavy] + level.astype(np.int64).view(np.uint64) * np.uint64(BASE)).astype(np.uint32)
        np.subtract(rate - rate * shift + np.float32(4), log_scale, out=rank)
        out[full, slot] = np.maximum.reduceat(pair.view(np.uint64).ravel(), heads).astype(np.uint32)
    return out


def as_text(signature: np.ndarray) -> list[str]:
    return [row.astype(">u4").tobytes().hex() for row in signature]


def likeness(a: str = "a", b: str = "b"):
    """Share of slots in which two fingerprint columns agree."""
    same = F.aggregate(F.sequence(F.lit(0), F.lit(SLOTS - 1)), F.lit(0), lambda n, k: n + (F.substring(a, k * 8 + 1, F.lit(8)) == F.substring(b, k * 8 + 1, F.lit(8))).cast("int"))
    return same / F.lit(float(SLOTS))


def fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of a text column as a string of hexadecimal digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, text, 1 << 18)):
            kept = [n for n in batch.schema.names if n != name]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(as_text(signatures(*text_bytes(batch.column(text)))))], names=[*kept, name])

    return df.mapInArrow(run, keep_types(df.drop(name), f"`{name}` string"))


def likenesses(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def id_cuts(ids: DataFrame) -> np.ndarray:
    """Ids that cut their order in ranges of about `BLOCK_ROWS` rows: at most `COARSE` quantiles, and where these are too few as many again in each of their ranges, up to 2**20 in all."""
    blocks = min(-(-ids.count() // BLOCK_ROWS), MOST_BLOCKS)
    inner = lambda n: F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20_000).alias("at")
    if blocks < 2:
        return np.zeros(0, np.int64)
    cuts = np.unique(np.array(ids.agg(inner(min(blocks, COARSE))).head()["at"] or [], np.int64))
    within = -(-blocks // COARSE)
    if within > 1:
        parts = ids.where(F.col("doc_id").isNotNull()).groupBy(range_number(ids, cuts).alias("part")).agg(inner(within)).collect()
        cuts = np.unique(np.concatenate([cuts, *(np.array(r["at"], np.int64) for r in parts)]))
    return cuts


def range_number(df: DataFrame, cuts: np.ndarray) -> Column:
    """How many cuts lie below a row's id; 0 without an id. Only the ids go to Python."""
    shared = df.sparkSession.sparkContext.broadcast(cuts)

    def number(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, ids.to_numpy(), side="left").astype(np.int32))

    return F.pandas_udf(number, "int")(F.coalesce("doc_id", F.lit(-(1 << 63))))


def in_id_order(df: DataFrame) -> DataFrame:
    """(doc_id, text, block, guest) dealt by ranges of the id and sorted, so that each row's successor follows it.

    A guest is a copy of the next range's first row (after the last range: of the first) that
    closes a range; if several rows tie for it, the first counts. Only quantiles of the ids and
    each range's least id reach the driver, at most 2**20 of each. Null ids come first.
    """
    dealt = df.select("doc_id", "text", range_number(df, id_cuts(df.select("doc_id"))).alias("block"))
    heads = dealt.groupBy("block").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id"))["doc_id"].alias("doc_id"))
    heads = sorted(heads.collect())
    guests = [(heads[k - 1].block, h.doc_id) for k, h in enumerate(heads)]
    guests = df.sparkSession.createDataFrame(guests, "host int, head long")
    copies = dealt.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("head"))).select("doc_id", "text", F.col("host").alias("block"), F.lit(True).alias("guest"))
    return dealt.withColumn("guest", F.lit(False)).union(copies).repartition("block").sortWithinPartitions("block", "guest", "doc_id", "text")


def edited_likeness(df: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edit, whose last quarter is the beginning of the next document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sign = None, None  # the row that waits for its successor, and its signature
        for batch in (s for b in batches for s in slices(b, "text")):
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "text", "block", "guest")]
            signs = signatures(*text_bytes(batch.column("text")))
            done = []
            for k, (doc, text, block, guest) in enumerate(zip(*columns, strict=True)):
                text = text or ""
                if held is not None and held[2] == block:
                    before, n = held[1], len(held[1])
                    done.append((held[0], n, before[: n - n // 4] + text[: n // 4], sign, signs[k]))
                held, sign = (None, None) if guest else ((doc, text, block), signs[k])
            if not done:
                continue
            doc, n, edited, own, following = zip(*done)
            own, changed = np.stack(own), signatures(*text_bytes(pa.array(edited, pa.string())))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array(as_text(own)), pa.array(as_text(changed)), pa.array(likenesses(own, changed)), pa.array(likenesses(own, np.stack(following)))],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return in_id_order(df).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edits, and how alike they are."""
    return edited_likeness(documents(spark, sf_dir))

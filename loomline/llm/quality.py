"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Every token (a run of letters, digits and bytes above 127, or a run of other signs) falls into
one of `BUCKETS` by its hash. Random indexing gives a bucket the sum of the fixed random vectors
of the tokens up to two places from it, over all documents; the vectors are scaled to length one.
A document's features are the pooled vectors of its tokens, their pooled index vectors, how many
tokens there are and what shares of them repeat an earlier one or the one before.
A two-layer network in numpy learns the label from about `SAMPLE` labelled rows at most, those with
the least hash of the id; a fifth of them sets the temperature that makes its scores probabilities.

Null and empty texts have the zero vector and get the score of that. An id labelled twice counts
once, as good if at least half its labels say so; without labels every score is one half. Columns
of the input stay; `score` replaces a column of that name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_crc, documents, keep_types, slices, span_hash, text_bytes, uniforms

BUCKETS, WIDTH, REACH = 4096, 32, 2
SAMPLE, HIDDEN, EPOCHS, SEED, SHRINK = 20_000, 32, 60, 4, 5
SLICE = 1 << 18  # bytes of text at a time: each of its tokens takes a few hundred bytes of work arrays
# Kinds of bytes: 0 white space, 1 letters, digits and bytes above 127, 2 other signs.
KIND = np.full(256, 2, np.int8)
KIND[[*b" \t\n\x0b\x0c\r"]] = 0
KIND[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = 1


def index_vectors() -> np.ndarray:
    """Sparse random vectors of the buckets: entries 1, -1 (a sixteenth each) or 0."""
    u = uniforms(BUCKETS, WIDTH, SEED).T
    return (u > 15 / 16).astype(np.float32) - (u < 1 / 16)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each token of all texts, and where each text's tokens begin."""
    data, offsets = text_bytes(column)
    kind = KIND[data]
    cut = np.ones(len(kind) + 1, bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    starts, ends = edges[:-1], edges[1:]
    full = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[full], ends[full]
    return (span_hash(data, starts, ends) >> np.uint64(40)).astype(np.int64) % BUCKETS, np.searchsorted(starts, offsets)


def pooled(bucket: np.ndarray, first: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Sum of each text's token vectors over their number and `SHRINK`, so that few tokens say little; then the log of the number, the share of tokens that repeat, and of those that repeat the one before."""
    n = np.diff(first)
    out = np.zeros((len(n), vectors.shape[1] + 3), np.float32)
    full = np.flatnonzero(n)
    if len(full):
        out[full, :-3] = np.add.reduceat(vectors[bucket], first[:-1][full], axis=0) / (n[full, None] + SHRINK)
        named = np.repeat(np.arange(len(n)), n) * BUCKETS + bucket
        kinds, again = np.unique(named) // BUCKETS, named[1:][named[1:] == named[:-1]] // BUCKETS
        out[:, -3] = np.log1p(n)
        out[full, -2] = 1 - np.bincount(kinds, minlength=len(n))[full] / n[full]
        out[full, -1] = np.bincount(again, minlength=len(n))[full] / n[full]
    return out


def word_vectors(df: DataFrame) -> np.ndarray:
    """Random-indexing vectors of all buckets from all texts. A task sends one row for each bucket it met."""
    index = index_vectors()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((BUCKETS, WIDTH))
        for batch in (s for b in batches for s in slices(b, "text", SLICE)):
            bucket, first = tokens(batch.column("text"))
            if not len(bucket):
                continue
            text, around = np.repeat(np.arange(len(first) - 1), np.diff(first)), np.zeros((len(bucket), WIDTH), np.float32)
            own = index[bucket]
            for k in range(1, REACH + 1):
                same = (text[k:] == text[:-k])[:, None]
                around[k:] += own[:-k] * same
                around[:-k] += own[k:] * same
            order = np.argsort(bucket, kind="stable")
            at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            sums[bucket[order][at]] += np.add.reduceat(around[order], at, axis=0)
        met = np.flatnonzero(np.abs(sums).sum(axis=1))
        columns = [pa.array(met.astype(np.int32)), *(pa.array(sums[met, k]) for k in range(WIDTH))]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", *(f"v{k}" for k in range(WIDTH))])

    parts = df.select("text").mapInArrow(run, "bucket int, " + ", ".join(f"v{k} double" for k in range(WIDTH)))
    total = parts.groupBy("bucket").agg(*(F.sum(f"v{k}").alias(f"v{k}") for k in range(WIDTH))).toPandas()
    vectors = np.zeros((BUCKETS, WIDTH), np.float32)
    if len(total):
        found = total.drop(columns="bucket").to_numpy()
        vectors[total["bucket"].to_numpy()] = found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)
    return np.concatenate((vectors, index), axis=1)


def features(df: DataFrame, vectors: np.ndarray) -> DataFrame:
    """Columns other than text, and the document vector."""
    kept = [c for c in df.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "text", SLICE)):
            found = pooled(*tokens(batch.column("text")), vectors)
            listed = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), found.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), listed], names=[*kept, "vector"])

    return df.mapInArrow(run, keep_types(df.drop("text"), "vector array<float>"))


class Network:
    """Standardised input, one hidden layer of rectified units, one logit, a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-6
        z, t = (x[~held] - self.mean) / self.spread, y[~held]
        self.w = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        moments, step = [[np.zeros_like(w), np.zeros_like(w)] for w in self.w], 0
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(len(z)), max(1, len(z) // 128)):
                hidden = np.maximum(z[part] @ self.w[0] + self.w[1], 0)
                error = (self.squash(hidden @ self.w[2] + self.w[3]) - t[part]) / len(part)
                back = np.outer(error, self.w[2]) * (hidden > 0)
                step += 1
                for w, m, g in zip(self.w, moments, (z[part].T @ back + 1e-4 * self.w[0], back.sum(axis=0), hidden.T @ error + 1e-4 * self.w[2], error.sum(keepdims=True)), strict=True):
                    m[0] += 0.1 * (g - m[0])
                    m[1] += 0.001 * (g * g - m[1])
                    w -= 0.003 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        if held.any():
            logits = self.logits(x[held])
            loss = [np.logaddexp(0, np.where(y[held] > 0, -1, 1) * logits / k).mean() for k in TEMPERATURES]
            self.temperature = float(TEMPERATURES[int(np.argmin(loss))])

    @staticmethod
    def squash(a: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(a, -40, 40)))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.spread @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.squash(self.logits(x) / self.temperature)


TEMPERATURES = np.geomspace(0.25, 8, 41)


def training_rows(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, quality): about `sample` labelled ids that may be learnt from, or all if there are fewer; those with the least hash, by a bound on it."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (doc_crc() % 3 != 1))
    rows = rows.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    bound = int(sample / max(rows.count(), 1) * (1 << 40))
    return rows.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 24) < bound)


def fit(df: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, Network | None]:
    """Word vectors from all texts and a network from the sampled labels (bounded, so both may be broadcast)."""
    vectors = word_vectors(df)
    known = df.select("doc_id", "text").join(F.broadcast(training_rows(labels, sample)), "doc_id")
    # Of an id's several texts the one with the least hash.
    known = known.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("quality").alias("quality"))
    rows = features(known, vectors).withColumn("h", F.xxhash64("doc_id")).toPandas().sort_values(["h", "doc_id"], kind="stable")
    if rows["quality"].nunique() < 2:
        return vectors, None
    x = np.stack(rows["vector"].to_numpy()).astype(np.float64)
    return vectors, Network(x, rows["quality"].to_numpy(), rows["h"].to_numpy() % 5 == 0)


def score(df: DataFrame, vectors: np.ndarray, network: Network | None) -> DataFrame:
    """Adds the probability that a text is good."""
    kept = [c for c in df.columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "text", SLICE)):
            found = pooled(*tokens(batch.column("text")), vectors)
            p = network(found.astype(np.float64)) if network else np.full(len(found), 0.5)
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(p)], names=[*kept, "score"])

    return df.mapInArrow(run, keep_types(df.drop("score"), "score double"))


def classify(df: DataFrame, labels: DataFrame) -> DataFrame:
    return score(df, *fit(df, labels))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    scored = classify(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", F.coalesce(doc_crc() % 3 == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""Helpers shared by the text operators: byte views of Arrow text columns, word
boundaries, vectorised hashing, a bounded memo and the shared checkpoint folder.

Words are maximal runs of bytes other than space and 0x09-0x0D, everywhere in this package.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = b" \t\n\x0b\x0c\r"
IS_WORD = np.ones(256, bool)
IS_WORD[list(SPACES)] = False
# An odd multiplier and its inverse modulo 2**64, for polynomial hashes of byte ranges.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers (splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniforms(n: int, streams: int, seed: int) -> np.ndarray:
    """Fixed pseudo-random numbers in (0, 1), shape (streams, n), from a counter and a seed."""
    counter = np.arange(n * streams, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)
    return ((mix(mix(counter + np.uint64(BASE))) >> np.uint64(11)).astype(np.float64) + 0.5).reshape(streams, n) / float(1 << 53)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and each row's offsets into them; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `limit` bytes of text, so that work arrays stay small; a longer text is a piece of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, a maximal run of the bytes that `kind` marks, and for each row the index of its first word (one more at the end)."""
    word = kind[data]
    inner = np.zeros(len(word), bool)
    inner[1:] = word[:-1]
    inner[offsets[:-1][offsets[:-1] < len(word)]] = False
    starts = np.flatnonzero(word & ~inner)
    inner[:-1] = word[1:]
    inner[-1:] = False
    last = offsets[1:] - 1
    inner[last[last >= 0]] = False
    ends = np.flatnonzero(word & ~inner) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def power(n: int, base: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 20), base, np.uint64)
        known[0] = 1
        _powers[base] = known = np.cumprod(known)
    return known[:n]


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, by differences of one running polynomial."""
    n = len(data)
    running = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power(n, BASE), out=running[1:])
    value = (running[ends] - running[starts]) * power(n + 1, INVERSE)[starts]
    return mix(value + mix((ends - starts).astype(np.uint64)))


def windows_hash(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` successive word hashes; len(words) - size + 1 of them."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, size):
        out = out * np.uint64(BASE) + words[k : k + n]
    return mix(out)


class Memo(dict):
    """A cache of a function. Two generations bound it: what was used since the last change of generation stays."""

    def __init__(self, function: Callable, limit: int = 200_000):
        self.function, self.limit, self.old = function, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; without one, a temporary folder in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loomline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame read back from the shared checkpoint folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The frame as a table in the shared folder, and its path, for results that `discard` removes once they have been used."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def skew_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join of `big` with `small`, which has one row for each key.

    The small side is written first, so that both sides come to the join straight from a shuffle, or the small one by
    broadcast if it turns out to be below the session's limit. Only then can adaptive execution deal the rows of a
    frequent key to several tasks.
    """
    return big.join(checkpointed(small), key, how)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def doc_crc(column: str = "doc_id"):
    """crc32 of the decimal id, by which folds are drawn."""
    return F.crc32(F.col(column).cast("string"))


def keep_types(df: DataFrame, *added: str) -> str:
    """A DDL schema: the frame's columns, then the added ones."""
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + list(added))

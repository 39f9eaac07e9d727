"""Packing documents into fixed-length sequences along a space-filling curve.

Each document's hashed words, projected to three dimensions and averaged, give a point; the
point's place on a Hilbert curve is the sort key, so that documents of one kind lie together.
The curve is cut into ranges of about equal size, one sort per range, and the token stream of
a range is cut at every `length` tokens. Only the last sequence of a range is not full.

A sort key holds the place on the curve and a hash of the id, so a mass of equal texts, which
share one place, is still spread over ranges. Ranges are cut by the bytes of all documents: each has
`range_bytes`, or a 2**20th of the whole where that is more, so the broadcast list of bounds has at
most 2**20 numbers. Ties in the key are ordered by id and text. Null and empty texts consist of the
end token. Long texts are cut like any other. Rows that repeat are packed as often as they occur. An
empty table gives no pieces. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import NUMBER, SPACE, byte_alphabet, byte_kinds, contractions
from .common import IS_WORD, checkpointed, documents, slices, span_hash, text_bytes, word_spans
from .prefix_bpe import PrefixTables, distinct, gathered

VOCABULARY = "word_bpe_49k.json"
END = 2
LENGTH = 4096
AXES, BITS = 3, 10
RANGE_BYTES, MOST_RANGES = 2 << 20, 1 << 20
SALT, CELL = 31, 10  # bits of the hash below a place on the curve; a part of the curve has 2**CELL cells
SLICE = 1 << 20  # bytes of text at a time


class WordIds:
    """Token ids of whole texts by one vocabulary file: lower case, white space dropped, a mark at each word's end.

    The different words of a slice are looked at once. Those of characters below U+0250 are cut into
    pieces on arrays of bytes and encoded together; anything else goes to the tokenizer itself.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        alphabet, vocab, suffix = byte_alphabet(), model["vocab"], model["end_of_word_suffix"]
        plain = lambda token: bytes(alphabet[c] for c in token.removesuffix(suffix)) + b"\0" * token.endswith(suffix)
        # The mark is byte 0. It joins the byte before it ahead of all other merges, by an id that the file doesn't have.
        mark = 1 + max(vocab.values())
        tokens: list[bytes | None] = [None] * mark + [b"\0"]
        for token, k in vocab.items():
            if all(c in alphabet for c in token.removesuffix(suffix)):
                tokens[k] = plain(token)
        merges = [(vocab[c], mark, vocab[c + suffix]) for c in alphabet]
        merges += [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
        self.tables = PrefixTables(tokens, merges)
        self.lower, self.odd = np.arange(256, dtype=np.uint8), np.zeros(0x250, bool)
        self.lower[ord("A") : ord("Z") + 1] += 32
        self.small = np.arange(0x250)
        for k in range(0x80, 0x250):
            small = chr(k).lower()
            self.small[k] = ord(small[0])
            self.odd[k] = len(small) > 1 or not 0x80 <= self.small[k] < 0x250 or chr(k).isspace()

    @functools.cached_property
    def tokenizer(self) -> Tokenizer:
        """Read when a word needs it."""
        return Tokenizer.from_file(self.path)

    def normal(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes in lower case, and which words (given by the offsets of their bytes) the tokenizer has to see."""
        data = self.lower[data]
        strange = (data >= 0xCA) | (data == 0) | (data == ord("<"))
        lead = np.flatnonzero((data >= 0xC2) & (data < 0xCA))
        number = (data[lead].astype(np.int64) & 0x1F) << 6 | data[lead + 1] & 0x3F
        inside = number < 0x250
        strange[lead[~inside]] = True
        lead, number = lead[inside], number[inside]
        strange[lead[self.odd[number]]] = True
        data[lead] = 0xC0 | self.small[number] >> 6
        data[lead + 1] = 0x80 | self.small[number] & 0x3F
        many = np.concatenate(([0], np.cumsum(strange)))
        return data, many[ends[1:]] > many[ends[:-1]]

    def pieces(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes and offsets of the pieces of words, each with the mark behind it, and the number of each word's first piece."""
        kinds, border = byte_kinds(data), np.zeros(len(data) + 1, bool)
        border[ends] = True
        cut = border.copy()
        cut[1:-1] |= kinds[1:] != kinds[:-1]
        cut[:-1] |= (kinds == NUMBER) & ((data & 0xC0) != 0x80)
        contractions(data, kinds, cut, border)
        starts = np.flatnonzero(cut)
        starts, stops = starts[:-1], starts[1:]
        full = kinds[starts] != SPACE
        starts, stops = starts[full], stops[full]
        sizes = stops - starts
        at = np.concatenate(([0], np.cumsum(sizes + 1)))
        out = np.zeros(at[-1], np.uint8)
        shift = np.repeat(at[:-1] - starts, sizes)
        source = np.arange(len(shift)) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
        out[source + shift] = data[source]
        return out, at, np.searchsorted(starts, ends)

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin (one more at the end)."""
        data, offsets = text_bytes(column)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(column) + 1, np.int64)
        # A word goes to the next word's first byte, and white space is all alike.
        data = np.where(IS_WORD[data], data, np.uint8(ord(" ")))
        begin = np.zeros(len(data) + 1, bool)
        begin[1:-1] = (data[1:] != ord(" ")) & (data[:-1] == ord(" "))
        begin[offsets] = True
        begin[[0, -1]] = True
        starts = np.flatnonzero(begin)
        words, ends, which = distinct(data, starts)
        small, strange = self.normal(words, ends)
        if strange.any():
            own = np.flatnonzero(strange)
            texts = [words[ends[k] : ends[k + 1]].tobytes().decode() for k in own]
            others = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            small[np.repeat(strange, np.diff(ends))] = ord(" ")
        found, at, head = self.pieces(small, ends)
        found, at, same = distinct(found, at)
        ids, first = gathered(*self.tables.encode(found, at), same)
        first = first[head]
        if strange.any():
            sizes = np.diff(first)
            sizes[own] = list(map(len, others))
            parts = np.split(ids, first[own])
            ids = np.concatenate([parts[0], *chain.from_iterable(zip(others, parts[1:]))])
            first = np.concatenate(([0], np.cumsum(sizes)))
        flat, at = gathered(ids, first, which)
        return flat, at[np.searchsorted(starts, offsets)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        flat, at = self.encode_column(pa.array(texts, pa.string()))
        raw = flat.astype("<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(at.tolist(), at[1:].tolist())]


@functools.cache
def words(vocabulary: str) -> WordIds:
    return WordIds(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of `points`, integers below 2**bits (Skilling's transposition)."""
    x = [c.astype(np.int64) for c in points.T]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for axis in x:
            high = (axis & q) > 0
            swap = np.where(high, 0, (x[0] ^ axis) & p)
            x[0] ^= np.where(high, p, swap)
            if axis is not x[0]:
                axis ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | ((axis ^ turn) >> bit & 1)
    return key


def curve_places(column: pa.Array) -> np.ndarray:
    """Place on the curve of each text: the mean of its words' pseudo-random points. No words: the middle."""
    data, offsets = text_bytes(column)
    starts, ends, first = word_spans(data, offsets)
    h = span_hash(data, starts, ends)
    count = np.maximum(np.diff(first), 1)
    point = np.empty((len(offsets) - 1, AXES))
    for axis in range(AXES):
        value = (h >> np.uint64(16 * axis) & np.uint64(0xFFFF)).astype(np.float64) / 32767.5 - 1
        point[:, axis] = np.diff(np.concatenate(([0.0], np.cumsum(value)))[first]) / count
    return hilbert(((np.tanh(4 * point) + 1) / 2 * ((1 << BITS) - 1e-3)).astype(np.int64), BITS)


def with_place(df: DataFrame, bounds: Broadcast | None = None) -> DataFrame:
    """(doc_id, text, salt) with the sort key `place`, and the number of its range if bounds are given; without them, the keys and bytes only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "text")):
            place = curve_places(batch.column("text")) << 32 | batch.column("salt").to_numpy()
            if bounds is None:
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.diff(text_bytes(batch.column("text"))[1]) + 1)], names=["place", "bytes"])
            else:
                span = pa.array(np.searchsorted(bounds.value, place, side="right").astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(place), span], names=["doc_id", "text", "place", "span"])

    return df.mapInArrow(run, "place long, bytes long" if bounds is None else "doc_id long, text string, place long, span int")


def range_bounds(salted: DataFrame, range_bytes: int) -> np.ndarray:
    """Sort keys at which ranges of `range_bytes` of text begin, from the bytes of all documents in each cell of the curve.

    The bytes before a cell are those of earlier parts of the curve and of earlier cells in its own. There
    are at most 2**20 parts, whose totals reach the driver, with at most 2**CELL cells each. Inside a cell
    the salt, which is even, carries on in proportion.
    """
    cells = checkpointed(with_place(salted).groupBy(F.shiftright("place", SALT + 1).alias("cell")).agg(F.sum("bytes").alias("bytes")))
    part = F.shiftright("cell", CELL).cast("int")
    totals = cells.groupBy(part.alias("part")).agg(F.sum("bytes").alias("ahead")).toPandas().sort_values("part")
    wide = max(range_bytes, -(-int(totals["ahead"].sum()) // MOST_RANGES))
    totals["ahead"] = totals["ahead"].cumsum() - totals["ahead"]
    parts = F.broadcast(salted.sparkSession.createDataFrame(totals.astype({"part": "int32", "ahead": "int64"}), "part int, ahead long"))
    earlier = F.sum("bytes").over(Window.partitionBy("part").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    placed = cells.withColumn("part", part).join(parts, "part").select("cell", "bytes", (F.col("ahead") + F.coalesce(earlier, F.lit(0))).alias("from"))
    up = lambda x: F.call_function("div", x + wide - 1, F.lit(wide))
    first, last = F.greatest(up(F.col("from")), F.lit(1)), up(F.col("from") + F.col("bytes")) - 1
    cuts = placed.where(first <= last).select("cell", "bytes", "from", F.explode(F.sequence(first, last)).alias("k"))
    inside = F.floor((F.col("k") * wide - F.col("from")) / F.col("bytes") * (1 << SALT)).cast("long")
    found = cuts.select((F.shiftleft("cell", SALT + 1) + inside).alias("at")).toPandas()
    return np.sort(found["at"].to_numpy(np.int64))


def pack(df: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, end: int = END, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Pieces of documents with their token ids (little-endian 32-bit integers) and their place in a sequence."""
    salted = df.select("doc_id", "text", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - SALT).alias("salt"))
    bounds = df.sparkSession.sparkContext.broadcast(range_bounds(salted, range_bytes))
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, span, sequence, used = words(vocabulary), None, 0, 0
        for batch in (s for b in batches for s in slices(b, "text", SLICE)):
            rows, (flat, at) = [], encoder.encode_column(batch.column("text"))
            raw, at = flat.astype("<u4").tobytes(), (4 * at).tolist()
            for k, (doc, own) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("span").to_pylist(), strict=True)):
                if own != span:
                    span, sequence, used = own, own << 32, 0
                ids = raw[at[k] : at[k + 1]] + tail
                total, start = len(ids) // 4, 0
                while start < total:
                    if used == length:
                        sequence, used = sequence + 1, 0
                    taken = min(total - start, length - used)
                    rows.append((doc, start, taken, ids[4 * start : 4 * (start + taken)], total, sequence, used))
                    start, used = start + taken, used + taken
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), PIECE_TYPES)], names=PIECE_NAMES)

    dealt = with_place(salted, bounds).repartition("span").sortWithinPartitions("span", "place", "doc_id", "text")
    return dealt.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


PIECE_NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
PIECE_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens; one row for each piece."""
    return pack(documents(spark, sf_dir)).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

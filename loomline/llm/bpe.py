"""Exact byte-level BPE by dynamic programming over prefixes (`prefix_bpe`).

Texts are cut into pieces by the vocabulary's pattern, on arrays of bytes: a piece is a run of
letters, of numbers, of other signs or of white space; one plain space goes to the run after it,
and an apostrophe takes the letters of a contraction. The different pieces of a slice of texts are
encoded once, together, and their ids dealt back to the texts.

Null and empty texts have no tokens. Strings of special tokens inside a text become their ids,
as the tokenizers library does by default. Long texts are encoded whole, in time linear in
their length. Rows that repeat are encoded each; an empty table gives an empty one. Columns of the
input stay; `ids`/`decoded` replace columns of the same name.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, keep_types, slices, text_bytes
from .prefix_bpe import PrefixTables, distinct, gathered

VOCABULARY = "byte_bpe_50k.json"
SLICE = 1 << 21  # bytes of text at a time
SPACE, LETTER, NUMBER, SIGN = range(4)
APOSTROPHE, BLANK = ord("'"), ord(" ")
ENDINGS = {b"s", b"t", b"m", b"d", b"re", b"ve", b"ll"}  # fixed values: what an apostrophe takes


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: itself if it shows, else the next character from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.cache
def character_kinds() -> np.ndarray:
    """The kind of every character, by its number."""
    kinds = np.full(0x110000, SIGN, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    at = lambda k: k if k < 0xD800 else k + 0x800
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            kinds[at(m.start()) : at(m.end() - 1) + 1] = kind
    return kinds


def byte_kinds(data: np.ndarray) -> np.ndarray:
    """The kind of the character to which each byte of UTF-8 text belongs."""
    table = character_kinds()
    out = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        size = 2 + (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0)
        number = data[lead].astype(np.int64) & (0xFF >> (size + 1))
        for k in range(1, 4):
            more = size > k
            number[more] = number[more] << 6 | data[lead[more] + k] & 0x3F
        kind = table[number]
        for k in range(4):
            more = size > k
            out[lead[more] + k] = kind[more]
    return out


def contractions(data: np.ndarray, kinds: np.ndarray, cut: np.ndarray, border: np.ndarray) -> None:
    """Moves the cuts after lone apostrophes that begin a piece: letters of a contraction in the same text join them."""
    for at in np.flatnonzero((data[:-1] == APOSTROPHE) & cut[:-2] & cut[1:-1] & (kinds[1:] == LETTER) & ~border[1:-1]).tolist():
        for size in (1, 2):
            if data[at + 1 : at + 1 + size].tobytes() in ENDINGS and not border[at + 2 : at + 1 + size].any():
                cut[at + 1], cut[at + 1 + size] = False, True
                break


def cut_pieces(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin, and the end; `bounds` are the texts' offsets."""
    kinds = byte_kinds(data)
    cut = np.ones(len(data) + 1, bool)
    cut[1:-1] = kinds[1:] != kinds[:-1]
    border = np.zeros(len(data) + 1, bool)
    border[bounds] = True
    cut |= border
    # White space before something else in the same text: its last character stands alone, or joins what follows.
    ends = np.flatnonzero(cut[1:-1] & ~border[1:-1] & (kinds[:-1] == SPACE)) + 1
    blank = data[ends - 1] == BLANK
    cut[ends[blank]] = False
    cut[ends[blank] - 1] = True
    head = ends[~blank] - 1
    while (inner := (data[head] & 0xC0) == 0x80).any():
        head = head - inner
    cut[head] = True
    contractions(data, kinds, cut, border)
    return np.flatnonzero(cut)


class Bpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, saved: dict):
        alphabet, vocab = byte_alphabet(), saved["model"]["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in saved["added_tokens"]}
        tokens: list[bytes | None] = [None] * (1 + max(*vocab.values(), *self.special.values()))
        for token, k in vocab.items():
            if all(c in alphabet for c in token) and token.encode() not in self.special:
                tokens[k] = bytes(map(alphabet.__getitem__, token))
        merges = [m.split(" ") if isinstance(m, str) else m for m in saved["model"]["merges"]]
        self.tables = PrefixTables(tokens, [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        for token, k in self.special.items():
            tokens[k] = token
        self.token_bytes = pa.array([t or b"" for t in tokens], pa.large_binary())
        self.at_special = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def special_spans(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Places of special tokens' strings; one that would reach over the end of its text is none."""
        found, at, raw = [], 0, data.tobytes()
        while self.at_special and (m := self.at_special.search(raw, at)):
            inside = np.searchsorted(offsets, m.start(), side="right") == np.searchsorted(offsets, m.end() - 1, side="right")
            if inside:
                found.append(m.span())
            at = m.end() if inside else m.start() + 1
        return found

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin (one more at the end)."""
        data, offsets = text_bytes(column)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(column) + 1, np.int64)
        spans = self.special_spans(data, offsets)
        starts = cut_pieces(data, np.concatenate((offsets, np.array(spans, np.int64).ravel())))
        for a, b in spans:
            starts = np.delete(starts, np.arange(*np.searchsorted(starts, (a + 1, b))))
        pieces, ends, which = distinct(data, starts)
        ids, first = self.tables.encode(pieces, ends)
        flat, at = gathered(ids, first, which)
        at = at[np.searchsorted(starts, offsets)]
        if spans:
            flat, at = self.with_special(flat, at, starts, offsets, spans, data, first[which + 1] - first[which])
        return flat, at

    def with_special(self, flat: np.ndarray, at: np.ndarray, starts: np.ndarray, offsets: np.ndarray, spans: list, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts one id in place of the ids of each special token's string."""
        begin = np.concatenate(([0], np.cumsum(sizes)))
        piece = np.searchsorted(starts, [a for a, _ in spans])
        keep = np.ones(len(flat), bool)
        flat = flat.copy()
        for p, (a, b) in zip(piece, spans):
            flat[begin[p]] = self.special[data[a:b].tobytes()]
            keep[begin[p] + 1 : begin[p + 1]] = False
        return flat[keep], np.concatenate(([0], np.cumsum(keep)))[at]

    def decode_column(self, flat: np.ndarray, at: np.ndarray) -> pa.Array:
        """The texts of lists of ids; bytes that are no UTF-8 become U+FFFD."""
        taken = self.token_bytes.take(pa.array(flat))
        _, ends, data = taken.buffers()
        ends = np.ascontiguousarray(np.frombuffer(ends, np.int64)[at]) if len(flat) else np.zeros(len(at), np.int64)
        texts = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(ends), data if data is not None else pa.py_buffer(b"")])
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:
            texts = pa.array([b.as_py().decode("utf-8", errors="replace") for b in texts.cast(pa.large_binary(), safe=False)], pa.large_string())
        return texts.cast(pa.string())


@functools.cache
def codec(vocabulary: str) -> Bpe:
    """One encoder and decoder for each worker process."""
    return Bpe(load(vocabulary))


def load(vocabulary: str) -> dict:
    """The vocabulary file's content. A bare name is looked up among the public vocabulary files."""
    with open(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary), encoding="utf-8") as file:
        return json.load(file)


def replaced(batch: pa.RecordBatch, kept: list[str], **values: pa.Array) -> pa.RecordBatch:
    """The batch's kept columns, then the new ones."""
    return pa.RecordBatch.from_arrays([*map(batch.column, kept), *values.values()], names=[*kept, *values])


def cut_lists(batch: pa.RecordBatch, name: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `limit` list items; a longer list is a piece of its own."""
    total = np.cumsum(batch.column(name).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def encode(df: DataFrame, text: str = "text", ids: str = "ids", decoded: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds the column `ids`, array<int>, and the text that decoding them gives if a name for it is given."""
    kept = [c for c in df.columns if c not in (ids, decoded)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for batch in (s for b in batches for s in slices(b, text, SLICE)):
            flat, at = bpe.encode_column(batch.column(text))
            values = {ids: pa.ListArray.from_arrays(at.astype(np.int32), flat)}
            if decoded:
                values[decoded] = bpe.decode_column(flat, at)
            yield replaced(batch, kept, **values)

    return df.mapInArrow(run, keep_types(df.select(*kept), f"`{ids}` array<int>", *([f"`{decoded}` string"] if decoded else [])))


def decode(df: DataFrame, ids: str = "ids", decoded: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds the column `decoded`, the text of the ids; bytes that are no UTF-8 become U+FFFD. Null ids give an empty text."""
    kept = [c for c in df.columns if c != decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for batch in (s for b in batches for s in cut_lists(b, ids)):
            lists = batch.column(ids)
            at = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            yield replaced(batch, kept, **{decoded: bpe.decode_column(lists.flatten().to_numpy(), at)})

    return df.mapInArrow(run, keep_types(df.select(*kept), f"`{decoded}` string"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip of every whole document through the encoder and the decoder, in one pass."""
    found = encode(documents(spark, sf_dir).select("doc_id", "text"), decoded="decoded")
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

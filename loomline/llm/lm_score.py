"""Language-model scores from a subword lattice.

A text is its words (A-Z lower-cased) and one end. A word is spelt by the pieces of an existing
vocabulary, a mark before its first letter; every way to cut it counts, and a forward recursion in
log space adds their probabilities. The pieces' weights start from the vocabulary's own scores
(1 / (10 - score)) and are fitted once to the training words: a forward-backward pass over all
distinct words gives each piece's expected count. Each word counts once there, as spellings serve
for words that are new or rare.

A word of the training texts is also one arc of its own lattice, weighted by its count c less a
discount d; the mass so set free goes to the spellings, so probabilities of all tokens sum to one:
P(w) = max(c - d, 0) / N + d * V / N * spelling(w). (Over all words the spellings sum to one: a word
goes on until the next piece begins with the mark.) The discount is the leave-one-out estimate
n1 / (n1 + 2 n2) from the numbers of words seen once and twice. Without training texts, P(w) is
the spelling's. The end's share of the spellings is `END_SHARE`.

Counts of words come from all training texts. The `FREQUENT` commonest words (a fixed bound) go to
all tasks; every other word of a text meets its count in a join. Null is the empty text, which is
one end. Long texts are scored whole. Rows that repeat are scored each. An empty table gives no rows. Columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, doc_crc, documents, slices

VOCABULARY = "piece_bpe_32k.model"
FREQUENT, END_SHARE, HELD = 1 << 17, 0.01, 400_000
END = "\n"  # no word has a line feed
MARK = "▁".encode().decode("latin-1")


class Lattice:
    """All spellings of words by the pieces of a vocabulary. Strings are UTF-8 bytes read as Latin-1."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces: dict[str, float] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or "▁" in piece[1:]:
                continue
            pieces[piece.encode().decode("latin-1")] = 1 / (10 - model.get_score(i))
        least = min(pieces.values())
        for b in range(256):
            pieces.setdefault(chr(b), least)
        self.automaton = ahocorasick.Automaton()
        for k, piece in enumerate(pieces):
            self.automaton.add_word(piece, k << 8 | len(piece))
        self.automaton.make_automaton()
        weight = np.array(list(pieces.values()))
        self.start = np.log(weight / weight.sum())

    def arcs(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Piece, start node and end node of every arc, the words' first nodes, and each arc's step (end within its word). A word of n bytes has n + 1 nodes."""
        text = "".join(words)
        packed = np.fromiter((end << 32 | value for end, value in self.automaton.iter(text)), np.int64)
        found = np.stack((packed >> 8 & 0xFFFFFF, packed & 0xFF, packed >> 32), axis=1)
        sizes = np.array([len(w) for w in words], np.int64)
        first = np.concatenate(([0], np.cumsum(sizes)))
        word = np.searchsorted(first, found[:, 2], side="right") - 1
        begin = found[:, 2] + 1 - found[:, 1]
        inside = begin >= first[word]
        found, word, begin = found[inside], word[inside], begin[inside]
        step = found[:, 2] + 1 - first[word]
        return found[:, 0], begin + word, found[:, 2] + 1 + word, first[:-1] + np.arange(len(words)), step

    @staticmethod
    def sweep(total: np.ndarray, source: np.ndarray, target: np.ndarray, weight: np.ndarray, step: np.ndarray) -> None:
        """Adds up, in log space and in order of `step`, what arcs bring to their target nodes."""
        order = np.lexsort((target, step))
        source, target, weight, step = source[order], target[order], weight[order], step[order]
        bounds = np.flatnonzero(np.diff(step, prepend=-1, append=-1))
        for a, b in zip(bounds, bounds[1:]):
            value, node = total[source[a:b]] + weight[a:b], target[a:b]
            heads = np.flatnonzero(np.diff(node, prepend=-1))
            most = np.maximum.reduceat(value, heads)
            share = np.exp(value - np.repeat(most, np.diff(np.append(heads, b - a))))
            total[node[heads]] = most + np.log(np.add.reduceat(share, heads))

    def groups(self, words: list[str], most: int = 200_000) -> Iterator[tuple[int, list[str]]]:
        """Words in groups of bounded size, with each group's first index."""
        begin = size = 0
        for k, w in enumerate(words):
            size += len(w)
            if size > most:
                yield begin, words[begin : k + 1]
                begin, size = k + 1, 0
        if begin < len(words):
            yield begin, words[begin:]

    def marginals(self, words: list[str], weight: np.ndarray) -> np.ndarray:
        """Natural log of the probability of all spellings of each word."""
        out = np.zeros(len(words))
        for begin, group in self.groups(words):
            piece, source, target, first, step = self.arcs(group)
            forward = np.full(len(first) + sum(map(len, group)), -np.inf)
            forward[first] = 0
            self.sweep(forward, source, target, weight[piece], step)
            out[begin : begin + len(group)] = forward[np.append(first[1:], len(forward)) - 1]
        return out

    def expected(self, words: list[str], counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected number of times each piece is used in spelling the words so often."""
        out = np.zeros(len(weight))
        for begin, group in self.groups(words):
            piece, source, target, first, step = self.arcs(group)
            nodes = len(first) + sum(map(len, group))
            last = np.append(first[1:], nodes) - 1
            forward, backward = np.full(nodes, -np.inf), np.full(nodes, -np.inf)
            forward[first] = 0
            backward[last] = 0
            self.sweep(forward, source, target, weight[piece], step)
            word = np.searchsorted(first, source, side="right") - 1
            self.sweep(backward, target, source, weight[piece], last[word] - source)
            share = np.exp(forward[source] + weight[piece] + backward[target] - forward[last][word])
            out += np.bincount(piece, share * counts[begin : begin + len(group)][word], len(out))
        return out


@functools.cache
def lattice(vocabulary: str) -> Lattice:
    return Lattice(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))


def spelt(word: bytes) -> str:
    return MARK + word.decode("latin-1")


def word_counts(training: DataFrame) -> DataFrame:
    """(word, c) of all training texts; the end is a word of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()).cast(pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "c"])
            count.clear()
            return out

        for batch in (s for b in batches for s in slices(b, "text")):
            for text in batch.column("text").to_pylist():
                count.update((text or "").encode().lower().split())
            count[END.encode()] += batch.num_rows
            if len(count) > HELD:
                yield flush()
        if count:
            yield flush()

    return training.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def piece_weights(counts: DataFrame, vocabulary: str) -> np.ndarray:
    """Log weights of the pieces, fitted once to all distinct training words. A task sends at most one row for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = lattice(vocabulary)
        total = np.zeros(len(spelling.start))
        for batch in batches:
            words = [spelt(w) for w in batch.column("word").cast(pa.binary()).to_pylist()]
            total += spelling.expected(words, np.ones(len(words)), spelling.start)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["piece", "n"])

    rows = counts.where(F.col("word") != END).mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    start = lattice(vocabulary).start
    if not rows:
        return start
    n = np.full(len(start), 0.1)
    n[[r.piece for r in rows]] += [r.n for r in rows]
    return np.log(n / n.sum())


def least_count(counts: DataFrame, most: int) -> int:
    """The least count that at most `most` words reach; only a histogram of counts, in steps of an eighth of a power of two, is gathered."""
    step = F.floor(8 * F.log2("c")).alias("step")
    rows = sorted(counts.groupBy(step).agg(F.count(F.lit(1)).alias("words"), F.min("c").alias("least")).collect(), reverse=True)
    total, least = 0, 1 << 62
    for r in rows:
        total += r.words
        if total > most:
            break
        least = r.least
    return least


def discounted(once: int, twice: int) -> float:
    """The discount by leaving each token out in turn, kept off its bounds."""
    return min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)


def score(df: DataFrame, training, vocabulary: str = VOCABULARY, frequent: int = FREQUENT) -> DataFrame:
    """Scores of all texts; `training` is the condition that picks the rows to learn from."""
    spark = df.sparkSession
    counts = checkpointed(word_counts(df.where(training)))
    n, v, once, twice = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).head()
    discount = discounted(once, twice)
    top = counts.where((F.col("word") != END) & (F.col("c") >= least_count(counts, frequent))).toPandas()
    ends = counts.where(F.col("word") == END).select("c").head()
    ends = ends.c if ends else 0
    shared = spark.sparkContext.broadcast((top["word"].str.encode("utf-8").tolist(), top["c"].to_numpy(np.int64), piece_weights(counts, vocabulary)))
    free = discount * v / n if n else 1.0
    divisor = n + 0.1 * (v + 1)
    end_base = float(np.log10((ends + 0.1) / divisor))
    end_score = float(np.log10(max(ends - discount, 0) / max(n, 1) + free * END_SHARE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling, (words, c, weight) = lattice(vocabulary), shared.value
        place = {w: k for k, w in enumerate(words)}
        spell = spelling.marginals([spelt(w) for w in words], weight) / np.log(10) + np.log10(1 - END_SHARE)
        base, own = np.log10((c + 0.1) / divisor), np.log10(np.maximum(c - discount, 0) / max(n, 1) + free * 10**spell)
        for batch in (s for b in batches for s in slices(b, "text")):
            rows: list[tuple] = []
            for row, doc, text in zip(*(batch.column(k).to_pylist() for k in ("row", "doc_id", "text")), strict=True):
                found = (text or "").encode().lower().split()
                at = np.fromiter((place.get(w, -1) for w in found), np.int64, len(found))
                rare = Counter([found[k] for k in np.flatnonzero(at < 0)])
                at = at[at >= 0]
                rows.append((row, doc, f"{END}{row % 1009}".encode(), None, len(found) + 1, len(at) + (ends > 0), float(base[at].sum()) + end_base, float(own[at].sum()) + end_score))
                rows += [(row, None, w, k, None, None, None, None) for w, k in rare.items()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
            columns[2] = columns[2].cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "word", "tf", "n_tokens", "known", "base", "own"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores of the words that met their counts. Rows come sorted by word, so a word is spelt about once."""
        spelling, (_, _, weight) = lattice(vocabulary), shared.value
        for batch in batches:
            columns = {k: batch.column(k) for k in batch.schema.names}
            rare = np.flatnonzero(columns["tf"].is_valid().to_numpy(zero_copy_only=False))
            words = columns["word"].take(pa.array(rare)).cast(pa.binary()).dictionary_encode()
            spell = spelling.marginals([spelt(w) for w in words.dictionary.to_pylist()], weight)[words.indices.to_numpy()] / np.log(10) + np.log10(1 - END_SHARE)
            tf = columns["tf"].take(pa.array(rare)).to_numpy()
            c = columns["c"].take(pa.array(rare)).fill_null(0).to_numpy(zero_copy_only=False)
            own = np.where(c > 0, np.log10(np.maximum(c - discount, 0) / max(n, 1) + free * 10**spell), np.log10(free) + spell)
            for name, value in (("known", np.where(c > 0, tf, 0)), ("base", tf * np.log10((c + 0.1) / divisor)), ("own", tf * own)):
                full = columns[name].fill_null(0).to_numpy(zero_copy_only=False).copy()
                full[rare] = value
                columns[name] = pa.array(full)
            names = ["row", "doc_id", "n_tokens", "known", "base", "own"]
            yield pa.RecordBatch.from_arrays([columns[k] for k in names], names=names)

    texts = df.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = texts.mapInArrow(run, "row long, doc_id long, word string, tf long, n_tokens long, known long, base double, own double")
    met = parts.join(counts, "word", "left").mapInArrow(finish, "row long, doc_id long, n_tokens long, known long, base double, own double")
    return met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), F.sum("base").alias("base_score"), F.sum("own").alias("score")
    ).drop("row")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the nine tenths that are not held out."""
    found = score(documents(spark, sf_dir).select("doc_id", "text"), F.coalesce(doc_crc(), F.lit(1)) % 10 != 0)
    return found.select("doc_id", F.coalesce(doc_crc() % 10 == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

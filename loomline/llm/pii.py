"""Personal data: exact patterns, and a semi-Markov conditional random field that adds to them.

The patterns (`base_spans`) find e-mail addresses, IP addresses, card and telephone numbers. The
field looks at the surroundings of digits, at-signs and at-signs spelt out in brackets. Whole spans of up to `LONGEST` tokens get
a score for each kind from features of the span as a whole (its shape, digits, groups, check digit,
neighbours); all other tokens score zero. A dynamic programme over the tokens picks boundaries and
kinds together, and a forward-backward pass gives a span's probability; spans that overlap no
pattern's are added if it is at least `SURE`. The weights are fitted by gradient ascent on the
likelihood of the patterns' own spans, and of the same data written otherwise (`variants`), so that the
field learns what the patterns pass over. It learns from at most `SAMPLE` documents, those with the least hash of
their id among all that have something to look at, and in each from at most `REGIONS` regions, those with the least hash.

Positions are code points, ends exclusive. Null and empty texts have no spans. All work on a text
is linear in its length, so long texts are read whole. Rows that repeat are read each; an empty table gives an
empty one. Columns of the input stay; `base` and `spans` replace columns so named.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, keep_types, slices

KINDS = ("email", "ip", "card", "phone")
SAMPLE, REGIONS, LONGEST, WIDEST, SURE, EPOCHS, SIZE = 400, 20, 18, 64, 0.8, 4, 1 << 13
AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin at the beginning of a run of digits, so runs are entered once.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9@]")
HINTS = r"[0-9@]|[(\[{<] ?at ?[)\]}>]"
HINT = re.compile(HINTS)
# An at-sign or a dot in brackets is one token.
TOKEN = re.compile(r"[(\[{<] ?(?:at|dot|\.) ?[)\]}>]|[^\W\d_]+|[0-9]+|[\s\S]")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The patterns' spans, by kind and start."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := AFTER_AT.match(text, at)):
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if not DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p := part.lstrip("0")) < 4 and int(p or "0") <= 255 for part in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(map(m[0].count, "0123456789")) <= 15]
    return out


def regions(text: str, margin: int = 24) -> list[tuple[int, int]]:
    """Surroundings of digits and at-signs, cut at white space where there is some near; they do not overlap."""
    out: list[list[int]] = []
    for m in HINT.finditer(text):
        if out and m.start() <= out[-1][1]:
            out[-1][1] = m.end() + margin
        else:
            out.append([m.start() - margin, m.end() + margin])
    found, before = [], 0
    for a, b in out:
        a, b = max(a, before), min(b, len(text))
        found.append((a, b))
        before = b
    return found


def shape(token: str) -> str:
    if len(token) > 2 and not token[0].isalnum():
        return "spelt at" if "at" in token else "spelt dot"
    return f"d{min(len(token), 7)}" if token[0] in "0123456789" else "a" if token[0].isalpha() else "s" if token.isspace() else token


def candidates(text: str, tokens: list[str], starts: list[int]) -> list[tuple[int, int, np.ndarray]]:
    """(first token, token after the last, feature numbers) of each span that may be an entity."""
    shapes, out = [shape(t) for t in tokens], []
    for i, head in enumerate(tokens):
        if not (head.isalnum() or head in "+(") or (i and head.isalnum() and tokens[i - 1].isalnum()):
            continue
        hint, digits, dots, ats, groups = False, "", 0, 0, []
        for j in range(i, min(i + LONGEST, len(tokens))):
            t = tokens[j]
            if t in "\n\r\t" or starts[j] + len(t) - starts[i] > WIDEST:
                break
            if t[0] in "0123456789":
                hint, digits = True, digits + t
                groups.append(t)
            at, dot = t == "@" or shapes[j] == "spelt at", t == "." or shapes[j] == "spelt dot"
            hint, ats, dots = hint or at, ats + at, dots + dot
            if not hint or not t.isalnum() or starts[j] + len(t) - starts[i] < 6:
                continue
            n = len(digits)
            names = [
                "shape " + "".join(shapes[i : j + 1]),
                f"digits {min(n, 20)}",
                f"at {ats} {dots > 0}",
                f"octets {len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups)} {dots}",
                f"groups {' '.join(str(len(g)) for g in groups[:6])}",
                f"check {13 <= n <= 19 and luhn(digits)} {'a' in shapes[i : j + 1]}",
                f"plus {head == '+'} {9 <= n <= 15}",
                f"first {shapes[i]} last {shapes[j]}",
                "left " + (shapes[i - 1] if i else "none"),
                "right " + (shapes[j + 1] if j + 1 < len(tokens) else "none"),
                f"tokens {j + 1 - i}",
                "any",
            ]
            out.append((i, j + 1, np.array([xxhash.xxh32_intdigest(x) % SIZE for x in names], np.uint16)))
    return out


class Field:
    """Weights of features and kinds, and the sums over all segmentations of a region."""

    def __init__(self):
        self.weight = np.zeros((SIZE, len(KINDS)))
        self.weight[xxhash.xxh32_intdigest("any") % SIZE] = -2.0

    def sums(self, n: int, spans: list[tuple[int, int, np.ndarray]], scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward log sums at the gaps between n tokens."""
        ends: dict[int, list[int]] = {}
        heads: dict[int, list[int]] = {}
        for k, (i, j, _) in enumerate(spans):
            ends.setdefault(j, []).append(k)
            heads.setdefault(i, []).append(k)
        whole = np.logaddexp.reduce(scores, axis=1)
        forward, backward = np.zeros(n + 1), np.zeros(n + 1)
        for j in range(1, n + 1):
            forward[j] = forward[j - 1]
            for k in ends.get(j, ()):
                forward[j] = np.logaddexp(forward[j], forward[spans[k][0]] + whole[k])
        for i in range(n - 1, -1, -1):
            backward[i] = backward[i + 1]
            for k in heads.get(i, ()):
                backward[i] = np.logaddexp(backward[i], backward[spans[k][1]] + whole[k])
        return forward, backward

    def scores(self, spans: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
        return np.stack([self.weight[f].sum(axis=0) for _, _, f in spans])

    def posterior(self, n: int, spans: list, scores: np.ndarray) -> np.ndarray:
        forward, backward = self.sums(n, spans, scores)
        begin, end = (np.array([s[k] for s in spans]) for k in (0, 1))
        return np.exp(np.clip(forward[begin][:, None] + scores + backward[end][:, None] - forward[n], -60, 0))

    def learn(self, n: int, spans: list, gold: dict[tuple[int, int], int], rate: float) -> None:
        step = -self.posterior(n, spans, self.scores(spans))
        for k, (i, j, _) in enumerate(spans):
            if (i, j) in gold:
                step[k, gold[i, j]] += 1
        for k in np.flatnonzero(np.abs(step).max(axis=1) > 1e-3):
            np.add.at(self.weight, spans[k][2], rate * step[k])

    def best(self, n: int, spans: list) -> list[tuple[int, int, int, float]]:
        """The best segmentation's spans (first and last gap, kind) with their probabilities."""
        scores = self.scores(spans)
        top, kind = scores.max(axis=1), scores.argmax(axis=1)
        if top.max() <= 0:
            return []
        value, back = np.zeros(n + 1), [-1] * (n + 1)
        order = sorted(range(len(spans)), key=lambda k: spans[k][1])
        at = 0
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            while at < len(order) and spans[order[at]][1] == j:
                k = order[at]
                if value[spans[k][0]] + top[k] > value[j]:
                    value[j], back[j] = value[spans[k][0]] + top[k], k
                at += 1
        chosen, j, p = [], n, self.posterior(n, spans, scores)
        while j > 0:
            k = back[j]
            if k < 0:
                j -= 1
            else:
                chosen.append((spans[k][0], j, int(kind[k]), float(p[k, kind[k]])))
                j = spans[k][0]
        return chosen[::-1]


def region_tokens(text: str, a: int, b: int) -> tuple[list[str], list[int]]:
    found = [(m[0], m.start()) for m in TOKEN.finditer(text, a, b)]
    return [t for t, _ in found], [s for _, s in found]


def variants(kind: str, found: str) -> list[str]:
    """Other ways to write what a pattern found, which the patterns themselves pass over."""
    digits = re.sub("[^0-9]", "", found)
    if kind == "phone" and len(digits) >= 10:
        area, first, last = digits[-10:-7], digits[-7:-4], digits[-4:]
        return [f"({area}) {first}-{last}", f"{area}-{first}-{last}", f"{area}.{first}.{last}", f"{digits[:-10] or 1} ({area}) {first}-{last}"]
    if kind == "card" and len(digits) == 16:
        return [mark.join(digits[k : k + 4] for k in range(0, 16, 4)) for mark in (".", "/", "_", " - ")]
    if kind == "ip":
        return [found.replace(".", mark) for mark in ("[.]", "(dot)", " . ", "-")]
    if kind == "email":
        name, domain = found.split("@")
        return [f"{name}(at){domain}", f"{name} [at] {domain.replace('.', ' [dot] ')}", f"{name} @ {domain}", f"{name}@{domain.replace('.', '(dot)')}"]
    return []


def lessons(texts: list[str], most: int = REGIONS) -> Iterator[tuple[str, int, int, dict[tuple[int, int], int]]]:
    """Regions to learn from with their entities: those of the texts, and the same with entities written otherwise."""
    for text in texts:
        base = base_spans(text)
        for a, b in sorted(regions(text), key=lambda r: xxhash.xxh64_intdigest(text[r[0] : r[1]]))[:most]:
            inside = [(k, s, e) for k, s, e in base if a <= s and e <= b]
            yield text, a, b, {(s, e): KINDS.index(k) for k, s, e in inside}
            if len(inside) == 1:
                kind, s, e = inside[0]
                for other in variants(kind, text[s:e]):
                    yield text[a:s] + other + text[e:b], 0, b - a + len(other) - (e - s), {(s - a, s - a + len(other)): KINDS.index(kind)}


def train(texts: list[str]) -> Field:
    """A field fitted to the patterns' spans in these texts, and to other spellings of them."""
    rows = []
    for text, a, b, entities in lessons(texts):
        tokens, starts = region_tokens(text, a, b)
        spans = candidates(text, tokens, starts)
        if spans:
            ends = [s + len(t) for s, t in zip(starts, tokens)]
            gold = {(i, j): entities[starts[i], ends[j - 1]] for i, j, _ in spans if (starts[i], ends[j - 1]) in entities}
            rows.append((len(tokens), spans, gold))
    field = Field()
    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            field.learn(*rows[k], 0.5 / (1 + epoch))
    return field


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """The field's spans that overlap none of the patterns'."""
    out, taken = [], []
    for s, e in sorted((s, e) for _, s, e in base):
        if taken and s < taken[-1][1]:
            taken[-1] = taken[-1][0], max(taken[-1][1], e)
        else:
            taken.append((s, e))
    ends = [e for _, e in taken]
    for a, b in regions(text):
        tokens, starts = region_tokens(text, a, b)
        spans = candidates(text, tokens, starts)
        if not spans:
            continue
        for i, j, kind, p in field.best(len(tokens), spans):
            start, end = starts[i], starts[j - 1] + len(tokens[j - 1])
            near = bisect_right(ends, start)
            if p >= SURE and not (near < len(taken) and taken[near][0] < end):
                out.append((KINDS[kind], start, end))
    return out


def training_texts(df: DataFrame, sample: int = SAMPLE) -> list[str]:
    """The sample's texts. Only hashes are sorted; the texts of those up to the last one chosen follow in a second pass."""
    hinted = df.where(F.col("text").rlike(HINTS)).select(F.xxhash64("doc_id", "text").alias("h"), "text")
    last = hinted.select("h").orderBy("h").limit(sample).agg(F.max("h")).head()[0]
    if last is None:
        return []
    rows = sorted((r.h, r.text) for r in hinted.where(F.col("h") <= last).dropDuplicates(["h"]).toLocalIterator())
    return [text for _, text in rows[:sample]]


def all_spans(text: str | None, field: Field) -> tuple[list[Span], list[Span]]:
    """The patterns' spans, and those with the field's."""
    if not text or not HINT.search(text):
        return [], []
    base = base_spans(text)
    return base, base + added_spans(text, base, field)


def find(df: DataFrame, field: Field | None = None) -> DataFrame:
    """Adds `base` and `spans`, arrays of kind:start:end ordered by kind and start."""
    field = field or train(training_texts(df))
    kept = [c for c in df.columns if c not in ("base", "spans")]

    def ordered(spans: list[Span]) -> list[str]:
        return [f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "text")):
            found = [all_spans(t, field) for t in batch.column("text").to_pylist()]
            columns = [pa.array([ordered(x) for x in c], pa.list_(pa.string())) for c in zip(*found)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *columns], names=[*kept, "base", "spans"])

    return df.mapInArrow(run, keep_types(df.select(*kept), "base array<string>", "spans array<string>"))


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in square brackets; of overlapping spans the first counts."""
    parts, last = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= last:
            parts += [text[last:start], f"[{kind.upper()}]"]
        last = max(last, end)
    return "".join([*parts, text[last:]])


def redact(df: DataFrame, field: Field | None = None) -> DataFrame:
    """The input with the personal data of its texts masked."""
    field = field or train(training_texts(df))
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "text")):
            texts = [masked(t, spans) if (spans := all_spans(t, field)[1]) else t for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names], names=names)

    return df.mapInArrow(run, df.schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = find(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: F.startswith(s, F.lit(f"{kind}:")))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"))

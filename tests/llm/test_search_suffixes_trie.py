"""Ranked search, suffix deduplication and the prefix trie against plain versions that see everything at once."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from loomline.llm import lexical, prefix_trie, suffix_dedup
from loomline.llm.registry import ORACLE, QUERIES

from ..oracle import spark_rows, sql_rows
from .conftest import ITEM, ITEMS, TURN

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain_scores(docs, items):
    """{item: [(score, doc_id)]}, best first, null ids last among equals."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(set)
    for i, text in items:
        asked[i] |= set(terms(text))
    out = {}
    for i, wanted in asked.items():
        found = []
        for d, c in counts:
            m = 50 + 50 * c.total() * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d, score))
        out[i] = [(s, d) for *_, d, s in sorted(found, key=lambda x: x[:3])]
    return out


def check_ranking(rows, want, k):
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        found[r["item_id"]].append((r["score"], r["doc_id"]))
        assert r["rank"] == len(found[r["item_id"]])
    assert {i: x[:k] for i, x in want.items() if x} == found


def test_search_equals_a_plain_ranking(spark, folder, corpus):
    rows = QUERIES["op11_search"](spark, folder).collect()
    check_ranking(rows, plain_scores([(d, t) for d, t, *_ in corpus], ITEMS), 50)
    assert {r["item_id"] for r in rows} == {1, None, 6}


def test_search_on_odd_tables(spark, odd_folder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{odd_folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{odd_folder}/benchmark.parquet").select("item_id", "text").collect()]
    check_ranking(QUERIES["op11_search"](spark, odd_folder).collect(), plain_scores(docs, items), 50)


def test_search_in_small_segments_and_blocks(spark, monkeypatch):
    """Many documents of few different texts, so that the best are full of ties; segments of a few postings, one item a block."""
    rng = random.Random(11)
    texts = [" ".join(rng.choices("the a of Zebra été gnu emu ox".split(), [9, 9, 9, 2, 2, 1, 1, 1], k=rng.randint(0, 12))) for _ in range(40)]
    docs = [(rng.randint(0, 500) if rng.random() < 0.95 else None, rng.choice(texts)) for _ in range(900)]
    items = [(k, " ".join(rng.sample("the a of zebra été gnu emu ox bee".split(), rng.randint(1, 6)))) for k in range(12)]
    monkeypatch.setattr(lexical, "SEGMENT", 70)
    monkeypatch.setattr(lexical, "ITEM_BYTES", 20)
    found = lexical.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, ITEM), 20)
    check_ranking(found.collect(), plain_scores(docs, items), 20)


@pytest.mark.parametrize("window", [1, 3, 64])
def test_a_segment_finds_what_adding_everything_finds(monkeypatch, window):
    monkeypatch.setattr(lexical, "WINDOW", window)
    rng = np.random.default_rng(window)
    n_terms, n_docs = 30, 400
    rows = [np.flatnonzero(rng.random(n_terms) < 1 / np.arange(1, n_terms + 1) ** 0.7) for _ in range(n_docs)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(n_docs)), "n": pa.array([len(r) + 1 for r in rows]), "terms": pa.array(rows, pa.list_(pa.int32())), "counts": pa.array([rng.integers(1, 5, len(r)) for r in rows], pa.list_(pa.int64()))})
    known = lexical.Statistics(n_docs, sum(map(len, rows)), rng.integers(0, 9000, n_terms))
    segment = lexical.Segment(batch, known)
    for _ in range(40):
        asked = np.sort(rng.choice(n_terms, rng.integers(1, 12), replace=False))
        sums = np.zeros(n_docs, np.int64)
        for t in asked:
            at = slice(segment.at[t], segment.at[t + 1])
            sums[segment.place[at]] += segment.share[at]
        best = lexical.Best(7)
        segment.search(asked, best)
        want = sorted((-s, d) for d, s in enumerate(sums.tolist()) if s)[:7]
        assert [(-s, d) for s, d in zip(best.score.tolist(), best.doc.tolist())] == want


def test_lengths_are_exact_beyond_64_bits():
    known = lexical.Statistics(10**12, 3 * 10**15 + 7, np.zeros(1, np.int64))
    n = np.array([1, 10**9, 7 * 10**8])
    assert known.length(n).tolist() == [50 + 50 * x * 10**12 // (3 * 10**15 + 7) for x in n.tolist()]


def covered(texts):
    """For each text, which bytes a repeated string of 200 bytes covers."""
    seen = Counter(t[p : p + 200] for t in texts for p in range(len(t) - 199))
    out = []
    for t in texts:
        mask = bytearray(len(t))
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                mask[p : p + 200] = b"\1" * 200
        out.append(bytes(mask))
    return out


def strings(rng, alphabet):
    parts = [bytes(rng.choices(alphabet, k=rng.choice([1, 50, 200, 250, 400]))) for _ in range(5)] + [b"a" * 700, b"ab" * 300, b"cba" * 120]
    return [b"".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(8)]


@pytest.mark.parametrize("alphabet", [b"ab", b"abcdefgh", bytes(range(256))])
def test_two_stage_order_and_runs(alphabet):
    rng = random.Random(len(alphabet))
    for _ in range(15):
        texts = [t for t in strings(rng, alphabet) if len(t) >= 200]
        raw = b"".join(texts)
        data, begin = np.frombuffer(raw, np.uint8), np.cumsum([0, *map(len, texts)])[:-1]
        size = np.array([len(t) - 199 for t in texts])
        order = suffix_dedup.suffix_order(data, begin, begin + size)
        heads = [raw[p : p + 200] for p in order]
        assert heads == sorted(heads) and sorted(order.tolist()) == [p for b, n in zip(begin, size) for p in range(b, b + n)]
        shared = suffix_dedup.common_prefixes(data, order)
        assert shared.tolist() == [next((k for k in range(200) if x[k] != y[k]), 200) for x, y in zip(heads, heads[1:])]
        masks = [bytearray(len(t)) for t in texts]
        for piece, a, b in zip(*suffix_dedup.repeated_runs(data, begin, size)):
            masks[piece][a : b + 199] = b"\1" * (b + 199 - a)
        assert [bytes(m) for m in masks] == covered(texts)


def test_pieces_hold_every_window_once_and_equal_windows_share_a_list(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LONGEST", 70)
    rng = random.Random(8)
    for k in suffix_dedup.LEVELS:
        texts = strings(rng, b"abcd")
        data, row = np.frombuffer(b"".join(texts), np.uint8), np.repeat(np.arange(len(texts)), [*map(len, texts)])
        h, _, start, size, again = suffix_dedup.find_pieces(data, row, k)
        raw, lists = data.tobytes(), {}
        places = [p for a, n in zip(start.tolist(), size.tolist()) for p in range(a, a + n)]
        assert size.max() <= 70 and places == [p for p in range(len(raw) - 199) if row[p] == row[p + 199]]
        for a, n, name in zip(start.tolist(), size.tolist(), h.tolist()):
            assert all(lists.setdefault(raw[p : p + 200], name) == name for p in range(a, a + n))
        inner = [len({raw[p : p + 200] for p in range(a, a + n)}) < n for a, n in zip(start.tolist(), size.tolist())]
        assert all(f for f, i in zip(again.tolist(), inner) if i)


def plain_removal(rows):
    texts = [(t or "").encode() for _, t in rows]
    return sorted(
        (-1 if d is None else d, len(t), sum(m), len(m.replace(b"\0", b" ").split()), hashlib.sha256(bytes(x for x, y in zip(t, m) if not y)).hexdigest()) for (d, _), t, m in zip(rows, texts, covered(texts))
    )


def removal(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("limit", [1 << 18, 250])
def test_suffix_dedup_equals_brute_force(spark, tmp_path, monkeypatch, limit):
    """Copies, shared passages in many surroundings, runs of one letter, repeats inside a text, lists split at every level."""
    monkeypatch.setattr(suffix_dedup, "LIST", limit)
    rng = random.Random(12)
    prose = lambda n: "".join(rng.choices("thern aé漢", k=n))
    passage, short = prose(260), prose(60)
    rows = [(k, prose(rng.randint(0, 300)) + passage + prose(rng.randint(0, 300))) for k in range(60)]
    rows += [(100 + k, prose(150) + short + prose(150)) for k in range(20)] + [(200, "x" * 9000), (201, "ab" * 700), (202, prose(500) * 2), (203, "a" * 199), (204, "a" * 200)]
    rows += rows[:5] + [(300 + k, rows[k][1]) for k in range(5)] + [(None, rows[7][1]), (None, None), (400, None), (401, ""), (None, "y" * 300), (7, prose(400))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    assert removal(QUERIES["op12_suffix_dedup"](spark, str(tmp_path))) == plain_removal(rows)


def test_suffix_dedup_keeps_columns_and_gives_spans(spark):
    rng = random.Random(2)
    text = "".join(rng.choices("abcdef ", k=250))
    rows = [(1, "é" * 5 + text + "q" * 30, "x"), (2, text + "w" * 40, "y"), (3, "short", "z")]
    found = suffix_dedup.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string, id string")).orderBy("doc_id").collect()
    assert [(r.id, bytes(r.kept).decode(), [tuple(s) for s in r.spans]) for r in found] == [("x", "é" * 5 + "q" * 30, [(10, 260)]), ("y", "w" * 40, [(0, 250)]), ("z", "short", [])]


def plain_trie(turns):
    own = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            own[c].append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(found, key=lambda x: x[0])] for c, found in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = own.get(c - int(math.fmod(c, 5)), [])
        paths[c] = tuple(base[:h] + own[c][h:])
    members = defaultdict(list)
    for c, path in sorted(paths.items()):
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    below = defaultdict(lambda: [0, 0])
    for p, found in members.items():
        value = (len(found) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            below[p[:d]][0] += not children[p]
            below[p[:d]][1] += value
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in members[p] if paths[c] == p).encode()).hexdigest()
    return sorted(str((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], *below[p], ends(p))) for p, m in members.items())


@pytest.mark.parametrize("cells", [1, 12, 40, 1 << 19])
def test_trie_equals_a_plain_one(spark, tmp_path, monkeypatch, cells):
    """Equal, nested, empty and very long conversations; blocks of single rows to one for everything."""
    monkeypatch.setattr(prefix_trie, "CELLS", cells)
    rng = random.Random(cells)
    turns = []
    for c in [*range(70), -3, -7, 1000, 1001, 1003]:
        same = rng.random() < 0.4
        turns += [(c, None if k == 0 and c % 7 == 0 else k, ["user", "assistant", None][k % 3], f"é{0 if same else rng.randint(0, 2)}" if k % 4 else None) for k in range(rng.choice([0, 1, 3, 6, 9, 14]) if c != 33 else 60)]
    turns.append((None, 1, "user", "lost"))
    spark.createDataFrame(turns, TURN).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    found = QUERIES["op13_prefix_trie"](spark, str(tmp_path))
    assert sorted(str(tuple(r)) for r in found.collect()) == plain_trie(turns)


def test_trie_on_odd_tables(spark, odd_folder):
    """Rows that repeat are turns of their own; a null number comes first; turns of one number are in a fixed order."""
    rows = QUERIES["op13_prefix_trie"](spark, odd_folder).collect()
    root = [r for r in rows if r.depth == 0]
    turns = spark.read.parquet(f"{odd_folder}/conversations.parquet").where("conv_id IS NOT NULL")
    assert len(root) == 1 and root[0].conv_id == -4 and root[0].parent_conv_id is None and root[0].n_convs == turns.select("conv_id").distinct().count()
    assert sum(r.n_children for r in rows) == len(rows) - 1 and root[0].n_leaves == sum(r.n_children == 0 for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, QUERIES["op13_prefix_trie"](spark, odd_folder).collect()))


@pytest.mark.parametrize("name", ["op11_search", "op12_suffix_dedup", "op13_prefix_trie"])
def test_queries_equal_their_sql(spark, name):
    from ..oracle import SF, database

    assert spark_rows(QUERIES[name](spark, SF)) == sql_rows(database(), ORACLE[name])

"""Candidates of the near-copy stage come from SimHash fingerprints: bits, postings of two bytes, counted bytes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import lists, near_copies
from loomline.llm.common import BASE, mix
from loomline.llm.components import connected_components


def plain_simhash(terms):
    """The sign of the sum of all weights, bit by bit."""
    out, steps = [], mix(np.arange(1, near_copies.BYTES // 4 + 1, dtype=np.uint64) * np.uint64(BASE))
    for step in steps:
        draws = [int(d) for d in mix(np.array(terms, np.uint64) ^ step)]
        for two in range(0, 8, 2):
            for lane in range(0, 64, 8):
                out.append(sum(2 * (d >> two + lane & 3) - 3 for d in draws) > 0)
    return np.packbits(out).tobytes()


def of_sets(found):
    first = np.concatenate(([0], np.cumsum([len(s) for s in found])))
    return near_copies.simhashes(np.array([t for s in found for t in sorted(s)], np.uint64), first)


def pairs_at(both, one, other, n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        fresh = lambda k: {rng.getrandbits(64) for _ in range(k)}
        common = fresh(both)
        yield common | fresh(one)
        yield common | fresh(other)


def test_fingerprints_equal_a_plain_simhash():
    """Sets on both sides of the blocks of terms, and without terms."""
    rng = random.Random(3)
    found = [{rng.getrandbits(64) for _ in range(n)} for n in (1, 0, 4, 85, 86, 171, 0)]
    prints = of_sets(found)
    assert prints.shape == (7, near_copies.BYTES)
    for s, got in zip(found, prints):
        assert got.tobytes() == (plain_simhash(sorted(s)) if s else bytes(near_copies.BYTES))


@pytest.mark.parametrize("both, one, other, share", [(4, 0, 1, 0.1641), (40, 5, 5, 0.1515), (80, 0, 20, 0.1476), (400, 50, 50, 0.1515)])
def test_pairs_at_four_fifths_are_candidates(both, one, other, share):
    """They differ in the calculated share of bits, meet in a posting, and pass both counts."""
    prints = of_sets(list(pairs_at(both, one, other, 500, both)))
    a, b = prints[::2], prints[1::2]
    assert abs(np.bitwise_count(a ^ b).mean() / 8 - share) < 0.004
    posting = near_copies.posting_ids(prints)
    assert (posting[::2] == posting[1::2]).any(axis=1).all()
    assert np.bitwise_count(a[:, :16] ^ b[:, :16]).sum(axis=1).max() <= near_copies.BITS
    assert (a == b).sum(axis=1).min() >= near_copies.SHARED


@pytest.mark.parametrize("most", [1024, 4])
def test_candidates_equal_plain_ones(spark, most):
    """Components of fingerprints that share two bytes at one place and differ in few bits; lists searched at once, also cut ones."""
    found = [s for k, (both, each) in enumerate([(40, 1), (40, 5), (40, 15), (40, 40)]) for s in pairs_at(both, each, each, 20, k)]
    found += [found[0] | {k} for k in range(1, 12)]
    prints = of_sets(found)
    distinct = spark.createDataFrame([(k, bytearray(p.tobytes())) for k, p in enumerate(prints)], "key long, prints binary").coalesce(2)
    counted = {r.posting: r.w for r in near_copies.crowded(distinct).collect()}
    posting = near_copies.posting_ids(prints)
    every = dict(zip(*(x.tolist() for x in np.unique(posting, return_counts=True))))
    assert all(every[k] - 2 < n <= every[k] for k, n in counted.items()) and max(counted.values()) > 4
    links = lists.linked(near_copies.posted(distinct), "posting", near_copies.by_bits, F.lit(1), most, near_copies.crowded(distinct), at_once=True)
    roots = {r.node: r.root for r in connected_components(links).collect()}
    root = list(range(len(found)))
    for a in range(len(found)):
        for b in range(a):
            few = np.bitwise_count(prints[a, :16] ^ prints[b, :16]).sum() <= near_copies.BITS
            if few and (posting[a] == posting[b]).any():
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    assert {k: roots.get(k, k) for k in range(len(found))} == dict(enumerate(root)) and len(set(root)) > 20


@pytest.mark.parametrize("most", [1 << 20, 50])
def test_forests_connect_what_links_connect(spark, monkeypatch, most):
    """Many hubs over the same nodes leave one link a node and task, or more if a task starts anew."""
    monkeypatch.setattr(lists, "LINKS", most)
    rows = [(hub, node) for hub in range(-40, 0) for node in range(60)] + [(1000 + k, 1001 + k) for k in range(9)] + [(5000, 5000)]
    links = spark.createDataFrame(rows, "a long, b long").coalesce(1)
    thin = lists.forest(links)
    if most > len(rows):
        assert thin.count() == 99 + 9
    assert sorted(map(tuple, connected_components(thin).collect())) == sorted(map(tuple, connected_components(links).collect()))

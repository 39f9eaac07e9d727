"""Chains of active rows and trailing repeats of blocks, against plain loops."""

import random

from pyspark.sql import functions as F

from loomline.operators import windows


def test_chains_are_cut_by_holes_and_by_events_between(spark):
    rng, rows, want = random.Random(51), [], {}
    for s in range(40):
        flags = [(rng.random() < 0.5, rng.random() < 0.1, rng.random() < 0.15) for _ in range(rng.randrange(25))]
        rows += [(s, k, *f) for k, f in enumerate(flags)]
        chains, last = [], None
        for k, (active, *_) in enumerate(flags):
            if active:
                if last is None or any(h for _, h, _ in flags[last : k + 1]) or any(e for _, _, e in flags[last + 1 : k]):
                    chains.append([])
                chains[-1].append(k)
                last = k
        want[s] = chains
    df = spark.createDataFrame([*rows, (99, 0, True, None, None), (99, 1, None, True, True), (99, 2, True, None, None)], "s long, k long, a boolean, h boolean, e boolean")
    found = windows.active_chains(df, "s", "k", F.col("a"), F.col("h"), F.col("e")).collect()
    want[99] = [[0], [2]]
    for s, chains in want.items():
        assert sorted((r.chain, r.k) for r in found if r.s == s) == [(c, k) for c, chain in enumerate(chains) for k in chain]


def test_a_hole_and_an_event_each_cut(spark):
    rows = [(1, 0, "a"), (1, 1, "h"), (1, 2, "a"), (1, 3, "e"), (1, 4, "a"), (1, 5, "x"), (1, 6, "a")]
    c = F.col("c")
    found = windows.active_chains(spark.createDataFrame(rows, "s long, k long, c string"), "s", "k", c == "a", c == "h", c == "e").collect()
    assert {r.k: r.chain for r in found} == {0: 0, 2: 1, 4: 2, 6: 2}


def test_trailing_blocks(spark):
    series = {
        "repeats": [["x", "y"], ["x"], ["x"], ["x"]],
        "other order": [["x", "y"], ["y", "x"]],
        "other length": [["x"], ["x", "x"]],
        "inner": [["x"], ["x"], ["y"]],
        "one": [["x"]],
        "all": [["x", None], ["x", None], ["x", None]],
        "null is no text": [["x", None], ["x", ""]],
    }
    left = {"repeats": 2, "other order": 2, "other length": 2, "inner": 3, "one": 1, "all": 1, "null is no text": 2}
    rows, want = [], set()
    for s, blocks in series.items():
        n = 0
        for b, block in enumerate(blocks):
            for k, v in enumerate(block):
                rows.append((s, n, k == 0, v))
                if b < left[s]:
                    want.add((s, n))
                n += 1
    df = spark.createDataFrame([*rows, (None, 0, True, "a"), (None, 1, True, "a")], "s string, k long, head boolean, v string")
    found = {(r.s, r.k) for r in windows.without_trailing_repeats(df, "s", "k", F.col("head"), ["v"]).collect()}
    assert found == want | {(None, 0)}

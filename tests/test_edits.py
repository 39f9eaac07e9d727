"""Edit distances of symbols against the table of distances, and rates with failures apart."""

import random
import time

import pytest
from pyspark.sql import functions as F

from loomline.operators.edits import edit_rates, symbol_distance, with_edits


def table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[-1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_distance_equals_the_table():
    rng = random.Random(31)
    for _ in range(1500):
        symbols = rng.choice([["a", "b"], ["note", "rest", "bar", None], list(range(200))])
        a = rng.choices(symbols, k=rng.randrange(0, 90))
        b = rng.choices(symbols, k=rng.randrange(0, 90)) if rng.random() < 0.5 else [x for x in a if rng.random() < 0.9]
        assert symbol_distance(a, b) == table_distance(a, b)


def test_long_sequences():
    rng = random.Random(32)
    a = rng.choices(range(500), k=20_000)
    b = [x if rng.random() > 0.01 else -1 for x in a]
    began = time.time()
    assert symbol_distance(a, b) == sum(x != y for x, y in zip(a, b))
    assert time.time() - began < 20


def test_failures_stay_apart(spark):
    rows = [("p", ["x", "y"], ["x", "z"], None), ("p", ["x"], None, None), ("p", ["a", "b"], ["a", "b"], "success"), ("p", ["a"], ["b"], "timeout"), ("q", None, ["a"], None), ("r", [], [], None)]
    scored = with_edits(spark.createDataFrame(rows, "k string, a array<string>, b array<string>, before string"), "a", "b", F.col("before"))
    assert sorted(map(str, (tuple(r) for r in scored.select("k", "status", "edits", "total_symbols", "rate").collect()))) == sorted(
        map(str, [("p", "success", 1, 4, 0.25), ("p", "missing", None, None, None), ("p", "success", 0, 4, 0.0), ("p", "timeout", None, None, None), ("q", "missing", None, None, None), ("r", "success", 0, 0, 0.0)])
    )
    rates = {r.k: r for r in edit_rates(scored, "k").collect()}
    assert (rates["p"].n_total, rates["p"].n_success, rates["p"].n_missing, rates["p"].n_failed) == (4, 2, 1, 1)
    assert rates["p"].macro_rate == pytest.approx(0.125) and rates["p"].corpus_rate == pytest.approx(0.125)
    assert rates["q"].macro_rate is None and rates["q"].corpus_rate is None and rates["r"].corpus_rate == 0

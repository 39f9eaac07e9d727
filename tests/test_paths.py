"""Best state sequences over blocks of rows against the recurrence read off row by row."""

import itertools
import math
import random

import numpy as np
import pytest

from loomline.operators import paths, stretches
from loomline.plans.base import kept

NAMES = ["x", "y", "z"]


@pytest.fixture
def uncoalesced(spark):
    """Small ranges stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def sequential(gains, penalty):
    """Staying wins ties, the first state leads among equals; sums of halves and quarters are exact."""
    total, back = list(gains[0]), []
    for row in gains[1:]:
        leader = max(range(len(total)), key=lambda s: (total[s], -s))
        enters = [total[leader] - penalty > t for t in total]
        back.append([leader if e else s for s, e in enumerate(enters)])
        total = [max(t, total[leader] - penalty) + g for t, g in zip(total, row)]
    state = max(range(len(total)), key=lambda s: (total[s], -s))
    out = [state]
    for step in reversed(back):
        state = step[state]
        out.append(state)
    return out[::-1]


def found(spark, series, penalty, partitions=None):
    rows = [(s, k, *g) for s, gains in series.items() for k, g in enumerate(gains)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "s string, k long, x double, y double, z double")
    out = {s: {} for s in series}
    for r in paths.steady_states(df, "s", "k", NAMES, penalty, kept).collect():
        assert r.k not in out[r.s]
        out[r.s][r.k] = NAMES.index(r.state)
    return {s: [p[k] for k in range(len(p))] for s, p in out.items()}


@pytest.mark.parametrize("penalty", [0.0, 0.5, 1.75, math.inf])
@pytest.mark.parametrize("rows", [1, 3, 16])
def test_equal_to_the_sequential_path(spark, monkeypatch, penalty, rows):
    """Many ties; short series and long ones over many blocks, and blocks over many ranges."""
    monkeypatch.setattr(stretches, "ROWS", rows)
    rng = random.Random(rows)
    series = {f"s{n}": [[rng.choice([0.0, 0.0, 0.25, 0.5, 1.0, -2.0]) for _ in NAMES] for _ in range(n)] for n in (1, 2, 5, 17, 90, 400)}
    series["flat"] = [[0.0] * 3] * 50
    assert found(spark, series, penalty) == {s: sequential(g, penalty) for s, g in series.items()}


def test_one_series_in_many_tasks(spark, uncoalesced):
    rng = np.random.default_rng(4)
    gains = (np.rint(rng.normal(0, 1, (20_000, 3)) * 4) / 4 + np.eye(3)[np.arange(20_000) // 700 % 3]).tolist()
    assert found(spark, {"one": gains}, 2.5) == {"one": sequential(gains, 2.5)}
    df = spark.createDataFrame([("one", k, *g) for k, g in enumerate(gains)], "s string, k long, x double, y double, z double")
    blocks = stretches.in_blocks(df, "s", ["k"]).collect()
    assert len({r.block >> 32 for r in blocks}) > 1 and max(len(r.k) for r in blocks) <= stretches.ROWS and len(blocks) < 120


def test_best_of_all_sequences(spark):
    rng = random.Random(6)
    series = {f"s{n}": [[rng.random() for _ in NAMES] for _ in range(6)] for n in range(5)}
    score = lambda g, p: sum(row[s] for row, s in zip(g, p)) - 0.5 * sum(a != b for a, b in zip(p, p[1:]))
    for s, path in found(spark, series, 0.5).items():
        assert score(series[s], path) == pytest.approx(max(score(series[s], p) for p in itertools.product(range(3), repeat=6)))


def test_missing_and_infinite_scores_and_series(spark):
    rows = [("a", 0, None, 0.0, 1.0), ("a", 1, -math.inf, 3.0, math.nan), ("a", 2, math.inf, 0.0, 0.0), (None, 0, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "s string, k long, x double, y double, z double")
    assert sorted(map(tuple, paths.steady_states(df, "s", "k", NAMES, 0.5, kept).collect())) == [("a", 0, "z"), ("a", 1, "y"), ("a", 2, "x")]
    assert paths.steady_states(df.where("s = 'none'"), "s", "k", NAMES, 0.5, kept).collect() == []

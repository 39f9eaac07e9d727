"""Rules that look back at the row kept last, against plain loops."""

import random

import numpy as np
import pytest

from loomline.operators import reach, stretches, windows
from loomline.plans.base import kept


@pytest.fixture(params=[1, 4, 256])
def rows_in_a_block(request, monkeypatch, spark):
    """Blocks of different sizes, and small ranges that stay apart."""
    monkeypatch.setattr(stretches, "ROWS", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("by_sum", [False, True])
def test_functions_compose_as_the_loop_goes_on(by_sum):
    """Steps of a tenth, so that sums and differences round."""
    rng = random.Random(3)
    for _ in range(60):
        x = np.array(sorted(rng.randrange(60) * 0.1 for _ in range(rng.randrange(2, 30))))
        rule = reach.Rule(rng.choice([0.3, 0.7, 1.2]), by_sum)
        cut = sorted(rng.sample(range(1, len(x)), min(3, len(x) - 1)))
        whole = None
        for part in np.split(x, cut):
            whole = rule.function(part) if whole is None else rule.both(whole, rule.function(part))
        for start in [-np.inf, float(x[0]), float(x[0]) - 0.2]:
            last = start
            for v in x:
                if v >= last + rule.gap if by_sum else v - last >= rule.gap:
                    last = v
            assert rule.after(np.array([start]), whole).tolist() == [last]


def test_thinning_equals_a_plain_loop(spark, rows_in_a_block):
    rng, rows, want = random.Random(22), [], set()
    for s in range(6):
        values = sorted(rng.choice([rng.uniform(0, 50), float(rng.randrange(50))]) for _ in range(rng.randrange(60) if s else 900))
        last = None
        for x in values:
            if last is None or x - last >= 2.5:
                want.add((s, x))
                last = x
        rows += [(s, x) for x in values]
    got = reach.thin(spark.createDataFrame([*rows, (None, 1.0), (1, None)], "s long, x double"), "s", "x", 2.5, kept).collect()
    assert {(r.s, r.x) for r in got} == want and len(got) == len(want)


def plain_chunks(rows, size, stride, fps, length, annotated):
    out, start = [], 0
    while start < len(rows):
        frame = int(rows[start][0] * fps)
        last = start
        while last + 1 < len(rows) and rows[last + 1][1] <= (frame + size) / fps:
            last += 1
        out.append((start, last, frame, min(int(rows[last][1] * fps), length)))
        later = [k for k in range(start + 1, len(rows)) if rows[k][0] >= rows[start][0] + stride]
        if not later and (annotated or last == len(rows) - 1):
            break
        start = later[0] if later else last + 1
    return out


def test_chunks_equal_a_plain_loop(spark, rows_in_a_block):
    """Over several Arrow batches too, so that chunks are decided before a series ends."""
    rng, rows, want = random.Random(23), [], {}
    for s in range(12):
        t, own = 0.0, []
        for _ in range(rng.randrange(1, 80) if s else 700):
            step = rng.choice([0.3, 1.0, 2.5, 9.0])
            own.append((t, t + step))
            t += step
        length, annotated = int(t * 10) - rng.randrange(5), s % 2 == 0
        want[s] = plain_chunks(own, 60, 3.0, 10.0, length, annotated)
        rows += [(s, k, a, b, length, annotated) for k, (a, b) in enumerate(own)]
    df = spark.createDataFrame(rows, "s long, k long, a double, b double, len long, ann boolean")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = reach.budget_chunks(df, "s", "k", "a", "b", 60, 3.0, 10.0, kept, "len", "ann").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    passed = windows.budget_pass(df, "s", "k", "a", "b", 60, 3.0, 10.0, "len", "ann").collect()
    assert sorted(map(tuple, passed)) == sorted(map(tuple, found))
    assert {s: sorted((r.first, r.last, r.start_frame, r.end_frame) for r in found if r.s == s) for s in want} == want



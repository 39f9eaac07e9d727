"""Exact fractions against the standard library's."""

import math
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from loomline.functions import fractions as fr

BIG = 1 << 62


def pairs(rng, n):
    number = lambda: rng.choice([rng.randint(-9, 9), rng.randint(-BIG, BIG), rng.choice([1, -1]) * 2 ** rng.randint(0, 60)])
    return [(k, number(), rng.choice([number(), 0]) or 1, number(), number() or 1) for k in range(n)]


def exact(f):
    return (f.numerator, f.denominator) if -(1 << 63) <= f.numerator < 1 << 63 and f.denominator < 1 << 63 else None


def test_arithmetic(spark):
    rows = pairs(random.Random(71), 500)
    df = spark.createDataFrame(rows, "k long, a long, b long, c long, d long")
    x, y = fr.fraction(F.col("a"), F.col("b")), fr.fraction(F.col("c"), F.col("d"))
    found = df.select("k", x.alias("x"), y.alias("y")).select("k", "x", fr.plus(F.col("x"), F.col("y")).alias("sum"), fr.times(F.col("x"), F.col("y")).alias("product"), fr.less(F.col("x"), F.col("y")).alias("less"))
    lost = 0
    for r in found.collect():
        _, a, b, c, d = rows[r.k]
        one, two = Fraction(a, b), Fraction(c, d)
        assert tuple(r.x) == (one.numerator, one.denominator) and r.less == (one < two)
        for got, want in ((r["sum"], exact(one + two)), (r.product, exact(one * two))):
            if got is None:
                lost += 1  # a part of the way may be beyond 64 bits where the result isn't
                assert abs(a) > 1 << 20 or abs(b) > 1 << 20 or abs(c) > 1 << 20 or abs(d) > 1 << 20
            else:
                assert tuple(got) == want
    assert 0 < lost < 700


def test_sums_nulls_and_errors(spark):
    one = spark.range(1).select(F.array(*(fr.fraction(1, n) for n in range(1, 12))).alias("f"), fr.fraction(1, 0).alias("none"), fr.fraction(BIG, 1).alias("big"))
    r = one.select(fr.total(F.col("f")).alias("sum"), "none", fr.plus(F.col("none"), F.col("big")).alias("null"), fr.plus(F.col("big"), F.col("big")).alias("over")).head()
    assert tuple(r["sum"]) == (lambda f: (f.numerator, f.denominator))(sum(Fraction(1, n) for n in range(1, 12)))
    assert r.none is None and r.null is None and r.over is None
    with pytest.raises(Exception, match="beyond 64 bits"):
        one.select(fr.checked(fr.plus(F.col("big"), F.col("big")), F.col("big"))).collect()
    assert one.select(fr.checked(fr.plus(F.col("none"), F.col("big")), F.col("none")).alias("x")).head().x is None


def plain_duration(token):
    if not token or token == "." or token[0] in "!*=":
        return None
    if "q" in token.lower():
        return Fraction(0)
    word = token.split(" ")[0]
    m = re.search(r"(\d+)(?:%(\d+))?", word)
    if not m:
        return None
    length = Fraction(8) if int(m[1]) == 0 else Fraction(4 * int(m[2] or 1), int(m[1]))
    dots = word.count(".")
    return length * (2 - Fraction(1, 2**dots)) if dots else length


def test_note_durations(spark):
    rng = random.Random(72)
    tokens = ["", ".", "!4", "*M4/4", "=12", "q8", "8Q", "4", "8.", "16..", "3%2", "0", "0.", "[12a", "(4A.", "6%5. 8", "r", "4%3...", ")4d", "00"]
    tokens += ["".join(rng.choices("0123468%.[(aq ", k=rng.randint(1, 6))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(tokens)), "k long, t string")
    for r in df.select("k", fr.note_duration(F.col("t")).alias("d")).collect():
        want = plain_duration(tokens[r.k])
        assert (None if r.d is None else Fraction(r.d.num, r.d.den)) == want, tokens[r.k]


def test_steps_of_the_divisor(spark):
    """Neighbours in Fibonacci's sequence take the most steps; all pairs end within those that their digits allow, and small ones don't take 92."""
    fib = [0, 1]
    while fib[-1] < 1 << 62:
        fib.append(fib[-1] + fib[-2])
    fib = [f for f in fib if f < 1 << 63]
    cases = [(a, b) for a, b in zip(fib, fib[1:])] + [(b, a) for a, b in zip(fib, fib[1:])] + [(a, b) for a in range(-13, 14) for b in range(13)] + [((1 << 63) - 1, 9), (9 * 10**17, 6**23)]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(cases)], "k long, a long, b long")
    divisor = fr.gcd(F.col("a"), F.col("b"))
    assert [r.g for r in df.select("k", divisor.alias("g")).orderBy("k").collect()] == [math.gcd(a, b) for a, b in cases]
    assert "sequence(1, 92" not in df.select(divisor)._jdf.queryExecution().analyzed().toString()


def test_durations_of_one_file_in_many_tasks(spark, tmp_path):
    from loomline.queries import QUERIES

    spark.range(50).selectExpr("id AS p_partkey", "cast(id % 50 AS int) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["prj10_durations"](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and found.count() == 50

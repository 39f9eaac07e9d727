"""Exact fractions as columns: a struct of num and den, both long, reduced, with den above 0. A result beyond 64 bits is null, or an error by `checked`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST = -(1 << 63)


def gcd(a: Column, b: Column) -> Column:
    """The greatest common divisor of two numbers, not negative. Euclid's way takes at most five steps a decimal digit of the lesser number (Lamé), and one that swaps them."""
    step = lambda s: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b")))
    steps = lambda p: F.sequence(F.lit(1), 5 * F.length(F.least(p["a"], p["b"]).cast("string")) + 1)
    whole_way = lambda p: F.aggregate(steps(p), p, lambda s, _: step(s), lambda s: s["a"])
    simple = lambda p: F.when((p["a"] == 1) | (p["b"] == 1), F.lit(1).cast("long")).when(p["b"] == 0, p["a"]).when(p["a"] % F.nullif(p["b"], F.lit(0).cast("long")) == 0, p["b"])
    pair = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    return let(pair, lambda p: F.coalesce(simple(p), whole_way(p)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fraction(num: Column | int, den: Column | int) -> Column:
    """num / den in lowest terms; null if the denominator is 0, or if either is null or the one long whose opposite isn't one."""
    num, den = (F.nullif(x.cast("long") if isinstance(x, Column) else F.lit(x).cast("long"), F.lit(LEAST).cast("long")) for x in (num, den))
    there = lambda v: v["num"].isNotNull() & v["den"].isNotNull() & (v["den"] != 0)
    reduced = lambda v: let(gcd(v["num"], v["den"]) * F.when(v["den"] < 0, -1).otherwise(1), lambda by: F.struct(whole(v["num"], by).alias("num"), whole(v["den"], by).alias("den")))
    return let(F.struct(num.alias("num"), den.alias("den")), lambda v: F.when(there(v), reduced(v)))


def both(x: Column, y: Column, body: Callable[[Column, Column], Column]) -> Column:
    return let(F.struct(x.alias("x"), y.alias("y")), lambda p: body(p["x"], p["y"]))


def plus(x: Column, y: Column) -> Column:
    """The sum; null where a product or sum leaves 64 bits."""

    def add(x: Column, y: Column) -> Column:
        over = lambda by: let(whole(y["den"], by), lambda up: fraction(F.try_add(F.try_multiply(x["num"], up), F.try_multiply(y["num"], whole(x["den"], by))), F.try_multiply(x["den"], up)))
        return let(gcd(x["den"], y["den"]), over)

    return both(x, y, add)


def times(x: Column, y: Column) -> Column:
    """The product, reduced crosswise first, after which it is in lowest terms."""

    def multiply(x: Column, y: Column) -> Column:
        by = F.struct(F.greatest(gcd(x["num"], y["den"]), F.lit(1).cast("long")).alias("one"), F.greatest(gcd(y["num"], x["den"]), F.lit(1).cast("long")).alias("other"))
        product = lambda g: F.struct(F.try_multiply(whole(x["num"], g["one"]), whole(y["num"], g["other"])).alias("num"), F.try_multiply(whole(x["den"], g["other"]), whole(y["den"], g["one"])).alias("den"))
        return let(let(by, product), lambda p: F.when(p["num"].isNotNull() & p["den"].isNotNull() & (p["num"] != LEAST), p))

    return both(x, y, multiply)


def whole(a: Column, b: Column) -> Column:
    """A quotient without rest, of whole numbers."""
    return F.call_function("div", a, b)


def less(x: Column, y: Column) -> Column:
    """Whether x < y, exactly: 128-bit products are compared."""
    wide = lambda a, b: a.cast("decimal(19,0)") * b.cast("decimal(19,0)")
    return wide(x["num"], y["den"]) < wide(y["num"], x["den"])


def total(fractions: Column) -> Column:
    """The sum of an array of fractions; null where it or an element can't be had."""
    return F.aggregate(fractions, F.struct(F.lit(0).cast("long").alias("num"), F.lit(1).cast("long").alias("den")), plus)


def checked(result: Column, *inputs: Column) -> Column:
    """The result, or an error where all inputs are there and it isn't."""
    given = F.lit(True)
    for x in inputs:
        given = given & x.isNotNull()
    return F.coalesce(result, F.when(given, F.raise_error(F.lit("a fraction is beyond 64 bits"))))


def as_double(x: Column) -> Column:
    return x["num"] / x["den"]


def note_duration(token: Column) -> Column:
    """The length of a note token in quarters: `8`, `3%2` and `16..` (each dot adds half of what was added before); 0 stands for a breve, `q` for no length.

    Null for tokens that have no length: empty, `.`, comments, interpretations, bar lines and tokens without a number.
    """
    none = (token == "") | (token == ".") | token.rlike("^[!*=]")
    word = F.substring_index(token, " ", 1)
    top = F.nullif(F.regexp_extract(word, r"(\d+)(?:%(\d+))?", 1), F.lit("")).try_cast("long")
    bottom = F.coalesce(F.nullif(F.regexp_extract(word, r"(\d+)(?:%(\d+))?", 2), F.lit("")).try_cast("long"), F.lit(1).cast("long"))
    plain = let(F.struct(top.alias("top"), bottom.alias("bottom")), lambda v: F.when(v["top"] == 0, F.struct(F.lit(8).cast("long").alias("num"), F.lit(1).cast("long").alias("den"))).otherwise(fraction(F.try_multiply(F.lit(4).cast("long"), v["bottom"]), v["top"])))
    dots = F.length(word) - F.length(F.replace(word, F.lit("."), F.lit("")))
    power = F.call_function("shiftleft", F.lit(1).cast("long"), F.least(dots, F.lit(61)).cast("int"))
    dotted = times(plain, let(power, lambda p: F.struct((2 * p - 1).alias("num"), p.alias("den"))))
    return F.when(none, None).when(F.lower(token).contains("q"), F.struct(F.lit(0).cast("long").alias("num"), F.lit(1).cast("long").alias("den"))).when(dots > 0, dotted).otherwise(plain)

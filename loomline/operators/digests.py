"""Digests of ordered groups of any size, as trees over ranges of a whole-number key.

A row's digest is SHA-256 of its values, each behind its length. Rows of one key meet by the first digits of their digests, and keys by ranges
of 2**16, 2**32 and 2**48 numbers, so no digest is taken over more than about 65,536 others, and the root of a group depends on
its rows alone, not on how they are dealt. Equal rows count as often as they occur. Two trees are compared from their roots down, by the nodes that differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Kept = Callable[[DataFrame], DataFrame]
WIDTHS = (16, 32, 48)


def row_digest(*columns: str) -> Column:
    """SHA-256 of the values with their lengths; null differs from the empty text, and no two rows have one encoding."""
    part = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("n"))
    return F.sha2(F.concat(*map(part, columns)), 256)


def of_children(rows: DataFrame, keys: list[str], child: str) -> DataFrame:
    """(keys, digest, n): the digest over the children's names and digests in their order, and the rows below."""
    items = F.array_sort(F.collect_list(F.struct(child, "digest")))
    text = F.array_join(F.transform(items, lambda x: F.concat(x[child].cast("string"), F.lit("="), x["digest"])), ",")
    return rows.groupBy(*keys).agg(F.sha2(text, 256).alias("digest"), F.sum("n").alias("n"))


def key_digests(df: DataFrame, group: str, key: str, columns: list[str]) -> DataFrame:
    """(group, node, digest, n) of each key: the lowest level of a group's tree."""
    rows = df.select(group, F.col(key).cast("long").alias("node"), row_digest(*columns).alias("row")).groupBy(group, "node", "row").agg(F.count(F.lit(1)).alias("n"))
    named = rows.withColumn("digest", F.col("n").cast("string")).withColumn("digits", F.substring("row", 1, 4))
    return of_children(of_children(named, [group, "node", "digits"], "row"), [group, "node"], "digits")


def digest_tree(df: DataFrame, group: str, key: str, columns: list[str], kept: Kept) -> list[DataFrame]:
    """Levels of the trees of all groups from the root down to keys, each (group, parent, node, digest, n). `columns` should name the key too; a null key is a node of its own."""
    below = kept(key_digests(df, group, key, columns))
    levels = []
    for low, high in zip((0, *WIDTHS), (*WIDTHS, None)):
        parent = F.shiftright("node", high - low) if high else F.lit(None).cast("long")
        named = below.withColumn("parent", parent)
        levels.append(named.select(group, "parent", "node", "digest", "n"))
        below = of_children(named, [group, "parent"], "node").withColumnRenamed("parent", "node")
        below = kept(below)
    levels.append(below.select(group, F.lit(None).cast("long").alias("parent"), "node", "digest", "n"))
    return levels[::-1]


def differing_keys(a: list[DataFrame], b: list[DataFrame], group: str, kept: Kept) -> DataFrame:
    """(group, key, side): keys whose rows differ between two trees, or that one of them lacks (`left`, `right` or `both` have it). Only nodes below differing ones are compared."""
    wanted = None
    for left, right in zip(a, b):
        if wanted is not None:
            above = wanted.select(group, F.col("node").alias("parent"))
            on = lambda x: x.join(above.withColumnRenamed(group, "__g").withColumnRenamed("parent", "__p"), F.col(group).eqNullSafe(F.col("__g")) & F.col("parent").eqNullSafe(F.col("__p")), "left_semi")
            left, right = on(left), on(right)
        left, right = (x.select(F.col(group).alias(f"{s}g"), F.col("node").alias(f"{s}n"), F.col("digest").alias(f"{s}d")) for x, s in ((left, "l"), (right, "r")))
        both = left.join(right, F.col("lg").eqNullSafe(F.col("rg")) & F.col("ln").eqNullSafe(F.col("rn")), "full_outer").where(~F.col("ld").eqNullSafe(F.col("rd")))
        side = F.when(F.col("rd").isNull(), "left").when(F.col("ld").isNull(), "right").otherwise("both")
        here = F.col("ld").isNotNull()
        wanted = kept(both.select(F.when(here, F.col("lg")).otherwise(F.col("rg")).alias(group), F.when(here, F.col("ln")).otherwise(F.col("rn")).alias("node"), side.alias("side")))
    return wanted.withColumnRenamed("node", "key")

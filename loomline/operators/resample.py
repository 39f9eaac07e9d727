"""Resampling of clusters. Rows are reduced to totals of each cluster before draws are joined, and the
draws are computed from a digest, so every system of a table meets the same ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import draw_int
from loomline.operators import checks

DRAWS = 500


def draw_table(spark: SparkSession, draws: int, slots: int, below: int, seed: str) -> DataFrame:
    """(b, slot, pick): one whole number below `below` for each replicate and slot."""
    rows = spark.range(draws).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("slot"))
    return rows.withColumn("pick", draw_int(F.lit(seed), "b", "slot", below=below))


def ranked_works(works: DataFrame, key: str = "work_id") -> DataFrame:
    """(key, pick): clusters numbered from 0 in order of their key. The number of clusters is small by nature."""
    return works.select(key).distinct().withColumn("pick", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(key)) - 1).cast("long"))


def cluster_draws(works: DataFrame, draws: int, seed: str) -> DataFrame:
    """(b, slot, pick, key): as many draws of clusters as there are clusters. Their number is a column, so no job is run to learn it."""
    n = works.agg(F.count(F.lit(1)).alias("n"))
    rows = works.sparkSession.range(draws).select(F.col("id").alias("b")).join(F.broadcast(n)).where("n > 0")
    slots = rows.select("b", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("slot"))
    return slots.withColumn("pick", draw_int(F.lit(seed), "b", "slot", below=F.col("n"))).drop("n").join(works, "pick")


def cluster_totals(filled: DataFrame, metric: str, keys: tuple[str, ...] = ("system",), work: str = "work_id") -> DataFrame:
    return filled.groupBy(*keys, work).agg(F.sum(metric).alias("s"), F.count(F.lit(1)).alias("c"))


def replicates(totals: DataFrame, draws: int, seed: str, keys: tuple[str, ...] = ("system",), work: str = "work_id") -> DataFrame:
    """(keys, b, score): sum of the drawn clusters' sums over the sum of their counts. A draw whose counts are all 0 is an error."""
    sums = drawn_sums(totals, draws, seed, keys, work)
    score = F.when(F.col("c") != 0, F.col("s") / F.col("c")).otherwise(F.raise_error(F.lit("a draw has no observations, its score is undefined")).cast("double"))
    return sums.select(*keys, "b", score.alias("score"))


def drawn_sums(totals: DataFrame, draws: int, seed: str, keys: tuple[str, ...] = ("system",), work: str = "work_id") -> DataFrame:
    """(keys, b, s, c): sums of the drawn clusters' sums and counts."""
    drawn = cluster_draws(ranked_works(totals, work), draws, seed)
    return drawn.join(totals, work).groupBy(*keys, "b").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))


def empty_sums(totals: DataFrame, draws: int, seed: str) -> DataFrame:
    """(system, b): systems whose counts are all 0 (b is null), and of the others the draws whose counts are."""
    none = totals.groupBy("system").agg(F.sum("c").alias("c")).where("c = 0").select("system", F.lit(None).cast("long").alias("b"))
    return none.unionByName(drawn_sums(totals, draws, seed).where("c = 0").select("system", "b").join(none.select("system"), "system", "left_anti"))


def seed_replicates(totals: DataFrame, draws: int, seed: str, arms: dict[str, tuple[str, ...]], work: str = "work_id") -> DataFrame:
    """(arm, b, score) of systems that have several seeds: seeds are drawn anew for each arm, on the shared draw of clusters.

    An arm with one seed draws none, so its scores equal those of `replicates`.
    """
    spark = totals.sparkSession
    scores = replicates(totals, draws, seed, ("system",), work)
    out = None
    for arm, seeds in arms.items():
        if len(seeds) == 1:
            part = scores.where(F.col("system") == seeds[0]).select(F.lit(arm).alias("arm"), "b", "score")
        else:
            names = F.array(*map(F.lit, seeds))
            picks = draw_table(spark, draws, len(seeds), len(seeds), f"{seed}:{arm}").select("b", F.element_at(names, F.col("pick").cast("int") + 1).alias("system"))
            part = picks.join(scores, ["b", "system"]).groupBy("b").agg(F.avg("score").alias("score")).select(F.lit(arm).alias("arm"), "b", "score")
        out = part if out is None else out.unionByName(part)
    return out


def interval(column: str | Column = "score", low: float = 0.025, high: float = 0.975) -> tuple[Column, Column]:
    """Exact percentiles with linear interpolation."""
    return F.percentile(column, F.lit(low)), F.percentile(column, F.lit(high))


def bad_totals(totals: DataFrame, numerator: str = "s", denominator: str = "c") -> DataFrame:
    """Clusters whose totals can't be resampled: negative, not finite, or a numerator without denominator."""
    s, c = F.col(numerator), F.col(denominator)
    reason = F.when((s < 0) | (c < 0), "negative").when(F.isnan(s) | (F.abs(s) == float("inf")), "not finite").when((c == 0) & (s != 0), "numerator without denominator")
    return totals.withColumn("reason", reason).where(F.col("reason").isNotNull())


def guard(totals: DataFrame) -> DataFrame:
    """The totals, unless a rule is broken."""
    checks.assert_empty(bad_totals(totals), "totals can't be resampled")
    if not totals.agg(F.sum("c")).head()[0]:
        raise checks.CheckFailed("the total denominator is 0")
    return totals

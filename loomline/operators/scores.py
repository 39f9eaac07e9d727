"""Score tables: filling gaps, composites, statuses, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import ratio

SYSTEMS = ("A", "N", "R")
METRICS = ("m1", "m2", "m3", "m4", "m5")


def composites(df: DataFrame, first: str = "m1", second: str = "m2", timed: str = "m3", third: str = "m4", fourth: str = "m5") -> DataFrame:
    """Adds the means of four and of five components; a null component counts zero."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    four = zero(first) + zero(second) + zero(third) + zero(fourth)
    return df.withColumns({"mv4": four / 4, "mv5": (zero(first) + zero(second) + zero(timed) + zero(third) + zero(fourth)) / 5})


def fill_inventory(inventory: DataFrame, scores: DataFrame, systems: tuple[str, ...] = SYSTEMS, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """One row for each expected task and system; absent scores are zero and `present` is false."""
    expected = inventory.withColumn("system", F.explode(F.array(*map(F.lit, systems))))
    joined = expected.join(scores.withColumn("present", F.lit(True)), ["task_id", "system"], "left")
    filled = joined.withColumns({m: F.coalesce(m, F.lit(0.0)) for m in metrics} | {"present": F.coalesce("present", F.lit(False))})
    return composites(filled)


def classify_status(overall: str = "mv5", first: str = "m1") -> Column:
    """failed without scores, zero_score if overall and first component are zero, else success."""
    return F.when(F.col(overall).isNull(), "failed").when((F.col(overall) == 0) & (F.col(first) == 0), "zero_score").otherwise("success")


def seen_by_all(scores: DataFrame, systems: tuple[str, ...] = SYSTEMS) -> DataFrame:
    """Tasks that every system has scored."""
    return scores.where(F.col("system").isin(*systems)).groupBy("task_id").agg(F.count_distinct("system").alias("n")).where(F.col("n") == len(systems)).select("task_id")


def long_metrics(df: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """One row for each metric: (metric, value) besides the other columns."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics))
    return df.withColumn("pair", F.explode(pairs)).select(*(c for c in df.columns if c not in metrics), "pair.metric", "pair.value")


def rates(df: DataFrame, keys: list[str], edits: str, total: str) -> DataFrame:
    """Mean of the rows' ratios beside the ratio of the sums; zero on an empty total."""
    return df.groupBy(*keys).agg(F.avg(ratio(edits, total)).alias("macro_rate"), ratio(F.sum(edits), F.sum(total)).alias("corpus_rate"), F.count(F.lit(1)).alias("n"))


def work_totals(filled: DataFrame, works: DataFrame, metric: str) -> DataFrame:
    """Sum and number of a metric for each system and work of a list; a work without rows has zeros."""
    return works.join(filled.groupBy("system", "work_id").agg(F.sum(metric).alias("total"), F.count(F.lit(1)).alias("n")), ["system", "work_id"], "left").fillna(0)

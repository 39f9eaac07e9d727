"""Queries that resample works: intervals of systems and of their differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import r6
from loomline.operators import resample
from loomline.operators.resample import DRAWS

from .base import kept, query, v_grounding
from .q_scores import v_filled

SEED = "7"
WORKS = "SELECT work_id, row_number() OVER (ORDER BY work_id) - 1 AS pick FROM (SELECT DISTINCT work_id FROM v_grounding)"
DRAWN = f"SELECT b, slot, work_id FROM (SELECT b, slot, ('0x' || substr(md5('{SEED}|' || b || '|' || slot), 1, 8))::BIGINT % n AS pick FROM (SELECT unnest(range({DRAWS})) AS b), (SELECT unnest(range(n)) AS slot, n FROM (SELECT count(*) AS n FROM ({WORKS})))) JOIN ({WORKS}) USING (pick)"
REPLICATES = f"SELECT system, metric, b, sum(s) / sum(c) AS score FROM ({DRAWN}) JOIN (SELECT system, 'mv5' AS metric, work_id, sum(mv5) AS s, count(*) AS c FROM v_filled GROUP BY ALL UNION ALL SELECT system, 'm1', work_id, sum(m1), count(*) FROM v_filled GROUP BY ALL) USING (work_id) GROUP BY ALL"


def totals(spark, sf, metric="mv5") -> DataFrame:
    """Totals of each system and work, few rows, checked and kept."""
    return resample.guard(kept(resample.cluster_totals(v_filled(spark, sf), metric)))


def both_metrics(spark, sf) -> DataFrame:
    """Totals of two metrics in one pass, checked and kept."""
    filled = v_filled(spark, sf).groupBy("system", "work_id").agg(F.sum("mv5").alias("mv5"), F.sum("m1").alias("m1"), F.count(F.lit(1)).alias("c"))
    rows = filled.select("system", "work_id", "c", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("s")) for m in ("mv5", "m1")))).alias("x")).select("system", "work_id", "x.metric", "x.s", "c")
    return resample.guard(kept(rows))


@query(f"SELECT b, slot, work_id FROM ({DRAWN})")
def rs1_draws(spark, sf):
    return resample.cluster_draws(resample.ranked_works(v_grounding(spark, sf)), DRAWS, SEED).select("b", "slot", "work_id")


@query(f"SELECT system, b, round(score, 6) AS score FROM ({REPLICATES}) WHERE metric = 'mv5'")
def rs2_cluster_bootstrap(spark, sf):
    return resample.replicates(totals(spark, sf), DRAWS, SEED).withColumn("score", r6("score"))


SEEDED = f"SELECT 'AN' AS arm, b, avg(score) AS score FROM (SELECT b, CASE ('0x' || substr(md5('{SEED}:AN|' || b || '|' || slot), 1, 8))::BIGINT % 2 WHEN 0 THEN 'A' ELSE 'N' END AS system FROM (SELECT unnest(range({DRAWS})) AS b), (SELECT unnest(range(2)) AS slot)) JOIN ({REPLICATES}) USING (b, system) WHERE metric = 'mv5' GROUP BY b UNION ALL SELECT 'R', b, score FROM ({REPLICATES}) WHERE metric = 'mv5' AND system = 'R'"
ARMS = {"AN": ("A", "N"), "R": ("R",)}


@query(f"SELECT arm, b, round(score, 6) AS score FROM ({SEEDED})")
def rs3_seed_cluster_bootstrap(spark, sf):
    return resample.seed_replicates(totals(spark, sf), DRAWS, SEED, ARMS).withColumn("score", r6("score"))


def difference(scores: DataFrame, name: str, candidate: str, reference: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, b, d): score of the candidate less that of the reference on the same draw."""
    side = lambda s: F.max(F.when(F.col(name) == s, F.col("score")))
    return scores.groupBy(*keys, "b").agg((side(candidate) - side(reference)).alias("d"))


def summary(differences: DataFrame, *keys: str) -> DataFrame:
    low, high = resample.interval("d")
    return differences.groupBy(*keys).agg(r6(F.avg("d")).alias("mean"), r6(low).alias("low"), r6(high).alias("high"), r6(F.stddev_samp("d")).alias("sd"), (F.percentile("d", F.lit(0.025)) > 0).alias("above"), (F.percentile("d", F.lit(0.975)) < 0).alias("below"))


SUMMARY = "round(avg(d), 6) AS mean, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, round(stddev_samp(d), 6) AS sd, quantile_cont(d, 0.025) > 0 AS above, quantile_cont(d, 0.975) < 0 AS below"
DIFFERENCE = f"SELECT metric, b, max(CASE WHEN system = 'A' THEN score END) - max(CASE WHEN system = 'R' THEN score END) AS d FROM ({REPLICATES}) GROUP BY ALL"


@query(f"SELECT {SUMMARY} FROM ({DIFFERENCE}) WHERE metric = 'mv5'")
def rs4_paired_ratio(spark, sf):
    return summary(difference(resample.replicates(totals(spark, sf), DRAWS, SEED), "system", "A", "R"))


@query(f"SELECT {SUMMARY} FROM (SELECT b, max(CASE WHEN arm = 'AN' THEN score END) - max(CASE WHEN arm = 'R' THEN score END) AS d FROM ({SEEDED}) GROUP BY b)")
def rs5_paired_ratio_seeds(spark, sf):
    return summary(difference(resample.seed_replicates(totals(spark, sf), DRAWS, SEED, ARMS), "arm", "AN", "R"))


WLT = "SELECT metric, count_if(d >= 1e-12)::BIGINT AS wins, count_if(d <= -1e-12)::BIGINT AS losses, count_if(abs(d) < 1e-12)::BIGINT AS ties FROM (SELECT metric, work_id, avg(CASE WHEN system = 'A' THEN v END) - avg(CASE WHEN system = 'R' THEN v END) AS d FROM (SELECT system, work_id, 'mv5' AS metric, mv5 AS v FROM v_filled UNION ALL SELECT system, work_id, 'm1', m1 FROM v_filled) GROUP BY ALL) GROUP BY metric"


@query(f"SELECT metric, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, wins, losses, ties FROM ({DIFFERENCE}) JOIN ({WLT}) USING (metric) GROUP BY ALL")
def rs6_paired_summary(spark, sf):
    sums = both_metrics(spark, sf)
    low, high = resample.interval("d")
    scores = resample.replicates(sums, DRAWS, SEED, ("system", "metric"))
    ci = difference(scores, "system", "A", "R", ("metric",)).groupBy("metric").agg(r6(F.avg("d")).alias("mean"), r6(low).alias("low"), r6(high).alias("high"))
    # Every system has a row for every task, so a work's mean difference is that of its totals.
    mean = lambda s: F.max(F.when(F.col("system") == s, F.col("s") / F.col("c")))
    d = F.col("d")
    works = sums.groupBy("metric", "work_id").agg((mean("A") - mean("R")).alias("d"))
    marks = works.groupBy("metric").agg(F.count_if(d >= 1e-12).alias("wins"), F.count_if(d <= -1e-12).alias("losses"), F.count_if(F.abs(d) < 1e-12).alias("ties"))
    return ci.join(marks, "metric")


@query(f"SELECT system, metric, round(quantile_cont(score, 0.025), 6) AS low, round(quantile_cont(score, 0.975), 6) AS high, any_value(mean) AS mean FROM ({REPLICATES}) JOIN (SELECT system, 'mv5' AS metric, round(avg(mv5), 6) AS mean FROM v_filled GROUP BY 1 UNION ALL SELECT system, 'm1', round(avg(m1), 6) FROM v_filled GROUP BY 1) USING (system, metric) GROUP BY 1, 2")
def rs7_own_interval(spark, sf):
    """Mean and interval of every system and metric."""
    sums = both_metrics(spark, sf)
    low, high = resample.interval()
    spread = resample.replicates(sums, DRAWS, SEED, ("system", "metric")).groupBy("system", "metric").agg(r6(low).alias("low"), r6(high).alias("high"))
    return sums.groupBy("system", "metric").agg(r6(F.sum("s") / F.sum("c")).alias("mean")).join(spread, ["system", "metric"])


@query(f"SELECT system, round(100 * any_value(rate), 6) AS rate, round(100 * (quantile_cont(score, 0.975) - quantile_cont(score, 0.025)) / 2, 6) AS half_width, any_value(n) AS n, any_value(works) AS works, any_value(failures) AS failures FROM ({REPLICATES}) JOIN (SELECT system, avg(mv5) AS rate, count(*) AS n, count(DISTINCT work_id) AS works, count_if(NOT present)::BIGINT AS failures FROM v_filled GROUP BY 1) USING (system) WHERE metric = 'mv5' GROUP BY 1")
def rs8_corpus_cell(spark, sf):
    """Rate, half width of its interval, and what it rests on, all from one kept table of works."""
    filled = v_filled(spark, sf).groupBy("system", "work_id").agg(F.sum("mv5").alias("s"), F.count(F.lit(1)).alias("c"), F.count_if(~F.col("present")).alias("failures"))
    works = resample.guard(kept(filled))
    low, high = resample.interval()
    spread = resample.replicates(works, DRAWS, SEED).groupBy("system").agg(r6(100 * (high - low) / 2).alias("half_width"))
    cell = works.groupBy("system").agg(r6(100 * F.sum("s") / F.sum("c")).alias("rate"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("works"), F.sum("failures").alias("failures"))
    return cell.join(spread, "system")


@query(f"SELECT metric, -round(avg(d), 6) AS diff, -round(quantile_cont(d, 0.975), 6) AS low, -round(quantile_cont(d, 0.025), 6) AS high FROM ({DIFFERENCE}) GROUP BY 1")
def rs9_arm_minus_base(spark, sf):
    """The paired difference seen from the other side: signs flip and bounds change places."""
    scores = resample.replicates(both_metrics(spark, sf), DRAWS, SEED, ("system", "metric"))
    low, high = resample.interval("d")
    return difference(scores, "system", "A", "R", ("metric",)).groupBy("metric").agg((-r6(F.avg("d"))).alias("diff"), (-r6(high)).alias("low"), (-r6(low)).alias("high"))


SPOILT = "SELECT system, work_id, CASE WHEN system = 'A' THEN sum(mv5) - 8 WHEN system = 'N' AND work_id = 5 THEN sum(mv5) ELSE 0 END AS s, CASE WHEN system = 'A' AND work_id <> 3 THEN count(*) WHEN system = 'N' AND work_id = 5 THEN count(*) ELSE 0 END AS c FROM v_filled GROUP BY system, work_id"


@query(f"""WITH t AS ({SPOILT}) SELECT system, work_id AS place, CASE WHEN s < 0 OR c < 0 THEN 'negative' WHEN isnan(s) OR isinf(s) THEN 'not finite' ELSE 'numerator without denominator' END AS reason FROM t WHERE s < 0 OR c < 0 OR isnan(s) OR isinf(s) OR (c = 0 AND s <> 0)
UNION ALL SELECT system, NULL, 'no observations' FROM t GROUP BY system HAVING sum(c) = 0
UNION ALL SELECT system, b, 'draw without observations' FROM ({DRAWN}) JOIN t USING (work_id) WHERE system NOT IN (SELECT system FROM t GROUP BY system HAVING sum(c) = 0) GROUP BY system, b HAVING sum(c) = 0""")
def rs10_guards(spark, sf):
    """Totals made to break the rules, and what is wrong with each: works, whole systems, draws."""
    system, work = F.col("system"), F.col("work_id")
    sums = kept(resample.cluster_totals(v_filled(spark, sf), "mv5"))
    lone = (system == "N") & (work == 5)
    spoilt = sums.select("system", "work_id", F.when(system == "A", F.col("s") - 8).when(lone, F.col("s")).otherwise(0.0).alias("s"), F.when((system == "A") & (work != 3), F.col("c")).when(lone, F.col("c")).otherwise(0).alias("c"))
    bad = resample.bad_totals(spoilt).select("system", F.col("work_id").cast("long").alias("place"), "reason")
    empty = resample.empty_sums(spoilt, DRAWS, SEED)
    return bad.unionByName(empty.select("system", F.col("b").alias("place"), F.when(F.col("b").isNull(), "no observations").otherwise("draw without observations").alias("reason")))


LOWER = "m1"  # plays the part of an error rate: less is better


@query(f"SELECT metric, system, CASE WHEN system = 'R' THEN '' WHEN best THEN 'dagger' WHEN beats_r THEN 'star' ELSE '' END AS mark FROM (SELECT metric, a AS system, bool_and(better) AS best, bool_or(better AND z = 'R') AS beats_r FROM (SELECT x.metric, x.system AS a, y.system AS z, CASE WHEN x.metric = '{LOWER}' THEN quantile_cont(x.score - y.score, 0.975) < 0 ELSE quantile_cont(x.score - y.score, 0.025) > 0 END AS better FROM ({REPLICATES}) x JOIN ({REPLICATES}) y ON x.b = y.b AND x.metric = y.metric AND x.system <> y.system GROUP BY 1, 2, 3) GROUP BY 1, 2)")
def agg14_significance_marks(spark, sf):
    """A dagger for a system better than all others, else a star for one better than the baseline R, which gets none.

    Better means that the interval of the difference lies above 0, or below it where less is better.
    """
    scores = resample.replicates(both_metrics(spark, sf), DRAWS, SEED, ("system", "metric"))
    gathered = scores.groupBy("metric", "b").agg(F.collect_list(F.struct("system", "score")).alias("all"))
    sides = gathered.withColumn("x", F.explode("all")).withColumn("y", F.explode("all")).where("x.system <> y.system")
    low, high = resample.interval(F.col("x.score") - F.col("y.score"))
    pairs = sides.groupBy("metric", F.col("x.system").alias("system"), F.col("y.system").alias("z")).agg(low.alias("low"), high.alias("high"))
    better = F.when(F.col("metric") == LOWER, F.col("high") < 0).otherwise(F.col("low") > 0)
    marks = pairs.groupBy("metric", "system").agg(F.bool_and(better).alias("best"), F.bool_or(better & (F.col("z") == "R")).alias("beats"))
    return marks.select("metric", "system", F.when(F.col("system") == "R", "").when(F.col("best"), "dagger").when(F.col("beats"), "star").otherwise("").alias("mark"))

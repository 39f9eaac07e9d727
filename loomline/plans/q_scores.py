"""Queries over score tables: projections, inventory joins, set differences, aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import r6
from loomline.operators import checks
from loomline.operators.scores import METRICS, classify_status, composites, fill_inventory, long_metrics, rates, seen_by_all, work_totals
from loomline.operators.windows import ranked

from .base import query, table, v_grounding, v_scores

ALL = (*METRICS, "mv4", "mv5")


def v_filled(spark: SparkSession, sf: str) -> DataFrame:
    return fill_inventory(v_grounding(spark, sf), v_scores(spark, sf))


@query("SELECT system, task_id, round((coalesce(m1,0)+coalesce(m2,0)+coalesce(m4,0)+coalesce(m5,0))/4 + 1e-9, 6) AS mv4, round((coalesce(m1,0)+coalesce(m2,0)+coalesce(m3,0)+coalesce(m4,0)+coalesce(m5,0))/5 + 1e-9, 6) AS mv5 FROM v_scores")
def prj2_composites(spark, sf):
    return composites(v_scores(spark, sf)).select("system", "task_id", r6(F.col("mv4") + 1e-9).alias("mv4"), r6(F.col("mv5") + 1e-9).alias("mv5"))


STATUS_SQL = "CASE WHEN ref_status = 'P' THEN 'reference_pending' WHEN NOT present THEN 'missing_prediction' WHEN m4 = 0 THEN 'empty_prediction' ELSE 'ready' END"


@query(f"SELECT task_id, system, {STATUS_SQL} AS status FROM v_filled")
def prj3_status_precedence(spark, sf):
    """The reference's status goes before the source's, and that before ready."""
    status = F.when(F.col("ref_status") == "P", "reference_pending").when(~F.col("present"), "missing_prediction").when(F.col("m4") == 0, "empty_prediction").otherwise("ready")
    return v_filled(spark, sf).select("task_id", "system", status.alias("status"))


@query("SELECT task_id, system, CASE WHEN NOT present THEN 'failed' WHEN mv5 = 0 AND m1 = 0 THEN 'zero_score' ELSE 'success' END AS status FROM v_filled")
def prj4_score_status(spark, sf):
    return v_filled(spark, sf).select("task_id", "system", F.when(~F.col("present"), "failed").otherwise(classify_status()).alias("status"))


@query("SELECT system, task_id, round(m3, 6) AS m3 FROM v_scores WHERE NOT (m3 * 1.25 BETWEEN 0 AND 1 + 1e-9)")
def prj5_range_guard(spark, sf):
    """Rows whose scaled component leaves [0, 1 + 1e-9]."""
    scaled = v_scores(spark, sf).withColumn("scaled", F.col("m3") * 1.25)
    return checks.out_of_range(scaled, ("scaled",)).select("system", "task_id", r6("m3").alias("m3"))


@query("SELECT system, task_id, present, round(m1,6) AS m1, round(mv5,6) AS mv5, sum(present::INT) OVER (PARTITION BY system)::BIGINT AS n_present FROM v_filled")
def jn1_inventory_zero_fill(spark, sf):
    filled = v_filled(spark, sf)
    counts = filled.groupBy("system").agg(F.count_if("present").alias("n_present"))
    return filled.join(F.broadcast(counts), "system").select("system", "task_id", "present", r6("m1").alias("m1"), r6("mv5").alias("mv5"), "n_present")


@query("SELECT task_id, work_id FROM v_grounding WHERE work_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3)) OR recording_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def jn2_allow_list(spark, sf):
    """Tasks whose work, or whose recording under an alias, is on a list; lists that leave nothing are an error."""
    works = table(spark, sf, "nation").where("n_regionkey IN (1, 3)").select(F.col("n_nationkey").alias("work_id"))
    recordings = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("recording_id"))
    return allowed(v_grounding(spark, sf), {"work_id": works, "recording_id": recordings}).select("task_id", "work_id")


def allowed(df: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """Rows of which one of the named columns is on its list (a table with a column of that name); an error if none is left."""
    marked = df
    for k, (name, listed) in enumerate(lists.items()):
        marked = marked.join(listed.select(name).distinct().withColumn(f"__by_{k}", F.lit(True)), name, "left")
    names = [f"__by_{k}" for k in range(len(lists))]
    some = marked.where(F.coalesce(*names, F.lit(False))).drop(*names)
    return checks.assert_some(some, f"the lists of {', '.join(lists)} leave no rows")


@query("SELECT s.system, s.task_id FROM v_scores s WHERE s.task_id IN (SELECT task_id FROM v_scores GROUP BY 1 HAVING count(DISTINCT system) = 3)")
def jn4_all_systems(spark, sf):
    scores = v_scores(spark, sf)
    return scores.join(seen_by_all(scores), "task_id", "left_semi").select("system", "task_id")


PREDICTED_SQL = "SELECT task_id + CASE WHEN task_id % 97 = 5 THEN 1000000000 ELSE 0 END AS task_id, m1 FROM v_scores WHERE system = 'A'"


@query(f"SELECT coalesce(g.task_id, s.task_id) AS task_id, CASE WHEN g.task_id IS NULL THEN 'unknown_reference' WHEN s.task_id IS NULL THEN 'no_prediction' WHEN g.ref_status = 'P' THEN 'no_reference' ELSE 'paired' END AS status, round(s.m1, 6) AS prediction, g.recording_id AS reference FROM v_grounding g FULL JOIN ({PREDICTED_SQL}) s ON s.task_id = g.task_id")
def jn17_pairing(spark, sf):
    """One row for each reference, with the artifacts of both sides and a status, and one for each prediction that no reference knows."""
    key = F.col("task_id")
    predictions = v_scores(spark, sf).where("system = 'A'").select((key + F.when(key % 97 == 5, 1000000000).otherwise(0)).alias("task_id"), r6("m1").alias("prediction"))
    references = v_grounding(spark, sf).select("task_id", F.col("recording_id").alias("reference"), (F.col("ref_status") != "P").alias("usable"))
    return paired(references, predictions, "task_id").select("task_id", "status", "prediction", "reference")


def paired(references: DataFrame, predictions: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """All columns of both sides by their key, with a status. `references` says which are `usable`. If `strict`, a repeated key, a prediction without its reference and a reference without prediction are errors."""
    both = references.withColumn("__r", F.lit(True)).join(predictions.withColumn("__p", F.lit(True)), key, "full_outer")
    status = F.when(F.col("__r").isNull(), "unknown_reference").when(F.col("__p").isNull(), "no_prediction").when(~F.col("usable"), "no_reference").otherwise("paired")
    found = both.withColumn("status", status).drop("__r", "__p", "usable")
    if strict:
        for side, df in (("references", references), ("predictions", predictions)):
            checks.assert_empty(checks.duplicate_keys(df, key), f"repeated keys of {side}")
        checks.assert_empty(found.where("status IN ('unknown_reference', 'no_prediction')").select(key, "status"), "keys of one side only")
    return found


@query("SELECT key, side FROM (SELECT DISTINCT o_orderkey AS key, 'missing' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT l_orderkey, 'unexpected' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))")
def set2_missing_unexpected(spark, sf):
    return checks.missing_and_unexpected(table(spark, sf, "orders").select(F.col("o_orderkey").alias("key")), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key")), "key")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, rank() OVER (ORDER BY l_orderkey, l_linenumber) AS place FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey % 3 AS shard FROM lineitem) GROUP BY 1, 2 HAVING count(*) > 1")
def set1_shard_union(spark, sf):
    """Keys that lie in several shards of a union, which has to be disjoint, with their rank in inventory order."""
    items = table(spark, sf, "lineitem")
    shards = [items.where(F.col("l_partkey") % 3 == k).select("l_orderkey", "l_linenumber").distinct() for k in range(3)]
    union = shards[0].unionByName(shards[1]).unionByName(shards[2])
    twice = union.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return ranked(twice, "l_orderkey", "l_linenumber", name="place").withColumn("place", F.col("place") + 1)


@query("""SELECT o_orderkey, list_filter([CASE WHEN o_orderstatus IS DISTINCT FROM s2 THEN 'o_orderstatus' END, CASE WHEN o_orderpriority IS DISTINCT FROM p2 THEN 'o_orderpriority' END], lambda x: x IS NOT NULL) AS differing, o_orderstatus IS NOT DISTINCT FROM s2 AND o_orderpriority IS NOT DISTINCT FROM p2 AS identical
FROM (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS s2, CASE WHEN o_orderkey % 11 = 0 THEN '9-NONE' ELSE o_orderpriority END AS p2 FROM orders)""")
def set3_content_diff(spark, sf):
    """Names of the columns in which a key's rows differ, null-safe."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    altered = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("o_orderstatus"), F.when(F.col("o_orderkey") % 11 == 0, "9-NONE").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    return content_diff(orders, altered, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


def content_diff(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    joined = left.alias("l").join(right.alias("r"), key)
    names = F.array(*(F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in columns))
    return joined.select(key, F.filter(names, lambda n: n.isNotNull()).alias("differing")).withColumn("identical", F.size("differing") == 0)


@query("SELECT system, task_id, round(m1 - stored, 6) AS delta FROM (SELECT *, CASE WHEN task_id % 50 = 0 THEN m1 + 0.01 WHEN task_id % 53 = 0 THEN m1 + 1e-12 ELSE m1 END AS stored FROM v_scores) WHERE abs(m1 - stored) > 1e-9")
def set4_tolerance_diff(spark, sf):
    scores = v_scores(spark, sf)
    stored = scores.select("system", "task_id", F.when(F.col("task_id") % 50 == 0, F.col("m1") + 0.01).when(F.col("task_id") % 53 == 0, F.col("m1") + 1e-12).otherwise(F.col("m1")).alias("stored"))
    return scores.join(stored, ["system", "task_id"]).where(F.abs(F.col("m1") - F.col("stored")) > 1e-9).select("system", "task_id", r6(F.col("m1") - F.col("stored")).alias("delta"))


LONG_SQL = "SELECT * FROM (UNPIVOT (SELECT system, work_id, task_id, present, m1, m2, m3, m4, m5, mv4, mv5 FROM v_filled) ON m1, m2, m3, m4, m5, mv4, mv5 INTO NAME metric VALUE value)"


@query(f"SELECT system, metric, round(avg(value), 6) AS mean, count(*) AS n FROM ({LONG_SQL}) GROUP BY 1, 2")
def agg1_pooled_mean(spark, sf):
    """All metrics in one pass; only their results become rows."""
    means = v_filled(spark, sf).groupBy("system").agg(*(F.avg(m).alias(m) for m in ALL), F.count(F.lit(1)).alias("n"))
    return long_metrics(means, ALL).select("system", "metric", r6("value").alias("mean"), "n")


@query("SELECT system, round(avg(CASE WHEN present THEN mv5 END), 6) AS mean_success, round(sum(mv5) / count(*), 6) AS mean_all, count(*) AS n_total, count_if(present)::BIGINT AS n_success FROM v_filled GROUP BY 1")
def agg2_two_denominators(spark, sf):
    return v_filled(spark, sf).groupBy("system").agg(r6(F.avg(F.when(F.col("present"), F.col("mv5")))).alias("mean_success"), r6(F.sum("mv5") / F.count(F.lit(1))).alias("mean_all"), F.count(F.lit(1)).alias("n_total"), F.count_if("present").alias("n_success"))


@query("SELECT l_returnflag, round(avg(coalesce(l_discount * l_quantity / nullif(l_quantity, 0), 0)), 6) AS macro_rate, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS corpus_rate, count(*) AS n FROM lineitem GROUP BY 1")
def agg3_macro_corpus(spark, sf):
    items = table(spark, sf, "lineitem").withColumn("edits", F.col("l_discount") * F.col("l_quantity"))
    return rates(items, ["l_returnflag"], "edits", "l_quantity").withColumns({"macro_rate": r6("macro_rate"), "corpus_rate": r6("corpus_rate")})


@query("SELECT o_orderpriority, count(*) AS n, (SELECT string_agg(s || '=' || c, ',' ORDER BY s) FROM (SELECT o_orderstatus AS s, count(*) AS c FROM orders o2 WHERE o2.o_orderpriority = o1.o_orderpriority GROUP BY 1)) AS statuses FROM orders o1 GROUP BY 1")
def agg4_status_counts(spark, sf):
    """Counts by status, as a map in order of its keys and as text."""
    counts = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("c"))
    entries = F.array_sort(F.collect_list(F.struct("o_orderstatus", "c")))
    mapped = counts.groupBy("o_orderpriority").agg(F.sum("c").alias("n"), F.map_from_entries(entries).alias("by_status"))
    text = F.array_join(F.transform(F.map_entries("by_status"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return mapped.select("o_orderpriority", "n", text.alias("statuses"))


@query("SELECT system, n_nationkey AS work_id, round(coalesce(sum(mv5), 0), 6) AS total, count(f.task_id) AS n FROM nation CROSS JOIN (VALUES ('A'), ('N'), ('R')) s(system) LEFT JOIN v_filled f USING (system) WHERE f.work_id = n_nationkey OR n_nationkey NOT IN (SELECT work_id FROM v_grounding) GROUP BY 1, 2")
def agg5_work_totals(spark, sf):
    works = table(spark, sf, "nation").select(F.col("n_nationkey").alias("work_id"), F.explode(F.array(*map(F.lit, ("A", "N", "R")))).alias("system"))
    return work_totals(v_filled(spark, sf), works, "mv5").withColumn("total", r6("total"))


@query("SELECT round(avg(abs(a.m1 - b.m1)), 6) AS m1, round(avg(abs(a.m3 - b.m3)), 6) AS m3, round(avg(abs((a.m1+a.m2+a.m3+a.m4+a.m5)/5 - (b.m1+b.m2+b.m3+b.m4+b.m5)/5)), 6) AS mv5, count(*) AS n FROM v_scores a JOIN v_scores b ON a.task_id = b.task_id AND a.system = 'A' AND b.system = 'R'")
def agg6_mean_absolute_difference(spark, sf):
    scored = composites(v_scores(spark, sf))
    a, b = (scored.where(F.col("system") == s).select("task_id", *(F.col(m).alias(f"{m}_{s}") for m in ("m1", "m3", "mv5"))) for s in ("A", "R"))
    return a.join(b, "task_id").agg(*(r6(F.avg(F.abs(F.col(f"{m}_A") - F.col(f"{m}_R")))).alias(m) for m in ("m1", "m3", "mv5")), F.count(F.lit(1)).alias("n"))


@query(f"SELECT level, metric, round(min(value), 6) AS low, round(max(value), 6) AS high FROM (SELECT CASE WHEN metric IN ('mv4', 'mv5') THEN 'composite' ELSE 'component' END AS level, metric, value FROM ({LONG_SQL})) GROUP BY GROUPING SETS ((level, metric), (level), ())")
def agg7_score_ranges(spark, sf):
    """Ranges of each metric, each level and all: one pass over the scores, then grouping sets over its one row a metric."""
    bounds = v_filled(spark, sf).agg(*(F.struct(F.min(m).alias("low"), F.max(m).alias("high")).alias(m) for m in ALL))
    levels = long_metrics(bounds, ALL).select("metric", "value.*").withColumn("level", F.when(F.col("metric").isin("mv4", "mv5"), "composite").otherwise("component"))
    return levels.groupingSets([["level", "metric"], ["level"], []], "level", "metric").agg(r6(F.min("low")).alias("low"), r6(F.max("high")).alias("high")).select("level", "metric", "low", "high")


@query("SELECT work_id, round(avg(m), 6) AS mean, count(*) AS n FROM (SELECT work_id, task_id, avg(mv5) AS m FROM v_filled WHERE present GROUP BY 1, 2) GROUP BY 1")
def agg8_seed_then_row(spark, sf):
    """The mean over systems (seeds) of a task first, then over tasks."""
    rows = v_filled(spark, sf).where("present").groupBy("work_id", "task_id").agg(F.avg("mv5").alias("m"))
    return rows.groupBy("work_id").agg(r6(F.avg("m")).alias("mean"), F.count(F.lit(1)).alias("n"))


PAIR_SQL = "SELECT work_id, avg(a.mv5 - r.mv5) AS d FROM (SELECT * FROM v_filled WHERE system = 'A') a JOIN (SELECT task_id, mv5 FROM v_filled WHERE system = 'R') r USING (task_id) GROUP BY 1"


def work_differences(filled: DataFrame, candidate: str = "A", reference: str = "R", metric: str = "mv5") -> DataFrame:
    """Mean difference of two systems in each work; both have a row for every task."""
    sides = filled.where(F.col("system").isin(candidate, reference)).groupBy("work_id").agg(F.avg(F.when(F.col("system") == candidate, F.col(metric))).alias("c"), F.avg(F.when(F.col("system") == reference, F.col(metric))).alias("r"))
    return sides.select("work_id", (F.col("c") - F.col("r")).alias("d"))


@query(f"SELECT count_if(d >= 1e-12)::BIGINT AS wins, count_if(d <= -1e-12)::BIGINT AS losses, count_if(abs(d) < 1e-12)::BIGINT AS ties, string_agg(work_id || ':' || CASE WHEN abs(d) < 1e-12 THEN 'T' WHEN d > 0 THEN 'W' ELSE 'L' END, ',' ORDER BY work_id) AS detail FROM ({PAIR_SQL})")
def agg9_win_loss_tie(spark, sf):
    d = F.col("d")
    mark = F.when(F.abs(d) < 1e-12, "T").when(d > 0, "W").otherwise("L")
    detail = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("work_id", mark.alias("m")))), lambda x: F.concat_ws(":", x["work_id"].cast("string"), x["m"])), ",")
    return work_differences(v_filled(spark, sf)).agg(F.count_if(d >= 1e-12).alias("wins"), F.count_if(d <= -1e-12).alias("losses"), F.count_if(F.abs(d) < 1e-12).alias("ties"), detail.alias("detail"))


@query("SELECT system, count_if(present)::BIGINT AS present, count_if(NOT present)::BIGINT AS absent, count(DISTINCT CASE WHEN present THEN work_id END) AS works, count(DISTINCT CASE WHEN present THEN recording_id END) AS recordings, min(min_by_system) AS worst_present FROM v_filled, (SELECT min(c) AS min_by_system FROM (SELECT count_if(present)::BIGINT AS c FROM v_filled GROUP BY system)) GROUP BY 1")
def agg10_coverage(spark, sf):
    present = F.col("present")
    rows = v_filled(spark, sf).groupBy("system").agg(F.count_if(present).alias("present"), F.count_if(~present).alias("absent"), F.count_distinct(F.when(present, F.col("work_id"))).alias("works"), F.count_distinct(F.when(present, F.col("recording_id"))).alias("recordings"))
    return rows.withColumn("worst_present", F.min("present").over(Window.partitionBy(F.lit(0))))


OUTCOME_SQL = "SELECT work_id, system, CASE WHEN NOT present THEN 'absent' WHEN m1 < 0.2 THEN 'failed' WHEN m1 < 0.3 THEN 'zero_score' ELSE 'success' END AS status FROM v_filled"


@query(f"WITH o AS ({OUTCOME_SQL}), s AS (SELECT work_id, system, count(*) AS n, count_if(status = 'success') AS good, count_if(status IN ('failed', 'absent')) AS bad FROM o GROUP BY 1, 2) SELECT work_id, min(n) AS n_total, min(good)::BIGINT AS min_success, max(bad)::BIGINT AS max_fail, arg_min(system, (good, system)) AS worst_seed, (SELECT string_agg(status || '=' || k, ',' ORDER BY status) FROM (SELECT status, count(*) AS k FROM o WHERE o.work_id = s.work_id GROUP BY 1)) AS statuses FROM s GROUP BY work_id")
def agg10_worst_seed(spark, sf):
    """Each work's outcomes over all seeds, with the fewest successes and the most failures of a seed."""
    status = F.when(~F.col("present"), "absent").when(F.col("m1") < 0.2, "failed").when(F.col("m1") < 0.3, "zero_score").otherwise("success")
    return worst_seed(v_filled(spark, sf).withColumn("status", status), "work_id", "system")


def worst_seed(rows: DataFrame, group: str, seed: str, good: tuple[str, ...] = ("success",), bad: tuple[str, ...] = ("failed", "absent")) -> DataFrame:
    """(group, n_total, min_success, max_fail, worst_seed, statuses): coverage by the worst seed, and the statuses of all of them."""
    counts = rows.groupBy(group, seed, "status").agg(F.count(F.lit(1)).alias("n"))
    sums = lambda names: F.sum(F.when(F.col("status").isin(*names), F.col("n")).otherwise(0))
    seeds = counts.groupBy(group, seed).agg(F.sum("n").alias("n"), sums(good).alias("good"), sums(bad).alias("bad"))
    worst = seeds.groupBy(group).agg(F.min("n").alias("n_total"), F.min("good").alias("min_success"), F.max("bad").alias("max_fail"), F.min_by(seed, F.struct("good", seed)).alias("worst_seed"))
    listed = counts.groupBy(group, "status").agg(F.sum("n").alias("n")).groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("status", "n"))), lambda x: F.concat_ws("=", x["status"], x["n"].cast("string"))), ",").alias("statuses"))
    return worst.join(listed, group)


@query("SELECT system, metric, format('{:.3f}', mean) AS cell FROM (SELECT system, metric, avg(value) AS mean FROM (" + LONG_SQL + ") WHERE metric IN ('m1', 'mv4') GROUP BY 1, 2)")
def snk4_report_cells(spark, sf):
    """The cells of a report, one row each; `report_table` pivots them."""
    means = v_filled(spark, sf).groupBy("system").agg(F.avg("m1").alias("m1"), F.avg("mv4").alias("mv4"))
    return long_metrics(means, ("m1", "mv4")).select("system", "metric", F.format_string("%.3f", "value").alias("cell"))


@query("SELECT system, max(CASE WHEN metric = 'm1' THEN c END) AS m1, max(CASE WHEN metric = 'mv4' THEN c END) AS mv4 FROM (SELECT system, metric, format('{:.2f} [{:.2f}, {:.2f}]', avg(value), min(value), max(value)) AS c FROM (" + LONG_SQL + ") GROUP BY 1, 2) GROUP BY 1")
def snk4_report_table(spark, sf):
    """Systems in rows, metrics in columns, cells as mean [low, high]."""
    return v_filled(spark, sf).groupBy("system").agg(*(F.format_string("%.2f [%.2f, %.2f]", F.avg(m), F.min(m), F.max(m)).alias(m) for m in ("m1", "mv4")))


@query("SELECT count(*) AS n, (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT task_id AS k FROM v_filled WHERE NOT present AND system = 'A' ORDER BY 1 LIMIT 10)) AS first_keys FROM v_filled WHERE NOT present AND system = 'A'")
def srt4_first_evidence(spark, sf):
    """How many tasks lack a score, and the first ten of them; a bounded top-k, not a list of all."""
    lacking = v_filled(spark, sf).where("NOT present AND system = 'A'").select("task_id")
    first = lacking.orderBy("task_id").limit(10).agg(F.array_join(F.array_sort(F.collect_list("task_id")).cast("array<string>"), ",").alias("first_keys"))
    return lacking.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(first))


@query("SELECT g.task_id FROM v_grounding g WHERE g.task_id NOT IN (SELECT task_id FROM v_scores WHERE system = 'A' AND m4 > 0)")
def inc1_resume(spark, sf):
    """Tasks that a resumed run still has to do: all but those already finished with success."""
    return remaining_tasks(v_grounding(spark, sf), v_scores(spark, sf).where("system = 'A' AND m4 > 0")).select("task_id")


def remaining_tasks(tasks: DataFrame, done: DataFrame, key: str = "task_id", settings: str | None = None, wanted: str | None = None) -> DataFrame:
    """Tasks without a finished result; results made under other settings are refused."""
    if settings:
        checks.assert_empty(done.where(~F.col(settings).eqNullSafe(F.lit(wanted))).select(key, settings), "finished results have other settings")
    return tasks.join(done.select(key), key, "left_anti")


@query("SELECT f.task_id, f.system FROM v_filled f WHERE NOT f.present AND f.task_id IN (SELECT l_orderkey FROM lineitem)")
def inc3_retry_set(spark, sf):
    """Failed tasks to try again, those only whose input is there."""
    inputs = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task_id"))
    return v_filled(spark, sf).where("NOT present").join(inputs, "task_id", "left_semi").select("task_id", "system")


@query("SELECT event_type AS category, CASE WHEN event_type = 'click' THEN 'timeout' ELSE 'other' END AS list, count(*) AS n, min(event_id) AS first_id FROM events WHERE event_type <> 'view' GROUP BY 1, 2")
def snk5_failure_lists(spark, sf):
    """Failures written apart by list, timeouts for themselves, and read again."""
    from .base import scratch

    failed = table(spark, sf, "events").where("event_type <> 'view'").select("event_id", F.col("event_type").alias("category"), F.when(F.col("event_type") == "click", "timeout").otherwise("other").alias("list"))
    out = scratch(spark)
    failed.write.partitionBy("list").mode("errorifexists").parquet(out)
    return spark.read.parquet(out).groupBy("category", "list").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))

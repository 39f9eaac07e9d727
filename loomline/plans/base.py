"""The registry of queries, the tables and the views that queries share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import epoch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
ORIGIN = 1704067200  # 2024-01-01, where the events begin

VIEWS = {
    "v_grounding": "SELECT o_orderkey AS task_id, o_custkey AS recording_id, c_nationkey AS work_id, o_orderstatus AS ref_status FROM orders JOIN customer ON o_custkey = c_custkey",
    "v_scores": "SELECT l_returnflag AS system, l_orderkey AS task_id, avg(l_discount) / 0.1 AS m1, avg(l_tax) / 0.08 AS m2, avg(l_quantity) / 50 AS m3, max(l_discount) / 0.1 AS m4, max(l_tax) / 0.08 AS m5 FROM lineitem GROUP BY ALL",
    "v_filled": "SELECT g.*, s.system, v.m1 IS NOT NULL AS present, coalesce(m1, 0) AS m1, coalesce(m2, 0) AS m2, coalesce(m3, 0) AS m3, coalesce(m4, 0) AS m4, coalesce(m5, 0) AS m5, (coalesce(m1, 0) + coalesce(m2, 0) + coalesce(m4, 0) + coalesce(m5, 0)) / 4 AS mv4, (coalesce(m1, 0) + coalesce(m2, 0) + coalesce(m3, 0) + coalesce(m4, 0) + coalesce(m5, 0)) / 5 AS mv5 FROM v_grounding g CROSS JOIN (VALUES ('A'), ('N'), ('R')) s(system) LEFT JOIN v_scores v ON v.task_id = g.task_id AND v.system = s.system",
    "v_bars": "SELECT * FROM (SELECT user_id, row_number() OVER w - 1 AS bar, epoch_us(ts) / 1e6 - 1704067200 AS start_sec, lead(epoch_us(ts) / 1e6 - 1704067200) OVER w AS end_sec, event_type AS state, event_type = 'view' AS head FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) WHERE end_sec IS NOT NULL",
    "v_turns": "SELECT conv_id, turn, role, text FROM conversations",
    "v_lines": "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents",
}
NEEDS = {"v_filled": ["v_grounding", "v_scores"]}


def with_views(sql: str) -> str:
    """The statement preceded by the views it names."""
    used: list[str] = []

    def use(name: str) -> None:
        for need in NEEDS.get(name, []):
            use(need)
        if name not in used:
            used.append(name)

    for name in VIEWS:
        if name in sql:
            use(name)
    if not used:
        return sql
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in used)
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH "):
        return f"WITH {'RECURSIVE ' if recursive else ''}{head},\n{body[15 if recursive else 5:]}"
    return f"WITH {head}\n{body}"


def query(sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = with_views(sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def temporary() -> str:
    """One folder for this process, which goes when it ends."""
    folder = tempfile.mkdtemp(prefix="loomline-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; without one in the session, a temporary folder in local mode only."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = temporary()
    return f"{shared}/scratch-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """A result written once and read again, for tables that a plan uses several times."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def v_grounding(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation inventory: task, recording, work, status of the reference."""
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("recording_id"), F.col("c_nationkey").alias("work_id"), F.col("o_orderstatus").alias("ref_status"))


def v_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of tasks by system; not every system has scored every task.

    The values of a mean are added in the table's order, as thresholds lie on values that another order misses by a last bit.
    """
    place = F.struct("_metadata.file_path", "_metadata.row_index").alias("place")
    items = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("system"), F.col("l_orderkey").alias("task_id"), "l_discount", "l_tax", "l_quantity", place)
    w = Window.partitionBy("system", "task_id").orderBy("place")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = {"m1": F.avg("l_discount").over(so_far) / 0.1, "m2": F.avg("l_tax").over(so_far) / 0.08, "m3": F.avg("l_quantity").over(so_far) / 50, "m4": F.max("l_discount").over(so_far) / 0.1, "m5": F.max("l_tax").over(so_far) / 0.08}
    return items.withColumns(running | {"next": F.lead(F.lit(True)).over(w)}).where(F.col("next").isNull()).select("system", "task_id", *running)


def v_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of each user's events in order of time; the last event opens none."""
    w = Window.partitionBy("user_id").orderBy("ts")
    events = table(spark, sf, "events").withColumn("start_sec", epoch("ts") - ORIGIN)
    bars = events.select("user_id", (F.row_number().over(w) - 1).cast("long").alias("bar"), "start_sec", F.lead("start_sec").over(w).alias("end_sec"), F.col("event_type").alias("state"), (F.col("event_type") == "view").alias("head"))
    return bars.where(F.col("end_sec").isNotNull())


def v_turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")


def v_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))

"""Queries over ordered rows: windows, islands, states, range and tolerance joins, time series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from loomline.functions import epoch, r6
from loomline.operators import paths, reach, timeline, windows

from .base import ORIGIN, kept, query, table, v_bars, v_turns


def by_bar() -> WindowSpec:
    return Window.partitionBy("user_id").orderBy("bar")


EVENTS_SQL = "SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 - 1704067200 AS t FROM events"
GROUPS_SQL = "SELECT user_id, bar // 8 AS g, min(start_sec) AS t0, max(end_sec) AS t1 FROM v_bars GROUP BY 1, 2"


def events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", (epoch("ts") - ORIGIN).alias("t"))


def groups(spark, sf) -> DataFrame:
    """Intervals of eight bars."""
    return v_bars(spark, sf).groupBy("user_id", F.expr("bar div 8").alias("g")).agg(F.min("start_sec").alias("t0"), F.max("end_sec").alias("t1"))


def bar_counts(spark, sf) -> DataFrame:
    return v_bars(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


TILES_SQL = "SELECT user_id, k * 16 AS first_row, k * 16 AS keep_from, 16::BIGINT AS keep_count FROM (SELECT user_id, unnest(range(count(*) // 16)) AS k FROM v_bars GROUP BY 1) UNION ALL SELECT user_id, n - 16, n // 16 * 16, n % 16 FROM (SELECT user_id, count(*) AS n FROM v_bars GROUP BY 1) WHERE n >= 16 AND n % 16 > 0"


@query(TILES_SQL)
def wn1_tiling(spark, sf):
    return windows.tiling(bar_counts(spark, sf), "user_id", "n", 16).withColumnRenamed("begin", "first_row")


def slide_sql(size: int, stride: int, first: str) -> str:
    return f"SELECT user_id, bar, start_sec AS t0, t1 FROM (SELECT *, last_value(end_sec) OVER w AS t1, count(*) OVER w AS k FROM v_bars WINDOW w AS (PARTITION BY user_id ORDER BY bar ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING)) WHERE k = {size} AND bar >= {first} AND (bar - {first}) % {stride} = 0"


@query(slide_sql(5, 3, "user_id % 2"))
def wn2_sliding(spark, sf):
    return windows.sliding(v_bars(spark, sf), "user_id", "bar", 5, 3, "start_sec", "end_sec", F.col("user_id") % 2).toDF("user_id", "bar", "t0", "t1")


@query("SELECT w.user_id, w.bar, w.t0, w.t1, CASE WHEN w.user_id % 3 = 0 THEN 'missing_reference' ELSE 'ready' END AS status FROM (SELECT b.user_id, b.bar, b.start_sec AS t0, last_value(b.end_sec) OVER w AS t1, count(*) OVER w AS k, p.pickup FROM v_bars b JOIN (SELECT user_id, (max(CASE WHEN bar = 0 THEN end_sec - start_sec END) < max(CASE WHEN bar = 1 THEN end_sec - start_sec END))::BIGINT AS pickup FROM v_bars GROUP BY 1) p USING (user_id) WINDOW w AS (PARTITION BY b.user_id ORDER BY b.bar ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) w WHERE k = 5 AND bar >= pickup AND (bar - pickup) % 5 = 0")
def wn3_windows_after_pickup(spark, sf):
    """A first interval shorter than the second is left out; windows without a reference get a status."""
    bars = v_bars(spark, sf)
    length = lambda k: F.max(F.when(F.col("bar") == k, F.col("end_sec") - F.col("start_sec")))
    pickup = bars.groupBy("user_id").agg(F.coalesce((length(0) < length(1)).cast("long"), F.lit(0).cast("long")).alias("pickup"))
    found = windows.sliding(bars.join(pickup, "user_id"), "user_id", "bar", 5, 5, "start_sec", "end_sec", F.col("pickup")).toDF("user_id", "bar", "t0", "t1")
    references = bars.select("user_id").distinct().where("user_id % 3 <> 0").withColumn("found", F.lit(True))
    return found.join(references, "user_id", "left").select("user_id", "bar", "t0", "t1", F.when(F.col("found"), "ready").otherwise("missing_reference").alias("status"))


@query("SELECT user_id, bar FROM (SELECT user_id, bar, bool_or(state = 'error') OVER w AS hole, count(*) OVER w AS k FROM v_bars WINDOW w AS (PARTITION BY user_id ORDER BY bar ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE k = 5 AND NOT hole")
def wn4_hole_free(spark, sf):
    w = by_bar().rowsBetween(0, 4)
    flagged = v_bars(spark, sf).withColumns({"hole": F.bool_or(F.col("state") == "error").over(w), "k": F.count(F.lit(1)).over(w)})
    return flagged.where("k = 5 AND NOT hole").select("user_id", "bar")


SET_SQL = "SELECT user_id, bar, t0, CASE WHEN user_id % 7 = 0 AND bar % 10 = 0 THEN t1 + 50000 ELSE t1 END AS t1 FROM (" + slide_sql(5, 5, "user_id % 4") + ")"


@query(f"SELECT user_id, bar, CASE WHEN prev IS NULL AND bar NOT IN (0, 1) THEN 'start' WHEN bar - prev <> 5 THEN 'stride' WHEN t1 > next_t0 THEN 'overlap' END AS reason FROM (SELECT *, lag(bar) OVER w AS prev, lead(t0) OVER w AS next_t0 FROM ({SET_SQL}) WINDOW w AS (PARTITION BY user_id ORDER BY bar)) WHERE (prev IS NULL AND bar NOT IN (0, 1)) OR bar - prev <> 5 OR t1 > next_t0")
def wn5_window_validation(spark, sf):
    """Windows that break the rules of a set, with the first rule broken."""
    found = windows.sliding(v_bars(spark, sf), "user_id", "bar", 5, 5, "start_sec", "end_sec", F.col("user_id") % 4).toDF("user_id", "bar", "t0", "t1")
    spoilt = found.withColumn("t1", F.when((F.col("user_id") % 7 == 0) & (F.col("bar") % 10 == 0), F.col("t1") + 50000).otherwise(F.col("t1")))
    seen = spoilt.withColumns({"prev": F.lag("bar").over(by_bar()), "next_t0": F.lead("t0").over(by_bar())})
    reason = F.when(F.col("prev").isNull() & ~F.col("bar").isin(0, 1), "start").when(F.col("bar") - F.col("prev") != 5, "stride").when(F.col("t1") > F.col("next_t0"), "overlap")
    return seen.select("user_id", "bar", reason.alias("reason")).where("reason IS NOT NULL")


FPS, CHUNK, STRIDE = 0.01, 1200, 60000  # frames a second of the events' long scale, frames of a chunk, seconds
FACTS_SQL = "SELECT user_id, max(bar) AS last, floor(max(end_sec) * 0.01)::BIGINT - user_id % 3 * 50 AS len, user_id % 4 > 0 AS annotated FROM v_bars GROUP BY 1"


@query(f"""WITH RECURSIVE b AS (SELECT v.*, f.last, f.len, f.annotated FROM v_bars v JOIN ({FACTS_SQL}) f USING (user_id)),
reach AS (SELECT h.user_id, h.bar AS k, h.start_sec AS t, h.last, h.annotated, h.len, floor(h.start_sec * {FPS})::BIGINT AS frame, coalesce((SELECT min(o.bar) FROM b o WHERE o.user_id = h.user_id AND o.bar > h.bar AND o.end_sec > (floor(h.start_sec * {FPS}) + {CHUNK}) / {FPS}) - 1, h.last) AS fit, (SELECT min(o.bar) FROM b o WHERE o.user_id = h.user_id AND o.bar > h.bar AND o.start_sec >= h.start_sec + {STRIDE}) AS nxt FROM b h),
head AS (SELECT user_id, 0::BIGINT AS k FROM b GROUP BY 1 UNION ALL SELECT r.user_id, coalesce(r.nxt, r.fit + 1) FROM head JOIN reach r ON r.user_id = head.user_id AND r.k = head.k WHERE r.nxt IS NOT NULL OR (r.fit < r.last AND NOT r.annotated))
SELECT r.user_id, r.k AS first, r.fit AS last, r.frame AS start_frame, least(floor(e.end_sec * {FPS})::BIGINT, r.len) AS end_frame FROM head JOIN reach r ON r.user_id = head.user_id AND r.k = head.k JOIN b e ON e.user_id = r.user_id AND e.bar = r.fit""")
def wn6_budget_chunks(spark, sf):
    """Chunks of at most so many frames, cut at the series' length; a series whose end is not annotated has its tail in further chunks."""
    bars = v_bars(spark, sf)
    user = F.col("user_id")
    facts = bars.groupBy("user_id").agg(F.floor(F.max("end_sec") * FPS).alias("n")).select("user_id", (F.col("n") - user % 3 * 50).alias("length"), (user % 4 > 0).alias("annotated"))
    return reach.budget_chunks(bars.join(facts, "user_id"), "user_id", "bar", "start_sec", "end_sec", CHUNK, STRIDE, FPS, kept, "length", "annotated")


@query("SELECT doc_id, k * 640 AS a, least(k * 640 + 1280, n_chars) AS b FROM (SELECT doc_id, n_chars, unnest(range(CASE WHEN n_chars <= 0 THEN 0 WHEN n_chars <= 1280 THEN 1 ELSE (n_chars - 1280 + 639) // 640 + 1 END)) AS k FROM documents)")
def wn7_fixed_chunks(spark, sf):
    n = F.col("n_chars")
    last = F.when(n <= 1280, 0).otherwise(F.ceil((n - 1280) / 640))
    chunks = table(spark, sf, "documents").where("n_chars > 0").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("k"))
    return chunks.select("doc_id", (F.col("k") * 640).alias("a"), F.least(F.col("k") * 640 + 1280, n).alias("b"))


@query("SELECT user_id, bar // 5 AS w, CASE WHEN max(end_sec) - min(start_sec) BETWEEN 40000 AND 110000 THEN 'ready' ELSE 'duration' END AS status FROM v_bars WHERE user_id IN (SELECT user_id FROM v_bars GROUP BY 1 HAVING count(*) >= 60) GROUP BY 1, 2 HAVING count(*) = 5 UNION ALL SELECT user_id, -1, 'too_few' FROM v_bars GROUP BY 1 HAVING count(*) < 60")
def wn8_duration_gate(spark, sf):
    """Series with too few rows give one failure row; windows of five rows are flagged by their length in seconds."""
    bars = v_bars(spark, sf).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
    tiles = bars.where("n >= 60").groupBy("user_id", F.expr("bar div 5").alias("w")).agg((F.max("end_sec") - F.min("start_sec")).alias("d"), F.count(F.lit(1)).alias("k")).where("k = 5")
    failed = bars.where("n < 60").select("user_id", F.lit(-1).cast("long").alias("w"), F.lit("too_few").alias("status")).distinct()
    return tiles.select("user_id", "w", F.when(F.col("d").between(40000, 110000), "ready").otherwise("duration").alias("status")).unionByName(failed)


@query("SELECT a.user_id, a.bar, greatest(count(b.bar), 1) AS rows FROM v_bars a LEFT JOIN v_bars b ON a.user_id = b.user_id AND b.bar >= a.bar AND b.end_sec <= a.start_sec + 100000 GROUP BY 1, 2")
def wn9_rows_in_budget(spark, sf):
    """How many rows from each on end within the budget: the boundaries after its start, counted over a range of time."""
    bars = v_bars(spark, sf)
    last = bars.groupBy("user_id").agg(F.max("end_sec").alias("t"), F.lit(None).cast("long").alias("bar"))
    boundaries = bars.select("user_id", "bar", F.col("start_sec").alias("t")).unionByName(last)
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(0, 100000)
    counted = boundaries.withColumn("rows", F.greatest(F.count(F.lit(1)).over(w) - 1, F.lit(1)))
    return counted.where("bar IS NOT NULL").select("user_id", "bar", "rows")


@query(f"SELECT user_id, event_id, t AS t0, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t), t) AS t1 FROM ({EVENTS_SQL}) WHERE event_type = 'click'")
def wn10_intervals_from_markers(spark, sf):
    w = Window.partitionBy("user_id").orderBy("t")
    return events(spark, sf).where("event_type = 'click'").select("user_id", "event_id", F.col("t").alias("t0"), F.coalesce(F.lead("t").over(w), F.col("t")).alias("t1"))


NUMBERED_SQL = "SELECT *, sum(head::INT) OVER (PARTITION BY user_id ORDER BY bar)::BIGINT AS grp FROM v_bars"


def numbered(spark, sf) -> DataFrame:
    return windows.islands(v_bars(spark, sf), "user_id", "bar", F.col("head"), "grp")


@query(f"SELECT user_id, bar, grp, row_number() OVER (PARTITION BY user_id, grp ORDER BY bar) - 1 AS place FROM ({NUMBERED_SQL})")
def wn11_group_numbering(spark, sf):
    """Group 0 holds the rows before the first head."""
    place = F.row_number().over(Window.partitionBy("user_id", "grp").orderBy("bar")) - 1
    return numbered(spark, sf).select("user_id", "bar", "grp", place.cast("long").alias("place"))


@query("SELECT user_id, bar, last_value(d IGNORE NULLS) OVER w AS carried, coalesce(last_value(d IGNORE NULLS) OVER w, first_value(d IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY bar ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM (SELECT *, CASE WHEN state IN ('view', 'purchase') THEN state END AS d FROM v_bars) WINDOW w AS (PARTITION BY user_id ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def wn12_carried_state(spark, sf):
    """The declaration in force at each row, with both rules for the rows before the first."""
    declared = F.when(F.col("state").isin("view", "purchase"), F.col("state"))
    once = windows.carried(v_bars(spark, sf), "user_id", "bar", declared, "carried")
    return windows.carried(once, "user_id", "bar", declared, "filled", before="first").select("user_id", "bar", "carried", "filled")


@query("SELECT user_id, bar, last_value(d IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS decision FROM (SELECT b.user_id, b.bar, s.state AS d FROM v_bars b LEFT JOIN v_bars s ON s.user_id = b.user_id AND s.bar = b.bar // 8 * 8 AND s.state <> 'error')")
def wn13_forward_fill(spark, sf):
    """A window's decision is spread to its rows; rows of windows without one take the last before."""
    bars = v_bars(spark, sf)
    decided = bars.where("bar % 8 = 0 AND state <> 'error'").select("user_id", F.col("state").alias("d"), F.explode(F.sequence("bar", F.col("bar") + 7)).alias("bar"))
    spread = bars.join(decided, ["user_id", "bar"], "left")
    return windows.carried(spread, "user_id", "bar", F.col("d"), "decision").select("user_id", "bar", "decision")


@query("SELECT user_id, min(bar) AS first, count(*) AS n FROM (SELECT *, bar - row_number() OVER (PARTITION BY user_id ORDER BY bar) AS island FROM v_bars WHERE state IN ('view', 'click')) GROUP BY user_id, island")
def wn14_islands(spark, sf):
    """Runs of flagged rows, cut where a row is not flagged."""
    flagged = F.col("state").isin("view", "click")
    cut = windows.islands(v_bars(spark, sf), "user_id", "bar", ~flagged)
    return cut.where(flagged).groupBy("user_id", "island").agg(F.min("bar").alias("first"), F.count(F.lit(1)).alias("n")).drop("island")


@query("""WITH c AS (SELECT user_id, bar, state, (state = 'error')::INT AS hole, (state = 'purchase')::INT AS event, sum((state = 'error')::INT) OVER w AS holes, sum((state = 'purchase')::INT) OVER w AS events FROM v_bars WINDOW w AS (PARTITION BY user_id ORDER BY bar)),
a AS (SELECT *, holes > lag(holes - hole) OVER w OR events - event > lag(events) OVER w AS cut FROM c WHERE state IN ('view', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY bar)),
n AS (SELECT *, sum(coalesce(cut, false)::INT) OVER (PARTITION BY user_id ORDER BY bar) AS chain FROM a)
SELECT user_id, chain::BIGINT AS chain, min(bar) AS first, max(bar) AS last, count(*) AS n FROM n GROUP BY 1, 2""")
def wn14_active_chains(spark, sf):
    """Chains of views and purchases, cut by errors, and by purchases between two active rows."""
    state = F.col("state")
    chains = windows.active_chains(v_bars(spark, sf), "user_id", "bar", state.isin("view", "purchase"), state == "error", state == "purchase")
    return chains.groupBy("user_id", "chain").agg(F.min("bar").alias("first"), F.max("bar").alias("last"), F.count(F.lit(1)).alias("n"))


FOLDED_SQL = "SELECT user_id, bar, CASE WHEN state IN ('view', 'signup') THEN 'v' ELSE 'c' END AS note, bar = 0 OR bar % (2 + user_id % 2) = user_id % 2 AS head FROM v_bars"


@query(f"""WITH b AS (SELECT *, sum(head::INT) OVER (PARTITION BY user_id ORDER BY bar) AS block FROM ({FOLDED_SQL})), k AS (SELECT user_id, block, string_agg(note, ',' ORDER BY bar) AS content FROM b GROUP BY 1, 2),
d AS (SELECT *, coalesce(content <> lag(content) OVER (PARTITION BY user_id ORDER BY block), true)::INT AS new FROM k), l AS (SELECT *, coalesce(sum(new) OVER (PARTITION BY user_id ORDER BY block DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM d)
SELECT b.user_id, b.bar, b.note FROM b JOIN l USING (user_id, block) WHERE NOT (new = 0 AND later = 0)""")
def wn16_trailing_blocks(spark, sf):
    """Series without the blocks of two or three rows at their end that repeat the block before."""
    bar, user = F.col("bar"), F.col("user_id")
    notes = v_bars(spark, sf).select("user_id", "bar", F.when(F.col("state").isin("view", "signup"), "v").otherwise("c").alias("note"))
    head = (bar == 0) | (F.pmod(bar, 2 + user % 2) == user % 2)
    return windows.without_trailing_repeats(notes, "user_id", "bar", head, ["note"])


EDGES = [("view", "click"), ("view", "view"), ("click", "purchase"), ("click", "view"), ("purchase", "view"), ("signup", "view"), ("view", "signup"), ("error", "view")]


@query("SELECT user_id, min(bar) AS bar, arg_min(reason, bar) AS reason FROM (SELECT user_id, bar, CASE WHEN bar = 0 AND state <> 'view' THEN 'start' WHEN nxt IS NOT NULL AND (state, nxt) NOT IN (" + ", ".join(map(str, EDGES)) + ") THEN 'step' END AS reason FROM (SELECT *, lead(state) OVER (PARTITION BY user_id ORDER BY bar) AS nxt FROM v_bars)) WHERE reason IS NOT NULL GROUP BY 1")
def wn15_grammar(spark, sf):
    """The first defect of each series: a wrong first state, or a step that is not in the table of edges."""
    edges = spark.createDataFrame(EDGES, "state string, nxt string").withColumn("allowed", F.lit(True))
    steps = v_bars(spark, sf).withColumn("nxt", F.lead("state").over(by_bar())).join(F.broadcast(edges), ["state", "nxt"], "left")
    reason = F.when((F.col("bar") == 0) & (F.col("state") != "view"), "start").when(F.col("nxt").isNotNull() & F.col("allowed").isNull(), "step")
    return steps.withColumn("reason", reason).where("reason IS NOT NULL").groupBy("user_id").agg(F.min_by("reason", "bar").alias("reason"), F.min("bar").alias("bar"))


BLOCK_SQL = "SELECT conv_id, turn, CASE WHEN turn >= 2 AND conv_id % 3 > 0 THEN 'tail' ELSE role END AS block FROM v_turns"


@query(f"SELECT conv_id, turn, block FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, later ORDER BY turn) AS place FROM (SELECT *, coalesce(sum(change) OVER (PARTITION BY conv_id ORDER BY turn DESC), 0) AS later FROM (SELECT *, (block <> lead(block) OVER (PARTITION BY conv_id ORDER BY turn))::INT AS change FROM ({BLOCK_SQL})))) WHERE later > 0 OR place = 1")
def wn16_trailing_repeats(spark, sf):
    """Of the last run of equal blocks only the first stays."""
    blocks = v_turns(spark, sf).select("conv_id", "turn", F.when((F.col("turn") >= 2) & (F.col("conv_id") % 3 > 0), "tail").otherwise(F.col("role")).alias("block"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    changed = blocks.withColumn("change", (F.col("block") != F.lead("block").over(w)).cast("int"))
    later = F.coalesce(F.sum("change").over(Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    runs = changed.withColumn("later", later).withColumn("place", F.row_number().over(Window.partitionBy("conv_id", "later").orderBy("turn")))
    return runs.where("later > 0 OR place = 1").select("conv_id", "turn", "block")


@query("SELECT user_id, bar, original, row_number() OVER (PARTITION BY user_id, original ORDER BY bar) AS occurrence, row_number() OVER (PARTITION BY user_id, original ORDER BY bar) > 1 AS is_repeat, chr((65 + falls)::INT) AS section FROM (SELECT *, coalesce(sum((original < prev)::INT) OVER (PARTITION BY user_id ORDER BY bar), 0) AS falls FROM (SELECT *, lag(original) OVER (PARTITION BY user_id ORDER BY bar) AS prev FROM (SELECT user_id, bar, bar % 9 AS original FROM v_bars)))")
def wn17_occurrences(spark, sf):
    """The how-manieth visit of its original each row is; the section advances where the number falls."""
    rows = v_bars(spark, sf).select("user_id", "bar", (F.col("bar") % 9).alias("original"))
    falls = rows.withColumn("prev", F.lag("original").over(by_bar())).withColumn("falls", F.coalesce(F.sum((F.col("original") < F.col("prev")).cast("int")).over(by_bar()), F.lit(0)))
    visit = F.row_number().over(Window.partitionBy("user_id", "original").orderBy("bar")).cast("long")
    return falls.withColumn("occurrence", visit).select("user_id", "bar", "original", "occurrence", (F.col("occurrence") > 1).alias("is_repeat"), F.char(F.col("falls") + 65).alias("section"))


HEADS = ("view", "click", "signup")


@query(f"SELECT user_id, g, n <= 4 AND grounded AND NOT (g = 0 AND user_id % 5 = 0) AND NOT (last AND user_id % 7 = 0) AND (first_state IN {HEADS} OR (g = 0 AND user_id % 3 = 1)) AND (last OR next_state IN {HEADS}) AS trusted FROM (SELECT *, lead(first_state) OVER w AS next_state, lead(g) OVER w IS NULL AS last FROM (SELECT user_id, bar // 4 AS g, count(*) AS n, bool_and(state <> 'error') AS grounded, arg_min(state, bar) AS first_state FROM v_bars GROUP BY 1, 2) WINDOW w AS (PARTITION BY user_id ORDER BY g))")
def wn18_trusted_intervals(spark, sf):
    """Not overfull, all events grounded, a grounded head at both ends, and no edge that a crop made.

    An opening pickup counts as a grounded start, and the last interval needs no head at its end. Some users' series stand for crops and pickups.
    """
    g = v_bars(spark, sf).groupBy("user_id", F.expr("bar div 4").alias("g")).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("state") != "error").alias("grounded"), F.min_by("state", "bar").alias("first_state"))
    w, user, first = Window.partitionBy("user_id").orderBy("g"), F.col("user_id"), F.col("g") == 0
    ends = g.withColumns({"following": F.lead("first_state").over(w), "last": F.lead("g").over(w).isNull()})
    cropped = (first & (user % 5 == 0)) | (F.col("last") & (user % 7 == 0))
    started = F.col("first_state").isin(*HEADS) | (first & (user % 3 == 1))
    trusted = (F.col("n") <= 4) & F.col("grounded") & ~cropped & started & (F.col("last") | F.col("following").isin(*HEADS))
    return ends.select("user_id", "g", trusted.alias("trusted"))


CLOCK_SQL = f"""i AS (SELECT *, (user_id + number) % 6 = 0 AS overfull, NOT (number = 0 AND user_id % 5 = 0) AS begin_known, NOT (number = max(number) OVER (PARTITION BY user_id) AND user_id % 7 = 0) AS end_known, number = max(number) OVER (PARTITION BY user_id) AS last FROM (SELECT user_id, bar // 3 AS number, min(start_sec) AS a, max(end_sec) AS b FROM v_bars GROUP BY 1, 2)),
e AS (SELECT user_id, t + CASE event_id % 10 WHEN 0 THEN 0.002 WHEN 1 THEN 0.0005 WHEN 2 THEN -0.0004 ELSE 0 END AS sec, event_type IN {HEADS} AS head, event_type <> 'error' AS grounded, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS place FROM ({EVENTS_SQL})),
n AS (SELECT i.user_id, i.number, bool_and(grounded) AS grounded, arg_min(place, sec) AS place FROM i JOIN e ON e.user_id = i.user_id AND e.sec >= i.a - 1e-3 AND e.sec < i.b - 1e-3 GROUP BY 1, 2),
clock AS (SELECT i.*, begin_known AND end_known AND NOT overfull AND coalesce(n.grounded, false) AND (EXISTS (SELECT 1 FROM e WHERE e.user_id = i.user_id AND head AND grounded AND abs(e.sec - i.a) <= 1e-3) OR (i.number = 0 AND coalesce(n.place > 0, false))) AND (last OR EXISTS (SELECT 1 FROM e WHERE e.user_id = i.user_id AND head AND grounded AND abs(e.sec - i.b) <= 1e-3)) AS trusted FROM i LEFT JOIN n ON n.user_id = i.user_id AND n.number = i.number)"""


def clock_tables(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Intervals of three bars, and the events as beats, some of which lie a little off the intervals' edges."""
    groups = v_bars(spark, sf).groupBy("user_id", F.expr("bar div 3").alias("number")).agg(F.min("start_sec").alias("begin"), F.max("end_sec").alias("end"))
    last = F.col("number") == F.max("number").over(Window.partitionBy("user_id"))
    user, number, event = F.col("user_id"), F.col("number"), F.col("event_id") % 10
    intervals = groups.withColumns({"overfull": (user + number) % 6 == 0, "begin_known": ~((number == 0) & (user % 5 == 0)), "end_known": ~(last & (user % 7 == 0))})
    shift = F.when(event == 0, 0.002).when(event == 1, 0.0005).when(event == 2, -0.0004).otherwise(0.0)
    kind = F.col("event_type")
    beats = events(spark, sf).select("user_id", (F.col("t") + shift).alias("sec"), kind.isin(*HEADS).alias("head"), (kind != "error").alias("grounded"), F.when(F.col("event_id") % 3 == 0, 1).otherwise(0).alias("place"))
    return intervals, beats


def clock(spark, sf) -> DataFrame:
    return timeline.trusted_intervals(*clock_tables(spark, sf), "user_id")


@query(f"WITH {CLOCK_SQL} SELECT user_id, number, trusted FROM clock")
def wn18_trusted_clock(spark, sf):
    """Intervals whose events are grounded, found by the interval join, and whose edges carry grounded heads, found by the tolerance join."""
    return clock(spark, sf).select("user_id", "number", "trusted")


@query("SELECT o_orderkey, CASE WHEN n = want THEN 'exact' WHEN n = want + 1 AND o_orderstatus = 'F' THEN 'added' ELSE 'skip' END AS verdict, n - want AS difference FROM (SELECT o_orderkey, o_orderstatus, 1 + o_orderkey % 7 AS want, coalesce(n, 0) AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)")
def wn19_count_alignment(spark, sf):
    """Equal counts are exact; one too many at a terminal row adds an interval; all else is skipped with its difference."""
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    both = table(spark, sf, "orders").join(counts, "o_orderkey", "left").withColumns({"want": 1 + F.col("o_orderkey") % 7, "n": F.coalesce("n", F.lit(0))})
    verdict = F.when(F.col("n") == F.col("want"), "exact").when((F.col("n") == F.col("want") + 1) & (F.col("o_orderstatus") == "F"), "added").otherwise("skip")
    return both.select("o_orderkey", verdict.alias("verdict"), (F.col("n") - F.col("want")).alias("difference"))


@query(f"SELECT user_id, string_agg(coalesce(s, '.'), '' ORDER BY bar) AS piece, count_if(s IS NULL)::BIGINT AS unfilled FROM (SELECT b.user_id, b.bar, CASE WHEN t.keep_from IS NOT NULL THEN substr(b.state, 1, 1) END AS s FROM v_bars b LEFT JOIN (SELECT * FROM ({TILES_SQL}) WHERE keep_from // 16 % 3 <> 1) t ON t.user_id = b.user_id AND b.bar >= t.keep_from AND b.bar < t.keep_from + t.keep_count) GROUP BY 1")
def wn20_assembly(spark, sf):
    """A piece put together from the windows that keep its rows; rows of lost windows get a filler."""
    bars, counts = v_bars(spark, sf), bar_counts(spark, sf)
    kept = windows.tiling(counts, "user_id", "n", 16).where("keep_from div 16 % 3 <> 1").select("user_id", F.explode(F.sequence("keep_from", F.col("keep_from") + F.col("keep_count") - 1)).alias("bar"))
    filled = kept.join(bars.select("user_id", "bar", F.left("state", F.lit(1)).alias("s")), ["user_id", "bar"])
    spine = counts.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("bar"))
    rows = spine.join(filled, ["user_id", "bar"], "left").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("bar", F.coalesce("s", F.lit(".")).alias("s")))).alias("a"), F.count_if(F.col("s").isNull()).alias("unfilled"))
    return rows.select("user_id", F.array_join(F.transform("a", lambda x: x["s"]), "").alias("piece"), "unfilled")


# Joins on time ----------------------------------------------------------------------------------


@query(f"SELECT e.user_id, g, count(*) AS n, round(sum(value) + 1e-9, 4) AS total FROM ({EVENTS_SQL}) e JOIN ({GROUPS_SQL}) g ON e.user_id = g.user_id AND e.t >= g.t0 AND e.t < g.t1 GROUP BY 1, 2")
def jn11_interval_join(spark, sf):
    placed = timeline.in_intervals(events(spark, sf), groups(spark, sf), "user_id", "t", "t0", "t1", "g")
    return placed.where("g IS NOT NULL").groupBy("user_id", "g").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value") + 1e-9, 4).alias("total"))


@query(f"SELECT e.event_id, g, abs(e.t - g.t0) < 1e-3 AS at_start FROM ({EVENTS_SQL}) e JOIN ({GROUPS_SQL}) g ON e.user_id = g.user_id AND abs(e.t - g.t0) <= 3000")
def jn12_tolerance_join(spark, sf):
    pairs = timeline.near(events(spark, sf), groups(spark, sf).select("user_id", "g", "t0"), "user_id", "t", "t0", 3000.0)
    return pairs.select("event_id", "g", (F.abs(F.col("t") - F.col("t0")) < 1e-3).alias("at_start"))


def asof_sql(grid: str, lead: float) -> str:
    """Rows of the grid with their segment: the last purchase at or before them, or the first one if it is less than `lead` later."""
    points = f"SELECT user_id, t, value, lead(t) OVER w AS t1, lead(value) OVER w AS v1, row_number() OVER w = 1 AS opening FROM ({EVENTS_SQL}) WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY t)"
    held = f"SELECT g.user_id, g.t, CASE WHEN b.t IS NULL THEN o.t ELSE b.t END AS st, CASE WHEN b.t IS NULL THEN o.value ELSE b.value END AS sv, CASE WHEN b.t IS NULL THEN o.t1 ELSE b.t1 END AS t1, CASE WHEN b.t IS NULL THEN o.v1 ELSE b.v1 END AS v1 FROM ({grid}) g ASOF LEFT JOIN ({points}) b ON g.user_id = b.user_id AND g.t >= b.t LEFT JOIN (SELECT * FROM ({points}) WHERE opening) o ON o.user_id = g.user_id AND o.t - g.t < {lead} AND o.t > g.t"
    return f"SELECT user_id, t, t1 IS NOT NULL AS valid, round(sv + (v1 - sv) / (t1 - st) * (t - st) + 1e-9, 6) AS value, (v1 - sv) / (t1 - st) AS rate FROM ({held})"


def frames_sql(step: int) -> str:
    return f"SELECT user_id, k AS frame, k * {step}.0::DOUBLE AS t FROM (SELECT user_id, unnest(range(floor(max(t) / {step})::BIGINT + 1)) AS k FROM ({EVENTS_SQL}) GROUP BY 1)"


def grid(spark, sf, step: int) -> DataFrame:
    """Every frame of each user's series, from 0 to that of its last event."""
    ends = events(spark, sf).groupBy("user_id").agg(F.floor(F.max("t") / step).alias("end")).where("end >= 0")
    return ends.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("end").cast("long"))).alias("frame")).withColumn("t", F.col("frame") * float(step))


@query(f"SELECT user_id, t, valid, value, round({2 * math.pi} * rate * 1e6, 6) AS rate, round({2 * math.pi} * value, 4) AS phase FROM ({asof_sql(frames_sql(10000), 5000.0)})")
def jn13_asof_interpolation(spark, sf):
    """The value at every frame with the angular rate (in millionths) and phase; the first point's frame may begin up to half a frame before it."""
    points = events(spark, sf).where("event_type = 'purchase'").select("user_id", "t", "value")
    found = timeline.interpolated(grid(spark, sf, 10000).select("user_id", "t"), points, "user_id", "t", "value", 5000.0)
    value = r6(F.col("value") + 1e-9)
    return found.select("user_id", "t", "valid", value.alias("value"), r6(2 * math.pi * F.col("rate") * 1e6).alias("rate"), F.round(2 * math.pi * value, 4).alias("phase"))


@query()
def jn14_greedy_match(spark, sf):
    """Clicks against purchases of each user, within three hours."""
    sides = events(spark, sf).where("event_type IN ('click', 'purchase')").select("user_id", F.when(F.col("event_type") == "click", "p").otherwise("t").alias("side"), F.col("t").alias("time"), F.col("event_id").alias("place"))
    matched = timeline.match_events(sides, "user_id", 10800.0)
    return matched.withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@query(f"WITH c AS (SELECT * FROM ({EVENTS_SQL}) WHERE event_type = 'click'), p AS (SELECT * FROM ({EVENTS_SQL}) WHERE event_type = 'purchase') SELECT user_id, count_if(kind = 'c')::BIGINT AS predicted, count_if(kind = 'c' AND hit)::BIGINT AS hits, count_if(kind = 'p')::BIGINT AS targets, count_if(kind = 'p' AND hit)::BIGINT AS found FROM (SELECT user_id, 'c' AS kind, EXISTS (SELECT 1 FROM p WHERE p.user_id = c.user_id AND abs(p.t - c.t) <= 10800) AS hit FROM c UNION ALL SELECT user_id, 'p', EXISTS (SELECT 1 FROM c WHERE p.user_id = c.user_id AND abs(p.t - c.t) <= 10800) FROM p) GROUP BY 1")
def jn15_tolerance_counts(spark, sf):
    """Predictions near any target and targets near any prediction."""
    both = events(spark, sf).where("event_type IN ('click', 'purchase')")
    return timeline.tolerance_counts(both, "user_id", "t", "event_type", ("click", "purchase"), 10800.0)


# Time series ------------------------------------------------------------------------------------


@query("SELECT piece, frame, round(avg(x) + 1e-9, 6) AS x, count(*) AS n FROM (SELECT vec_id // 4 AS piece, vec_id % 4 * 32 + pos - 1 AS frame, x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)) GROUP BY 1, 2")
def ts1_overlap_average(spark, sf):
    """Frames of windows that overlap by half, averaged."""
    frames = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    placed = frames.select(F.expr("vec_id div 4").alias("piece"), (F.col("vec_id") % 4 * 32 + F.col("pos")).alias("frame"), F.col("x").cast("double").alias("x"))
    return placed.groupBy("piece", "frame").agg(r6(F.avg("x") + 1e-9).alias("x"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT vec_id, round(sum(e * cos(a)) / sum(e), 6) AS c, round(sum(e * sin(a)) / sum(e), 6) AS s FROM (SELECT vec_id, exp(x::DOUBLE) AS e, {2 * math.pi} * (pos - 1) / 64 AS a FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)) GROUP BY 1")
def ts2_circular_moment(spark, sf):
    """Mean cosine and sine under the softmax of a vector, by array functions inside the row."""
    v = F.transform("embedding", lambda x, k: F.struct(F.exp(x.cast("double")).alias("e"), (k * (2 * math.pi) / 64).alias("a")))
    total = lambda f: F.aggregate("v", F.lit(0.0), lambda s, x: s + f(x))
    rows = table(spark, sf, "embeddings").select("vec_id", v.alias("v"))
    return rows.select("vec_id", *(r6(total(lambda x, f=f: x["e"] * f(x["a"])) / total(lambda x: x["e"])).alias(n) for f, n in ((F.cos, "c"), (F.sin, "s"))))


CENTRED_SQL = f"SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS k, value - 10 AS im, 12 - value AS re FROM ({EVENTS_SQL})"


@query(f"SELECT DISTINCT user_id, round_even(k + f, 0)::BIGINT AS frame FROM (SELECT user_id, k, re, re1, -im / (im1 - im) AS f FROM (SELECT *, lead(im) OVER w AS im1, lead(re) OVER w AS re1 FROM ({CENTRED_SQL}) WINDOW w AS (PARTITION BY user_id ORDER BY k)) WHERE im <= 0 AND im1 > 0) WHERE re + (re1 - re) * f > 0")
def ts3_zero_crossings(spark, sf):
    """Frames where the imaginary part rises through zero while the real part between is positive."""
    w = Window.partitionBy("user_id").orderBy("t")
    x = events(spark, sf).select("user_id", "t", (F.row_number().over(w) - 1).alias("k"), (F.col("value") - 10).alias("im"), (12 - F.col("value")).alias("re"))
    x = x.withColumns({"im1": F.lead("im").over(w), "re1": F.lead("re").over(w)}).where("im <= 0 AND im1 > 0").withColumn("f", -F.col("im") / (F.col("im1") - F.col("im")))
    return x.where("re + (re1 - re) * f > 0").select("user_id", F.rint(F.col("k") + F.col("f")).cast("long").alias("frame")).distinct()


@query("WITH RECURSIVE kept AS (SELECT user_id, min(start_sec) AS start_sec FROM v_bars GROUP BY 1 UNION ALL SELECT user_id, t FROM (SELECT k.user_id, min(b.start_sec) AS t FROM kept k JOIN v_bars b ON b.user_id = k.user_id AND b.start_sec - k.start_sec >= 30000 GROUP BY k.user_id, k.start_sec)) SELECT user_id, start_sec FROM kept")
def ts4_thinning(spark, sf):
    return reach.thin(v_bars(spark, sf), "user_id", "start_sec", 30000.0, kept)


FRAMES_SQL = frames_sql(50000)


@query(f"SELECT f.user_id, f.frame, a.valid, a.value FROM ({FRAMES_SQL}) f JOIN ({asof_sql(FRAMES_SQL, 25000.0)}) a ON a.user_id = f.user_id AND a.t = f.t")
def ts5_frame_grid(spark, sf):
    """Every frame of a series with its interpolated value and validity."""
    points = events(spark, sf).where("event_type = 'purchase'").select("user_id", "t", "value")
    dense = timeline.interpolated(grid(spark, sf, 50000).select("user_id", "t"), points, "user_id", "t", "value", 25000.0)
    return dense.select("user_id", F.rint(F.col("t") / 50000).cast("long").alias("frame"), "valid", r6(F.col("value") + 1e-9).alias("value"))


@query(f"SELECT user_id, bar, round(cycle, 6) AS cycle, round(cos({2 * math.pi} * cycle), 5) AS c FROM (SELECT b.user_id, b.bar, g.g + (b.start_sec - g.t0) / (g.t1 - g.t0) AS cycle FROM v_bars b JOIN ({GROUPS_SQL}) g ON g.user_id = b.user_id AND b.start_sec >= g.t0 AND b.start_sec < g.t1)")
def ts6_cycle_fraction(spark, sf):
    """One cycle for each interval of eight bars; a bar's place in it as a fraction."""
    span = Window.partitionBy("user_id", "g")
    placed = v_bars(spark, sf).withColumn("g", F.expr("bar div 8"))
    t0, t1 = F.min("start_sec").over(span), F.max("end_sec").over(span)
    cycle = placed.withColumn("cycle", F.col("g") + (F.col("start_sec") - t0) / (t1 - t0))
    return cycle.select("user_id", "bar", r6("cycle").alias("cycle"), F.round(F.cos(F.col("cycle") * (2 * math.pi)), 5).alias("c"))


CYCLES_SQL = f"""{CLOCK_SQL}, p AS (SELECT user_id, bar, start_sec, end_sec, bar + CASE WHEN user_id % 9 = 4 THEN 0.05 ELSE 0 END AS cycle, bar = max(bar) OVER (PARTITION BY user_id) AS final FROM v_bars),
anchor AS (SELECT c.user_id, min(e.sec) AS sec, arg_min(place, e.sec) AS place FROM clock c JOIN e ON e.user_id = c.user_id AND e.sec >= c.a AND e.sec < c.b WHERE c.number = 0 GROUP BY 1),
anchored AS (SELECT n.user_id, n.place, CASE WHEN p.final THEN p.cycle ELSE p.cycle + (n.sec - p.start_sec) / (p.end_sec - p.start_sec) END AS cycle FROM anchor n JOIN p ON p.user_id = n.user_id AND n.sec >= p.start_sec AND n.sec < p.end_sec),
edge AS (SELECT c.*, CASE WHEN c.number = 0 AND n.place > 0 THEN n.cycle - n.place ELSE f.cycle END AS lo, CASE WHEN c.last THEN l.cycle + 1 ELSE l.cycle END AS hi FROM clock c JOIN p f ON f.user_id = c.user_id AND f.start_sec = c.a JOIN p l ON l.user_id = c.user_id AND (CASE WHEN c.last THEN l.final ELSE l.start_sec = c.b END) LEFT JOIN anchored n ON n.user_id = c.user_id),
cycles AS (SELECT *, round_even(lo, 0)::BIGINT AS low, (round_even(hi, 0) - round_even(lo, 0))::BIGINT AS span, CASE WHEN trusted AND (abs(lo - round_even(lo, 0)) > 0.01 OR abs(hi - round_even(hi, 0)) > 0.01) THEN 'off_grid' WHEN trusted AND round_even(hi, 0) <= round_even(lo, 0) THEN 'no_span' END AS violation FROM edge)"""


def cycle_tables(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The clock's intervals with their cycles, and the grid: a cycle for each bar, off by a twentieth for some users."""
    points = v_bars(spark, sf).select("user_id", F.col("start_sec").alias("sec"), (F.col("bar") + F.when(F.col("user_id") % 9 == 4, 0.05).otherwise(0.0)).alias("cycle"))
    intervals, beats = clock_tables(spark, sf)
    return timeline.interval_cycles(timeline.trusted_intervals(intervals, beats, "user_id"), beats, points, "user_id"), points


@query(f"WITH {CYCLES_SQL} SELECT user_id, number, low, span, trusted, violation FROM cycles")
def ts6_interval_cycles(spark, sf):
    """Where intervals begin in whole cycles and what they span, with pickups, a closing edge and edges off the grid."""
    return cycle_tables(spark, sf)[0].select("user_id", "number", "low", "span", "trusted", "violation")


@query(f"WITH {CYCLES_SQL}, f AS (SELECT f.user_id, f.t, CASE WHEN p.user_id IS NULL THEN CASE WHEN f.t < s.t0 THEN s.c0 ELSE s.c1 END WHEN p.final THEN p.cycle ELSE p.cycle + (f.t - p.start_sec) / (p.end_sec - p.start_sec) END AS cycle FROM ({frames_sql(10000)}) f JOIN (SELECT user_id, min(start_sec) AS t0, arg_min(cycle, start_sec) AS c0, arg_max(cycle, start_sec) AS c1 FROM p GROUP BY 1) s USING (user_id) LEFT JOIN p ON p.user_id = f.user_id AND f.t >= p.start_sec AND f.t < p.end_sec) SELECT f.user_id, f.t, coalesce(c.number, 0) AS number, round(CASE WHEN coalesce(c.trusted, z.trusted) AND coalesce(c.violation, CASE WHEN c.user_id IS NULL THEN z.violation END) IS NULL THEN (f.cycle - coalesce(c.low, z.low)) / coalesce(c.span, z.span) ELSE 0 END, 6) AS fraction FROM f ASOF LEFT JOIN cycles c ON c.user_id = f.user_id AND f.t >= c.a JOIN cycles z ON z.user_id = f.user_id AND z.number = 0")
def ts6_cycle_curve(spark, sf):
    """How far each frame is through its interval, in cycles of the grid instead of seconds."""
    cycles, points = cycle_tables(spark, sf)
    frames = grid(spark, sf, 10000).select("user_id", F.col("t").alias("sec"))
    return timeline.cycle_curve(frames, cycles, points, "user_id").select("user_id", F.col("sec").alias("t"), "number", r6("fraction").alias("fraction"))


@query(f"WITH e AS (SELECT user_id, floor(t / 50000)::BIGINT AS frame, bool_or(event_type = 'purchase') AS hit, bool_or(event_type = 'error') AS bad FROM ({EVENTS_SQL}) GROUP BY 1, 2) SELECT f.user_id, f.frame, coalesce(hit, false)::INT AS target, (NOT coalesce(bad, false))::INT AS weight FROM ({FRAMES_SQL}) f LEFT JOIN e USING (user_id, frame)")
def ts7_event_targets(spark, sf):
    """0 or 1 for each frame, and no weight where the frame holds an error."""
    seen = events(spark, sf).groupBy("user_id", F.floor(F.col("t") / 50000).alias("frame")).agg(F.bool_or(F.col("event_type") == "purchase").alias("hit"), F.bool_or(F.col("event_type") == "error").alias("bad"))
    frames = grid(spark, sf, 50000).select("user_id", "frame").join(seen, ["user_id", "frame"], "left")
    return frames.select("user_id", "frame", F.coalesce("hit", F.lit(False)).cast("int").alias("target"), (~F.coalesce("bad", F.lit(False))).cast("int").alias("weight"))


@query(f"WITH {CLOCK_SQL}, h AS (SELECT DISTINCT user_id, floor(t / 50000)::BIGINT AS frame FROM ({EVENTS_SQL}) WHERE event_type = 'purchase') SELECT f.user_id, f.frame, (h.frame IS NOT NULL)::INT AS target, coalesce(c.trusted, true)::INT AS weight FROM ({FRAMES_SQL}) f LEFT JOIN h ON h.user_id = f.user_id AND h.frame = f.frame LEFT JOIN clock c ON c.user_id = f.user_id AND f.t >= c.a AND f.t < c.b")
def ts7_trusted_targets(spark, sf):
    """0 or 1 for each frame, and no weight where the frame begins in an interval that isn't trusted."""
    hits = events(spark, sf).where("event_type = 'purchase'").select("user_id", F.floor(F.col("t") / 50000).alias("frame"), F.lit(1).alias("target")).distinct()
    spans = clock(spark, sf).select("user_id", "begin", "end", "trusted")
    frames = timeline.in_intervals(grid(spark, sf, 50000), spans, "user_id", "t", "begin", "end", "trusted")
    return frames.join(hits, ["user_id", "frame"], "left").select("user_id", "frame", F.coalesce("target", F.lit(0)).alias("target"), F.coalesce("trusted", F.lit(True)).cast("int").alias("weight"))


@query(f"SELECT user_id, bar, coalesce(c.id + place, -100) AS class FROM (SELECT user_id, bar, row_number() OVER (PARTITION BY user_id, grp ORDER BY bar) - 1 AS place, count(*) OVER (PARTITION BY user_id, grp) AS n FROM ({NUMBERED_SQL})) LEFT JOIN (VALUES (2, 0), (3, 2), (4, 5), (6, 9)) c(n, id) USING (n)")
def ts8_position_classes(spark, sf):
    """The class of a row's place in its group, where a cycle of the group's size is known."""
    known = spark.createDataFrame([(2, 0), (3, 2), (4, 5), (6, 9)], "n long, id long")
    w = Window.partitionBy("user_id", "grp")
    placed = numbered(spark, sf).withColumns({"place": (F.row_number().over(w.orderBy("bar")) - 1).cast("long"), "n": F.count(F.lit(1)).over(w)})
    return placed.join(F.broadcast(known), "n", "left").select("user_id", "bar", F.coalesce(F.col("id") + F.col("place"), F.lit(-100)).alias("class"))


@query("SELECT user_id, (hour + d + 24) % 24 AS class, round(sum((1 - abs(d) * 0.25) / 4), 6) AS weight FROM (SELECT user_id, hour(ts) AS hour FROM events), (SELECT unnest(range(-3, 4)) AS d) GROUP BY 1, 2")
def ts9_circular_blur(spark, sf):
    """Each hour's weight is spread over its neighbours, 1, .75, .5 and .25, around the clock. Hours are counted first."""
    hours = table(spark, sf, "events").groupBy("user_id", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("k"))
    spread = hours.withColumn("d", F.explode(F.sequence(F.lit(-3).cast("long"), F.lit(3).cast("long"))))
    return spread.groupBy("user_id", F.pmod(F.col("hour") + F.col("d"), F.lit(24)).alias("class")).agg(r6(F.sum(F.col("k") * (1 - F.abs("d") * 0.25) / 4)).alias("weight"))


STATES = ["click", "error", "purchase", "signup", "view"]
GAINS_SQL = ", ".join(f"round_even(ln(1 + count_if(event_type = '{s}')::DOUBLE) * 1073741824, 0)::BIGINT" for s in STATES)


@query(f"""WITH RECURSIVE g AS (SELECT user_id, floor(t / 86400)::BIGINT AS day, row_number() OVER (PARTITION BY user_id ORDER BY day) AS n, [{GAINS_SQL}] AS gain FROM ({EVENTS_SQL}) GROUP BY user_id, day),
f AS (SELECT user_id, n, gain AS total, [1, 2, 3, 4, 5]::BIGINT[] AS back FROM g WHERE n = 1 UNION ALL
SELECT g.user_id, g.n, list_transform([1, 2, 3, 4, 5], lambda s: greatest(f.total[s], list_max(f.total) - 858993459) + g.gain[s]), list_transform([1, 2, 3, 4, 5], lambda s: CASE WHEN list_max(f.total) - 858993459 > f.total[s] THEN list_position(f.total, list_max(f.total)) ELSE s END) FROM f JOIN g ON g.user_id = f.user_id AND g.n = f.n + 1),
b AS (SELECT user_id, max(n) AS n, arg_max(list_position(total, list_max(total)), n) AS s FROM f GROUP BY 1 UNION ALL SELECT b.user_id, b.n - 1, f.back[b.s] FROM b JOIN f ON f.user_id = b.user_id AND f.n = b.n WHERE b.n > 1)
SELECT b.user_id, g.day, {STATES}[b.s] AS state FROM b JOIN g ON g.user_id = b.user_id AND g.n = b.n""")
def ts10_sticky_path(spark, sf):
    """The best path of event types over a user's days, with ln(1 + count) for evidence."""
    days = events(spark, sf).groupBy("user_id", F.floor(F.col("t") / 86400).alias("day")).pivot("event_type", STATES).agg(F.count(F.lit(1)))
    evidence = days.select("user_id", "day", *(F.log1p(F.coalesce(F.col(s), F.lit(0)).cast("double")).alias(s) for s in STATES))
    return paths.steady_states(evidence, "user_id", "day", STATES, 0.8, kept)


@query(f"SELECT floor(t / 86400)::BIGINT AS day, event_type, round(max(value / 10) + ln(sum(exp(value / 10)) / exp(max(value / 10))), 6) AS evidence FROM ({EVENTS_SQL}) GROUP BY 1, 2")
def ts11_log_evidence(spark, sf):
    """ln of a sum of exponentials, by steps of the exponent."""
    e = events(spark, sf).select(F.floor(F.col("t") / 86400).alias("day"), "event_type", (F.col("value") / 10).alias("x"))
    return timeline.log_sum_exp(e, ["day", "event_type"], "x", "evidence").withColumn("evidence", r6("evidence"))


@query("SELECT user_id, bar, floor(start_sec * 62.5)::BIGINT AS floor_frame, round_even(end_sec * 62.5, 0)::BIGINT AS near_frame, round(floor(start_sec * 62.5) / 62.5, 4) AS back FROM v_bars")
def ts12_frames(spark, sf):
    """Seconds to frames at 62.5 a second, cut off and rounded to even, and back."""
    floor = F.floor(F.col("start_sec") * 62.5)
    return v_bars(spark, sf).select("user_id", "bar", floor.alias("floor_frame"), F.rint(F.col("end_sec") * 62.5).cast("long").alias("near_frame"), F.round(floor / 62.5, 4).alias("back"))

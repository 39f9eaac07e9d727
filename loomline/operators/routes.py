"""Which source rows each position of a recording plays: one route for each recording, from several kinds of evidence, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words by which tables of adjudications and results name things.
APPROVED, DROPPING = "user_approved", "drop_official_positions"
OFFICIAL, ADJUSTED, FALLBACK, WRITTEN = "official", "user_approved_official_adjustment", "user_approved_fallback", "source_written_unaligned"


def candidate_routes(count: Column, expanded: Column, pickup: Column, wanted: Column) -> Column:
    """(label, route) of the written order and of the expanded one, without an opening pickup, where they have the wanted length; equal routes count once, as written."""
    bare = lambda r: F.when(pickup & (F.get(r, F.lit(0)) == 0), F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0)))).otherwise(r)
    none = F.array().cast("array<bigint>")
    written = bare(F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(none))
    played = bare(F.coalesce(expanded, none))
    one = lambda label, r: F.struct(F.lit(label).alias("label"), r.alias("route"))
    fits = F.array(F.struct(F.size(written) == wanted, one("written", written).alias("c")), F.struct(expanded.isNotNull() & (F.size(played) == wanted) & ~((F.size(written) == wanted) & (written == played)), one("expanded", played).alias("c")))
    return F.transform(F.filter(fits, lambda x: x["col1"]), lambda x: x["c"])


def resolved_routes(df: DataFrame, fallback: bool) -> DataFrame:
    """Adds provenance, groups, pickup_inserted, undefined and violation to recordings; where there is a violation, groups and undefined are null.

    `df` has official (array of arrays of ordinals, or null), adjudication (struct of status, operation, drops, route and evidence, a map from position
    to the group expected there; or null), aligned, wanted (how many downbeats the score has), count (source rows), expanded (the route with repeats, or null), pickup,
    downbeats (times) and undefined_times. Adjudications count only with `fallback`. Order of evidence: the official map, less the positions an
    adjudication drops; the adjudicated route; the only candidate of the wanted length, if the recording is aligned; the written order. A pickup
    that the first group lacks is put in front, and an undefined time is the position whose downbeat is the last one up to it, or the first position.
    """
    a, official, count = F.col("adjudication"), F.col("official"), F.col("count")
    use = a.isNotNull() if fallback else F.lit(False)
    has, approved, drops = official.isNotNull(), a["status"] == APPROVED, a["drops"]
    candidates = candidate_routes(count, F.col("expanded"), F.col("pickup"), F.col("wanted"))
    single = lambda r: F.transform(r, lambda x: F.array(x))
    remaining = F.filter(official, lambda g, i: ~F.array_contains(drops, i.cast("long")))
    written = F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<bigint>"))
    aligned = F.coalesce(F.col("aligned"), F.lit(False))
    groups = F.when(has & use, remaining).when(has, official).when(use, single(a["route"])).when(aligned, single(F.get(candidates, F.lit(0))["route"])).otherwise(single(written))
    provenance = F.when(has & use, ADJUSTED).when(has, OFFICIAL).when(use, FALLBACK).when(aligned, F.get(candidates, F.lit(0))["label"]).otherwise(WRITTEN)
    changed = F.exists(F.map_entries(F.coalesce(a["evidence"], F.create_map().cast("map<bigint,array<bigint>>"))), lambda e: F.array_contains(drops, e["key"]) & ~F.get(official, e["key"].cast("int")).eqNullSafe(e["value"]))
    before = (
        F.when(use & ~F.coalesce(approved, F.lit(False)), "not_approved")
        .when(has & use & ~F.coalesce(a["operation"] == DROPPING, F.lit(False)), "unsupported_operation")
        .when(has & use & (drops.isNull() | F.exists(drops, lambda i: i.isNull())), "invalid_drops")
        .when(has & use & F.exists(drops, lambda i: (i < 0) | (i >= F.size(official))), "drop_out_of_range")
        .when(has & use & changed, "evidence_changed")
        .when(~has & use & (a["route"].isNull() | F.exists(a["route"], lambda i: i.isNull())), "no_route")
        .when(~has & ~use & aligned & (F.size(candidates) != 1), F.when(F.size(candidates) == 0, "no_candidate").otherwise("ambiguous_route"))
    )
    rows = df.withColumns({"provenance": provenance, "groups": groups, "violation": before})
    empty = F.exists("groups", lambda g: F.size(g) == 0)
    outside = F.exists("groups", lambda g: F.exists(g, lambda x: (x < 0) | (x >= F.col("count"))))
    rows = rows.withColumn("violation", F.coalesce("violation", F.when(empty, "empty_group").when(outside, "ordinal_out_of_range")))
    fine = F.col("violation").isNull()
    inserted = F.col("pickup") & (F.size("groups") > 0) & ~F.array_contains(F.get("groups", F.lit(0)), 0)
    rows = rows.withColumn("pickup_inserted", F.when(fine, F.coalesce(inserted, F.lit(False))))
    rows = rows.withColumn("groups", F.when(fine, F.when(F.col("pickup_inserted"), F.concat(F.array(F.array(F.lit(0).cast("long"))), F.col("groups"))).otherwise(F.col("groups"))))
    upto = lambda t: F.size(F.filter("downbeats", lambda d: d <= t))
    places = F.transform("undefined_times", lambda t: F.when(upto(t) == 0, 0).otherwise(upto(t) - 1 + F.col("pickup_inserted").cast("int")))
    return rows.withColumn("undefined", F.when(fine, F.array_sort(F.array_distinct(F.filter(places, lambda p: p < F.size("groups"))))))

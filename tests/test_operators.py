"""Guards that have to fail, sequential operators against plain versions, and properties of windows and draws."""

import random

import pytest
from pyspark.sql import functions as F

from loomline import sources
from loomline.operators import checks, resample, timeline, windows
from loomline.operators.scores import fill_inventory
from loomline.plans.q_rows import parse_cells, range_shard
from loomline.plans.q_scores import remaining_tasks


def test_duplicates_and_missing_keys_are_violations(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long")
    assert {r.k for r in checks.duplicate_keys(df, "k").collect()} == {1, None}
    with pytest.raises(checks.CheckFailed):
        checks.assert_empty(checks.duplicate_keys(df, "k"), "keys")


def test_ranges(spark):
    df = spark.createDataFrame([(0.5,), (1.1,), (-0.1,), (float("nan"),), (float("inf"),), (None,), (1 + 5e-10,)], "x double")
    assert checks.out_of_range(df, ("x",)).count() == 4


@pytest.mark.parametrize("lines", [['{"k": 1}', '{"k": 1}'], ['{"k": 1}', "{oops"], ['{"j": 1}']])
def test_strict_jsonl_rejects(spark, tmp_path, lines):
    (tmp_path / "a.jsonl").write_text("\n\n".join(lines))
    with pytest.raises(checks.CheckFailed):
        sources.read_strict_jsonl(spark, str(tmp_path), "k long", "k").collect()


def test_json_documents(spark, tmp_path):
    (tmp_path / "array.json").write_text('[\n {"id": "a", "n": 1},\n {"id": "b", "n": 2}\n]')
    (tmp_path / "keyed.json").write_text('{\n "a": {"n": 1},\n "b": {"n": 2}\n}')
    assert sorted(map(tuple, sources.read_json_array(spark, str(tmp_path / "array.json"), "id string, n long").collect())) == [("a", 1), ("b", 2)]
    assert sorted(map(tuple, sources.read_keyed_json(spark, str(tmp_path / "keyed.json"), "n long").collect())) == [("a", 1), ("b", 2)]


def test_keyed_directory(spark, tmp_path):
    (tmp_path / "one_mv.json").write_text('{"x": 1}')
    (tmp_path / "two_mv.json").write_text('{"x": 2}')
    (tmp_path / "other.json").write_text('{"x": 3}')
    rows = sources.read_keyed_directory(spark, str(tmp_path), "x long", r"([^/]+)_mv\.json$", "*_mv.json").collect()
    assert {(r.key, r.x) for r in rows} == {("one", 1), ("two", 2)}


def test_headers_are_demanded(spark, tmp_path):
    (tmp_path / "list.txt").write_text("title\na\n")
    with pytest.raises(checks.CheckFailed):
        sources.read_name_list(spark, str(tmp_path / "list.txt"))
    (tmp_path / "t.csv").write_text("a,b\n1,2\n")
    with pytest.raises(checks.CheckFailed):
        sources.read_dirty_csv(spark, str(tmp_path / "t.csv"), {"a": "int", "c": "int"})


def test_publish_refuses_an_existing_target(spark, tmp_path):
    df = spark.range(3)
    assert sources.publish(df, str(tmp_path / "t")).count() == 3
    with pytest.raises(Exception, match="already exists"):
        sources.publish(df, str(tmp_path / "t"))


def test_ledger_round_trip(spark, tmp_path):
    rows = [("a\tb", "x\\ty", "line\nnext\\"), ("", "\\\\n", "\r\n"), ("a\0b", "\\\t\\", "\\\\\\t\0")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    sources.write_ledger(df, str(tmp_path / "l"))
    assert sorted(map(tuple, sources.read_ledger(spark, str(tmp_path / "l"), "a", "b", "c").collect())) == sorted(rows)


def test_resume_refuses_other_settings(spark):
    done = spark.createDataFrame([(1, "v1")], "task_id long, version string")
    assert [r.task_id for r in remaining_tasks(spark.createDataFrame([(1,), (2,)], "task_id long"), done, settings="version", wanted="v1").collect()] == [2]
    with pytest.raises(checks.CheckFailed):
        remaining_tasks(done, done, settings="version", wanted="v2")


def test_totals_that_cannot_be_resampled(spark):
    with pytest.raises(checks.CheckFailed):
        resample.guard(spark.createDataFrame([("A", 1, -1.0, 1)], "system string, work_id long, s double, c long"))
    with pytest.raises(checks.CheckFailed):
        resample.guard(spark.createDataFrame([("A", 1, 0.0, 0)], "system string, work_id long, s double, c long"))


def test_equal_systems_have_equal_draws_and_one_seed_draws_none(spark):
    rows = [(s, w, float(w * 3 % 7), 5) for s in ("A", "B") for w in range(6)]
    totals = spark.createDataFrame(rows, "system string, work_id long, s double, c long")
    scores = resample.replicates(totals, 50, "1").groupBy("b").agg((F.max("score") - F.min("score")).alias("d"))
    assert scores.agg(F.max("d")).head()[0] == 0
    single = {(r.b, round(r.score, 9)) for r in resample.seed_replicates(totals, 50, "1", {"only": ("A",)}).collect()}
    assert single == {(r.b, round(r.score, 9)) for r in resample.replicates(totals, 50, "1").where("system = 'A'").collect()}


def test_zero_fill_keeps_the_inventory(spark):
    inventory = spark.createDataFrame([(1,), (2,)], "task_id long")
    scores = spark.createDataFrame([("A", 1, 1.0, 1.0, 1.0, 1.0, 1.0), ("A", 9, 1.0, 1.0, 1.0, 1.0, 1.0)], "system string, task_id long, m1 double, m2 double, m3 double, m4 double, m5 double")
    rows = fill_inventory(inventory, scores).collect()
    assert len(rows) == 6 and sum(r.present for r in rows) == 1 and sum(r.mv5 for r in rows) == 1


def test_tiles_cover_every_row_once(spark):
    counts = spark.createDataFrame([(k, k) for k in range(1, 40)], "s long, n long")
    tiles = windows.tiling(counts, "s", "n", 7).select("s", F.explode(F.sequence("keep_from", F.col("keep_from") + F.col("keep_count") - 1)).alias("row"))
    got = {s: [] for s in range(1, 40)}
    for r in tiles.collect():
        got[r.s].append(r.row)
    assert all(sorted(v) == (list(range(s)) if s >= 7 else []) for s, v in got.items())


def greedy(p, t, tolerance):
    used = set()
    for x in p:
        free = sorted((abs(x - y), k) for k, y in enumerate(t) if k not in used and abs(x - y) <= tolerance)
        if free:
            used.add(free[0][1])
    return len(used)


def test_greedy_match(spark):
    """Dense and sparse series, ties in time and distance, series with one side only."""
    rng, rows, want = random.Random(5), [], {}
    for s in range(30):
        span = rng.choice([12, 60, 400])
        p, t = ([rng.randrange(span) for _ in range(rng.randrange(40))] for _ in range(2))
        if p or t:
            want[s] = greedy(p, t, 4)
        rows += [(s, "p", float(x), k) for k, x in enumerate(p)] + [(s, "t", float(x), k) for k, x in enumerate(t)]
    got = timeline.match_events(spark.createDataFrame(rows, "s long, side string, time double, place long"), "s", 4.0).collect()
    assert {r.s: r.hits for r in got} == want


def test_cells_that_are_no_numbers_are_null(spark):
    df = spark.createDataFrame([("8",), ("8-0,3",), ("x",), ("1-",), (None,)], "c string")
    assert [r.g for r in df.select(parse_cells("c").alias("g")).collect()] == [[[8]], [[8, 0], [3]], None, None, None]


def test_ranks_over_blocks_of_blocks(spark):
    rng = random.Random(21)
    keys = sorted(rng.sample(range(-500, 3000), 400)) + [7, 7]
    rows = windows.ranked(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long"), "k", "i", block=8).collect()
    assert {(r.k, r.i): r["rank"] for r in rows} == {pair: at for at, pair in enumerate(sorted((k, i) for i, k in enumerate(keys)))}


def test_shards_of_ranks(spark):
    df = spark.createDataFrame([(k * 3,) for k in range(10)], "k long")
    assert sorted(r.k for r in range_shard(df, "k", 8, 10).collect()) == [24, 27]
    for first, last in ((3, 3), (-1, 2), (8, 11)):
        with pytest.raises(checks.CheckFailed):
            range_shard(df, "k", first, last)


def test_draws_without_observations_are_errors(spark):
    totals = spark.createDataFrame([("A", w, float(w == 5), int(w == 5)) for w in range(12)], "system string, work_id long, s double, c long")
    with pytest.raises(Exception, match="no observations"):
        resample.replicates(totals, 50, "1").collect()
    assert resample.empty_sums(totals, 50, "1").count() > 0


def test_streamed_results_keep_each_key_once(spark, tmp_path):
    from loomline.streaming import append_results

    schema, folder = "k long, v string", str(tmp_path / "in")
    spark.createDataFrame([(k, "a") for k in range(50)], schema).repartition(5).write.parquet(folder)
    append_results(spark, folder, str(tmp_path / "out"), str(tmp_path / "state"), spark.createDataFrame([], schema).schema, "k")
    spark.createDataFrame([(k, "b") for k in range(40, 60)], schema).repartition(3).write.mode("append").parquet(folder)
    rows = append_results(spark, folder, str(tmp_path / "out"), str(tmp_path / "state"), spark.createDataFrame([], schema).schema, "k").collect()
    assert {r.k: r.v for r in rows} == {k: "a" if k < 50 else "b" for k in range(60)} and len(rows) == 60

"""Checks that have to fail where lists, pairs and inventories don't fit, and digest trees."""

import pytest

from loomline.operators import checks, digests
from loomline.plans.base import kept
from loomline.plans.q_rows import zip_lists
from loomline.plans.q_scores import allowed, paired


def test_lists_of_unequal_length(spark):
    left = spark.createDataFrame([("a", 0, "x"), ("a", 5, "y"), ("b", 0, "z"), ("c", 1, "u")], "k string, at long, v string")
    right = spark.createDataFrame([("a", 7, "p"), ("a", 9, "q"), ("b", 0, "r"), ("b", 1, "s"), ("d", 0, "t")], "k string, at long, v string")
    rows = zip_lists(left, right, "k", "at", "v").collect()
    assert sorted(map(str, (tuple(r) for r in rows))) == sorted(map(str, [("a", 0, "x", "p", "paired"), ("a", 1, "y", "q", "paired"), ("b", None, None, None, "unequal"), ("c", None, None, None, "unequal"), ("d", None, None, None, "unequal")]))
    with pytest.raises(checks.CheckFailed, match="unequal"):
        zip_lists(left, right, "k", "at", "v", strict=True)
    same = left.where("k = 'a'")
    assert zip_lists(same, same, "k", "at", "v", strict=True).count() == 2


def test_lists_that_leave_nothing(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "work long, rec long")
    one, none = spark.createDataFrame([(2,), (2,), (None,)], "work long"), spark.createDataFrame([(99,)], "rec long")
    assert [r.work for r in allowed(df, {"work": one, "rec": none}).collect()] == [2]
    with pytest.raises(checks.CheckFailed, match="leave no rows"):
        allowed(df, {"rec": none})


def test_pairs_that_do_not_fit(spark):
    references = spark.createDataFrame([(1, True), (2, False), (3, True)], "k long, usable boolean")
    predictions = spark.createDataFrame([(1, "p"), (2, "q"), (9, "r")], "k long, p string")
    assert {r.k: r.status for r in paired(references, predictions, "k").collect()} == {1: "paired", 2: "no_reference", 3: "no_prediction", 9: "unknown_reference"}
    for bad in (predictions, predictions.where("k < 3"), predictions.where("k < 3").union(spark.createDataFrame([(3, "x"), (3, "y")], "k long, p string"))):
        with pytest.raises(checks.CheckFailed):
            paired(references, bad, "k", strict=True)
    good = predictions.where("k < 3").union(spark.createDataFrame([(3, "x")], "k long, p string"))
    assert paired(references, good, "k", strict=True).count() == 3


ROWS = [(g, k * 7919 - 20_000_000, k, None if k % 50 == 0 else f"v{k}") for g in ("a", "b") for k in range(6000)]
ROWS += [("hot", 5, k, "x") for k in range(3000)] + [("hot", 5, 1, "x")] * 3 + [("hot", None, 0, "none"), ("one", -1, 0, "")]
KIND, COLUMNS = "g string, k long, n long, v string", ["k", "n", "v"]


def roots(tree):
    return {r.g: (r.digest, r.n) for r in tree[0].collect()}


def test_roots_depend_on_rows_alone(spark):
    first = roots(digests.digest_tree(spark.createDataFrame(ROWS, KIND), "g", "k", COLUMNS, kept))
    other = roots(digests.digest_tree(spark.createDataFrame(ROWS[::-1], KIND).repartition(13), "g", "k", COLUMNS, kept))
    assert first == other and first["hot"][1] == 3004 and first["a"] == first["b"] and len({d for d, _ in first.values()}) == 3
    for changed in ([*ROWS, ROWS[0]], ROWS[1:], [(g, k, n, "" if v is None else v) for g, k, n, v in ROWS]):
        assert roots(digests.digest_tree(spark.createDataFrame(changed, KIND), "g", "k", COLUMNS, kept))["a"] != first["a"]


def test_differences_are_located(spark):
    changed = [r for r in ROWS if r[2] != 17] + [("a", 123_456_789_012, 0, "new"), ("new", 3, 0, "n")]
    changed = [(g, k, n, "other" if (g, n) == ("b", 4000) else v) for g, k, n, v in changed]
    trees = [digests.digest_tree(spark.createDataFrame(x, KIND), "g", "k", COLUMNS, kept) for x in (ROWS, changed)]
    found = {(r.g, r.key, r.side) for r in digests.differing_keys(*trees, "g", kept).collect()}
    at = lambda n: n * 7919 - 20_000_000
    assert found == {("a", at(17), "left"), ("b", at(17), "left"), ("hot", 5, "both"), ("b", at(4000), "both"), ("a", 123_456_789_012, "right"), ("new", 3, "right")}
    assert digests.differing_keys(trees[0], trees[0], "g", kept).collect() == []


def test_refreshed_ledgers_keep_what_was_before(spark):
    from loomline.plans.q_rows import refreshed

    ledger = spark.createDataFrame([(1, "a", 5), (2, "b", None), (3, "c", 7)], "k long, name string, plan long")
    same = spark.createDataFrame([(1, 5), (2, None), (9, 9)], "k long, plan long")
    assert sorted(map(str, (tuple(r) for r in refreshed(ledger, same, "k", "plan").collect()))) == sorted(map(str, [(1, "a", "current", 5, 0), (2, "b", "current", None, 0), (3, "c", "current", 7, 0)]))
    other = spark.createDataFrame([(1, 6), (3, None)], "k long, plan long")
    rows = {(r.k, r.version): (r.plan, r.n_changed) for r in refreshed(ledger, other, "k", "plan").collect()}
    assert rows == {(1, "current"): (6, 2), (2, "current"): (None, 2), (3, "current"): (None, 2), (1, "prior"): (5, 2), (2, "prior"): (None, 2), (3, "prior"): (7, 2)}


def test_rotation_goes_on_where_a_row_takes_nothing(spark):
    from loomline.plans.q_rows import rotated

    rows = [(g, k, k % 3 != 1) for g in range(6) for k in range(9)]
    found = {}
    for r in rotated(spark.createDataFrame(rows, "g long, k long, d boolean"), "g", "k", "d", ["p", "q", "r"]).collect():
        found.setdefault(r.g, {})[r.k] = r.opt
    for got in found.values():
        drawn = [got[k] for k in range(9) if k % 3 != 1]
        start = ["p", "q", "r"].index(drawn[0])
        assert drawn == [["p", "q", "r"][(start + i) % 3] for i in range(6)] and all(got[k] is None for k in range(1, 9, 3))
    assert len({got[0] for got in found.values()}) > 1


def test_worst_seeds(spark):
    from loomline.plans.q_scores import worst_seed

    rows = [("w", "s1", "success")] * 3 + [("w", "s2", "success"), ("w", "s2", "failed"), ("w", "s2", "absent"), ("w", "s3", "zero_score"), ("w", "s3", "failed"), ("w", "s3", "success")]
    r = worst_seed(spark.createDataFrame(rows, "g string, seed string, status string"), "g", "seed").head()
    assert (r.n_total, r.min_success, r.max_fail, r.worst_seed, r.statuses) == (3, 1, 2, "s2", "absent=1,failed=2,success=5,zero_score=1")


def test_means_are_added_in_the_order_of_the_table(spark, tmp_path):
    """0.01, 0.06, 0.04, 0.01 and 0.06, 0.04, 0.01, 0.01 have means on two sides of 0.03; Spark would take the larger file first."""
    import duckdb

    from loomline.plans.base import VIEWS, v_scores

    names = "l_orderkey long, l_returnflag string, l_discount double, l_tax double, l_quantity double"
    row = lambda key, x: (key, "R", x, x / 2, x * 100)
    parts = [[row(1, 0.01)], [row(1, 0.06), row(1, 0.04), row(1, 0.01), *(row(k, k / 1000) for k in range(2, 900))]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, names).coalesce(1).write.parquet(f"{tmp_path}/out{k}")
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        next((tmp_path / f"out{k}").glob("*.parquet")).rename(tmp_path / "lineitem.parquet" / f"part-{k}.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT system, task_id, m1, m2, m3, m4, m5 FROM ({VIEWS['v_scores']})").fetchall())
    assert want[0][2] < 0.3
    assert sorted(tuple(r) for r in v_scores(spark, str(tmp_path)).collect()) == want

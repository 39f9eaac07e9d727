"""Scorers that misbehave, and inventories of all kinds of files."""

import hashlib
import os
import time

import pytest

from loomline.operators import checks, scorers
from loomline.sources.files import FileDigests, file_inventory


def moody(a, b):
    match a:
        case "sleep":
            time.sleep(600)
        case "native":  # one call into C that no alarm can interrupt
            return float(len(hashlib.pbkdf2_hmac("sha256", b"x", b"y", 10**9)))
        case "exit":
            os._exit(7)
        case "kill":
            os.kill(os.getpid(), 9)
        case "raise":
            raise KeyError("k")
        case "system exit":
            raise SystemExit(1)
        case "none":
            return None
    return float(len(a or "") + len(b or ""))


def test_every_kind_of_failure_is_a_status(spark):
    kinds = ["fine", "sleep", "fine", "native", "exit", "fine", "kill", "raise", "system exit", "none", None, "fine"]
    df = spark.createDataFrame([(k, a, "b") for k, a in enumerate(kinds)], "k long, a string, b string").coalesce(1)
    began = time.time()
    rows = {r.k: (r.status, r.score, r.message) for r in df.mapInPandas(scorers.score_pairs(moody, 1.0), "k long, status string, score double, message string").collect()}
    assert time.time() - began < 60
    want = {"fine": ("success", 5.0, None), "sleep": ("timeout", None, "over 1.0 s"), "native": ("timeout", None, "over 1.0 s"), "exit": ("crashed", None, "exit code 7"), "kill": ("crashed", None, "exit code -9")}
    want |= {"raise": ("error", None, "KeyError: 'k'"), "system exit": ("error", None, "SystemExit: 1"), "none": ("empty", None, "no result"), None: ("success", 1.0, None)}
    assert rows == {k: want[a] for k, a in enumerate(kinds)}


def test_inventory_equals_hashes_taken_by_hand(spark, tmp_path, monkeypatch):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    files = {"a.bin": b"a", "empty.bin": b"", "deep/b.bin": b"\0x" * 999, "deep/er/c d.bin": "é".encode(), "deep/large.bin": os.urandom(9_000_001)}
    for name, content in {**files, "other.txt": b"x"}.items():
        (tmp_path / name).write_bytes(content)
    want = {(n, len(c), hashlib.sha256(c).hexdigest()) for n, c in files.items()}
    for size, parts in ((1 << 27, 1), (1, 4)):
        found = file_inventory(spark, str(tmp_path), "*.bin", size)
        assert {tuple(r) for r in found.collect()} == want and found.rdd.getNumPartitions() >= parts
    assert {tuple(r) for r in file_inventory(spark, f"file://{tmp_path}", "*.bin").collect()} == want
    (tmp_path / "a.bin").rename(tmp_path / "deep" / "er" / "b.bin")
    with pytest.raises(checks.CheckFailed):
        file_inventory(spark, str(tmp_path), "*.bin")


def test_no_files(spark, tmp_path):
    assert file_inventory(spark, str(tmp_path)).collect() == [] and FileDigests.name() == "file_digests"


def test_tables_in_parts_and_stores_that_only_spark_reads(spark, tmp_path):
    from loomline.queries import QUERIES

    want = set()
    for name, content in {"one.parquet/part-0.parquet": b"1", "two.parquet/part-0.parquet": b"22", "two.parquet/part-1.parquet": b"", "three.parquet": b"333"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
        want.add((name, len(content), hashlib.sha256(content).hexdigest()))
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./in", f"file://{tmp_path}")
    for where in (str(tmp_path), f"file:{tmp_path}", "viewfs://store/in"):
        assert {tuple(r) for r in QUERIES["src7_file_inventory"](spark, where).collect()} == want
    with pytest.raises(checks.CheckFailed):
        file_inventory(spark, "viewfs://store/in", "*.parquet")


def test_many_small_keyed_files(spark, tmp_path, monkeypatch):
    """A folder for each of 2,500 keys in two tasks, not one for 32 files; what Spark's reader makes of odd lines and files holds for both ways."""
    from loomline import sources
    from loomline.sources import files

    rows = spark.range(5000).selectExpr("concat('k', id % 2500) AS k", "id", "if(id % 7 = 0, NULL, concat('é', id)) AS s")
    path = f"{tmp_path}/keyed"
    sources.write_keyed_directory(rows, path, "k")
    found = sources.read_keyed_directory(spark, path, "id long, s string", r"/k=([^/]+)/")
    assert len(list((tmp_path / "keyed").iterdir())) == 2500 and found.rdd.getNumPartitions() == 2
    assert sorted(found.select("key", "id", "s").collect()) == sorted(rows.select("k", "id", "s").collect())
    odd = tmp_path / "odd"
    for name, text in {"a/x.json": '{"id": 1}\n\n \t\n{"id": 2, "s": "z"}\r\n{"id": \n{"other": 3}', "b/y.json": "", "c/.z.json": '{"id": 4}', "_d/w.json": '{"id": 5}', "e f/large.json": '{"id": 6}\n' * 99, "g/v.txt": '{"id": 7}'}.items():
        (odd / name).parent.mkdir(parents=True)
        (odd / name).write_text(text)
    few = files.file_lines
    results = []
    for limit, seen in ((1 << 27, True), (100, True), (100, False)):
        monkeypatch.setattr(files, "file_lines", lambda *a, limit=limit: few(*a, limit=limit))
        monkeypatch.setattr(files, "known", lambda _, seen=seen: seen)
        read = sources.read_keyed_directory(spark, str(odd), "id long, s string", r"/odd/([a-z])[^/]*/", "*.json")
        results.append(sorted(map(str, read.select("key", "id", "s").collect())))
    assert results[0] == results[1] == results[2] and len(results[0]) == 4 + 99


def test_slow_calls_wait_side_by_side(spark):
    """Forty calls that hang cost a few time limits, not forty; answers keep their rows, slow ones that come in time included."""
    def late(a, b):
        if a == "nap":
            time.sleep(0.3)
        return moody(a, b)

    kinds = (["sleep", "fine", "nap", "exit", "raise"] * 40)
    df = spark.createDataFrame([(k, a, "b") for k, a in enumerate(kinds)], "k long, a string, b string").coalesce(1)
    began = time.time()
    rows = {r.k: r.status for r in df.mapInPandas(scorers.score_pairs(late, 1.0), "k long, status string, score double, message string").collect()}
    assert time.time() - began < 25
    assert rows == {k: {"sleep": "timeout", "fine": "success", "nap": "success", "exit": "crashed", "raise": "error"}[a] for k, a in enumerate(kinds)}

import random

import pytest

TYPES = "doc_id long, text string, lang string, source string, n_chars long"
ITEM, TURN = "item_id long, text string", "conv_id long, turn long, role string, text string"
ITEMS = [(1, "the on Theran the"), (2, None), (3, ""), (None, "word one"), (5, "xyzzyx-Qqqq"), (6, "Ünï 漢字 a")]
TURNS = [(c, t, ["user", "assistant", None][(c + t) % 3], f"turn {c // 2 % 3} {t}" if (c * t) % 5 else None) for c in range(23) for t in range(c % 6)]


def prose(rng: random.Random, words: int) -> str:
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "é"]
    out = []
    for k in range(words):
        out.append("".join(rng.choices(parts, k=rng.randint(1, 4))) + ("." if rng.random() < 0.1 else ""))
        out.append("\n" if rng.random() < 0.08 else " ")
    return "".join(out).strip()


@pytest.fixture(scope="session")
def corpus():
    """Documents with copies, near copies, nulls, empty, blank and long texts, and odd characters."""
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(1, 160)) for _ in range(60)]
    texts += [texts[0], texts[0], texts[1] + " more", texts[2][:-3], "one two", "one two", "a", None, "", "", "  \n\t ", "x" * 5000, "word " * 3000]
    texts += ["A\nB\nC\nD\nA\nB\nC\nE", "mail joe.1@mail5.example.com or +1 (743) 555-3824, 4785380592391139 at 10.2.3.4", "Ünï 漢字 <|endoftext|> 's ''  two  spaces\x1c"]
    return [(7 * k + 3, t, ["en", "fr", None][k % 3], f"s{k % 2}", len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def folder(spark, corpus, tmp_path_factory):
    """The corpus as a table in three files, with labels."""
    where = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(corpus, TYPES).repartition(3).write.parquet(f"{where}/documents.parquet")
    labels = [(d, int("x" * 9 not in (t or "")), 0) for d, t, *_ in corpus] + [(3, 1, 0), (999, 1, 0), (None, 0, 0), (10, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(ITEMS, ITEM).write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame(TURNS, TURN).repartition(3).write.parquet(f"{where}/conversations.parquet")
    return where


@pytest.fixture(scope="session")
def empty_folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], TYPES).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([], ITEM).write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([], TURN).write.parquet(f"{where}/conversations.parquet")
    return where


@pytest.fixture(scope="session")
def odd_folder(spark, corpus, tmp_path_factory):
    """Rows that repeat, null ids, and extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    where = str(tmp_path_factory.mktemp("odd"))
    rows = [*corpus[:12], *corpus[:4], (None, "one two three four", None, None, None), (None, None, None, None, None)]
    names = "item_id rank item terms counts n h c which kept spans runs again ids decoded key marked score fp component_id base spans shard size node place span vector row word stratum block guest".split()
    spark.createDataFrame(rows, TYPES).withColumns({n: F.lit("odd") for n in names}).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(d, k % 2, 0) for k, (d, *_) in enumerate(corpus[:12])], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    odd = {n: F.lit("odd") for n in ("doc_id", "n", "score", "turns", "key", "base", "bytes", "depth")}
    spark.createDataFrame([*ITEMS, *ITEMS[:2], (1, "in heed")], ITEM).withColumns({**odd, "lang": F.lit("en")}).write.parquet(f"{where}/benchmark.parquet")
    turns = [*TURNS, *TURNS[:9], (None, 1, "user", "lost"), (7, None, None, "before all"), (-3, None, None, None), (-4, 2, "user", "x")]
    spark.createDataFrame(turns, TURN).withColumns(odd).write.parquet(f"{where}/conversations.parquet")
    return where

"""Every query on empty tables, nulls, repeated rows and clashing columns."""

import hashlib
import random

import pytest

import corpus_pipeline
from loomline.llm.registry import QUERIES

from .conftest import TYPES

NOTHING = hashlib.sha256(b"").hexdigest()
BY_DOCUMENT = [name for name in QUERIES if name not in ("op11_search", "op13_prefix_trie")]


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables_give_no_rows(spark, empty_folder, name):
    assert QUERIES[name](spark, empty_folder).collect() == []


# What a row without a text gives.
EMPTY = {
    "op1_bpe": {"n_tokens": 0, "ids_sha256": NOTHING, "decoded_sha256": NOTHING},
    "op2_packing": {"doc_tokens": 1, "length": 1, "start": 0},
    "op3_fingerprints": {"n_chars": 0, "fingerprint": "0" * 1024},
    "op4_quality": {"held_out": False},
    "op5_lm_score": {"n_tokens": 1, "held_out": False},
    "op6_rules": {"n_words": 0, "word_chars": 0, "base_failed": True, "kept": False},
    "op7_line_dedup": {"n_lines": 0, "n_removed": 0, "text_sha256": None},
    "op8_simhash": {"fingerprint": "0" * 16},
    "op9_pii": {"n_email": 0, "n_ip": 0, "n_card": 0, "n_phone": 0, "base_sha256": NOTHING, "spans": ""},
    "op10_sharding": {"size": 16, "text_crc32": 0, "law": "bytes"},
    "op12_suffix_dedup": {"n_bytes": 0, "n_removed": 0, "n_spans": 0, "kept_sha256": NOTHING},
}


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_odd_rows(spark, odd_folder, name):
    """Every row has its result; rows that repeat have equal ones; a row without id and text has a defined one."""
    rows = [r.asDict() for r in QUERIES[name](spark, odd_folder).collect()]
    assert len(rows) == 18 if name != "op2_packing" else {r["doc_id"] for r in rows} >= {None, 3}
    placed = ("shard", "slot", "sequence_id", "offset", "near_next", "near_edited", "edited_sha256", "edited_fingerprint")
    by_id = {}
    for r in rows:
        if r["doc_id"] is not None and name != "op2_packing":
            by_id.setdefault(r["doc_id"], []).append({k: v for k, v in r.items() if k not in placed})
    assert sum(len(same) == 2 for same in by_id.values()) == (4 if by_id else 0)
    assert all(x == same[0] for same in by_id.values() for x in same)
    want = EMPTY[name].items()
    assert any(r["doc_id"] is None and all(r[k] == v for k, v in want) for r in rows)


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_one_very_long_text(spark, tmp_path_factory, name):
    """A text of three million characters among short ones is handled whole."""
    where = str(tmp_path_factory.mktemp("long"))
    rng = random.Random(31)
    line = lambda: " ".join("".join(rng.choices(["th", "er", "on", "an"], k=3)) for _ in range(10))
    text = "\n".join(line() for _ in range(42_000)) + " mail joe.1@mail5.example.com"
    rows = [(k, text if k == 5 else line() * 6, "en", "s", 1) for k in range(12)]
    spark.createDataFrame(rows, TYPES).repartition(2).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    rows = [r.asDict() for r in QUERIES[name](spark, where).collect() if r.doc_id == 5]
    r, words = rows[0], len(text.split())
    if name == "op2_packing":
        rows.sort(key=lambda r: r["start"])
        assert [r["start"] for r in rows] == [sum(x["length"] for x in rows[:k]) for k in range(len(rows))] and sum(x["length"] for x in rows) == r["doc_tokens"] > words
    else:
        assert len(rows) == 1
        known = {
            "op1_bpe": lambda: r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["n_tokens"] > words,
            "op3_fingerprints": lambda: r["n_chars"] == len(text) and len(set(r["fingerprint"])) > 10,
            "op4_quality": lambda: 0 <= r["score"] <= 1,
            "op5_lm_score": lambda: r["n_tokens"] == words + 1 and r["score"] < -words,
            "op6_rules": lambda: r["n_words"] == words,
            "op7_line_dedup": lambda: (r["n_lines"], r["n_removed"]) == (42_000, 0),
            "op8_simhash": lambda: r["component_id"] == 5,
            "op9_pii": lambda: r["n_email"] == 1 and r["spans"].startswith("email:"),
            "op10_sharding": lambda: r["size"] == len(text) + 16,
            "op12_suffix_dedup": lambda: (r["n_bytes"], r["n_removed"]) == (len(text), 0),
        }
        assert known[name]()


def test_pipeline_on_empty_and_odd_tables(spark, empty_folder, odd_folder):
    assert corpus_pipeline.run(spark, empty_folder).collect() == []
    rows = corpus_pipeline.run(spark, odd_folder).collect()
    assert all(0 < r.length <= 4096 and len(r.ids) == 4 * r.length for r in rows)
    parts = {}
    for r in rows:
        parts.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in parts.values():
        assert [a for a, _ in sorted(found)] == [sum(n for _, n in sorted(found)[:k]) for k in range(len(found))]


def test_stages_keep_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert dict(stage(spark, docs, folder).dtypes) == dict(docs.dtypes)


def test_near_copies_with_repeated_and_null_ids(spark):
    """Of one id's texts only the copy goes; equal rows stay together; rows without an id stay."""
    text = " ".join(f"word{k}" for k in range(60))
    near, other = text + " more", " ".join(f"other{k}" for k in range(60))
    rows = [(1, text), (1, text), (2, near), (2, other), (None, text), (3, other), (4, None), (5, ""), (6, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, docs, "").select("doc_id", "text").collect()
    key = lambda r: (r[0] or 0, r[1] or "")
    assert sorted(map(tuple, kept), key=key) == sorted([(1, text), (1, text), (2, other), (None, text), (4, None)], key=key)

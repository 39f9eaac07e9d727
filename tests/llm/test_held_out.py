"""What trained models make of rows and spellings that they were not shown, on the given tables."""

import pytest
from pyspark.sql import functions as F

from loomline.llm import pii
from loomline.llm.registry import QUERIES

SF = "/root/testdata/sf0.1"


def test_quality_ranks_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality IS NOT NULL").select("doc_id", "quality")
    rows = [(r.score, r.quality) for r in QUERIES["op4_quality"](spark, SF).where("held_out").join(labels, "doc_id").collect()]
    good, bad = [s for s, q in rows if q], [s for s, q in rows if not q]
    assert len(good) > 20 and len(bad) > 20
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.95 and sum((s >= 0.5) == bool(q) for s, q in rows) > 0.9 * len(rows)


@pytest.mark.parametrize("taught", [0, 1])
def test_most_data_in_untaught_spellings_is_found(spark, monkeypatch, taught):
    """Every second spelling of each kind is taught, and the others are planted in other documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = pii.training_texts(docs, 200)
    every, known = pii.variants, set(texts)
    monkeypatch.setattr(pii, "variants", lambda kind, found: every(kind, found)[taught::2])
    field = pii.train(texts)
    hit = total = 0
    for r in docs.where(F.col("text").rlike(pii.HINTS)).select("text").collect():
        base = pii.base_spans(r.text)
        if len(base) != 1 or r.text in known or len(r.text) > 5000 or total > 300:
            continue
        kind, start, end = base[0]
        for other in every(kind, r.text[start:end])[1 - taught :: 2]:
            text = r.text[:start] + other + r.text[end:]
            if not pii.base_spans(text):
                total += 1
                hit += (kind, start, start + len(other)) in pii.all_spans(text, field)[1]
    assert total > 40 and hit >= total / 2

"""Personal data in texts with very long runs of digits."""

import re

import pytest

import corpus_pipeline
from loomline.llm import pii

from .conftest import TYPES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
ZEROS, NINES = "0" * 5000, "9" * 5000
TEXTS = [
    *(f"x {a}{b} y" for a in (ZEROS, NINES) for b in ("1.1.1.1", ".2.3.4", "@mail.example.com", " 4785 3805 9239 1139", "")),
    f"9.{ZEROS}7.8.255 and 9.8.{NINES}.1 and 1.2.3.{ZEROS}",
    f"+{ZEROS} +1{NINES} +1 743 555 3824",
    f"a@{NINES}.com {ZEROS}@{ZEROS}.{NINES}",
    " ".join(["4785380592391139"] * 400) + f" {NINES}-{ZEROS}",
    "1" * 3000 + "." * 10 + "2" * 5000 + "@",
]


def plain(text):
    """The four rules read off one by one."""
    ip = [m for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    card = [m for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    phone = [m for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return [(k, *m.span()) for k, found in (("email", EMAIL.finditer(text)), ("ip", ip), ("card", card), ("phone", phone)) for m in found]


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_patterns_on_long_runs(text):
    assert pii.base_spans(text) == plain(text)


def test_query_and_pipeline_stage_on_long_runs(spark, tmp_path):
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, TYPES)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.op9_pii(spark, str(tmp_path)).collect()}
    assert found == {k: tuple(sum(s[0] == kind for s in plain(t)) for kind in pii.KINDS) for k, t in enumerate(TEXTS)}
    cleaned = dict(corpus_pipeline.STAGES)["PII"](spark, docs, str(tmp_path)).collect()
    assert len(cleaned) == len(TEXTS) and all("[EMAIL]" in r.text for r in cleaned if r.doc_id in (2, 7, 12))

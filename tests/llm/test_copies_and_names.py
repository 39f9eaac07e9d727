"""Copies are one trial of the rules, texts of one id have an order, and no column name is taken."""

from loomline.llm import quality, rules
from loomline.llm.line_dedup import dedup_lines


def test_copies_of_a_text_are_one_trial(spark):
    """3,000 copies of one bad-looking good text would bar every cutoff if each counted; as one text among 900 they do not."""
    clean, marked = " ".join(f"word{k}" for k in range(60)), " ".join(f"w{k} #" for k in range(60))
    texts = [(f"{clean} n{k}", 1) for k in range(900)] + [(f"{marked} n{k}", 0) for k in range(400)]
    copy = f"{marked} copy"
    both = texts + [(copy, 1)] * 3000
    make = lambda rows: (spark.createDataFrame([(k, t, "en") for k, (t, _) in enumerate(rows)], "doc_id long, text string, lang string"), spark.createDataFrame([(k, g) for k, (_, g) in enumerate(rows)], "doc_id long, quality int"))
    judged = rules.judge(*make(both))
    assert "symbols" in rules.thresholds(judged.drop("kept"), make(both)[1])["en"]
    assert rules.thresholds(judged.drop("kept", "mark"), make(both)[1])["en"] == {}


def test_training_texts_do_not_depend_on_the_order_of_rows(spark):
    rows = [(k, f"text {k} {j} " + "good words here " * (k % 3)) for k in range(60) for j in range(3)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    found = []
    for part in (rows, rows[::-1]):
        scored = quality.classify(spark.createDataFrame(part, "doc_id long, text string").repartition(5), labels)
        found.append(sorted((r.doc_id, r.text, round(r.score, 6)) for r in scored.collect()))
    assert found[0] == found[1]


def test_names_with_underscores_stay(spark):
    rows = [(1, "a\nb\nc\nd", "k", "o", "m", "x"), (2, "a\nb\nc\ne", "k2", "o2", "m2", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __key string, __of string, __marked string, marked string")
    found = {r.doc_id: r for r in dedup_lines(df).collect()}
    assert found[2].text == "e" and found[1].text == "a\nb\nc\nd" and (found[2]["__key"], found[2]["__of"], found[2]["__marked"], found[2].marked) == ("k2", "o2", "m2", "y")

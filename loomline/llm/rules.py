"""Quality rules with risk-controlled thresholds.

A document's signals are ratios of what its text shows. Labelled texts are dealt by a hash: a third,
for tuning, proposes rules and the rest, the holdout, tests them. Copies of a text within a stratum are one trial, for the bound holds for independent ones;
near copies still count each. For each stratum (the language) tuning rows
propose one joint rule for each of `RATES`: for every signal the strictest cutoff that rejects at most that
share of the good tuning rows, if it rejects more bad rows than `COST` times the good ones. The
holdout tests a stratum's joint rules from lax to strict: a rule is safe if the exact binomial upper
bound (Clopper and Pearson) of the rate at which it rejects good documents, by any of its signals, is at
most `RISK`. Testing stops at the first rule that isn't safe, so the order needs no correction; over
the strata Bonferroni's divides `DELTA`. Of the safe rules that with the best balance on tuning rows is taken, the
laxest on a tie; without one, nothing is rejected. So with probability 1 - `DELTA` no stratum's verdict
rejects more than a share `RISK` of its good documents that pass the base rule.

Null and empty texts have no words, fail the base rule and are not kept. A language with fewer than
`LEAST` good texts, or null, belongs to the stratum `other`; any number of languages can have a stratum of
their own, judged by its own rule only. Labels that contradict each other count as good
if at least half say so, over all copies. Without labels only the base rule rejects. Rows that repeat, and rows of one id
with other texts, are judged each. Long texts are read whole. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, documents, keep_types, slices, span_hash, text_bytes, windows_hash, word_spans

RISK, DELTA, COST, LEAST = 0.05, 0.05, 3, 200
RATES = (0.0, 0.003, 0.01, 0.02, 0.04)  # of good tuning rows that one signal may reject, lax rules first
SYMBOLS = "#*$%&|<>"  # fixed values
SPACES = re.compile(r"[\x20\x09-\x0D]+")
# Cutoffs of each signal, strict to lax: a document is rejected if the signal is above.
CUTOFFS = {
    "symbols": [0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3],
    "repeats": [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4],
    "lines": [0.05, 0.1, 0.2, 0.3, 0.4, 0.6],
    "capitals": [0.02, 0.05, 0.1, 0.2, 0.3, 0.5],
    "length": [6.5, 7, 8, 9, 10, 12, 15],
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]


def count_symbols(text: str) -> int:
    return sum(map(text.count, SYMBOLS))


def repeated_words(words: np.ndarray) -> int:
    """Words in windows of three that occur twice or more."""
    window = windows_hash(words, 3)
    if len(window) < 2:
        return 0
    _, which, count = np.unique(window, return_inverse=True, return_counts=True)
    twice = count[which] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(window)] |= twice
    return int(covered.sum())


def signals(df: DataFrame) -> DataFrame:
    """Counts of each text, in place of the text."""
    kept = [c for c in df.columns if c != "text" and c not in COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "text")):
            data, offsets = text_bytes(batch.column("text"))
            starts, ends, first = word_spans(data, offsets)
            words = span_hash(data, starts, ends)
            # Bytes that begin a character, in words: all but the continuation bytes 10xxxxxx.
            heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            chars = np.concatenate(([0], np.cumsum(heads[ends] - heads[starts])))
            rows = []
            for k, text in enumerate(batch.column("text").to_pylist()):
                text, seen, again, lines = text or "", set(), 0, 0
                for line in text.split("\n"):
                    if line.strip(" \t\x0b\x0c\r"):
                        lines += 1
                        again += line in seen
                        seen.add(line)
                capitals = sum(1 for w in SPACES.split(text) if len(w) > 1 and w.isupper())
                rows.append((first[k + 1] - first[k], chars[first[k + 1]] - chars[first[k]], count_symbols(text), again, repeated_words(words[first[k] : first[k + 1]]), lines, capitals))
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *(pa.array(c, pa.int64()) for c in zip(*rows))], names=[*kept, *COUNTS])

    return df.mapInArrow(run, keep_types(df.select(*kept), *(f"{c} long" for c in COUNTS)))


def ratios(df: DataFrame) -> DataFrame:
    share = lambda a, b: F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))
    return df.withColumns({"symbols": share("n_symbols", "word_chars"), "repeats": share("n_repeat_words", "n_words"), "lines": share("n_dup_lines", "n_lines"), "capitals": share("n_capitals", "n_words"), "length": share("word_chars", "n_words")})


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    value, m = d, 0
    while True:
        m += 1
        step = 1.0
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            step = c * d
            value *= step
        if abs(step - 1) < 1e-14 or m > 100_000:
            break
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    return math.exp(front) * value / a


def at_most(failures: int, trials: int, p: float) -> float:
    """The probability of so few failures at rate p, without a sum over them."""
    return 1.0 if failures >= trials else beta_share(1 - p, trials - failures, failures + 1)


def safe(failures: int, trials: int, delta: float, risk: float) -> bool:
    """Whether `upper_bound` is at most `risk`, by one evaluation."""
    return failures <= risk * trials and failures < trials and at_most(failures, trials, risk) <= delta


def upper_bound(failures: int, trials: int, delta: float) -> float:
    """The largest rate under which so few failures have probability `delta` at least."""
    if failures >= trials:
        return 1.0
    low, high = failures / trials, 1.0
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if at_most(failures, trials, middle) > delta else (low, middle)
    return high


def proposed(row: dict) -> list[dict[str, float]]:
    """The joint rules that a stratum's tuning counts propose, lax ones first."""
    rules = []
    for rate in RATES:
        rule = {}
        for signal, cut in CUTOFFS.items():
            for k, c in enumerate(cut):
                good, bad = row[f"{signal}_{k}_True"], row[f"{signal}_{k}_False"]
                if good <= rate * row["n"] and bad > COST * good:
                    rule[signal] = c
                    break
        rules.append(rule)
    return rules


def thresholds(scored: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> dict[str, dict[str, float]]:
    """The cutoffs of each named stratum and of `other`, by signal. Labelled texts, told apart by `mark` (without that column, rows by id), are reduced to counts, one row for each stratum that has enough of them."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    unit = "mark" if "mark" in scored.columns else "doc_id"
    known = scored.where("NOT base_failed").join(known, "doc_id").groupBy("stratum", unit).agg((F.avg(F.col("good").cast("int")) >= 0.5).alias("good"), *(F.first(s).alias(s) for s in CUTOFFS))
    known = known.withColumn("tuning", F.pmod(F.xxhash64(unit), F.lit(3)) == 0)
    counts = {f"{s}_{k}_{side}": F.count_if(F.col("tuning") & (F.col("good") == side) & (F.col(s) > c)) for s, cut in CUTOFFS.items() for k, c in enumerate(cut) for side in (True, False)}
    sums = known.groupBy("stratum").agg(F.count_if("good").alias("all"), F.count_if(F.col("good") & F.col("tuning")).alias("n"), *(c.alias(name) for name, c in counts.items()))
    merged = F.when(F.col("all") >= LEAST, F.col("stratum")).otherwise("other")
    tables = {r["stratum"]: r.asDict() for r in sums.groupBy(merged.alias("stratum")).agg(*(F.sum(c).alias(c) for c in ("n", *counts))).collect()}
    rules = {name: proposed(row) for name, row in tables.items()}
    if not rules:
        return {"other": {}}
    # The holdout's good rows meet the rules of their stratum, of which there are few, each cutoff a column's array over the rules.
    given = [(name, *([None if (c := r.get(s)) is None else float(c) for r in found] for s in CUTOFFS)) for name, found in rules.items()]
    table = scored.sparkSession.createDataFrame(given, ", ".join(["named string", *(f"`cut_{s}` array<double>" for s in CUTOFFS)]))
    names = F.broadcast(table.select(F.col("named").alias("stratum"), F.col("named").alias("own")))
    held = known.where("good AND NOT tuning").join(names, "stratum", "left").withColumn("named", F.coalesce("own", F.lit("other"))).join(F.broadcast(table), "named")
    rejected = lambda k: F.array_max(F.array(*(F.coalesce(F.col(s) > F.get(f"cut_{s}", k), F.lit(False)) for s in CUTOFFS)))
    tests = held.groupBy("named").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(rejected(k)).alias(f"r{k}") for k in range(len(RATES)))).collect()
    chosen: dict[str, dict[str, float]] = {"other": {}} | {name: {} for name in rules}
    for row in tests:
        best = 0
        for k, rule in enumerate(rules[row["named"]]):
            if not safe(row[f"r{k}"], row["n"], delta / len(rules), risk):
                break
            counts_of = tables[row["named"]]
            gain = sum(counts_of[f"{s}_{CUTOFFS[s].index(c)}_False"] - COST * counts_of[f"{s}_{CUTOFFS[s].index(c)}_True"] for s, c in rule.items())
            if gain > best:
                best, chosen[row["named"]] = gain, rule
    return chosen


def judge(df: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """Counts of each document, a hash of its text (`mark`), the base rule's verdict and the rules' verdict `kept`. `df` needs doc_id, text and the stratum."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = signals(df.select("doc_id", "text", F.coalesce(F.col(stratum).cast("string"), F.lit("other")).alias("stratum"), F.xxhash64("text").alias("mark")))
    scored = checkpointed(ratios(counted).withColumn("base_failed", failed))
    chosen = thresholds(scored, labels)
    rows = [(name, *(found.get(signal) for signal in CUTOFFS)) for name, found in chosen.items() if name != "other"]
    # A named stratum is judged by its own cutoffs only, even if it has none.
    own = df.sparkSession.createDataFrame([(name, *(None if c is None else float(c) for c in cut)) for name, *cut in rows], ", ".join(["named string", *(f"`cut_{s}` double" for s in CUTOFFS)]))
    met = scored.join(F.broadcast(own), F.col("stratum") == F.col("named"), "left")
    rejected = F.lit(False)
    for signal in CUTOFFS:
        other = F.lit(chosen["other"].get(signal)).cast("double")
        cutoff = F.when(F.col("named").isNotNull(), F.col(f"cut_{signal}")).otherwise(other)
        rejected = rejected | F.coalesce(F.col(signal) > cutoff, F.lit(False))
    return met.withColumn("kept", ~F.col("base_failed") & ~rejected).select(*scored.columns, "kept")


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule signals and verdicts of all documents."""
    judged = judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

"""Line deduplication by overlapping windows of three lines.

Lines that are blank do not count. Each run of three successive lines of a text is hashed to 128
bits. A window that occurs more than once anywhere keeps its first occurrence, in order of id and
place; the lines of every later one are marked, overlapping marks merge, and marked lines go. The
first of all equal lines is never marked, so no line is lost altogether. Texts of fewer than three
lines are left alone, null stays null, and a text all of whose lines go becomes empty. Rows with
the same id but other texts count as different rows, in order of a hash of the text; rows equal in both
are treated as one and stay together. All work on a text is linear in its lines, so long texts are
handled whole. An empty table gives an empty one. Columns of the input stay; `n_lines` and `n_removed`
replace columns so named.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, documents, keep_types, slices

SIZE = 3


def windows(df: DataFrame) -> DataFrame:
    """(a, b, at): the 128-bit hash of each window and its place, a row's key and the window's number."""
    full = F.filter(F.split("text", "\n"), lambda line: F.trim(line) != "")
    lines = df.select("key", full.alias("lines")).where(F.size("lines") >= SIZE)
    both = F.transform(
        F.sequence(F.lit(0), F.size("lines") - SIZE),
        lambda k: F.struct(
            F.xxhash64(*(F.get("lines", k + j) for j in range(SIZE))).alias("a"),
            F.xxhash64(F.lit(7), *(F.get("lines", k + j) for j in reversed(range(SIZE)))).alias("b"),
            k.alias("place"),
        ),
    )
    return lines.select("key", F.explode(both).alias("w")).select("w.a", "w.b", F.struct("key", "w.place").alias("at"))


def marked_lines(df: DataFrame) -> DataFrame:
    """(key, marked): the numbers of the lines of each row that go, counted among lines that are not blank."""
    found = windows(df)
    first = found.groupBy("a", "b").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # Written first, so that adaptive execution can deal the rows of a very common window to several tasks.
    later = found.join(checkpointed(first), ["a", "b"]).where(F.col("at") > F.col("first"))
    return later.groupBy("at.key").agg(F.collect_set("at.place").alias("places")).select("key", F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + SIZE - 1)))).alias("marked"))


def without(text: str | None, marked: list[int] | None) -> tuple[str | None, int, int]:
    """A text without its marked lines, the number of its lines that are not blank, and of those that went."""
    if text is None:
        return None, 0, 0
    lines = text.split("\n")
    full = [k for k, line in enumerate(lines) if line.strip(" ")]
    if not marked:
        return text, len(full), 0
    gone = {full[k] for k in marked}
    return "\n".join([line for k, line in enumerate(lines) if k not in gone]), len(full), len(gone)


def dedup_lines(df: DataFrame) -> DataFrame:
    """The input with cleaned texts, the number of lines that are not blank and of those removed."""
    key = F.struct("doc_id", F.xxhash64("text").alias("h"))
    marked = marked_lines(df.select(key.alias("key"), "text")).select(F.struct("key", "marked").alias("gone"))
    rest, lines = [c for c in df.columns if c not in ("text", "n_lines", "n_removed")], "marked"
    while lines in df.columns:
        lines += "_"
    keyed = df.select(F.struct(*rest, "text").alias("row"), key.alias("key")).join(marked, F.col("key") == F.col("gone.key"), "left")
    joined = keyed.select(*(F.col("row")[c].alias(c) for c in [*rest, "text"]), F.col("gone.marked").alias(lines))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "text")):
            found = [without(t, m) for t, m in zip(batch.column("text").to_pylist(), batch.column(lines).to_pylist(), strict=True)]
            columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*map(batch.column, rest), *columns], names=[*rest, "text", "n_lines", "n_removed"])

    return joined.mapInArrow(run, keep_types(df.select(*rest), "text string", "n_lines long", "n_removed long"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated lines."""
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


ORACLE_OP7 = """
WITH line AS (
  SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), numbered AS (
  SELECT *, CASE WHEN trim(line) = '' THEN NULL ELSE sum((trim(line) <> '')::INT) OVER (PARTITION BY doc_id ORDER BY pos) - 1 END AS n FROM line
), win AS (
  SELECT doc_id, n, line AS l0, lead(line) OVER w AS l1, lead(line, 2) OVER w AS l2 FROM numbered WHERE n IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY n)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY l0, l1, l2 ORDER BY doc_id, n) AS r FROM win WHERE l2 IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, n + k AS n FROM ranked, (VALUES (0), (1), (2)) v(k) WHERE r > 1
)
SELECT a.doc_id, count(a.n)::BIGINT AS n_lines, count(g.n)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(a.line, chr(10) ORDER BY a.pos) FILTER (WHERE g.n IS NULL), '')) AS text_sha256
FROM numbered a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.n = g.n GROUP BY a.doc_id
"""

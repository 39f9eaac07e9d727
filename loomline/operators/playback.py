"""Playback order of documents that declare it: a line `*>[A,A,B,B1,B,B2]` names sections, each opened by a line `*>A`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER, LABEL = r"^\*>\[([^\]]+)\]", r"^\*>([A-Za-z0-9]+)\s*$"
NO_LABEL = ""


def labelled(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, line_no, line) with the label of the section they lie in, empty before the first; lines that declare something go."""
    label = F.nullif(F.regexp_extract("line", LABEL, 1), F.lit(""))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    held = lines.withColumn("section", F.coalesce(F.last(label, ignorenulls=True).over(w), F.lit(NO_LABEL)))
    return held.where(label.isNull() & ~F.col("line").rlike(ORDER))


def declared_orders(lines: DataFrame) -> DataFrame:
    """(doc_id, place, section): the order that a document's first declaration gives, one row for each visit. Documents without one have none."""
    orders = lines.where(F.col("line").rlike(ORDER)).groupBy("doc_id").agg(F.min_by("line", "line_no").alias("line"))
    names = F.transform(F.split(F.regexp_extract("line", ORDER, 1), ","), lambda s: F.trim(s))
    return orders.select("doc_id", F.posexplode(names).alias("place", "section"))


def ending(section: Column) -> Column:
    """The number of a first or second ending (`B1`, `B2`), else 0."""
    return F.coalesce(F.nullif(F.regexp_extract(section, r"^[A-Za-z]+(\d+)$", 1), F.lit("")).try_cast("int"), F.lit(0))


def played_visits(lines: DataFrame) -> DataFrame:
    """(doc_id, place, section, occurrence, is_repeat, ending, known): each visit of the order, how many visits of its section came before, whether the section
    is an ending whose other one the document has too, and whether the document has the section at all.

    A document that declares no order visits its sections once as written, those that come before the first label included.
    """
    own = labelled(lines).groupBy("doc_id", "section").agg(F.min("line_no").alias("first"))
    marks = lines.where(F.col("line").rlike(LABEL)).groupBy("doc_id", F.regexp_extract("line", LABEL, 1).alias("section")).agg(F.min("line_no").alias("first"))
    has = own.unionByName(marks).groupBy("doc_id", "section").agg(F.min("first").alias("first"))
    orders = declared_orders(lines)
    written = has.join(orders.select("doc_id").distinct(), "doc_id", "left_anti")
    written = written.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")) - 1).select("doc_id", "place", "section")
    visits = orders.unionByName(written)
    before = F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("place")) - 1
    number = ending(F.col("section"))
    stem = F.regexp_extract("section", r"^([A-Za-z]*)", 1)
    other = F.concat(stem, F.when(number == 1, "2").otherwise("1"))
    known = has.select("doc_id", "section", F.lit(True).alias("known"))
    pair = has.select("doc_id", F.col("section").alias("other"), F.lit(True).alias("paired"))
    visits = visits.withColumn("occurrence", before.cast("long")).withColumn("number", number).withColumn("other", other)
    visits = visits.join(known, ["doc_id", "section"], "left").join(pair, ["doc_id", "other"], "left")
    ends = F.when((F.col("number") > 0) & F.col("paired"), F.col("number")).otherwise(0)
    return visits.select("doc_id", F.col("place").cast("long").alias("place"), "section", "occurrence", (F.col("occurrence") > 0).alias("is_repeat"), ends.alias("ending"), F.coalesce("known", F.lit(False)).alias("known"))


def played(lines: DataFrame) -> DataFrame:
    """The lines in the order of play, (doc_id, place, section, line_no, occurrence, is_repeat, ending); a visit of a section that the document lacks, which is a violation, has a null line. Empty sections give no lines."""
    visits = played_visits(lines)
    text = labelled(lines).select("doc_id", "section", "line_no")
    lines_of = visits.where("known").join(text, ["doc_id", "section"])
    both = lines_of.unionByName(visits.where("NOT known").withColumn("line_no", F.lit(None).cast("long")))
    return both.select("doc_id", "place", "section", "line_no", "occurrence", "is_repeat", "ending")


def expansion(lines: DataFrame) -> DataFrame:
    """(doc_id, has_repeats, original, expanded, ratio, undeclared): lines of the sections visited, lines played, and visits of sections that are not there."""
    visits = played_visits(lines)
    sizes = labelled(lines).groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n"))
    sized = visits.join(sizes, ["doc_id", "section"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = sized.groupBy("doc_id").agg(F.bool_or("is_repeat").alias("has_repeats"), F.sum(F.when(F.col("occurrence") == 0, F.col("n")).otherwise(0)).alias("original"), F.sum("n").alias("expanded"), F.count_if(~F.col("known")).alias("undeclared"))
    return out.withColumn("ratio", F.when(F.col("original") > 0, F.col("expanded") / F.col("original")))

"""Readers with explicit schemas that reject or drop what breaks their format, and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import checks
from loomline.sources import files as files_of


def read_strict_jsonl(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """One JSON object a line; blank lines are skipped. A malformed line and a key that is missing or repeats are errors."""
    names = spark.createDataFrame([], schema).columns
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("r"), "value").select("r.*", "value")
    checks.assert_empty(rows.where(F.col("_broken").isNotNull()).select("value"), "lines that are no JSON object")
    checks.assert_empty(checks.duplicate_keys(rows, key), f"{key} is missing or repeats")
    return rows.select(*names)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of files that hold one JSON array each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_keyed_json(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """(key, value fields) of files that hold one JSON object, whose keys are ids."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", f"map<string, struct<{value_schema}>>")).alias("key", "entry"))
    return entries.select("key", "entry.*")


def read_dirty_csv(spark: SparkSession, path: str, required: dict[str, str], total: str = "TOTAL") -> DataFrame:
    """Columns `required` (name: type) of a CSV file with padded header names.

    Repeated header rows, total rows, rows of another width and rows whose values don't cast are dropped; a table
    without a header that has all required columns is an error.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    cells = lines.select(F.transform(F.split("value", ","), lambda c: F.trim(c)).alias("c"))
    header = cells.where(F.size(F.array_except(F.array(*map(F.lit, required)), "c")) == 0).head()
    if header is None:
        raise checks.CheckFailed(f"no header has all of the columns {', '.join(required)}")
    names = list(header.c)
    kept = cells.where((F.size("c") == len(names)) & (F.get("c", 0) != names[0]) & (F.get("c", 0) != total))
    typed = kept.select(*(F.get("c", names.index(n)).try_cast(t).alias(n) for n, t in required.items()))
    return typed.dropna("any")


def read_name_list(spark: SparkSession, path: str, header: str = "name") -> DataFrame:
    """A list of names, one a line under its header, in one file or several; lines that begin with ! or # are comments."""
    lines = spark.read.text(path, wholetext=False).select(F.trim("value").alias("name"), F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    # A file's first line is the first of its first block, so each file is judged by one row.
    firsts = lines.where("block = 0").groupBy("file").agg(F.min_by("name", "at").alias("first"))
    checks.assert_empty(firsts.where(~F.col("first").eqNullSafe(header)), f"the first line is not {header!r}")
    return lines.where((F.col("name") != "") & (F.col("name") != header) & ~F.col("name").rlike("^[!#]")).select("name")


def write_keyed_directory(df: DataFrame, path: str, key: str) -> None:
    """A folder `key=value` for each value of a column that has rows, with these as JSON lines of one file."""
    if not files_of.known(path):
        df.repartition(key).write.partitionBy(key).json(path)
        return
    safe = F.call_function("url_encode", F.col(key).cast("string"))
    place = F.concat(F.lit(f"{key}="), safe, F.lit("/part.json"))
    files_of.write_lines(df.select(place.alias("place"), F.to_json(F.struct(*(c for c in df.columns if c != key))).alias("value")), path)


def read_keyed_directory(spark: SparkSession, path: str, schema: str, pattern: str, files: str = "*") -> DataFrame:
    """JSON files that each hold one key's rows; `pattern` takes the key from a file's path as its first group. A key without a file has no row."""
    by_spark = lambda where: spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", files).json(where).withColumn("key", F.regexp_extract(F.input_file_name(), pattern, 1))
    if not files_of.known(path):
        return by_spark(path)
    lines, large = files_of.file_lines(spark, path, files)
    rows = lines.select(F.from_json("value", schema).alias("r"), F.regexp_extract("file", pattern, 1).alias("key")).select("r.*", "key")
    return rows.unionByName(by_spark(large)) if large else rows


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Rows `time, time, type[,meter[,key]]`, the type after tabs, as typed columns; fields that are left out are null."""
    cells = spark.read.text(path).where(F.trim("value") != "").select(F.split("value", "\t").alias("c"))
    parts = F.split(F.get("c", 2), ",")
    return cells.select(F.get("c", 0).cast("double").alias("sec"), F.get("c", 1).cast("double").alias("until"), F.get(parts, 0).alias("type"), F.get(parts, 1).alias("meter"), F.get(parts, 2).cast("int").alias("key"))


def publish(df: DataFrame, path: str) -> DataFrame:
    """Writes to a folder that may not exist yet, all or nothing by Spark's commit protocol, and reads it back."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def publish_splits(df: DataFrame, path: str, split: str) -> DataFrame:
    """Writes a part for each split and checks each part's number of rows against the source."""
    df.write.mode("errorifexists").partitionBy(split).parquet(path)
    back = df.sparkSession.read.parquet(path)
    want, got = (x.groupBy(split).agg(F.count(F.lit(1)).alias(n)) for x, n in ((df, "want"), (back, "got")))
    checks.assert_empty(want.join(got, split, "full_outer").where(~F.col("want").eqNullSafe(F.col("got"))), "parts differ from their source")
    return back


ESCAPES = (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"))


def write_ledger(df: DataFrame, path: str) -> None:
    """A ledger file, status, detail, families: tabs and line ends of a field are written as \\t, \\n and \\r."""
    def escaped(name: str):
        out = F.coalesce(F.col(name).cast("string"), F.lit(""))
        for plain, code in ESCAPES:
            out = F.replace(out, F.lit(plain), F.lit(code))
        return out

    df.select(F.concat_ws("\t", *(escaped(c) for c in df.columns)).alias("value")).write.mode("errorifexists").text(path)


def read_ledger(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """The ledger's rows with their escapes undone, from left to right: between doubled backslashes every other one begins a code."""

    def single(part):
        for text, code in ESCAPES[1:]:
            part = F.replace(part, F.lit(code), F.lit(text))
        return part

    plain = lambda cell: F.array_join(F.transform(F.split(cell, r"\\\\"), single), "\\")
    cells = F.split("value", "\t")
    return spark.read.text(path).select(*(plain(F.get(cells, k)).alias(n) for k, n in enumerate(names)))

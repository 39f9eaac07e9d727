"""Queries through files: sources, sinks, streams, and text tables."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline import sources
from loomline.functions import r6, ratio
from loomline.operators import edits as edits_of
from loomline.operators import playback, scorers, windows
from loomline.sources.files import file_inventory
from loomline.streaming import append_results

from .base import query, scratch, table, v_lines, v_turns
from .q_rows import PREFIXES, longest_prefix, tokens


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def src1_strict_jsonl(spark, sf):
    path = scratch(spark)
    lines = table(spark, sf, "orders").select(F.explode(F.array(F.to_json(F.struct("o_orderkey", "o_custkey", "o_orderstatus")), F.lit(""))).alias("value"))
    lines.write.text(path)
    return sources.read_strict_jsonl(spark, path, "o_orderkey long, o_custkey long, o_orderstatus string", "o_orderkey")


@query("SELECT event_id, event_type, user_id, 'array' AS form FROM events UNION ALL SELECT event_id, event_type, user_id, 'object' FROM events")
def src2_json_documents(spark, sf):
    """Files that hold one array of records or one object keyed by id, a file for each range of ids."""
    record = F.struct("event_id", "event_type", "user_id")
    entry = F.struct(F.col("event_id").cast("string"), F.struct("event_type", "user_id"))
    files = table(spark, sf, "events").groupBy(F.expr("event_id div 4096").alias("part")).agg(F.to_json(F.collect_list(record)).alias("array"), F.to_json(F.map_from_entries(F.collect_list(entry))).alias("keyed"))
    array, keyed = scratch(spark), scratch(spark)
    for form, path in (("array", array), ("keyed", keyed)):
        files.select("part", F.col(form).alias("value")).repartition("part").write.partitionBy("part").text(path)
    listed = sources.read_json_array(spark, array, "event_id long, event_type string, user_id long").select("event_id", "event_type", "user_id", F.lit("array").alias("form"))
    mapped = sources.read_keyed_json(spark, keyed, "event_type: string, user_id: bigint")
    return listed.unionByName(mapped.select(F.col("key").cast("long").alias("event_id"), "event_type", "user_id", F.lit("object").alias("form")))


@query("SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE p_size > 20 AND p_brand <> 'Brand#3'")
def src3_header_csv(spark, sf):
    path = scratch(spark)
    table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size").write.option("header", True).csv(path)
    rows = spark.read.schema("p_partkey long, p_name string, p_brand string, p_size int").option("header", True).csv(path)
    return rows.where((F.col("p_size") > 20) & (F.col("p_brand") != "Brand#3"))


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey % 10 <> 3 AND s_suppkey % 10 <> 7")
def src4_dirty_csv(spark, sf):
    """Padded names, repeated headers, totals, short rows and values that don't cast."""
    path = scratch(spark)
    k = F.col("s_suppkey")
    line = F.when(k % 10 == 3, F.concat(k.cast("string"), F.lit(",n/a,x"))).when(k % 10 == 7, F.concat(k.cast("string"), F.lit(",1.5"))).otherwise(F.concat_ws(" , ", k.cast("string"), F.col("s_acctbal").cast("string"), "s_name"))
    noise = F.when(k % 25 == 1, F.array(line, F.lit(" s_suppkey , s_acctbal,name "))).when(k % 25 == 2, F.array(line, F.lit("TOTAL,1,x"))).otherwise(F.array(line))
    body = table(spark, sf, "supplier").select(F.explode(noise).alias("value"))
    head = spark.createDataFrame([(" s_suppkey , s_acctbal,name ",)], "value string")
    head.coalesce(1).write.text(path)
    body.write.mode("append").text(path)
    return sources.read_dirty_csv(spark, path, {"s_suppkey": "long", "s_acctbal": "double"})


@query("SELECT c_name AS name FROM customer WHERE c_custkey % 5 <> 0")
def src5_name_list(spark, sf):
    """Names in several files, each under its header, with comments between them."""
    path = scratch(spark)
    line = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("! "), "c_name")).otherwise(F.col("c_name"))
    table(spark, sf, "customer").select(line.alias("name")).write.option("header", True).option("quote", "").csv(path)
    return sources.read_name_list(spark, path)


@query("SELECT 'key' || s_suppkey AS key, s_name, s_acctbal FROM supplier WHERE s_suppkey % 4 <> 1")
def src6_keyed_directory(spark, sf):
    """A folder for each key whose file carries the key in its path; some keys have none."""
    path = scratch(spark)
    kept = table(spark, sf, "supplier").where("s_suppkey % 4 <> 1")
    sources.write_keyed_directory(kept.select(F.concat(F.lit("key"), F.col("s_suppkey").cast("string")).alias("k"), "s_name", "s_acctbal"), path, "k")
    return sources.read_keyed_directory(spark, path, "s_name string, s_acctbal double", r"/k=([^/]+)/").select("key", "s_name", "s_acctbal")


@query()
def src7_file_inventory(spark, sf):
    """All files of all tables, named by their path; tables in several parts have files of the same name."""
    return file_inventory(spark, sf, "*.parquet", unique=False)


@query("SELECT event_id, round(value, 6) AS sec, event_type AS type, CASE WHEN event_id % 3 > 0 THEN '4/4' END AS meter, CASE WHEN event_id % 3 = 2 THEN (event_id % 12)::INT END AS key FROM events")
def src8_annotations(spark, sf):
    path = scratch(spark)
    k = F.col("event_id")
    last = F.concat_ws(",", "event_type", F.when(k % 3 > 0, F.lit("4/4")), F.when(k % 3 == 2, (k % 12).cast("string")))
    table(spark, sf, "events").select(F.concat_ws("\t", F.col("value").cast("string"), k.cast("string"), last).alias("value")).write.text(path)
    return sources.read_annotations(spark, path).select(F.col("until").cast("long").alias("event_id"), r6("sec").alias("sec"), "type", "meter", "key")


@query("SELECT doc_id, line_no, line FROM v_lines")
def src9_document_lines(spark, sf):
    return v_lines(spark, sf)


@query("SELECT * FROM orders")
def snk1_publish(spark, sf):
    return sources.publish(table(spark, sf, "orders"), scratch(spark))


@query("SELECT c_mktsegment AS split, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer GROUP BY 1")
def snk2_splits(spark, sf):
    back = sources.publish_splits(table(spark, sf, "customer").withColumnRenamed("c_mktsegment", "split"), scratch(spark), "split")
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))


@query(r"SELECT doc_id::VARCHAR AS file, split_part(text, ':', 1) AS status, CASE WHEN contains(text, ':') THEN regexp_replace(substr(text, strpos(text, ':') + 1), '^\s+|\s+\z', '', 'g') ELSE '' END AS detail, source AS families FROM documents")
def snk3_ledger(spark, sf):
    """Whole messages `status: detail` cut at their first colon, written with escapes and read again."""
    at = F.instr("text", ":")
    detail = F.regexp_replace(F.substr("text", at + 1), r"^\s+|\s+\z", "")
    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file"), F.substring_index("text", ":", 1).alias("status"), F.when(at > 0, detail).otherwise("").alias("detail"), F.col("source").alias("families"))
    path = scratch(spark)
    sources.write_ledger(rows, path)
    return sources.read_ledger(spark, path, "file", "status", "detail", "families")


# Text tables ------------------------------------------------------------------------------------


SECTIONS_SQL = "SELECT doc_id, section, min(line_no) AS first, max(line_no) AS last FROM (SELECT doc_id, line_no, line, sum(starts_with(line, 'T')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM v_lines) WHERE NOT starts_with(line, 'T') GROUP BY 1, 2"


def sections(spark, sf) -> DataFrame:
    """Lines with the number of their section; a line that starts with T opens one."""
    return windows.islands(v_lines(spark, sf), "doc_id", "line_no", F.startswith("line", F.lit("T")), "section")


@query(f"SELECT doc_id, section::BIGINT AS section, first, last FROM ({SECTIONS_SQL})")
def txt1_section_spans(spark, sf):
    """First and last line of each section behind its marker; empty sections drop out, section 0 is the pickup."""
    body = sections(spark, sf).where(~F.startswith("line", F.lit("T")))
    return body.groupBy("doc_id", "section").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"))


@query(f"SELECT s.doc_id, o.place, s.section::BIGINT AS section, l.line_no, row_number() OVER (PARTITION BY s.doc_id, s.section, l.line_no ORDER BY o.place) AS occurrence FROM ({SECTIONS_SQL}) s JOIN (VALUES (0, 0), (1, 1), (2, 1), (3, 2), (4, 1)) o(place, section) USING (section) JOIN v_lines l ON l.doc_id = s.doc_id AND l.line_no BETWEEN s.first AND s.last AND NOT starts_with(l.line, 'T')")
def txt2_playback(spark, sf):
    """Sections in a listed order, some of them more than once, as lines with their occurrence."""
    order = [(0, 0), (1, 1), (2, 1), (3, 2), (4, 1)]
    # How often a section has come before depends on the list alone.
    ranked = [(place, section, sum(s == section for _, s in order[: k + 1])) for k, (place, section) in enumerate(order)]
    body = sections(spark, sf).where(~F.startswith("line", F.lit("T")))
    played = body.join(F.broadcast(spark.createDataFrame(ranked, "place int, section long, occurrence long")), "section")
    return played.select("doc_id", "place", "section", "line_no", "occurrence")


LABELS = ("A", "B", "B1", "B2", "C", "D1", "D2", "E2")
ORDERS = ("*>[A,A,B,B1,B,B2]", "*>[A, B1 ,A,B2,C]", None, "*>[A,Q,C,D1,C,D2]", "*>[C,E2,C]")
SCORES_SQL = f"""SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, sub) - 1 AS line_no FROM (
SELECT doc_id, -1 AS line_no, 0 AS sub, {list(ORDERS)!r}[doc_id % 5 + 1] AS line FROM documents UNION ALL
SELECT doc_id, line_no, unnest([0, 1]) AS sub, unnest([CASE WHEN starts_with(line, 'T') THEN '*>' || coalesce({list(LABELS)}[k], 'S' || k) END, line]) AS line
FROM (SELECT *, sum(starts_with(line, 'T')::INT) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS k FROM v_lines)) WHERE line IS NOT NULL""".replace("None", "NULL")
MARKED_SQL = f"SELECT *, nullif(regexp_extract(line, '^\\*>([A-Za-z0-9]+)\\s*$', 1), '') AS mark, regexp_extract(line, '^\\*>\\[([^\\]]+)\\]', 1) AS listed FROM ({SCORES_SQL})"
VISITS_SQL = f"""m AS ({MARKED_SQL}), body AS (SELECT doc_id, line_no, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section, mark, listed FROM m),
has AS (SELECT doc_id, section, min(line_no) AS first FROM body WHERE mark IS NOT NULL OR listed = '' GROUP BY 1, 2),
declared AS (SELECT doc_id, unnest(string_split(arg_min(listed, line_no), ',')) AS section, generate_subscripts(string_split(arg_min(listed, line_no), ','), 1) - 1 AS place FROM m WHERE listed <> '' GROUP BY doc_id),
plan AS (SELECT doc_id, place, trim(section) AS section FROM declared UNION ALL SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1, section FROM has WHERE doc_id NOT IN (SELECT doc_id FROM declared)),
visits AS (SELECT p.*, row_number() OVER (PARTITION BY p.doc_id, p.section ORDER BY place) - 1 AS occurrence, h.doc_id IS NOT NULL AS known, CASE WHEN regexp_matches(p.section, '^[A-Za-z]+[0-9]+$') AND EXISTS (SELECT 1 FROM has o WHERE o.doc_id = p.doc_id AND o.section = regexp_extract(p.section, '^[A-Za-z]*') || CASE WHEN regexp_extract(p.section, '[0-9]+$') = '1' THEN '2' ELSE '1' END) THEN regexp_extract(p.section, '[0-9]+$')::INT ELSE 0 END AS ending FROM plan p LEFT JOIN has h ON h.doc_id = p.doc_id AND h.section = p.section)"""


def score_lines(spark, sf) -> DataFrame:
    """Documents as scores: four of five declare an order, and each line that begins with T opens a section with the next label."""
    lines = sections(spark, sf)
    label = F.coalesce(F.get(F.array(*map(F.lit, LABELS)), (F.col("section") - 1).cast("int")), F.concat(F.lit("S"), F.col("section").cast("string")))
    both = F.when(F.startswith("line", F.lit("T")), F.array(F.concat(F.lit("*>"), label), F.col("line"))).otherwise(F.array("line"))
    body = lines.select("doc_id", "line_no", F.posexplode(both).alias("sub", "line"))
    order = F.get(F.array(*map(F.lit, ORDERS)), (F.col("doc_id") % 5).cast("int"))
    heads = table(spark, sf, "documents").select("doc_id", F.lit(-1).cast("long").alias("line_no"), F.lit(0).alias("sub"), order.alias("line")).where("line IS NOT NULL")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "sub")) - 1
    return body.unionByName(heads).withColumn("line_no", number.cast("long")).drop("sub")


@query(f"WITH {VISITS_SQL} SELECT v.doc_id, v.place::BIGINT AS place, v.section, b.line_no, v.occurrence, v.occurrence > 0 AS is_repeat, v.ending FROM visits v JOIN body b ON b.doc_id = v.doc_id AND b.section = v.section AND b.mark IS NULL AND b.listed = '' UNION ALL SELECT doc_id, place, section, NULL, occurrence, occurrence > 0, ending FROM visits WHERE NOT known")
def txt2_declared_playback(spark, sf):
    """Lines in the order that each document declares, with occurrences and endings; undeclared sections are violations."""
    return playback.played(score_lines(spark, sf))


@query(f"WITH {VISITS_SQL}, sized AS (SELECT v.*, (SELECT count(*) FROM body b WHERE b.doc_id = v.doc_id AND b.section = v.section AND b.mark IS NULL AND b.listed = '') AS n FROM visits v) SELECT doc_id, bool_or(occurrence > 0) AS has_repeats, sum(CASE WHEN occurrence = 0 THEN n ELSE 0 END)::BIGINT AS original, sum(n)::BIGINT AS expanded, count_if(NOT known)::BIGINT AS undeclared, round(sum(n) / nullif(sum(CASE WHEN occurrence = 0 THEN n ELSE 0 END), 0), 6) AS ratio FROM sized GROUP BY 1")
def txt2_expansion_ratio(spark, sf):
    """How much longer each document is when played."""
    return playback.expansion(score_lines(spark, sf)).withColumn("ratio", r6("ratio"))


LABEL_SQL = "CASE WHEN doc_id % 5 = 0 THEN '*' ELSE (doc_id % 3)::VARCHAR END"
PATCH_SQL = f"SELECT doc_id + CASE WHEN doc_id % 50 = 9 THEN 100000000 ELSE 0 END AS doc_id, {LABEL_SQL} AS label, (doc_id % 4 + CASE WHEN doc_id % 50 = 3 THEN 1000 ELSE 0 END)::INT AS col, string_split(line, ' ')[doc_id % 4 + 1] AS old, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE 'PATCHED' END AS new FROM v_lines WHERE line_no = doc_id % 7"


@query(f"""WITH p AS ({PATCH_SQL}), l AS (SELECT *, (sum(starts_with(line, 'T')::INT) OVER (PARTITION BY doc_id ORDER BY line_no))::VARCHAR AS section, string_split(line, ' ') AS cells FROM v_lines),
s AS (SELECT p.*, l.doc_id IS NULL AS missing, l.line_no, l.line, coalesce(p.label = '*' OR p.label = l.section, false) AS inside, l.cells[p.col + 1] AS cell, l.cells FROM p LEFT JOIN l USING (doc_id)),
h AS (SELECT doc_id, label, col, old, new, bool_or(missing) AS missing, bool_or(inside) AS found, coalesce(max(len(cells)) FILTER (inside), 0) AS wide, coalesce(count_if(inside AND cell = old), 0) AS hits, string_agg(CASE WHEN coalesce(inside AND cell = old, false) THEN array_to_string(list_transform(cells, lambda c, i: CASE WHEN i = col + 1 THEN coalesce(new, '') ELSE c END), ' ') ELSE line END, chr(10) ORDER BY line_no) AS patched FROM s GROUP BY 1, 2, 3, 4, 5)
SELECT doc_id, label, CASE WHEN missing THEN 'no_document' WHEN NOT found THEN 'no_section' WHEN col >= wide THEN 'no_column' WHEN hits = 1 THEN 'applied' ELSE 'not_unique' END AS verdict, CASE WHEN NOT missing AND found AND col < wide THEN hits::BIGINT ELSE 0 END AS hits, CASE WHEN NOT missing AND hits = 1 THEN sha256(patched) END AS patched FROM h""")
def txt3_patches(spark, sf):
    """A patch for each document, addressed by section (`*`: anywhere), column and exact old cell, applied where that is found exactly once; the verdict names what is wrong otherwise."""
    doc = F.col("doc_id")
    lines = v_lines(spark, sf)
    patches = lines.where(F.col("line_no") == doc % 7).select(
        (doc + F.when(doc % 50 == 9, 100000000).otherwise(0)).alias("doc_id"),
        F.when(doc % 5 == 0, "*").otherwise((doc % 3).cast("string")).alias("label"),
        (doc % 4 + F.when(doc % 50 == 3, 1000).otherwise(0)).cast("int").alias("col"),
        F.get(F.split("line", " "), (doc % 4).cast("int")).alias("old"),
        F.when(doc % 6 != 0, "PATCHED").alias("new"),
    )
    return apply_patches(sections(spark, sf).withColumn("section", F.col("section").cast("string")), patches)


def apply_patches(lines: DataFrame, patches: DataFrame) -> DataFrame:
    """Verdict and hits of each patch (doc_id, label, col, old, new), and the digest of the patched text. `lines` has doc_id, section, line_no and line."""
    cells, cell = F.split("line", " "), F.get(F.split("line", " "), F.col("col"))
    seen = patches.join(lines.withColumn("there", F.lit(True)), "doc_id", "left")
    inside = F.coalesce((F.col("label") == "*") | (F.col("label") == F.col("section")), F.lit(False)) & F.col("there").isNotNull()
    hit = inside & F.coalesce(cell == F.col("old"), F.lit(False))
    line = F.when(hit, F.array_join(F.transform(cells, lambda c, k: F.when(k == F.col("col"), F.coalesce("new", F.lit(""))).otherwise(c)), " ")).otherwise(F.col("line"))
    found = seen.groupBy("doc_id", "label", "col", "old", "new").agg(
        F.bool_or(F.col("there").isNull()).alias("missing"), F.bool_or(inside).alias("found"), F.coalesce(F.max(F.when(inside, F.size(cells))), F.lit(0)).alias("wide"), F.count_if(hit).alias("n"),
        F.array_sort(F.collect_list(F.struct("line_no", line.alias("line")))).alias("text"),
    )
    good = ~F.col("missing") & F.col("found") & (F.col("col") < F.col("wide"))
    verdict = F.when(F.col("missing"), "no_document").when(~F.col("found"), "no_section").when(F.col("col") >= F.col("wide"), "no_column").when(F.col("n") == 1, "applied").otherwise("not_unique")
    patched = F.sha2(F.array_join(F.transform("text", lambda x: x["line"]), "\n"), 256)
    return found.select("doc_id", "label", verdict.alias("verdict"), F.when(good, F.col("n")).otherwise(0).alias("hits"), F.when(~F.col("missing") & (F.col("n") == 1), patched).alias("patched"))


@query("WITH d AS (SELECT conv_id, turn, role, text, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS declared FROM v_turns) SELECT conv_id, string_agg(role || ':' || length(text), '|' ORDER BY turn) AS slice FROM (SELECT conv_id, turn, role, text FROM d WHERE turn BETWEEN 2 AND 3 UNION ALL SELECT t.conv_id, t.turn, t.role, t.text FROM d JOIN v_turns t ON t.conv_id = d.conv_id AND t.turn = d.declared WHERE d.turn = 2) GROUP BY 1")
def txt4_self_contained_slice(spark, sf):
    """The declaration in force where a slice begins, then the slice's own rows."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = v_turns(spark, sf).withColumn("item", F.struct("turn", F.concat_ws(":", "role", F.length("text").cast("string")).alias("x")))
    declared = turns.withColumn("declared", F.last(F.when(F.col("role") == "user", F.col("item")), ignorenulls=True).over(w))
    rows = declared.where("turn BETWEEN 2 AND 3").withColumn("items", F.when((F.col("turn") == 2) & F.col("declared").isNotNull(), F.array("declared", "item")).otherwise(F.array("item")))
    gathered = rows.groupBy("conv_id").agg(F.array_sort(F.flatten(F.collect_list("items"))).alias("items"))
    return gathered.select("conv_id", F.array_join(F.transform("items", lambda i: i["x"]), "|").alias("slice"))


PAIRS_SQL = "SELECT a.conv_id, a.turn, a.text AS a, b.text AS b FROM v_turns a JOIN v_turns b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


def turn_pairs(spark, sf) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = v_turns(spark, sf).select("conv_id", "turn", F.col("text").alias("a"), F.lead("text").over(w).alias("b"), F.lead("turn").over(w).alias("next"))
    return pairs.where("next = turn + 1").drop("next")


BEYOND_ASCII = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"  # DuckDB's levenshtein counts bytes: each of these stands as one byte that no text has
ONE_BYTE = "translate({}, '" + BEYOND_ASCII + "', " + " || ".join(f"chr({1 + k if k < 8 else 6 + k})" for k in range(len(BEYOND_ASCII))) + ")"


@query(f"SELECT conv_id, round(avg(coalesce(e / nullif(n, 0), 0)), 6) AS macro_rate, round(coalesce(sum(e) / nullif(sum(n), 0), 0), 6) AS corpus_rate, count(*) AS pairs FROM (SELECT conv_id, levenshtein({ONE_BYTE.format('a')}, {ONE_BYTE.format('b')}) AS e, length(a) + length(b) AS n FROM ({PAIRS_SQL})) GROUP BY 1")
def txt5_edit_distance(spark, sf):
    """Edits over characters of neighbouring texts, whole, as a mean of ratios and a ratio of sums."""
    scored = turn_pairs(spark, sf).select("conv_id", F.levenshtein("a", "b").cast("long").alias("e"), (F.length("a") + F.length("b")).cast("long").alias("n"))
    return scored.groupBy("conv_id").agg(r6(F.avg(ratio("e", "n"))).alias("macro_rate"), r6(ratio(F.sum("e"), F.sum("n"))).alias("corpus_rate"), F.count(F.lit(1)).alias("pairs"))


CODE_SQL = "33 + 3 * CASE WHEN ascii(lower({0})) BETWEEN 97 AND 122 THEN ascii(lower({0})) - 96 ELSE 0 END + length({0}) % 3"
CODES_SQL = "list_transform(list_filter(string_split({}, ' '), lambda w: w <> ''), lambda w: chr((" + CODE_SQL.format("w") + ")::INT))"
SYMBOLS_SQL = f"SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 9 = 4 THEN 'error' WHEN b IS NULL THEN 'missing' ELSE 'success' END AS status, array_to_string(a, '') AS a, array_to_string(b, '') AS b FROM (SELECT a.conv_id, a.turn, {CODES_SQL.format('a.text')} AS a, {CODES_SQL.format('b.text')} AS b FROM v_turns a LEFT JOIN v_turns b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
SCORED_SQL = f"SELECT conv_id, turn, status, CASE WHEN status = 'success' THEN levenshtein(a, b) END::BIGINT AS e, CASE WHEN status = 'success' THEN length(a) + length(b) END::BIGINT AS n FROM ({SYMBOLS_SQL})"


def symbol_pairs(spark, sf) -> DataFrame:
    """Turns and their successors as arrays of symbols (a word's first letter and its length modulo 3), some with a status from before and some without a successor."""
    letter = lambda word: F.ascii(F.lower(word))
    code = lambda word: F.lit(33) + F.when(letter(word).between(97, 122), letter(word) - 96).otherwise(0) * 3 + F.length(word) % 3
    symbols = lambda text: F.transform(F.filter(F.split(text, " "), lambda word: word != ""), code)
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = v_turns(spark, sf).withColumns({"following": F.lead("text").over(w), "next": F.lead("turn").over(w)})
    before = F.when((F.col("conv_id") + F.col("turn")) % 9 == 4, "error")
    return turns.select("conv_id", "turn", before.alias("before"), symbols("text").alias("a"), F.when(F.col("next") == F.col("turn") + 1, symbols("following")).alias("b"))


@query(f"SELECT conv_id, count(*) AS n_total, count_if(status = 'success')::BIGINT AS n_success, count_if(status = 'missing')::BIGINT AS n_missing, count_if(status = 'error')::BIGINT AS n_failed, round(avg(coalesce(e / nullif(n, 0), 0)) FILTER (status = 'success'), 6) AS macro_rate, CASE WHEN n_success > 0 THEN round(coalesce(sum(e) / nullif(sum(n), 0), 0), 6) END AS corpus_rate, sum(e)::BIGINT AS edits, sum(n)::BIGINT AS symbols FROM ({SCORED_SQL}) GROUP BY 1")
def txt5_symbol_edits(spark, sf):
    """Edits of whole symbols between neighbouring turns, as a mean of rates and a rate of sums, with pairs that could not be scored apart."""
    scored = edits_of.with_edits(symbol_pairs(spark, sf), "a", "b", F.col("before"))
    return edits_of.edit_rates(scored, "conv_id").withColumns({c: r6(c) for c in ("macro_rate", "corpus_rate")})


TEMPO_SQL = "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'unit = ' || (60 + p_size) WHEN p_partkey % 5 = 1 THEN 'unknown; ' || p_name ELSE p_name END AS t FROM part"


@query(f"SELECT p_partkey, coalesce(TRY_CAST(nullif(regexp_extract(t, 'unit = (\\d+)', 1), '') AS INTEGER), min_by(code, place) FILTER (code IS NOT NULL)) AS bpm FROM (SELECT p_partkey, t, place, (SELECT arg_max(code, length(prefix)) FROM (VALUES {', '.join(str(x) for x in PREFIXES)}) d(prefix, code) WHERE starts_with(part, prefix)) AS code FROM (SELECT p_partkey, t, unnest(string_split(t, '; ')) AS part, generate_subscripts(string_split(t, '; '), 1) AS place FROM ({TEMPO_SQL}))) GROUP BY p_partkey, t")
def txt6_tempo_lookup(spark, sf):
    """An explicit number, else the first part of the text that a dictionary knows by its longest prefix."""
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, F.concat(F.lit("unit = "), (60 + F.col("p_size")).cast("string"))).when(k % 5 == 1, F.concat(F.lit("unknown; "), "p_name")).otherwise(F.col("p_name"))
    parts = table(spark, sf, "part").select("p_partkey", text.alias("t")).select("p_partkey", "t", F.posexplode(F.split("t", "; ")).alias("place", "part"))
    coded = longest_prefix(parts, "part", PREFIXES)
    explicit = F.nullif(F.regexp_extract("t", r"unit = (\d+)", 1), F.lit("")).try_cast("int")
    return coded.groupBy("p_partkey", "t").agg(F.min_by("code", F.when(F.col("code").isNotNull(), F.col("place"))).alias("code")).select("p_partkey", F.coalesce(explicit, "code").alias("bpm"))


@query("SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS token FROM documents) WHERE regexp_matches(token, '[#*$%&|]') GROUP BY 1 ORDER BY n DESC, token LIMIT 25")
def srt3_top_tokens(spark, sf):
    """The most frequent unclean tokens: the limit is the feature."""
    unclean = tokens(spark, sf).where(F.col("token").rlike("[#*$%&|]")).groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("k"))
    return unclean.groupBy("token").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("docs")).orderBy(F.desc("n"), "token").limit(25)


CATEGORIES = (("number sign", "#"), ("money", "[$%]"), ("joined", "[&|]"))


@query(f"""WITH t AS (SELECT token, count(*) AS n FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS token FROM documents) WHERE regexp_matches(token, '[#*$%&|]') GROUP BY 1 ORDER BY n DESC, token LIMIT 100)
SELECT CASE {' '.join(f"WHEN regexp_matches(token, '{rule}') THEN '{name}'" for name, rule in CATEGORIES)} ELSE 'other' END AS category, count(*) AS tokens, sum(n)::BIGINT AS occurrences FROM t GROUP BY 1""")
def srt3_token_categories(spark, sf):
    """The hundred most frequent unclean tokens by the first kind that each is of: the limit is the feature."""
    top = tokens(spark, sf).where(F.col("token").rlike("[#*$%&|]")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(100)
    return by_category(top, "token", CATEGORIES).groupBy("category").agg(F.count(F.lit(1)).alias("tokens"), F.sum("n").alias("occurrences"))


def by_category(df: DataFrame, column: str, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """Adds the name of the first rule (name, pattern) that a text fits, else `other`."""
    kind = F
    for name, pattern in rules:
        kind = kind.when(F.col(column).rlike(pattern), name)
    return df.withColumn("category", kind.otherwise("other"))


@query("SELECT event_id, event_type, user_id FROM events")
def inc2_append_stream(spark, sf):
    """Result files that repeat some rows, appended as a stream, each key once."""
    rows = table(spark, sf, "events").select("event_id", "event_type", "user_id")
    incoming, target, state = scratch(spark), scratch(spark), scratch(spark)
    rows.repartition(6, "event_id").write.parquet(incoming)
    rows.where("event_id % 10 = 0").write.mode("append").parquet(incoming)
    return append_results(spark, incoming, target, state, rows.schema, "event_id")


def edits(a: str, b: str) -> float | None:
    """Share of differing places; refuses some inputs, fails on some, hangs on some and ends its process on some, as a real scorer does."""
    if len(a) % 97 == 1:
        time.sleep(600)
    if len(a) % 89 == 2:
        os._exit(3)
    if len(a) % 7 == 0:
        raise ValueError("length")
    if len(b) % 5 == 0:
        return None
    return sum(x != y for x, y in zip(a, b)) / max(len(a), len(b))


@query(f"SELECT conv_id, turn, CASE WHEN length(a) % 97 = 1 THEN 'timeout' WHEN length(a) % 89 = 2 THEN 'crashed' WHEN length(a) % 7 = 0 THEN 'error' WHEN length(b) % 5 = 0 THEN 'empty' ELSE 'success' END AS status, CASE WHEN length(a) % 97 = 1 THEN 'over 1.0 s' WHEN length(a) % 89 = 2 THEN 'exit code 3' WHEN length(a) % 7 = 0 THEN 'ValueError: length' WHEN length(b) % 5 = 0 THEN 'no result' END AS message FROM ({PAIRS_SQL})")
def udf1_fault_isolation(spark, sf):
    """A scorer over pairs whose failures, death and time limit become statuses."""
    # Few bytes and much waiting: adaptive execution would put all pairs into few tasks.
    pairs = turn_pairs(spark, sf).repartition(spark.sparkContext.defaultParallelism)
    scored = pairs.mapInPandas(scorers.score_pairs(edits, 1.0), "conv_id long, turn long, status string, score double, message string")
    return scored.select("conv_id", "turn", "status", "message")

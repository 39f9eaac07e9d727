"""Row-wise queries, dictionary and key joins, nested data, seeded plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import draw_int, draw_unit, fractions, md5_key, r6, ratio
from loomline.operators import checks, digests, routes
from loomline.operators.windows import ranked

from .base import kept, query, table, v_bars, v_turns


def values(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    """A small list or dictionary given in the query itself."""
    return spark.createDataFrame(list(rows), schema)


# Compound ids ---------------------------------------------------------------------------------


def parse_id(column: str) -> tuple[Column, Column, Column]:
    """piece, performance and index of `piece#performance.index`, split from the right; missing parts are '' and 0."""
    c = F.col(column)
    dotted = c.contains(".")
    stem = F.when(dotted, F.regexp_extract(c, r"^(.*)\.[^.]*$", 1)).otherwise(c)
    index = F.when(dotted, F.coalesce(F.substring_index(c, ".", -1).try_cast("int"), F.lit(0))).otherwise(0)
    hashed = stem.contains("#")
    return F.when(hashed, F.regexp_extract(stem, r"^(.*)#[^#]*$", 1)).otherwise(stem), F.when(hashed, F.substring_index(stem, "#", -1)).otherwise(""), index


@query("""SELECT id, CASE WHEN contains(stem, '#') THEN regexp_extract(stem, '^(.*)#[^#]*$', 1) ELSE stem END AS piece, CASE WHEN contains(stem, '#') THEN regexp_extract(stem, '([^#]*)$', 1) ELSE '' END AS performance, CASE WHEN contains(id, '.') THEN coalesce(TRY_CAST(regexp_extract(id, '([^.]*)$', 1) AS INTEGER), 0) ELSE 0 END AS idx
FROM (SELECT *, CASE WHEN contains(id, '.') THEN regexp_extract(id, '^(.*)\\.[^.]*$', 1) ELSE id END AS stem FROM (SELECT DISTINCT CASE l_linenumber % 4 WHEN 0 THEN l_orderkey || '' WHEN 1 THEN l_orderkey || '#' || l_suppkey || '.' || l_linenumber WHEN 2 THEN l_orderkey || '#' || l_suppkey ELSE l_orderkey || '.x' END AS id FROM lineitem))""")
def prj1_compound_id(spark, sf):
    kind = F.col("l_linenumber") % 4
    made = F.when(kind == 0, F.concat("l_orderkey")).when(kind == 1, F.concat("l_orderkey", F.lit("#"), "l_suppkey", F.lit("."), "l_linenumber")).when(kind == 2, F.concat("l_orderkey", F.lit("#"), "l_suppkey")).otherwise(F.concat("l_orderkey", F.lit(".x")))
    ids = table(spark, sf, "lineitem").select(made.cast("string").alias("id")).distinct()
    piece, performance, index = parse_id("id")
    return ids.select("id", piece.alias("piece"), performance.alias("performance"), index.alias("idx"))


@query("SELECT p_partkey, coalesce(nullif(CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE '' END, ''), nullif(CASE WHEN p_partkey % 3 = 1 THEN p_brand END, ''), p_type) AS id FROM part")
def prj6_aliased_pick(spark, sf):
    """The first column that is not empty gives the id."""
    part = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise("").alias("a"), F.when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).alias("b"), "p_type")
    return part.select("p_partkey", first_filled("a", "b", "p_type").alias("id"))


def first_filled(*columns: str) -> Column:
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns))


@query("SELECT regexp_replace(p_name, ' [a-z]+$', '') AS family, count(*) AS n, count(DISTINCT p_name) AS variants FROM part GROUP BY 1")
def prj7_variant_folding(spark, sf):
    folded = table(spark, sf, "part").withColumn("family", F.regexp_replace("p_name", " [a-z]+$", ""))
    return folded.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_name").alias("variants"))


@query("SELECT c_custkey, r.mapped || '_' || split_part(c_name, '#', 2) AS canonical FROM customer JOIN (VALUES ('Customer', 'cust'), ('Supplier', 'supp')) r(prefix, mapped) ON split_part(c_name, '#', 1) = r.prefix")
def prj8_canonical_names(spark, sf):
    """prefix#name becomes mapped_name through a dictionary of prefixes, an equi-join instead of a search through all names."""
    prefixes = values(spark, "prefix string, mapped string", ("Customer", "cust"), ("Supplier", "supp"))
    named = table(spark, sf, "customer").select("c_custkey", F.split_part("c_name", F.lit("#"), F.lit(1)).alias("prefix"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("rest"))
    return named.join(F.broadcast(prefixes), "prefix").select("c_custkey", F.concat_ws("_", "mapped", "rest").alias("canonical"))


@query("SELECT user_id, bar, round(start_sec, 4) AS start_key, round(end_sec, 4) AS end_key, isfinite(start_sec) AND isfinite(end_sec) AND end_sec > start_sec AS valid FROM v_bars")
def prj9_time_key(spark, sf):
    finite = lambda c: F.abs(F.col(c)) < float("inf")
    return v_bars(spark, sf).select("user_id", "bar", F.round("start_sec", 4).alias("start_key"), F.round("end_sec", 4).alias("end_key"), (finite("start_sec") & finite("end_sec") & (F.col("end_sec") > F.col("start_sec"))).alias("valid"))


@query("SELECT p_partkey, num, den, CASE WHEN num > 3 AND num % 3 = 0 THEN num // 3 ELSE num END AS large, num > 3 AND num % 3 = 0 AS compound FROM (SELECT p_partkey, regexp_extract(m, '^\\*M(\\d+)/(\\d+)$', 1)::INT AS num, regexp_extract(m, '^\\*M(\\d+)/(\\d+)$', 2)::INT AS den FROM (SELECT p_partkey, '*M' || (p_size % 12 + 1) || '/' || [2, 4, 8][p_size % 3 + 1] AS m FROM part))")
def prj10_meter(spark, sf):
    """*Mn/d as numbers; a compound meter has a third of its beats as large ones."""
    meter = F.concat(F.lit("*M"), (F.col("p_size") % 12 + 1).cast("string"), F.lit("/"), F.element_at(F.array(*map(F.lit, ("2", "4", "8"))), F.col("p_size") % 3 + 1))
    parsed = table(spark, sf, "part").select("p_partkey", *(F.regexp_extract(meter, r"^\*M(\d+)/(\d+)$", k).cast("int").alias(n) for k, n in ((1, "num"), (2, "den"))))
    compound = (F.col("num") > 3) & (F.col("num") % 3 == 0)
    return parsed.withColumns({"large": F.when(compound, F.expr("num div 3").cast("int")).otherwise(F.col("num")), "compound": compound})


TOKENS = ("4", "8.", "16..", "3%2", "[0a", "(4A.", "q8", ".", "=12", "12", "6%5. 8", "r")
TOKEN_SQL = f"SELECT p_partkey, generate_subscripts(t, 1) AS place, unnest(t) AS token FROM (SELECT p_partkey, list_transform(range(p_size % 6 + 2), lambda i: {list(TOKENS)}[((p_partkey * 7 + i * 5) % 12 + 1)::INT]) AS t FROM part)"


@query(f"""WITH d AS (SELECT *, TRY_CAST(nullif(regexp_extract(token, '(\\d+)(?:%(\\d+))?', 1), '') AS BIGINT) AS top, coalesce(TRY_CAST(nullif(regexp_extract(token, '(\\d+)(?:%(\\d+))?', 2), '') AS BIGINT), 1) AS bottom, length(split_part(token, ' ', 1)) - length(replace(split_part(token, ' ', 1), '.', '')) AS dots FROM ({TOKEN_SQL})),
f AS (SELECT p_partkey, CASE WHEN token IN ('.', 'r') OR token[1] = '=' THEN NULL WHEN contains(token, 'q') THEN 0 WHEN top = 0 THEN 8 * (2 * (1 << dots) - 1) ELSE 4 * bottom * (2 * (1 << dots) - 1) END AS num, CASE WHEN contains(token, 'q') THEN 1 WHEN top = 0 THEN 1 << dots ELSE top * (1 << dots) END AS den FROM d),
s AS (SELECT p_partkey, sum(num * (2880 // den))::BIGINT AS parts, count(num) AS notes, count(*) - count(num) AS silent FROM f GROUP BY 1)
SELECT p_partkey, notes, silent, coalesce(parts, 0) // gcd(coalesce(parts, 0), 2880) AS num, 2880 // gcd(coalesce(parts, 0), 2880) AS den, coalesce(parts, 0) < 2880 * 4 AS short, coalesce(parts, 0) > 2880 * 4 AS overfull FROM s""")
def prj10_durations(spark, sf):
    """The notes' exact lengths summed for each part, and whether they fall short of or exceed four quarters."""
    place = F.sequence(F.lit(0).cast("long"), (F.col("p_size") % 6 + 1).cast("long"))
    tokens_of = F.transform(place, lambda i: F.get(F.array(*map(F.lit, TOKENS)), ((F.col("p_partkey") * 7 + i * 5) % 12).cast("int")))
    # Small rows with much to compute: a file of few row groups would be few tasks.
    parts = table(spark, sf, "part").select("p_partkey", "p_size").repartition(spark.sparkContext.defaultParallelism, "p_partkey")
    lengths = parts.select("p_partkey", F.transform(tokens_of, fractions.note_duration).alias("d"))
    known = F.filter("d", lambda x: x.isNotNull())
    summed = lengths.select("p_partkey", F.size(known).cast("long").alias("notes"), (F.size("d") - F.size(known)).cast("long").alias("silent"), fractions.checked(fractions.total(known)).alias("f"))
    four = fractions.fraction(4, 1)
    return summed.select("p_partkey", "notes", "silent", "f.num", "f.den", fractions.less(F.col("f"), four).alias("short"), fractions.less(four, F.col("f")).alias("overfull"))


@query("SELECT event_id, coalesce(id, -100) AS label FROM events LEFT JOIN (VALUES ('click', 0), ('purchase', 1), ('view', 2)) v(name, id) ON event_type = name")
def prj11_label_encoding(spark, sf):
    words = values(spark, "event_type string, id int", ("click", 0), ("purchase", 1), ("view", 2))
    return encode_labels(table(spark, sf, "events"), words, "event_type").select("event_id", "label")


def encode_labels(df: DataFrame, vocabulary: DataFrame, column: str, unknown: int = -100) -> DataFrame:
    return df.join(F.broadcast(vocabulary), column, "left").withColumn("label", F.coalesce("id", F.lit(unknown)))


TOKENS_SQL = "SELECT doc_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS token FROM documents"


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("token"))


TOKEN_CLASS = "CASE WHEN starts_with(token, '###') THEN 'schema' WHEN token IN ('|', '***', '$$$') THEN 'structure' WHEN regexp_matches(token, '^[0-9]+\\.*$') THEN 'duration' ELSE 'pitch' END"


def token_class(token: str = "token") -> Column:
    return F.when(F.startswith(token, F.lit("###")), "schema").when(F.col(token).isin("|", "***", "$$$"), "structure").when(F.col(token).rlike(r"^[0-9]+\.*$"), "duration").otherwise("pitch")


@query(f"SELECT class, count(*) AS n, count(DISTINCT token) AS types FROM (SELECT token, {TOKEN_CLASS} AS class FROM ({TOKENS_SQL}) WHERE token <> '') GROUP BY 1")
def prj12_token_class(spark, sf):
    """Counted by token first, so that the distinct count sees each token once."""
    counted = tokens(spark, sf).where("token <> ''").groupBy("token").agg(F.count(F.lit(1)).alias("k"))
    return counted.groupBy(token_class().alias("class")).agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("types"))


@query("SELECT p_partkey, id FROM (SELECT p_partkey, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_name || '~' || p_brand END, CASE WHEN p_partkey % 3 = 0 THEN p_brand END, p_type) AS id FROM part) WHERE regexp_extract(id, '([^~]*)$', 1) IN ('Brand#11', 'Brand#12', 'Brand#21')")
def prj13_timbre_filter(spark, sf):
    named = table(spark, sf, "part").select("p_partkey", F.coalesce(F.when(F.col("p_partkey") % 2 == 0, F.concat_ws("~", "p_name", "p_brand")), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")), "p_type").alias("id"))
    return named.where(F.substring_index("id", "~", -1).isin("Brand#11", "Brand#12", "Brand#21"))


# Joins ------------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') AND o_orderpriority NOT IN ('5-LOW')")
def jn3_exclusions(spark, sf):
    barred = table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").where("o_orderpriority <> '5-LOW'").join(barred, "o_custkey", "left_anti").select("o_orderkey")


ALIAS_LIST = "SELECT 'Customer#' || lpad((k * 3)::VARCHAR, 9, '0') AS entry FROM range(1, 20) t(k) UNION ALL SELECT 'cust_' || k FROM range(100, 110) t(k) UNION ALL SELECT k || '' FROM range(40, 45) t(k) UNION ALL SELECT 'nobody'"


@query(f"WITH entries AS ({ALIAS_LIST}), aliases AS (SELECT c_custkey, unnest([c_name, 'cust_' || c_custkey, c_custkey || '']) AS entry FROM customer) SELECT c_custkey, 'matched' AS kind FROM aliases JOIN entries USING (entry) GROUP BY 1 UNION ALL SELECT NULL, 'unmatched ' || entry FROM entries WHERE entry NOT IN (SELECT entry FROM aliases)")
def jn5_any_alias(spark, sf):
    """Rows one of whose spellings is listed, and the listed names that no row has."""
    entries = values(spark, "entry string", *((f"Customer#{k * 3:09d}",) for k in range(1, 20)), *((f"cust_{k}",) for k in range(100, 110)), *((f"{k}",) for k in range(40, 45)), ("nobody",))
    aliases = table(spark, sf, "customer").select("c_custkey", F.explode(F.array("c_name", F.concat(F.lit("cust_"), F.col("c_custkey").cast("string")), F.col("c_custkey").cast("string"))).alias("entry"))
    hits = aliases.join(F.broadcast(entries), "entry")
    matched = hits.select("c_custkey").distinct().withColumn("kind", F.lit("matched"))
    return matched.unionByName(entries.join(hits.select("entry").distinct(), "entry", "left_anti").select(F.lit(None).cast("long").alias("c_custkey"), F.concat(F.lit("unmatched "), F.col("entry")).alias("kind")))


@query("SELECT render, count(DISTINCT owner) AS owners, min(owner) AS owner FROM (SELECT l_orderkey AS owner, 'o' || l_orderkey AS render FROM lineitem UNION SELECT l_orderkey, 'p' || l_partkey FROM lineitem WHERE l_linenumber = 1) GROUP BY 1")
def jn6_render_index(spark, sf):
    """Source ids and the ids of their renders, each pointing to its owner; more than one owner is a conflict."""
    items = table(spark, sf, "lineitem")
    entries = items.groupBy(F.col("l_orderkey").alias("owner")).agg(F.collect_set(F.when(F.col("l_linenumber") == 1, F.concat(F.lit("p"), F.col("l_partkey").cast("string")))).alias("renders"))
    own = entries.select("owner", F.concat(F.lit("o"), F.col("owner").cast("string")).alias("render"))
    index = own.unionByName(entries.select("owner", F.explode("renders").alias("render")))
    return index.groupBy("render").agg(F.count_distinct("owner").alias("owners"), F.min("owner").alias("owner"))


ZIP_SQL = "SELECT conv_id, turn, role, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM v_turns"


@query(f"WITH t AS ({ZIP_SQL}), l AS (SELECT * FROM t WHERE conv_id % 2 = 0), r AS (SELECT conv_id - 1 AS conv_id, turn, role, n, place FROM t WHERE conv_id % 2 = 1) SELECT l.conv_id, l.place, l.role AS left_role, r.role AS right_role, 'paired' AS verdict FROM l JOIN r USING (conv_id, place) WHERE l.n = r.n UNION ALL SELECT DISTINCT coalesce(a.conv_id, b.conv_id), NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, 'unequal' FROM l a FULL JOIN r b ON a.conv_id = b.conv_id WHERE a.n IS DISTINCT FROM b.n")
def jn7_positional_zip(spark, sf):
    """The i-th turn of one conversation with the i-th of the next one; conversations of unequal length are violations, not cut to the shorter."""
    turns = v_turns(spark, sf).select("conv_id", "turn", "role")
    left, right = turns.where("conv_id % 2 = 0"), turns.where("conv_id % 2 = 1").withColumn("conv_id", F.col("conv_id") - 1)
    zipped = zip_lists(left, right, "conv_id", "turn", "role")
    return zipped.select("conv_id", "place", "left_role", "right_role", "verdict")


def zip_lists(left: DataFrame, right: DataFrame, series: str, order: str, value: str, strict: bool = False) -> DataFrame:
    """(series, place, left, right, verdict): values of both lists by their place. A series whose lists differ in length has one row `unequal`, or is an error if `strict`."""
    placed = lambda df, side: df.select(series, (F.row_number().over(Window.partitionBy(series).orderBy(order)) - 1).cast("long").alias("place"), F.col(value).alias(f"{side}_{value}"), F.lit(True).alias(side))
    both = placed(left, "left").join(placed(right, "right"), [series, "place"], "full_outer")
    alone = F.max((F.col("left").isNull() | F.col("right").isNull()).cast("int")).over(Window.partitionBy(series)) == 1
    marked = both.withColumn("unequal", alone)
    broken = marked.where("unequal").select(series).distinct()
    if strict:
        checks.assert_empty(broken, "lists of unequal length")
    paired = marked.where("NOT unequal").drop("left", "right", "unequal").withColumn("verdict", F.lit("paired"))
    return paired.unionByName(broken.withColumn("verdict", F.lit("unequal")), allowMissingColumns=True)


@query("SELECT d.doc_id, coalesce(l.quality::VARCHAR, nullif(d.lang, ''), 'none') AS merged, l.doc_id IS NOT NULL AS from_labels FROM documents d LEFT JOIN labels l USING (doc_id)")
def jn8_preferred_merge(spark, sf):
    """Metadata columns go before the manifest's own where they are there and not empty."""
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("preferred"), F.lit(True).alias("labelled"))
    joined = table(spark, sf, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    return joined.select("doc_id", F.coalesce(F.nullif("preferred", F.lit("")), F.nullif("lang", F.lit("")), F.lit("none")).alias("merged"), F.coalesce("labelled", F.lit(False)).alias("from_labels"))


PREFIXES = [("small", 1), ("small ring", 2), ("red", 3), ("red wid", 4), ("blue b", 5), ("green", 6)]
PREFIX_SQL = ", ".join(f"('{p}', {k})" for p, k in PREFIXES)


def longest_prefix(df: DataFrame, column: str, entries: list[tuple[str, int]]) -> DataFrame:
    """Adds prefix and code of the entry with the longest matching prefix, or nulls.

    The text's beginnings, at the lengths that entries have, meet the dictionary by equality, so no entry is tried on every row.
    """
    sizes = sorted({len(p) for p, _ in entries}, reverse=True)
    known = F.create_map(*(F.lit(x) for e in entries for x in e))
    found = F.coalesce(*(F.when(F.length(column) >= n, F.when(F.get(F.array(known[F.left(F.col(column), F.lit(n))]), 0).isNotNull(), F.left(F.col(column), F.lit(n)))) for n in sizes))
    return df.withColumn("prefix", found).withColumn("code", known[F.col("prefix")])


@query(f"SELECT p_partkey, prefix, code FROM part LEFT JOIN (SELECT p_name, prefix, code FROM (SELECT DISTINCT p_name FROM part), (VALUES {PREFIX_SQL}) d(prefix, code) WHERE starts_with(p_name, prefix) QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY length(prefix) DESC) = 1) USING (p_name)")
def jn9_longest_prefix(spark, sf):
    return longest_prefix(table(spark, sf, "part"), "p_name", PREFIXES).select("p_partkey", "prefix", "code")


@query(f"SELECT p_partkey, coalesce(o.bpm, CASE WHEN p_size % 4 = 0 THEN p_size END, code * 10, 96) AS bpm, CASE WHEN o.bpm IS NOT NULL THEN 'override' WHEN p_size % 4 = 0 THEN 'own' WHEN code IS NOT NULL THEN 'text' ELSE 'constant' END AS origin FROM part LEFT JOIN (VALUES (1, 140), (8, 150), (15, 160)) o(p_partkey, bpm) USING (p_partkey) LEFT JOIN (SELECT p_name, code FROM (SELECT DISTINCT p_name FROM part), (VALUES {PREFIX_SQL}) d(prefix, code) WHERE starts_with(p_name, prefix) QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY length(prefix) DESC) = 1) USING (p_name)")
def jn10_layered_defaults(spark, sf):
    overrides = values(spark, "p_partkey long, forced int", (1, 140), (8, 150), (15, 160))
    part = longest_prefix(table(spark, sf, "part"), "p_name", PREFIXES).join(F.broadcast(overrides), "p_partkey", "left")
    own = F.when(F.col("p_size") % 4 == 0, F.col("p_size"))
    origin = F.when(F.col("forced").isNotNull(), "override").when(own.isNotNull(), "own").when(F.col("code").isNotNull(), "text").otherwise("constant")
    return part.select("p_partkey", F.coalesce("forced", own, F.col("code") * 10, F.lit(96)).alias("bpm"), origin.alias("origin"))


@query("WITH cand AS (SELECT * FROM (VALUES ('x1', 'NATION_1', 1), ('x2', 'NATION_2', 2), ('x3', 'NATION_2', 3), ('x4', 'NATION_3', 4)) t(name, comp, ckpt)), byc AS (SELECT comp, count(*) AS n, min(ckpt) AS ckpt FROM cand GROUP BY 1) SELECT c_custkey, CASE WHEN e.ckpt IS NOT NULL THEN e.ckpt WHEN b.n = 1 THEN b.ckpt WHEN b.n > 1 THEN -1 ELSE 0 END AS ckpt FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN cand e ON e.name = 'x' || c_custkey LEFT JOIN byc b ON b.comp = n_name")
def jn16_fallback_match(spark, sf):
    """The exact name, else the only candidate of the group; several candidates are marked -1, none 0."""
    candidates = values(spark, "name string, comp string, ckpt int", ("x1", "NATION_1", 1), ("x2", "NATION_2", 2), ("x3", "NATION_2", 3), ("x4", "NATION_3", 4))
    by_group = candidates.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.min("ckpt").alias("only"))
    rows = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(F.lit("x"), F.col("c_custkey").cast("string")).alias("name"), F.col("n_name").alias("comp"))
    joined = rows.join(F.broadcast(candidates.select("name", "ckpt")), "name", "left").join(F.broadcast(by_group), "comp", "left")
    return joined.select("c_custkey", F.when(F.col("ckpt").isNotNull(), F.col("ckpt")).when(F.col("n") == 1, F.col("only")).when(F.col("n") > 1, -1).otherwise(0).alias("ckpt"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
def jn18_catalog_overlap(spark, sf):
    """Rows whose recording is in the test split of another catalogue, once its paths lose their root."""
    tested = table(spark, sf, "orders").where("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
    paths = tested.select(F.concat(F.lit("{root}/Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("path"))
    names = paths.select(F.regexp_replace("path", r"^\{root\}/", "").alias("c_name")).distinct()
    return table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("Customer#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("c_name")).join(names, "c_name").select("c_custkey")


@query("SELECT p_brand AS k, count(DISTINCT p_size) AS n_values, count(*) AS n_rows FROM part GROUP BY 1 HAVING count(DISTINCT p_size) > 1")
def jn19_functional_dependency(spark, sf):
    return checks.dependency_conflicts(table(spark, sf, "part").select(F.col("p_brand").alias("k"), "p_size"), "k", "p_size")


@query("WITH g AS (SELECT s_nationkey, dense_rank() OVER (ORDER BY s_nationkey) - 1 AS r, min(s_suppkey) AS first FROM supplier GROUP BY 1), n AS (SELECT count(*) AS n FROM g) SELECT s.s_suppkey, d.first AS donor FROM supplier s JOIN g ON s.s_nationkey = g.s_nationkey JOIN g d ON d.r = (g.r + 1) % (SELECT n FROM n)")
def jn20_donor(spark, sf):
    """Each row takes the first item of the next group, the last group that of the first. Groups are few: ranks are over groups, not rows."""
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return supplier.join(next_groups(supplier, "s_nationkey", "s_suppkey"), "s_nationkey").select("s_suppkey", "donor")


def next_groups(df: DataFrame, group: str, item: str) -> DataFrame:
    firsts = df.groupBy(group).agg(F.min(item).alias("first"))
    w = Window.partitionBy(F.lit(0)).orderBy(group)
    start = F.first("first").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return firsts.select(group, F.coalesce(F.lead("first").over(w), start).alias("donor"))


# Sets and nested data -----------------------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'excluded' WHEN c_custkey % 10 = 0 THEN 'test' WHEN c_custkey % 15 = 0 OR c_custkey % 10 = 5 THEN 'valid' ELSE 'train' END AS split FROM customer")
def set5_split_assignment(spark, sf):
    """Exclusions, then the test list, then the validation list; all others are for training."""
    customer = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    test = customer.where("c_custkey % 10 = 0").select("c_custkey", F.lit(True).alias("test"))
    valid = customer.where("c_custkey % 15 = 0 OR c_custkey % 10 = 5").select("c_custkey", F.lit(True).alias("valid"))
    joined = customer.join(test, "c_custkey", "left").join(valid, "c_custkey", "left")
    return joined.select("c_custkey", F.when(F.col("c_mktsegment") == "MACHINERY", "excluded").when(F.col("test"), "test").when(F.col("valid"), "valid").otherwise("train").alias("split"))


@query("WITH done AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) >= 3), req AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, 1::BIGINT AS n FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM done) AND l_orderkey IN (SELECT o_orderkey FROM req) GROUP BY 1, 2 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM req) GROUP BY 1, 2, 3")
def set6_keep_first(spark, sf):
    """Rows of finished groups once per key, the first seen; rows of groups outside the run as they are; partial groups go."""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    requested = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    done = items.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("k")).where("k >= 3").select("l_orderkey")
    inside = items.join(requested, "l_orderkey", "left_semi").join(done, "l_orderkey", "left_semi").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey")).withColumn("n", F.lit(1).cast("long"))
    outside = items.join(requested, "l_orderkey", "left_anti").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return inside.unionByName(outside)


@query("SELECT l_orderkey, o_orderstatus, l_partkey, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate IS NOT NULL AND l_returnflag <> 'N' AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def nst1_explode_children(spark, sf):
    """Children of an array with their parent's columns, without those excluded or absent."""
    items = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "l_quantity", "l_returnflag")).alias("renders"))
    parents = items.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey")
    children = parents.select("l_orderkey", "o_orderstatus", F.explode(F.filter("renders", lambda r: r["l_returnflag"] != "N")).alias("r")).select("l_orderkey", "o_orderstatus", "r.l_partkey", "r.l_quantity")
    return children.join(table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi").select("l_orderkey", "o_orderstatus", "l_partkey", "l_quantity")


def parse_cells(column: str) -> Column:
    """`8,8-0,3` as an array of integer arrays; a cell that is no group of numbers gives null."""
    groups = F.transform(F.split(column, ","), lambda g: F.transform(F.split(g, "-"), lambda x: x.try_cast("int")))
    return F.when(F.col(column).rlike(r"^\d+(-\d+)*(,\d+(-\d+)*)*$"), groups)


CELL_SQL = "SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'bad' ELSE p_size || '-' || (p_partkey % 5) || ',' || (p_size + 1) END AS cell FROM part"


def cells(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.col("p_size").cast("string"), F.lit("-"), (F.col("p_partkey") % 5).cast("string"), F.lit(","), (F.col("p_size") + 1).cast("string"))
    return table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 == 0, "bad").otherwise(text).alias("cell"))


@query(f"SELECT p_partkey, CASE WHEN cell <> 'bad' THEN replace(cell, '-', ',') END AS path, CASE WHEN cell <> 'bad' THEN len(string_split(cell, ',')) END AS groups, cell = 'bad' AS invalid FROM ({CELL_SQL})")
def nst2_group_cells(spark, sf):
    parsed = cells(spark, sf).withColumn("g", parse_cells("cell"))
    return parsed.select("p_partkey", F.array_join(F.flatten("g").cast("array<string>"), ",").alias("path"), F.when(F.col("g").isNotNull(), F.size("g")).cast("long").alias("groups"), F.col("g").isNull().alias("invalid"))


@query("SELECT p_partkey, CASE WHEN list_contains(f, 0) THEN f ELSE list_concat([0], f) END AS route, NOT list_contains(f, 0) AS inserted FROM (SELECT p_partkey, [p_partkey % 3, p_size % 4 + 10, 7]::BIGINT[] AS f FROM part)")
def nst3_conditional_insert(spark, sf):
    """A leading 0 is put before a route whose first group lacks it."""
    made = table(spark, sf, "part").select("p_partkey", F.array(F.col("p_partkey") % 3, (F.col("p_size") % 4 + 10).cast("long"), F.lit(7).cast("long")).alias("f"))
    return made.select("p_partkey", with_pickup("f").alias("route"), (~F.array_contains("f", 0)).alias("inserted"))


ROUTES_SQL = """SELECT p_partkey, 4 + p_partkey % 3 AS n, p_partkey % 4 = 1 AS pickup, CASE WHEN p_partkey % 30 = 0 THEN [[]::BIGINT[], [1]] WHEN p_partkey % 6 = 0 THEN [[p_partkey % 4, 1], [2], [3]] END AS official,
p_partkey % 5 = 0 AS adjudicated, CASE WHEN p_partkey % 35 = 0 THEN 'pending' ELSE 'user_approved' END AS status, [p_partkey % 4]::BIGINT[] AS drops, CASE WHEN p_partkey % 12 = 0 THEN 2 ELSE p_partkey % 4 + 1 END AS seen, [0, 1, p_partkey % 7]::BIGINT[] AS route,
p_partkey % 3 = 1 AS aligned, 4 + p_partkey % 3 - (p_partkey % 4 = 1)::INT + CASE WHEN p_partkey % 11 = 0 THEN 2 ELSE 0 END AS wanted,
CASE WHEN p_partkey % 8 = 0 THEN range(4 + p_partkey % 3) WHEN p_partkey % 2 = 0 THEN [0, 1]::BIGINT[] || range(4 + p_partkey % 3) WHEN p_partkey % 13 = 0 THEN [3, 2, 1] || range(1 + p_partkey % 3) END AS expanded,
CASE p_partkey % 9 WHEN 0 THEN [0.5, 2.0, 9.0] WHEN 1 THEN [3.5] ELSE [] END::DOUBLE[] AS undefined_times FROM part"""


@query(f"""WITH r AS ({ROUTES_SQL}), c AS (SELECT *, CASE WHEN pickup THEN range(1, n) ELSE range(n) END AS written, CASE WHEN pickup AND expanded[1] = 0 THEN expanded[2:] ELSE expanded END AS played FROM r),
k AS (SELECT *, len(written) = wanted AS w, coalesce(len(played) = wanted, false) AND NOT (len(written) = wanted AND written = played) AS p FROM c),
g AS (SELECT *, CASE WHEN official IS NOT NULL AND adjudicated THEN list_filter(official, lambda x, i: i - 1 <> drops[1]) WHEN official IS NOT NULL THEN official WHEN adjudicated THEN list_transform(route, lambda x: [x]) WHEN aligned THEN list_transform(CASE WHEN w THEN written WHEN p THEN played END, lambda x: [x]) ELSE list_transform(range(n), lambda x: [x]) END AS groups,
CASE WHEN official IS NOT NULL AND adjudicated THEN 'user_approved_official_adjustment' WHEN official IS NOT NULL THEN 'official' WHEN adjudicated THEN 'user_approved_fallback' WHEN aligned THEN CASE WHEN w THEN 'written' WHEN p THEN 'expanded' END ELSE 'source_written_unaligned' END AS provenance,
CASE WHEN adjudicated AND status <> 'user_approved' THEN 'not_approved' WHEN official IS NOT NULL AND adjudicated AND drops[1] >= len(official) THEN 'drop_out_of_range' WHEN official IS NOT NULL AND adjudicated AND drops[1] = 1 AND official[2] <> [seen]::BIGINT[] THEN 'evidence_changed' WHEN official IS NULL AND NOT adjudicated AND aligned AND NOT w AND NOT p THEN 'no_candidate' WHEN official IS NULL AND NOT adjudicated AND aligned AND w AND p THEN 'ambiguous_route' END AS early FROM k),
v AS (SELECT *, coalesce(early, CASE WHEN len(list_filter(groups, lambda x: len(x) = 0)) > 0 THEN 'empty_group' WHEN len(list_filter(flatten(groups), lambda x: x < 0 OR x >= n)) > 0 THEN 'ordinal_out_of_range' END) AS violation FROM g),
i AS (SELECT *, CASE WHEN violation IS NULL THEN pickup AND len(groups) > 0 AND NOT list_contains(groups[1], 0) END AS inserted FROM v),
f AS (SELECT *, CASE WHEN violation IS NULL THEN CASE WHEN inserted THEN [[0]::BIGINT[]] || groups ELSE groups END END AS path FROM i)
SELECT p_partkey, provenance, violation, inserted AS pickup_inserted, array_to_string(list_transform(path, lambda x: array_to_string(x, '-')), ',') AS route, CASE WHEN violation IS NULL THEN array_to_string(list_sort(list_distinct(list_filter(list_transform(undefined_times, lambda t: CASE WHEN t < 1 THEN 0 ELSE least(floor(t), 4)::INT - 1 + inserted::INT END), lambda x: x < len(path)))), ',') END AS undefined FROM f""")
def nst3_routes(spark, sf):
    """Routes of recordings by official maps, adjudications, unique candidates or the written order, with what is wrong where there is none."""
    k, none = F.col("p_partkey"), F.lit(None)
    longs = lambda *xs: F.array(*(x.cast("long") if isinstance(x, Column) else F.lit(x).cast("long") for x in xs))
    count = (4 + k % 3).cast("long")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    seen = F.when(k % 12 == 0, 2).otherwise(k % 4 + 1).cast("long")
    adjudication = F.struct(
        F.when(k % 35 == 0, "pending").otherwise("user_approved").alias("status"), F.lit("drop_official_positions").alias("operation"), longs(k % 4).alias("drops"),
        longs(0, 1, k % 7).alias("route"), F.create_map(F.lit(1).cast("long"), F.array(seen)).alias("evidence"),
    )
    recordings = table(spark, sf, "part").select(
        "p_partkey",
        count.alias("count"),
        (k % 4 == 1).alias("pickup"),
        F.when(k % 30 == 0, F.array(F.array().cast("array<bigint>"), longs(1))).when(k % 6 == 0, F.array(longs(k % 4, 1), longs(2), longs(3))).alias("official"),
        F.when(k % 5 == 0, adjudication).alias("adjudication"),
        (k % 3 == 1).alias("aligned"),
        (count - (k % 4 == 1).cast("int") + F.when(k % 11 == 0, 2).otherwise(0)).alias("wanted"),
        F.when(k % 8 == 0, upto(count)).when(k % 2 == 0, F.concat(longs(0, 1), upto(count))).when(k % 13 == 0, F.concat(longs(3, 2, 1), upto(1 + k % 3))).otherwise(none).alias("expanded"),
        F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0))).alias("downbeats"),
        F.when(k % 9 == 0, F.array(*map(F.lit, (0.5, 2.0, 9.0)))).when(k % 9 == 1, F.array(F.lit(3.5))).otherwise(F.array().cast("array<double>")).alias("undefined_times"),
    )
    found = routes.resolved_routes(recordings, fallback=True)
    text = F.array_join(F.transform("groups", lambda g: F.array_join(g.cast("array<string>"), "-")), ",")
    return found.select("p_partkey", "provenance", "violation", "pickup_inserted", text.alias("route"), F.array_join(F.col("undefined").cast("array<string>"), ",").alias("undefined"))


def with_pickup(column: str, dropped: list[int] | None = None) -> Column:
    """The array with 0 in front if it lacks it, without the listed positions."""
    whole = F.when(F.array_contains(column, 0), F.col(column)).otherwise(F.concat(F.array(F.lit(0).cast("long")), F.col(column)))
    return F.filter(whole, lambda x, i: ~i.isin(dropped)) if dropped else whole


@query("SELECT user_id, w, list(state ORDER BY bar) AS states FROM (SELECT user_id, bar // 8 AS w, bar, state, bar % 8 AS k FROM v_bars) WHERE k BETWEEN 2 AND 5 GROUP BY 1, 2")
def nst4_slices(spark, sf):
    """The third to sixth child of every window of eight."""
    windows = v_bars(spark, sf).groupBy("user_id", F.expr("bar div 8").alias("w")).agg(F.array_sort(F.collect_list(F.struct("bar", "state"))).alias("c"))
    sliced = windows.select("user_id", "w", F.transform(F.slice("c", 3, 4), lambda x: x["state"]).alias("states"))
    return sliced.where(F.size("states") > 0)


@query("WITH c AS (SELECT conv_id, list(length(text) ORDER BY turn) AS a FROM v_turns GROUP BY 1), m AS (SELECT max(len(a)) AS m FROM c) SELECT conv_id, list_concat(a, list_transform(range(m - len(a)), lambda x: -100)) AS padded FROM c, m")
def nst5_padded_arrays(spark, sf):
    arrays = v_turns(spark, sf).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("n")))), lambda x: x["n"]).alias("a"))
    longest = arrays.agg(F.max(F.size("a"))).head()[0] or 0
    return arrays.select("conv_id", padded("a", longest).alias("padded"))


def padded(column: str, size: int, value: int = -100) -> Column:
    return F.concat(F.col(column), F.array_repeat(F.lit(value).cast("long"), F.greatest(F.lit(size) - F.size(column), F.lit(0))))


# More aggregates -----------------------------------------------------------------------------------


@query("SELECT lang, count(*) AS n, coalesce(sum(n_chars), 0)::BIGINT AS total, round(coalesce(avg(n_chars), 0), 6) AS mean, coalesce(sum(n_chars // 16), 0)::BIGINT AS frames FROM documents GROUP BY 1")
def agg11_manifest_stats(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("total"), r6(F.coalesce(F.avg("n_chars"), F.lit(0.0))).alias("mean"), F.coalesce(F.sum(F.expr("n_chars div 16")), F.lit(0)).alias("frames"))


@query("SELECT o_custkey, sha256(string_agg(o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority, chr(10) ORDER BY o_orderkey)) AS fingerprint FROM orders GROUP BY 1")
def agg12_ordered_fingerprint(spark, sf):
    """One digest for each customer over its orders."""
    return ordered_fingerprint(table(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")


def ordered_fingerprint(df: DataFrame, group: str, *columns: str) -> DataFrame:
    """SHA-256 over a group's rows in order of their key. A group's rows are gathered, so groups have to be small."""
    rows = F.array_sort(F.collect_list(F.struct(*columns)))
    lines = F.transform(rows, lambda r: F.concat_ws("|", *(r[c].cast("string") for c in columns)))
    return df.groupBy(group).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("fingerprint"))


ROW_SQL = "sha256(" + " || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, 'n')" for c in ("o_orderkey", "o_custkey", "o_orderpriority")) + ")"
LEVEL_SQL = "SELECT g, node >> 16 AS node, sha256(string_agg(node || '=' || digest, ',' ORDER BY node)) AS digest, sum(n)::BIGINT AS n FROM {} GROUP BY 1, 2"
KEYS_SQL = """rows AS (SELECT o_orderstatus AS g, o_orderkey AS node, {row} AS row, count(*) AS n FROM {table} GROUP BY 1, 2, 3),
digits AS (SELECT g, node, left(row, 4) AS digits, sha256(string_agg(row || '=' || n, ',' ORDER BY row)) AS digest, sum(n) AS n FROM rows GROUP BY 1, 2, 3),
keys AS (SELECT g, node, sha256(string_agg(digits || '=' || digest, ',' ORDER BY digits)) AS digest, sum(n) AS n FROM digits GROUP BY 1, 2)"""


@query(f"WITH {KEYS_SQL.format(row=ROW_SQL, table='orders')}, a AS ({LEVEL_SQL.format('keys')}), b AS ({LEVEL_SQL.format('a')}), c AS ({LEVEL_SQL.format('b')}) SELECT g AS o_orderstatus, sha256(string_agg(node || '=' || digest, ',' ORDER BY node)) AS fingerprint, sum(n)::BIGINT AS n FROM c GROUP BY 1")
def agg12_digest_tree(spark, sf):
    """One digest for all orders of a status, by ranges of their keys."""
    tree = digests.digest_tree(table(spark, sf, "orders"), "o_orderstatus", "o_orderkey", ["o_orderkey", "o_custkey", "o_orderpriority"], kept)
    return tree[0].select("o_orderstatus", F.col("digest").alias("fingerprint"), "n")


ALTERED_SQL = "SELECT o_orderkey + CASE WHEN o_orderkey % 501 = 7 THEN 90000000 ELSE 0 END AS o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 203 = 5 THEN 'changed' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 397 <> 11"


@query(f"WITH a AS (SELECT o_orderstatus, o_orderkey, o_orderpriority, o_custkey FROM orders), b AS ({ALTERED_SQL}) SELECT coalesce(a.o_orderstatus, b.o_orderstatus) AS o_orderstatus, coalesce(a.o_orderkey, b.o_orderkey) AS key, CASE WHEN b.o_orderkey IS NULL THEN 'left' WHEN a.o_orderkey IS NULL THEN 'right' ELSE 'both' END AS side FROM a FULL JOIN b USING (o_orderstatus, o_orderkey) WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderpriority <> b.o_orderpriority")
def set3_located_differences(spark, sf):
    """Keys at which an altered copy differs, found by descending two digest trees."""
    orders, key = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), F.col("o_orderkey")
    altered = orders.where(key % 397 != 11).withColumn("o_orderpriority", F.when(key % 203 == 5, "changed").otherwise(F.col("o_orderpriority"))).withColumn("o_orderkey", key + F.when(key % 501 == 7, 90000000).otherwise(0))
    columns = ["o_orderkey", "o_custkey", "o_orderpriority"]
    trees = [digests.digest_tree(x, "o_orderstatus", "o_orderkey", columns, kept) for x in (orders, altered)]
    return digests.differing_keys(*trees, "o_orderstatus", kept)


STATES = ("view", "click", "purchase", "signup", "error")
STATE_SQL = "SELECT user_id, bar, CASE WHEN user_id % 13 = 5 AND bar = 2 THEN 'other' WHEN user_id % 11 = 4 AND bar = 3 THEN NULL ELSE state END AS state FROM v_bars WHERE user_id % 17 <> 3 OR bar = 0"


@query(f"""WITH s AS (SELECT *, lag(state) OVER w AS prev, row_number() OVER w AS place FROM ({STATE_SQL}) WINDOW w AS (PARTITION BY user_id ORDER BY bar)),
u AS (SELECT user_id, CASE WHEN count(*) < 2 THEN 'few' WHEN bool_or(state IS NULL) THEN 'missing' WHEN bool_or(state NOT IN {STATES}) THEN 'unknown' END AS skipped, count(*) - 1 AS t, count_if(place > 1 AND state <> prev) AS c FROM s GROUP BY 1)
SELECT sum(t)::BIGINT AS transitions, sum(c)::BIGINT AS changes, count_if(c > 0)::BIGINT AS series, round(sum(c) / sum(t), 6) AS p, round(ln((1 - sum(c) / sum(t)) * 4 / (sum(c) / sum(t))), 6) AS penalty, any_value(few) AS skipped_few, any_value(missing) AS skipped_missing, any_value(unknown) AS skipped_unknown
FROM u, (SELECT count_if(skipped = 'few')::BIGINT AS few, count_if(skipped = 'missing')::BIGINT AS missing, count_if(skipped = 'unknown')::BIGINT AS unknown FROM u) WHERE skipped IS NULL""")
def agg13_switch_rate(spark, sf):
    """Changes of state over transitions, the penalty ln((1 - p)(K - 1) / p) of K states, and how many series are left out for which reason."""
    user = F.col("user_id")
    state = F.when((user % 13 == 5) & (F.col("bar") == 2), "other").when((user % 11 == 4) & (F.col("bar") == 3), None).otherwise(F.col("state"))
    return switch_rate(v_bars(spark, sf).where((user % 17 != 3) | (F.col("bar") == 0)).withColumn("state", state), "user_id", "bar", STATES)


def switch_rate(df: DataFrame, series: str, order: str, states: tuple[str, ...]) -> DataFrame:
    moved = df.withColumn("prev", F.lag("state").over(Window.partitionBy(series).orderBy(order)))
    per = moved.groupBy(series).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") != F.col("prev")).alias("c"), F.bool_or(F.col("state").isNull()).alias("missing"), F.bool_or(~F.col("state").isin(*states)).alias("unknown"))
    skipped = F.when(F.col("n") < 2, "few").when(F.col("missing"), "missing").when(F.col("unknown"), "unknown")
    used = lambda x: F.when(F.col("skipped").isNull(), x)
    total = per.withColumn("skipped", skipped).agg(
        F.sum(used(F.col("n") - 1)).alias("transitions"), F.sum(used(F.col("c"))).alias("changes"), F.count_if(used(F.col("c") > 0)).alias("series"),
        *(F.count_if(F.col("skipped") == reason).alias(f"skipped_{reason}") for reason in ("few", "missing", "unknown")),
    )
    rate = F.col("changes") / F.col("transitions")
    return total.select("transitions", "changes", "series", r6(rate).alias("p"), r6(F.log((1 - rate) * (len(states) - 1) / rate)).alias("penalty"), "skipped_few", "skipped_missing", "skipped_unknown")


@query("SELECT 'outcome ' || split_part(outcome, ':', 1) AS what, count(*) AS n FROM (SELECT lang || ': ' || source AS outcome FROM documents) GROUP BY 1 UNION ALL SELECT 'family ' || f, count(*) FROM (SELECT unnest(string_split(lang || ',' || source, ',')) AS f FROM documents) GROUP BY 1")
def agg15_outcome_counts(spark, sf):
    """Outcomes by the text before the colon, and the members of a column of several values."""
    docs = table(spark, sf, "documents").select("lang", "source")
    outcomes = docs.groupBy(F.concat(F.lit("outcome "), F.split_part(F.concat_ws(": ", "lang", "source"), F.lit(":"), F.lit(1))).alias("what")).agg(F.count(F.lit(1)).alias("n"))
    families = docs.select(F.explode(F.split(F.concat_ws(",", "lang", "source"), ",")).alias("f")).groupBy(F.concat(F.lit("family "), F.col("f")).alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return outcomes.unionByName(families)


@query("SELECT user_id, count_if(event_type = 'click')::BIGINT AS predicted, count_if(event_type = 'purchase')::BIGINT AS reference, round(coalesce(count_if(event_type = 'click') / nullif(count_if(event_type = 'purchase'), 0), 0), 6) AS agreement FROM events GROUP BY 1")
def agg16_count_agreement(spark, sf):
    counts = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("predicted"), F.count_if(F.col("event_type") == "purchase").alias("reference"))
    return counts.withColumn("agreement", r6(ratio("predicted", "reference")))


@query("SELECT s_nationkey, arg_max(s_name, (floor(s_acctbal / 1000), -s_suppkey)) AS best FROM supplier GROUP BY 1")
def agg17_best_variant(spark, sf):
    """The member with most marks, on a tie the first."""
    return table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.max_by("s_name", F.struct(F.floor(F.col("s_acctbal") / 1000), -F.col("s_suppkey"))).alias("best"))


# Seeded plans -----------------------------------------------------------------------------------


def H(key: str) -> str:
    return f"('0x' || substr(md5({key}), 1, 8))::BIGINT"


@query(f"SELECT c_custkey, version, round(-0.5 + 0.25 * (stratum + u), 6) AS x, round(pow(2, -0.5 + 0.25 * (stratum + u)), 6) AS scale FROM (SELECT c_custkey, k AS stratum, {H("'t|' || c_custkey || '|' || k")} / 4294967296.0 AS u, row_number() OVER (PARTITION BY c_custkey ORDER BY md5('p|' || c_custkey || '|' || k)) - 1 AS version FROM customer, range(4) t(k))")
def smp1_stratified_draws(spark, sf):
    """Four strata over [-0.5, 0.5], a jittered draw in each, dealt to the versions in an order of their own."""
    rows = table(spark, sf, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("stratum"))
    order = Window.partitionBy("c_custkey").orderBy(md5_key(F.lit("p"), "c_custkey", "stratum"))
    x = -0.5 + 0.25 * (F.col("stratum") + draw_unit(F.lit("t"), "c_custkey", "stratum"))
    return rows.select("c_custkey", (F.row_number().over(order) - 1).cast("long").alias("version"), r6(x).alias("x"), r6(F.pow(F.lit(2.0), x)).alias("scale"))


OPTIONS = ("hall", "room", "plate", "none")


@query("WITH o AS (SELECT unnest(['hall', 'room', 'plate', 'none']) AS opt) SELECT s_suppkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY md5('o|' || s_suppkey || '|' || opt)) - 1 AS version, opt FROM supplier, o")
def smp2_balanced_permutation(spark, sf):
    """Every version of a key gets another option."""
    rows = table(spark, sf, "supplier").select("s_suppkey", F.explode(F.array(*map(F.lit, OPTIONS))).alias("opt"))
    order = Window.partitionBy("s_suppkey").orderBy(md5_key(F.lit("o"), "s_suppkey", "opt"))
    return rows.select("s_suppkey", (F.row_number().over(order) - 1).cast("long").alias("version"), "opt")


@query(f"WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus <> 'P' AS drawn, row_number() OVER (PARTITION BY o_custkey, o_orderstatus <> 'P' ORDER BY o_orderkey) - 1 AS place FROM orders) SELECT o_custkey, o_orderkey, CASE WHEN drawn THEN ['hall', 'room', 'plate', 'none'][({H("'timbre|' || o_custkey")} + place) % 4 + 1] END AS opt FROM o")
def smp2_rotation(spark, sf):
    """Options in turn from an offset of each customer; orders that take none don't use up a turn."""
    return rotated(table(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") != "P").alias("drawn")), "o_custkey", "o_orderkey", "drawn", OPTIONS).select("o_custkey", "o_orderkey", "opt")


def rotated(df: DataFrame, group: str, order: str, drawn: str, options: tuple[str, ...] | list[str]) -> DataFrame:
    """Adds `opt`: the options in turn over a group's drawn rows, from an offset that the group's name decides; null for the others."""
    place = F.row_number().over(Window.partitionBy(group, drawn).orderBy(order)) - 1
    start = draw_int(F.lit("timbre"), group, below=len(options))
    return df.withColumn("opt", F.when(F.col(drawn), F.get(F.array(*map(F.lit, options)), ((start + place) % len(options)).cast("int"))))


@query(f"SELECT p_partkey, v AS version, CASE WHEN p_brand = 'Brand#5' THEN '' WHEN p_size % 10 = 0 THEN 'fixed' WHEN v = 0 THEN 'default' ELSE ['a', 'b', 'c'][{H("'s|' || p_partkey || '|' || v")} % 3 + 1] END AS style FROM part, range(3) t(v)")
def smp3_first_fixed_style(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("version"))
    drawn = F.element_at(F.array(*map(F.lit, "abc")), (draw_int(F.lit("s"), "p_partkey", "version", below=3) + 1).cast("int"))
    style = F.when(F.col("p_brand") == "Brand#5", "").when(F.col("p_size") % 10 == 0, "fixed").when(F.col("version") == 0, "default").otherwise(drawn)
    return rows.select("p_partkey", "version", style.alias("style"))


@query(f"SELECT s_suppkey, k AS slot, CASE WHEN r > 1 THEN ['hall', 'room', 'plate', 'none'][{H("'i|' || s_suppkey || '|' || k")} % 4 + 1] END AS ir, CASE WHEN r > 1 THEN round(0.1 + 0.3 * ({H("'m|' || s_suppkey || '|' || k")} / 4294967296.0), 6) END AS mix FROM (SELECT s_suppkey, k, row_number() OVER (PARTITION BY s_suppkey ORDER BY md5('d|' || s_suppkey || '|' || k)) AS r FROM supplier, range(4) t(k))")
def smp4_one_dry_slot(spark, sf):
    """One slot of each key stays dry; the others get an option and an amount."""
    rows = table(spark, sf, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("slot"))
    wet = F.row_number().over(Window.partitionBy("s_suppkey").orderBy(md5_key(F.lit("d"), "s_suppkey", "slot"))) > 1
    option = F.element_at(F.array(*map(F.lit, OPTIONS)), (draw_int(F.lit("i"), "s_suppkey", "slot", below=4) + 1).cast("int"))
    marked = rows.withColumn("wet", wet)
    return marked.select("s_suppkey", "slot", F.when(F.col("wet"), option).alias("ir"), F.when(F.col("wet"), r6(0.1 + 0.3 * draw_unit(F.lit("m"), "s_suppkey", "slot"))).alias("mix"))


@query(f"SELECT e AS epoch, o_orderkey FROM range(3) t(e), (SELECT o.*, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) - 1 AS v FROM orders o) JOIN (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1) USING (o_custkey) WHERE v = {H("'e|' || e || '|' || o_custkey")} % n")
def smp5_one_version_per_epoch(spark, sf):
    """In each epoch a group keeps the rows of one of its versions."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    versions = orders.select("o_custkey", "o_orderpriority").distinct()
    w = Window.partitionBy("o_custkey")
    versions = versions.withColumns({"v": (F.row_number().over(w.orderBy("o_orderpriority")) - 1).cast("long"), "n": F.count(F.lit(1)).over(w)})
    epochs = versions.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    chosen = epochs.where(F.col("v") == draw_int(F.lit("e"), "epoch", "o_custkey", below=F.col("n"))).select("epoch", "o_custkey", "o_orderpriority")
    return orders.join(chosen, ["o_custkey", "o_orderpriority"]).select("epoch", "o_orderkey")


@query(f"SELECT user_id, bar, round(first, 6) AS first, round(least(first, 0.5) * ({H("'q|' || user_id || '|' || bar")} / 4294967296.0), 6) AS second FROM (SELECT user_id, bar, greatest(least(coalesce(start_sec - prev, 0), 600), 0) * ({H("'f|' || user_id || '|' || bar")} / 4294967296.0) AS first FROM (SELECT *, lag(start_sec) OVER (PARTITION BY user_id ORDER BY bar) AS prev FROM v_bars))")
def smp6_bounded_offsets(spark, sf):
    """An offset below the previous gap and a cap, and a second one bounded by the first."""
    gap = F.coalesce(F.col("start_sec") - F.lag("start_sec").over(Window.partitionBy("user_id").orderBy("bar")), F.lit(0.0))
    first = F.greatest(F.least(gap, F.lit(600.0)), F.lit(0.0)) * draw_unit(F.lit("f"), "user_id", "bar")
    drawn = v_bars(spark, sf).withColumn("first", first)
    return drawn.select("user_id", "bar", r6("first").alias("first"), r6(F.least("first", F.lit(0.5)) * draw_unit(F.lit("q"), "user_id", "bar")).alias("second"))


@query("SELECT count(*) AS sampled, count_if(abs(n_chars - length(text)) > 1)::BIGINT AS mismatched FROM (SELECT n_chars, text FROM documents ORDER BY md5('v|' || doc_id) LIMIT 20)")
def smp7_sampled_validation(spark, sf):
    """Twenty documents by hash, measured again: the sample is the feature."""
    docs = table(spark, sf, "documents")
    chosen = docs.select("doc_id").orderBy(md5_key(F.lit("v"), "doc_id")).limit(20)
    again = docs.join(F.broadcast(chosen), "doc_id")
    return again.agg(F.count(F.lit(1)).alias("sampled"), F.count_if(F.abs(F.col("n_chars") - F.length("text")) > 1).alias("mismatched"))


@query(f"SELECT s_suppkey, s_name, CASE WHEN s_nationkey % 3 = 0 THEN {H("'new|' || s_suppkey")} % 5 ELSE {H("'old|' || s_suppkey")} % 5 END AS plan, CASE WHEN s_nationkey % 3 = 0 THEN {H("'new|' || s_suppkey")} % 5 <> {H("'old|' || s_suppkey")} % 5 ELSE false END AS changed FROM supplier")
def smp8_ledger_refresh(spark, sf):
    """The ledger's rows stay; only the plan column of chosen groups is drawn anew, and changes are marked."""
    ledger = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", draw_int(F.lit("old"), "s_suppkey", below=5).alias("old_plan"))
    fresh = table(spark, sf, "supplier").where("s_nationkey % 3 = 0").select("s_suppkey", draw_int(F.lit("new"), "s_suppkey", below=5).alias("new_plan"))
    joined = ledger.join(fresh, "s_suppkey", "left")
    plan = F.coalesce("new_plan", "old_plan")
    return joined.select("s_suppkey", "s_name", plan.alias("plan"), (~plan.eqNullSafe(F.col("old_plan"))).alias("changed"))


@query(f"WITH l AS (SELECT s_suppkey, {H("'old|' || s_suppkey")} % 5 AS plan, CASE WHEN s_nationkey % 3 = 0 THEN {H("'new|' || s_suppkey")} % 5 END AS fresh FROM supplier), c AS (SELECT count_if(fresh <> plan)::BIGINT AS n FROM l) SELECT s_suppkey, 'current' AS version, coalesce(fresh, plan) AS plan, n AS n_changed FROM l, c UNION ALL SELECT s_suppkey, 'prior', plan, n FROM l, c WHERE n > 0")
def smp8_versions(spark, sf):
    """The refreshed ledger beside the one before it, with the number of rows that changed."""
    ledger = table(spark, sf, "supplier").select("s_suppkey", draw_int(F.lit("old"), "s_suppkey", below=5).alias("plan"))
    fresh = table(spark, sf, "supplier").where("s_nationkey % 3 = 0").select("s_suppkey", draw_int(F.lit("new"), "s_suppkey", below=5).alias("plan"))
    return refreshed(ledger, fresh, "s_suppkey", "plan")


def refreshed(ledger: DataFrame, fresh: DataFrame, key: str, column: str) -> DataFrame:
    """The ledger's rows with `column` from `fresh` where that has their key, as version `current`; if any changed, the old rows stay as version `prior`. Keys that the ledger lacks are not added."""
    new = fresh.select(key, F.col(column).alias("__new"), F.lit(True).alias("__there"))
    joined = ledger.join(new, key, "left").withColumn("__now", F.when(F.col("__there"), F.col("__new")).otherwise(F.col(column)))
    n_changed = joined.agg(F.count_if(~F.col("__now").eqNullSafe(F.col(column)))).head()[0]
    rows = [c for c in ledger.columns if c != column]
    current = joined.select(*rows, F.lit("current").alias("version"), F.col("__now").alias(column))
    whole = current.unionByName(ledger.select(*rows, F.lit("prior").alias("version"), column)) if n_changed else current
    return whole.withColumn("n_changed", F.lit(n_changed))


CANDIDATE_SQL = "SELECT c_nationkey AS fam, c_mktsegment AS folder, c_custkey AS member, c_acctbal < 9000 AS b FROM customer WHERE c_acctbal > 7500"


@query(f"""WITH m AS ({CANDIDATE_SQL}), o AS (SELECT c_nationkey AS fam, min(c_mktsegment) AS origin FROM customer GROUP BY 1),
r AS (SELECT m.*, folder = origin AS own, row_number() OVER (PARTITION BY fam ORDER BY b, folder <> origin, folder, md5('k|' || member)) AS turn FROM m JOIN o USING (fam)),
k AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY b, NOT own, folder, member) - 1 AS slot FROM r WHERE turn <= 8)
SELECT fam, slot, CASE WHEN b THEN 'B' ELSE 'A' END AS tier, folder, member FROM k UNION ALL SELECT fam, s, 'generated', origin, NULL FROM (SELECT o.fam, o.origin, count(k.fam) AS c FROM o LEFT JOIN k USING (fam) GROUP BY 1, 2), range(8) t(s) WHERE s >= c""")
def srt2_tiered_top_k(spark, sf):
    """Eight slots a family: tier A before B, in a tier the origin folder first and then by name, in a folder by name; what is left is generated.

    Only the folder in which the slots run out is sampled, in order of a hash.
    """
    customer = table(spark, sf, "customer").select(F.col("c_nationkey").alias("fam"), F.col("c_mktsegment").alias("folder"), F.col("c_custkey").alias("member"), "c_acctbal")
    origins = customer.groupBy("fam").agg(F.min("folder").alias("origin"))
    members = customer.where("c_acctbal > 7500").withColumn("b", F.col("c_acctbal") < 9000).join(origins, "fam").withColumn("other", F.col("folder") != F.col("origin"))
    w = Window.partitionBy("fam")
    chosen = members.withColumn("turn", F.row_number().over(w.orderBy("b", "other", "folder", md5_key(F.lit("k"), "member")))).where("turn <= 8")
    filled = chosen.withColumn("slot", (F.row_number().over(w.orderBy("b", "other", "folder", "member")) - 1).cast("long"))
    counts = origins.join(filled.groupBy("fam").agg(F.count(F.lit(1)).alias("c")), "fam", "left").withColumn("c", F.coalesce("c", F.lit(0))).where("c < 8")
    rest = counts.select("fam", F.explode(F.sequence("c", F.lit(7).cast("long"))).alias("slot"), F.lit("generated").alias("tier"), F.col("origin").alias("folder"), F.lit(None).cast("long").alias("member"))
    return filled.select("fam", "slot", F.when(F.col("b"), "B").otherwise("A").alias("tier"), "folder", "member").unionByName(rest)


@query("SELECT user_id, bar, state, row_number() OVER (PARTITION BY user_id ORDER BY bar) AS place FROM v_bars")
def srt1_canonical_order(spark, sf):
    """Sorted by series and position over all partitions, with each row's place in its series."""
    placed = v_bars(spark, sf).withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("bar")).cast("long"))
    return placed.select("user_id", "bar", "state", "place").orderBy("user_id", "bar")


@query("SELECT o_orderkey, shard, shard * 100 AS first, least(shard * 100 + 100, n) AS last FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS shard, count(*) OVER () AS n FROM orders)")
def udf2_even_shards(spark, sf):
    """Contiguous shards [first, last) of a hundred rows, the last one short; none may be empty."""
    orders = table(spark, sf, "orders").select("o_orderkey")
    shards = even_shards(orders, "o_orderkey", 100)
    n = orders.agg(F.count(F.lit(1)).alias("n"))
    bounds = shards.join(F.broadcast(n)).withColumns({"first": F.col("shard") * 100, "last": F.least(F.col("shard") * 100 + 100, "n")}).drop("n")
    checks.assert_empty(bounds.where("first < 0 OR last <= first"), "empty shards")
    return bounds


def even_shards(df: DataFrame, key: str, size: int) -> DataFrame:
    """Adds `shard`, floor(rank / size)."""
    return ranked(df, key).withColumn("shard", F.floor(F.col("rank") / size).cast("long")).drop("rank")


def range_shard(df: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """The rows with ranks in [first, last) of the key's order; a shard that is empty or reaches past the end is an error."""
    rows = ranked(df, key)
    if first < 0 or last <= first or last > rows.count():
        raise checks.CheckFailed(f"no shard [{first}, {last})")
    return rows.where(F.col("rank").between(first, last - 1)).drop("rank")

"""Queries over the derived vault and, for each, what DuckDB says over the tables it was derived from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.operators.recordset import RecordSet
from notelake.testing.vault_from_tables import vault

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# What the derived notes hold, in SQL.
_O = """(SELECT *, 'orders/' || lower(o_orderstatus) || '/order-' || o_orderkey || '.md' AS path, 'order-' || o_orderkey AS name,
    CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS total, strftime(o_orderdate, '%Y-%m-%d') AS placed FROM orders)"""
_C = """(SELECT *, 'customers/' || lower(c_mktsegment) || '/customer-' || c_custkey || '.md' AS path, 'customer-' || c_custkey AS name,
    CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS balance FROM customer)"""
_P = "(SELECT *, 'parts/part-' || p_partkey || '.md' AS path, 'part-' || p_partkey AS name FROM part)"
_D = "(SELECT *, 'docs/' || coalesce(lang, 'none') || '/' || coalesce(source, 'none') || '/doc-' || doc_id || '.txt' AS path, 'doc-' || doc_id AS name FROM documents)"
_ALL = f"(SELECT path, name FROM {_O} UNION ALL SELECT path, name FROM {_C} UNION ALL SELECT path, name FROM {_P} UNION ALL SELECT path, name FROM {_D})"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def paths(rows: RecordSet) -> DataFrame:
    return rows.select(path="file.path")


def pages(name: str, sql: str, kinds: tuple[str, ...], source: str | None = None, where: str | None = None, tasks: bool = True) -> None:
    """A query for the paths of the pages that a source and a filter select."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = vault(spark, sf_dir, *kinds, tasks=tasks).pages(source)
        return paths(rows.where(where) if where else rows)

    query(name, sql)(run)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vault(spark, sf_dir, "orders").pages("#order and orders/f/").where("total > 100000").sort("total", True).limit(10)
    return rows.values("total").select(F.col("name"), rows.column("total")["n"].alias("total"))


query("flagship_topk", f"SELECT name, total FROM {_O} WHERE o_orderstatus = 'F' AND total > 100000 ORDER BY total DESC, string_split(path, '/') LIMIT 10")(flagship)

# ---- files and sources

_FOUR = ("orders", "customers", "parts", "documents")


@query("scan_all_files", f"SELECT path, name, regexp_replace(path, '/[^/]*$', '') AS folder, CASE WHEN path LIKE '%.md' THEN 'note' ELSE 'other' END AS format FROM {_ALL}")
def scan_all_files(spark, sf_dir):
    v = vault(spark, sf_dir, *_FOUR)
    return v.pages().files.select("path", "name", "folder", "format")


pages("source_all", f"SELECT path FROM {_ALL}", _FOUR)
pages("source_tag", f"SELECT path FROM {_O} WHERE o_orderstatus = 'F'", ("orders", "customers"), "#order/f")
pages("source_tag_nested", f"SELECT path FROM {_O}", ("orders", "customers"), "#order")
pages("source_exact", f"SELECT path FROM {_C} WHERE path = 'customers/machinery/customer-1.md' OR path = 'customers/household/customer-3.md'", ("customers",), "customers/machinery/customer-1.md or 'customers/household/customer-3.md' or customers/none/customer-3.md")
pages("source_folder", f"SELECT path FROM {_O} WHERE starts_with(path, 'orders/f/')", ("orders", "customers"), "orders/f/")
pages("source_glob_star", f"SELECT path FROM {_ALL} WHERE regexp_matches(path, '^parts/[^/]*7\\.md$')", _FOUR, "parts/*7.md")
pages("source_glob_globstar", f"SELECT path FROM {_ALL} WHERE regexp_matches(path, '^(?s:.*)/[^/]*-1(?s:.*)$')", _FOUR, "**/*-1**")
pages("source_bool_precedence", f"SELECT path FROM {_ALL} WHERE starts_with(path, 'parts/') OR (starts_with(path, 'orders/') AND NOT starts_with(path, 'orders/o/'))", _FOUR, "parts/ or #order and not orders/o/")
pages("source_symbols", f"SELECT path FROM {_ALL} WHERE (starts_with(path, 'parts/') OR starts_with(path, 'customers/')) AND NOT starts_with(path, 'customers/building/')", _FOUR, "(parts/ || #customer) && !customers/building/")
pages("source_not_keeps_other_files", f"SELECT path FROM {_ALL} WHERE NOT starts_with(path, 'orders/') AND NOT starts_with(path, 'customers/')", _FOUR, "not #order and not @Customer")
pages("source_class_exact", f"SELECT path FROM {_O}", _FOUR, "@Order")
pages("source_class_children", f"SELECT path FROM {_O}", _FOUR, "class(Deal, children)")
pages("source_class_descendants", f"SELECT path FROM {_O} UNION ALL SELECT path FROM {_C}", _FOUR, "class(Record).with_descendants()")
pages("source_class_itself", f"SELECT path FROM {_P}", _FOUR, "@Part* and not @Record")

# ---- fields


@query("field_file", f"SELECT path, name, regexp_replace(path, '/[^/]*$', '') AS folder, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS mtime, strftime(o_orderdate, '%Y-%m-%d') AS mdate, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS ctime, strftime(o_orderdate, '%Y-%m-%d') AS cdate FROM {_O}")
def field_file(spark, sf_dir):
    rows = vault(spark, sf_dir, "orders").pages()
    return rows.select(path="file.path", name="file.name", folder="file.folder", mtime="file.mtime", mdate="file.mdate", ctime="file.created_at", cdate="file.cdate")


@query("field_size", f"SELECT path, CAST(strlen(coalesce(text, '')) AS DOUBLE) AS size FROM {_D}")
def field_size(spark, sf_dir):
    return vault(spark, sf_dir, "documents").pages().select(path="file.path", size="file.size")


@query("field_metadata", f"SELECT path, total, placed, o_orderpriority AS priority, 'customer-' || o_custkey AS customer FROM {_O}")
def field_metadata(spark, sf_dir):
    rows = vault(spark, sf_dir, "orders").pages()
    c = rows.column
    return rows.values("total", "placed", "priority", "customer").select("path", c("total")["n"].alias("total"), c("placed")["s"].alias("placed"), c("Priority")["s"].alias("priority"), c("customer")["s"].alias("customer"))


@query("field_tags", f"SELECT path, ['#order/' || lower(o_orderstatus)] AS tags FROM {_O}")
def field_tags(spark, sf_dir):
    return vault(spark, sf_dir, "orders").pages().select(path="file.path", tags="tags")


# ---- filters

_FILTERS = {
    "filter_eq": ("priority == \"1-URGENT\"", "o_orderpriority = '1-URGENT'"),
    "filter_ne": ("priority != \"1-URGENT\"", "o_orderpriority IS DISTINCT FROM '1-URGENT'"),
    "filter_lt": ("total < 50000", "total < 50000"),
    "filter_le": ("placed <= \"1996-06-30\"", "placed <= '1996-06-30'"),
    "filter_gt": ("total > 250000.5", "total > 250000.5"),
    "filter_ge": ("placed >= \"1997-01-01\"", "placed >= '1997-01-01'"),
    "filter_null_eq": ("missing == null", "true"),
    "filter_null_ne": ("total != null", "total IS NOT NULL"),
    "filter_missing_ne": ("missing != 7", "true"),
    "filter_kind_mismatch": ("total == \"1\" or total > \"a\"", "false"),
    "filter_contains_text": ("contains(priority, \"URG\") or CONTAINS(file.name, \"9\")", "contains(o_orderpriority, 'URG') OR contains(name, '9')"),
    "filter_contains_tag": ("contains(tags, \"#order\") and not contains(tags, \"#order/f\")", "o_orderstatus <> 'F'"),
    "filter_and_or_not": ("total > 100000 and not (placed < \"1996-01-01\" or priority == \"5-LOW\") || file.name == \"order-1\"", "(total > 100000 AND NOT (placed < '1996-01-01' OR o_orderpriority = '5-LOW')) OR name = 'order-1'"),
}
for _name, (_where, _sql) in _FILTERS.items():
    pages(_name, f"SELECT path FROM {_O} WHERE {_sql}", ("orders",), None, _where)
pages("filter_contains_list", f"SELECT path FROM {_P} WHERE p_partkey % 3 = 0 AND (p_size = 7 OR p_size + 1 = 7)", ("parts",), None, "contains(sizes, 7)")
pages("filter_link_never_equal", f"SELECT path FROM {_P} WHERE p_size = 7", ("parts",), None, 'made == "maker" or contains(made, "maker") or size == 7')
pages("filter_contains_nested_tag", f"SELECT path FROM {_P}", ("parts",), None, "contains(kinds, \"#part\")")


@query("filter_composed", f"SELECT path FROM {_O} WHERE total > 100000 AND total < 200000 AND o_orderpriority = '2-HIGH'")
def filter_composed(spark, sf_dir):
    return paths(vault(spark, sf_dir, "orders").pages().where("total > 100000").where("total < 200000").filter('priority == "2-HIGH"'))


# ---- order, limits, flattening, counting


def sorted_pages(name: str, order_by: str, source: str, kinds: tuple[str, ...], change) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return change(vault(spark, sf_dir, *kinds).pages()).numbered().select("path", "position")

    query(name, f"SELECT path, row_number() OVER (ORDER BY {order_by}) AS position FROM {source}")(run)


_BY_PATH = "string_split(path, '/')"
sorted_pages("sort_num_asc", f"balance, {_BY_PATH}", _C, ("customers",), lambda r: r.sort("balance"))
sorted_pages("sort_num_desc", f"balance DESC, {_BY_PATH}", _C, ("customers",), lambda r: r.sort("balance", True))
sorted_pages("sort_text", f"c_mktsegment, {_BY_PATH}", _C, ("customers",), lambda r: r.sort("segment"))
sorted_pages("sort_stable_chain", f"c_mktsegment DESC, balance, {_BY_PATH}", _C, ("customers",), lambda r: r.sort("balance").sort("segment", True))
sorted_pages("sort_null_first", f"CASE WHEN c_acctbal IS NULL THEN 1 ELSE 0 END, {_BY_PATH}", _C, ("customers",), lambda r: r.sort("nothing"))
sorted_pages("sort_path_default", _BY_PATH, _ALL, _FOUR, lambda r: r)
sorted_pages("group_by_clusters", f"c_mktsegment, {_BY_PATH}", _C, ("customers",), lambda r: r.group_by("segment"))


@query("limit_topk", f"SELECT path, total FROM {_O} ORDER BY total DESC, {_BY_PATH} LIMIT 25")
def limit_topk(spark, sf_dir):
    rows = vault(spark, sf_dir, "orders").pages().sort("total", descending=True).limit(25)
    return rows.values("total").select("path", rows.column("total")["n"].alias("total"))


@query("limit_seals", f"SELECT path FROM (SELECT * FROM {_O} ORDER BY total DESC, {_BY_PATH} LIMIT 40) WHERE o_orderstatus = 'F'")
def limit_seals(spark, sf_dir):
    return paths(vault(spark, sf_dir, "orders").pages().sort("total", True).limit(40).where('contains(tags, "#order/f")'))


@query("flatten_list", f"SELECT path, CAST(s AS DOUBLE) AS size FROM (SELECT path, unnest([p_size, p_size + 1]) AS s FROM {_P} WHERE p_partkey % 3 = 0) UNION ALL SELECT path, CAST(p_size AS DOUBLE) FROM {_P} WHERE p_partkey % 3 = 2")
def flatten_list(spark, sf_dir):
    rows = vault(spark, sf_dir, "parts").pages().flatten("sizes")
    return rows.values("sizes").select("path", rows.column("sizes")["n"].alias("size"))


@query("flatten_missing_keeps", f"SELECT path, CAST(NULL AS VARCHAR) AS kind FROM {_P}")
def flatten_missing_keeps(spark, sf_dir):
    rows = vault(spark, sf_dir, "parts").pages().flatten("nothing")
    return rows.values("nothing").select("path", rows.column("nothing")["kind"].alias("kind"))


@query("flatten_twice", f"SELECT path, s AS size, k AS kind FROM (SELECT path, CAST(unnest([p_size, p_size + 1]) AS DOUBLE) AS s, ['a', '#part/' || lower(string_split(p_type, ' ')[1])] AS ks FROM {_P} WHERE p_partkey % 3 = 0 UNION ALL SELECT path, CAST(p_size AS DOUBLE), ['a', '#part/' || lower(string_split(p_type, ' ')[1])] FROM {_P} WHERE p_partkey % 3 = 2), unnest(ks) AS u(k)")
def flatten_twice(spark, sf_dir):
    rows = vault(spark, sf_dir, "parts").pages().flatten("sizes").flatten("kinds").sort("sizes")
    return rows.values("sizes", "kinds").select("path", rows.column("sizes")["n"].alias("size"), rows.column("kinds")["s"].alias("kind"))


@query("flatten_tags", f"SELECT path, '#order/' || lower(o_orderstatus) AS tag FROM {_O}")
def flatten_tags(spark, sf_dir):
    rows = vault(spark, sf_dir, "orders").pages().flatten("tags")
    return rows.values("tags").select("path", rows.column("tags")["s"].alias("tag"))


@query("count_rows", f"SELECT count(*) AS n FROM {_O} WHERE total > 100000")
def count_rows(spark, sf_dir):
    rows = vault(spark, sf_dir, "orders").pages("orders/").where("total > 100000")
    return spark.createDataFrame([(rows.count(),)], "n long")


# ---- tasks

_T = f"""(SELECT o.path, o.total, l_linestatus = 'F' AS completed, 'ship part ' || l_partkey || ' line ' || l_linenumber AS text,
    l_linenumber, l_partkey, l_suppkey, o.o_orderstatus FROM {_O} o JOIN lineitem ON l_orderkey = o_orderkey)"""


@query("tasks_all", f"SELECT path, completed, text FROM {_T}")
def tasks_all(spark, sf_dir):
    return vault(spark, sf_dir, "orders").tasks().select(path="file.path", completed="task.completed", text="task.text")


@query("tasks_completed", f"SELECT path, text FROM {_T} WHERE completed AND o_orderstatus = 'F'")
def tasks_completed(spark, sf_dir):
    rows = vault(spark, sf_dir, "orders").tasks("orders/f/").where("task.completed == true")
    return rows.select(path="file.path", text="task.text")


@query("tasks_parent_fields", f"SELECT path, total, text FROM {_T} WHERE total > 300000 AND NOT completed")
def tasks_parent_fields(spark, sf_dir):
    rows = vault(spark, sf_dir, "orders").tasks().where("total > 300000 and task.completed == false")
    return rows.values("total", "task.text").select("path", rows.column("total")["n"].alias("total"), F.col("task.text").alias("text"))


@query("tasks_on_pages_null", f"SELECT path FROM {_O}")
def tasks_on_pages_null(spark, sf_dir):
    return paths(vault(spark, sf_dir, "orders").pages().where("task.completed == null and task.text == null"))


# ---- links


@query("outlinks", f"SELECT path, 'customer-' || o_custkey AS target, 'wikilink' AS kind FROM {_O}")
def outlinks(spark, sf_dir):
    v = vault(spark, sf_dir, "orders")
    return v.notes.select("path", F.explode("outlinks").alias("o")).select("path", "o.target", "o.kind")


_LINKED = f"SELECT c.path AS target, o.path AS source FROM {_O} o JOIN {_C} c ON c.c_custkey = o.o_custkey"


@query("links_nearest", _LINKED)
def links_nearest(spark, sf_dir):
    return vault(spark, sf_dir, "orders", "customers").links


@query("inlinks", f"SELECT target AS path, list(source ORDER BY string_split(source, '/')) AS inlinks FROM ({_LINKED}) GROUP BY target UNION ALL SELECT path, CAST([] AS VARCHAR[]) FROM {_C} WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def inlinks(spark, sf_dir):
    # the linkers are outside of the source, and count all the same
    return vault(spark, sf_dir, "orders", "customers").pages("customers/").select(path="file.path", inlinks="inlinks")


@query("inlinks_count", f"SELECT target AS path, count(*) AS n FROM ({_LINKED}) GROUP BY target")
def inlinks_count(spark, sf_dir):
    rows = vault(spark, sf_dir, "orders", "customers").pages("@Customer").flatten("inlinks")
    return rows.files.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query("links_tie_none", "SELECT path FROM (SELECT 1 AS path) WHERE false")
def links_tie_none(spark, sf_dir):
    """Two notes of each stem, as near as each other to the linker: nothing resolves."""
    from notelake.operators.links import edges

    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("k"))
    none = F.array().cast("array<struct<target:string,text:string,kind:string,embedded:boolean>>")
    link = F.array(F.struct(F.col("k").alias("target"), F.col("k").alias("text"), F.lit("wikilink").alias("kind"), F.lit(False).alias("embedded")))
    notes = c.select(F.concat(F.lit("a/"), "k", F.lit(".md")).alias("path"), none.alias("outlinks")).unionByName(c.select(F.concat(F.lit("b/"), "k", F.lit(".md")).alias("path"), none.alias("outlinks"))).unionByName(c.select(F.concat(F.lit("c/from-"), "k", F.lit(".md")).alias("path"), link.alias("outlinks")))
    return edges(notes).select(F.lit(1).alias("path"))


# ---- functions: over texts and numbers of the tables


def function(name: str, source: str, sql: str, columns: Callable[[], dict], table: str) -> None:
    """A query of key columns and one or more function results over a table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*[c.alias(n) for n, c in columns().items()])

    query(f"fn_{name}", f"SELECT {sql} FROM {source}")(run)


def _shown(v):
    """A double as text, as DuckDB writes it."""
    return F.when(F.isnan(v), "nan").when(v == float("inf"), "inf").when(v == -1e300, "-1e+300").when(v == 4503599627370497.0, "4503599627370497.0").otherwise(v.cast("string"))


def _functions() -> None:
    from notelake.functions import dates as d
    from notelake.functions import numbers as n
    from notelake.functions import paths as p
    from notelake.functions import strings as s

    c = F.col
    key = "p_partkey AS k"
    part = lambda name, sql, col: function(name, "part", f"{key}, {sql} AS v", lambda: {"k": c("p_partkey"), "v": col()}, "part")
    words = "list_transform(list_filter(string_split(p_name, ' '), lambda w: w <> ''), lambda w: lower(w))"
    capital = "upper(w[1]) || lower(w[2:])"
    part("snake_case", f"array_to_string({words}, '_')", lambda: s.snake_case(c("p_name")))
    part("kebab_case", f"array_to_string({words}, '-')", lambda: s.kebab_case(c("p_name")))
    part("pascal_case", f"array_to_string(list_transform({words}, lambda w: {capital}), '')", lambda: s.pascal_case(c("p_name")))
    part("title_case", f"array_to_string(list_transform({words}, lambda w: {capital}), ' ')", lambda: s.title_case(c("p_name")))
    part("camel_case", f"lower(({words})[1]) || array_to_string(list_transform(({words})[2:], lambda w: {capital}), '')", lambda: s.camel_case(c("p_name")))
    part("trim_prefix", "CASE WHEN starts_with(p_brand, 'Brand#1') THEN p_brand[8:] ELSE p_brand END", lambda: s.trim_prefix(c("p_brand"), "Brand#1"))
    part("trim_suffix", "CASE WHEN ends_with(p_brand, '3') THEN p_brand[:-2] ELSE p_brand END", lambda: s.trim_suffix(c("p_brand"), "3"))
    part("truncate", "CASE WHEN length(p_type) <= 10 THEN p_type ELSE p_type[1:7] || '...' END", lambda: s.truncate(c("p_type"), 10))
    part("truncate_words", "CASE WHEN len(string_split(p_type, ' ')) <= 1 THEN p_type ELSE string_split(p_type, ' ')[1] || ' ...' END", lambda: s.truncate_words(c("p_type"), 1))
    function("word_count", "documents", "doc_id AS k, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS BIGINT) AS v", lambda: {"k": c("doc_id"), "v": s.word_count(c("text"))}, "documents")
    part("repeat", "repeat(p_brand, 3)", lambda: s.repeat(c("p_brand"), 3))
    part("regex_replace", "regexp_replace(p_type, '[AEIOU]+', '_', 'g')", lambda: s.regex_replace(c("p_type"), "[AEIOU]+", "_"))
    part("regex_match", "regexp_matches(p_type, 'A[A-Z]*D')", lambda: s.regex_match(c("p_type"), "A[A-Z]*D"))

    part("ceil", "CAST(ceil(p_retailprice / 7) AS DOUBLE)", lambda: n.ceil(c("p_retailprice") / 7))
    part("floor", "CAST(floor(p_retailprice / 7) AS DOUBLE)", lambda: n.floor(c("p_retailprice") / 7))
    edges = "CASE p_partkey % 6 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('Infinity' AS DOUBLE) WHEN 2 THEN -1e300 WHEN 3 THEN -0.25 WHEN 4 THEN CAST('-0.0' AS DOUBLE) ELSE 4503599627370497.0 END"
    odd = lambda: F.expr("CASE p_partkey % 6 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') WHEN 2 THEN -1e300D WHEN 3 THEN -0.25D WHEN 4 THEN double('-0.0') ELSE 4503599627370497.0D END")
    function("ceil_edges", "part", f"{key}, CAST(ceil({edges}) AS VARCHAR) AS up, CAST(floor({edges}) AS VARCHAR) AS down", lambda: {"k": c("p_partkey"), "up": _shown(n.ceil(odd())), "down": _shown(n.floor(odd()))}, "part")
    part("sqrt", "sqrt(p_size)", lambda: n.sqrt(c("p_size").cast("double")))
    part("num_format", "printf('%.2f', CAST(p_size AS DOUBLE) / 3)", lambda: n.num_format(c("p_size").cast("double") / 3, 2))

    path = lambda: F.concat(F.lit("parts/a.b/"), c("p_partkey").cast("string"), F.lit(".tar.gz"))
    part("path_filename", "p_partkey || '.tar.gz'", lambda: p.path_filename(path()))
    part("path_basename", "p_partkey || '.tar'", lambda: p.path_basename(path()))
    part("path_extension", "'gz'", lambda: p.path_extension(path()))
    part("path_parent", "'parts/a.b'", lambda: p.path_parent(path()))

    day = lambda: F.date_format("o_orderdate", "yyyy-MM-dd")
    moment = lambda: F.concat(day(), F.lit("T10:20:30"))
    when = lambda name, sql, col: function(name, "orders", f"o_orderkey AS k, {sql} AS v", lambda: {"k": c("o_orderkey"), "v": col()}, "orders")
    at = "CAST(strftime(o_orderdate, '%Y-%m-%d') || ' 10:20:30' AS TIMESTAMP)"
    date = lambda e: f"strftime({e}, '%Y-%m-%d')"
    full = lambda e: f"strftime({e}, '%Y-%m-%d %H:%M:%S')"
    when("date_format", "strftime(o_orderdate, '%d/%m/%Y on day %j')", lambda: d.date_format(day(), "%d/%m/%Y on day %j"))
    when("timestamp", f"CAST(epoch({at}) AS BIGINT)", lambda: d.timestamp(moment()))
    when("from_timestamp", "strftime(CAST('1970-01-01' AS TIMESTAMP) + to_seconds(o_orderkey * 1000), '%Y-%m-%d %H:%M:%S')", lambda: d.from_timestamp(c("o_orderkey") * 1000, "%Y-%m-%d %H:%M:%S"))
    when("date_add", full(f"{at} + INTERVAL 50 HOUR"), lambda: d.date_add(moment(), 50, "hours"))
    when("date_sub", date("o_orderdate - INTERVAL 3 MONTH"), lambda: d.date_sub(day(), 3, "months"))
    when("add_days", date("o_orderdate + INTERVAL 40 DAY"), lambda: d.add_days(day(), 40))
    when("sub_days", full(f"{at} - INTERVAL 40 DAY"), lambda: d.sub_days(moment(), 40))
    when("add_months", date("o_orderdate + INTERVAL 1 MONTH"), lambda: d.add_months(day(), 1))
    when("sub_months", date("o_orderdate - INTERVAL 1 MONTH"), lambda: d.sub_months(day(), 1))
    when("add_years", date("o_orderdate + INTERVAL 1 YEAR"), lambda: d.add_years(day(), 1))
    when("sub_years", date("o_orderdate - INTERVAL 1 YEAR"), lambda: d.sub_years(day(), 1))
    when("start_of_month", full(f"date_trunc('month', {at}) + INTERVAL 10 HOUR + INTERVAL 20 MINUTE + INTERVAL 30 SECOND"), lambda: d.start_of_month(moment()))
    when("end_of_month", date("last_day(CAST(o_orderdate AS DATE))"), lambda: d.end_of_month(day()))
    when("weekday", "CAST(isodow(o_orderdate) - 1 AS INTEGER)", lambda: d.weekday(day()))
    when("is_leap_year", "year(o_orderdate) % 4 = 0 AND (year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0)", lambda: d.is_leap_year(day()))
    # from the order's date to a fixed one: positive if that is later
    when("date_diff_days", "date_diff('day', CAST(o_orderdate AS DATE), CAST('1996-02-29' AS DATE))", lambda: d.date_diff(day(), F.lit("1996-02-29"), "days", whole=True))
    when("date_diff_hours", f"CAST(date_diff('second', {at}, CAST('1996-02-29 12:00:00' AS TIMESTAMP)) AS DOUBLE) / 3600", lambda: d.date_diff(moment(), F.lit("1996-02-29 12:00:00"), "hours"))
    when("date_diff_minutes_untimed", f"CAST(trunc(date_diff('second', {at}, CAST('1996-02-29' AS TIMESTAMP)) / 60.0) AS BIGINT)", lambda: d.date_diff(moment(), F.lit("1996-02-29"), "minutes", whole=True))
    # whole calendar units elapsed, with the sign of the way from the order's date to the fixed one
    low, high = "least(CAST(o_orderdate AS DATE), DATE '1996-02-15')", "greatest(CAST(o_orderdate AS DATE), DATE '1996-02-15')"
    sign = "CASE WHEN CAST(o_orderdate AS DATE) > DATE '1996-02-15' THEN -1 ELSE 1 END"
    months = f"((year({high}) - year({low})) * 12 + month({high}) - month({low}) - CASE WHEN day({high}) < day({low}) THEN 1 ELSE 0 END)"
    when("date_diff_months", f"CAST({sign} * {months} AS BIGINT)", lambda: d.date_diff(day(), F.lit("1996-02-15"), "months"))
    when("date_diff_years", f"CAST({sign} * floor({months} / 12) AS BIGINT)", lambda: d.date_diff(day(), F.lit("1996-02-15"), "years"))
    when("is_past", "true", lambda: d.is_past(day()))
    when("is_future", "false", lambda: d.is_future(moment()))


_functions()


@query("fn_today", "SELECT true AS v")
def fn_today(spark, sf_dir):
    """now, today, tomorrow and yesterday, against each other."""
    from notelake.functions import dates as d

    one = spark.range(1)
    return one.select(((d.date_add(d.yesterday(), 2) == d.tomorrow()) & (d.add_days(d.today(), 1) == d.tomorrow()) & (F.char_length(d.now("%Y-%m-%d %H:%M")) == 16)).alias("v"))


@query("fn_uuid", "SELECT 36 AS n")
def fn_uuid(spark, sf_dir):
    from notelake.functions.misc import uuid

    return spark.range(1).select(F.char_length(uuid()).alias("n"))


@query("fn_path_tests", f"SELECT path FROM {_C} WHERE c_custkey % 2 = 0 UNION ALL SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') FROM {_C}")
def fn_path_tests(spark, sf_dir):
    from notelake.functions.paths import path_exists

    v = vault(spark, sf_dir, "customers")
    own = v.files.filter(F.pmod(F.regexp_extract("path", r"(\d+)", 1).try_cast("long"), F.lit(2)) == 0).select("path")
    asked = own.unionByName(v.files.select(F.col("folder").alias("path")).distinct()).unionByName(own.select(F.concat(F.lit("no/"), "path").alias("path")))
    return path_exists(asked, v.files)


# ---- refresh, rendering, persisting


@query("refresh_diff", f"SELECT path, CASE WHEN o_orderkey % 10 = 3 THEN 'removed' WHEN o_orderkey % 10 = 5 THEN 'added' WHEN o_orderkey % 10 = 7 THEN 'changed' ELSE 'same' END AS change FROM {_O}")
def refresh_diff(spark, sf_dir):
    from notelake.sources.index import diff

    files = vault(spark, sf_dir, "orders").files
    digit = F.pmod(F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long"), F.lit(10))
    before = files.filter(digit != 5)
    now = files.filter(digit != 3).withColumn("size", F.col("size") + F.when(digit == 7, 1).otherwise(0))
    return diff(now, before)


def _text(spark, text: str) -> DataFrame:
    return spark.createDataFrame([(i, line) for i, line in enumerate(text.split("\n")[:-1])], "line int, text string")


# a double as a note's text shows it
_SHOWN = "regexp_replace(CAST(total AS VARCHAR), '\\.0$', '')"


@query("render_table", f"""
    WITH r AS (SELECT name, {_SHOWN} AS total, placed, row_number() OVER (ORDER BY o.total DESC, {_BY_PATH}) AS i FROM (SELECT * FROM {_O} WHERE o_orderstatus = 'F') o),
    c AS (SELECT 0 AS i, 'Name' AS a, 'Total' AS b, 'Placed' AS c UNION ALL SELECT i, name, total, placed FROM r WHERE i <= 10),
    w AS (SELECT CAST(max(length(a)) AS INTEGER) AS wa, CAST(max(length(b)) AS INTEGER) AS wb, CAST(max(length(c)) AS INTEGER) AS wc FROM c)
    SELECT CAST(CASE WHEN i = 0 THEN 0 ELSE i + 1 END AS INTEGER) AS line, '| ' || rpad(a, wa, ' ') || ' | ' || rpad(b, wb, ' ') || ' | ' || rpad(c, wc, ' ') || ' |' AS text FROM c, w
    UNION ALL SELECT 1, '|' || repeat('-', wa + 2) || '|' || repeat('-', wb + 2) || '|' || repeat('-', wc + 2) || '|' FROM w
""")
def render_table(spark, sf_dir):
    rows = vault(spark, sf_dir, "orders").pages("orders/f/").sort("total", True).limit(10)
    return _text(spark, rows.table(["Name", "Total", "Placed"], ["file.name", "total", "placed"]))


@query("render_list", f"SELECT CAST(row_number() OVER (ORDER BY balance DESC, {_BY_PATH}) - 1 AS INTEGER) AS line, '- ' || name AS text FROM {_C} ORDER BY balance DESC, {_BY_PATH} LIMIT 20")
def render_list(spark, sf_dir):
    return _text(spark, vault(spark, sf_dir, "customers").pages().sort("balance", True).limit(20).list("file.name"))


@query("render_task_list", f"""
    SELECT CAST(row_number() OVER (ORDER BY {_BY_PATH}, l_linenumber, l_partkey, l_suppkey, said) - 1 AS INTEGER) AS line, said AS text
    FROM (SELECT *, CASE WHEN completed THEN '- [x] ' ELSE '- [ ] ' END || text AS said FROM {_T} WHERE o_orderstatus = 'F')
""")
def render_task_list(spark, sf_dir):
    return vault(spark, sf_dir, "orders").tasks("orders/f/").task_lines().select(F.col("line").cast("int"), "text")


@query("render_kinds", f"""
    SELECT CAST(row_number() OVER (ORDER BY {_BY_PATH}) - 1 AS INTEGER) AS line,
           '- ' || CASE p_partkey % 3 WHEN 0 THEN p_size || ', ' || (p_size + 1) WHEN 1 THEN '' ELSE CAST(p_size AS VARCHAR) END AS text FROM {_P}
""")
def render_kinds(spark, sf_dir):
    """Lists, empty lists and numbers as texts."""
    return _text(spark, vault(spark, sf_dir, "parts").pages().list("sizes"))


@query("position_get", f"SELECT path, empty, beyond FROM (SELECT path, false AS empty, true AS beyond, row_number() OVER (ORDER BY balance, {_BY_PATH}) AS i FROM {_C}) WHERE i IN (1, 8)")
def position_get(spark, sf_dir):
    """Rows by their place from 0, and what is out of range."""
    rows = vault(spark, sf_dir, "customers").pages().sort("balance")
    beyond = rows.get(-1) is None and rows.get(rows.count()) is None
    return spark.createDataFrame([(rows.get(i)["path"], rows.is_empty(), beyond) for i in (0, 7)], "path string, empty boolean, beyond boolean")


# ---- links in each of the ways that they resolve

_FROM = "'from/' || (c_custkey % 7) || '/deep/link-' || c_custkey || '.md'"


@query("links_tiers", f"""
    SELECT source, CASE c_custkey % 6 WHEN 3 THEN 'from/near/stem-' || c_custkey || '.md' ELSE path END AS target
    FROM (SELECT *, {_FROM} AS source FROM {_C}) WHERE c_custkey % 6 <= 3
    UNION ALL SELECT 'x/' || source, 'x/' || source FROM (SELECT {_FROM} AS source, c_custkey FROM customer) WHERE c_custkey % 6 = 5
""")
def links_tiers(spark, sf_dir):
    """By a path, by a path without `.md`, by a stem, by the nearer of two notes of a stem; ties, `../` and other files don't resolve; links to oneself do."""
    from notelake.operators.links import edges

    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k, kind = F.col("c_custkey").cast("string"), F.col("c_custkey") % 6
    bare = F.concat(F.lit("customers/"), F.lower("c_mktsegment"), F.lit("/customer-"), k)
    source = F.concat(F.lit("from/"), (F.col("c_custkey") % 7).cast("string"), F.lit("/deep/link-"), k, F.lit(".md"))
    stem = F.concat(F.lit("stem-"), k)
    wanted = F.when(kind == 0, F.concat(bare, F.lit(".md#part"))).when(kind == 1, bare).when(kind == 2, F.concat(F.lit("customer-"), k)).when(kind == 3, stem).when(kind == 4, F.concat(F.lit("tie-"), k)).otherwise(F.concat(F.lit("../customer-"), k))
    link = lambda t: F.array(F.struct(t.alias("target"), t.alias("text"), F.lit("wikilink").alias("kind"), F.lit(False).alias("embedded")))
    note = lambda path, t=None: c.select(path.alias("path"), (F.array().cast("array<struct<target:string,text:string,kind:string,embedded:boolean>>") if t is None else link(t)).alias("outlinks"))
    one, md = lambda folder, name: F.concat(F.lit(folder), name, F.lit(".md")), F.lit(".md")
    notes = note(F.concat(bare, md)).unionByName(note(source, wanted)).unionByName(note(one("from/near/", stem))).unionByName(note(one("a/b/c/", stem)))
    notes = notes.unionByName(note(one("tie/", F.concat(F.lit("tie-"), k)))).unionByName(note(one("eit/", F.concat(F.lit("tie-"), k))))
    own = c.filter(kind == 5).select(F.concat(F.lit("x/"), source).alias("path"), link(F.concat(F.lit("x/"), source)).alias("outlinks"))
    return edges(notes.unionByName(own))


# ---- what the parser reads: fields in brackets, task dates, code, kinds of lists and links


def _written(spark, sf_dir):
    """A vault of notes that use the syntax that the other derived notes don't."""
    from notelake.sources.vault import Vault

    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = F.concat(
        F.lit("Sold [Due Date:: 2024-01-02] and (mood:: good (really)) #seen [bad\nWeight:: "), size, F.lit(" kg\nOdd:: 1.50, true, \"a, b\"\n\n- [ ] open "), k, F.lit(" 🗓️ 2024-05-01 ➕2024-04-01 [prio:: "), size,
        F.lit("]\n  - [x] inner `[no:: 1] #no` ✅ 2024-05-02\n- plain [[part-"), k, F.lit("|Me]] ![[pic.png]] [web](https://x.y/z)\n\n```\n#code Fake:: 1\n```\n\n    #code [[none]] Fake:: 2\n\nend `Fake:: 3` #x/y-"), k, F.lit(", #1 a#b\n"),
    )
    files = p.select(F.concat(F.lit("w/part-"), k, F.lit(".md")).alias("path"), text.alias("content"), F.lit(None).cast("timestamp").alias("created_at"), F.lit("1995-01-01 00:00:00").cast("timestamp").alias("modified_at"))
    return Vault.of_contents(files.withColumn("size", F.octet_length("content").cast("long")))


_W = "(SELECT 'w/part-' || p_partkey || '.md' AS path, p_partkey AS k, p_size AS size FROM part)"


@query("inline_forms", f"SELECT path, '2024-01-02' AS due, 'date' AS due_kind, 'good (really)' AS mood, size || ' kg' AS weight, 'string' AS weight_kind, CAST(size AS DOUBLE) AS prio, CAST(NULL AS VARCHAR) AS fake, 'list' AS odd_kind, ['number', 'bool', 'string'] AS odd FROM {_W}")
def inline_forms(spark, sf_dir):
    rows = _written(spark, sf_dir).pages()
    c = rows.column
    return rows.values("mood").select("path", c("due date")["s"].alias("due"), c("due-date")["kind"].alias("due_kind"), c("mood")["s"].alias("mood"), c("weight")["s"].alias("weight"), c("weight")["kind"].alias("weight_kind"), c("prio")["n"].alias("prio"), c("fake")["s"].alias("fake"), c("odd")["kind"].alias("odd_kind"), F.transform(c("odd")["items"], lambda x: x["kind"]).alias("odd"))


@query("task_dates", f"SELECT path, '2024-05-01' AS due, '2024-04-01' AS created, '2024-05-02' AS done FROM {_W}")
def task_dates(spark, sf_dir):
    rows = _written(spark, sf_dir).pages()
    return rows.values("due").select("path", rows.column("due")["s"].alias("due"), rows.column("created")["s"].alias("created"), rows.column("completion")["s"].alias("done"))


@query("code_excluded", f"SELECT path, ['#seen', '#x/y-' || k] AS tags FROM {_W}")
def code_excluded(spark, sf_dir):
    """Neither code nor glued or numeric look-alikes give tags."""
    return _written(spark, sf_dir).pages().where("fake == null").select(path="file.path", tags="tags")


@query("tasks_nested", f"SELECT path, 0 AS place, false AS completed, 'open ' || k || ' 🗓️ 2024-05-01 ➕2024-04-01 [prio:: ' || size || ']' AS text FROM {_W} UNION ALL SELECT path, 1, true, 'inner [no:: 1] #no ✅ 2024-05-02' FROM {_W}")
def tasks_nested(spark, sf_dir):
    return _written(spark, sf_dir).tasks().select(path="file.path", completed="task.completed", text="task.text").withColumn("place", F.when(F.col("completed"), 1).otherwise(0))


@query("outlink_kinds", f"SELECT path, ['part-' || k, 'https://x.y/z'] AS targets, ['Me', 'web'] AS texts, ['wikilink', 'markdown'] AS kinds FROM {_W}")
def outlink_kinds(spark, sf_dir):
    """Embeds and what is in code aren't links."""
    each = lambda n: F.transform("outlinks", lambda o: o[n])
    return _written(spark, sf_dir).notes.select("path", each("target").alias("targets"), each("text").alias("texts"), each("kind").alias("kinds"))


# ---- classes


@query("schema_fields", """
    SELECT * FROM (VALUES
        ('Record', 'note', 'input', ''), ('Record', 'amount', 'number', 'min'), ('Deal', 'note', 'input', ''), ('Deal', 'amount', 'number', 'min'), ('Deal', 'total', 'number', 'max,min'),
        ('Order', 'note', 'input', ''), ('Order', 'total', 'number', 'max,min'), ('Order', 'placed', 'date', 'format'), ('Order', 'customer', 'file', 'class'), ('Party', 'note', 'input', ''), ('Party', 'amount', 'input', ''),
        ('Customer', 'note', 'input', ''), ('Customer', 'amount', 'input', ''), ('Customer', 'segment', 'select', 'values'), ('Customer', 'notes', 'file', 'ext,folders'), ('Part', 'sizes', 'number', ''), ('global', 'placed', 'date', 'format')
    ) AS t(class, field, type, options)""")
def schema_fields(spark, sf_dir):
    """The fields of each class that could be built: own ones over those of parents, references followed, exclusions gone."""
    from notelake.testing.vault_from_tables import registry

    rows = [(n, f.name, f.type, ",".join(sorted(f.options))) for n, c in registry().classes.items() for f in c.fields.values()]
    return spark.createDataFrame(rows, "class string, field string, type string, options string")


@query("schema_hierarchy", """
    SELECT * FROM (VALUES ('Record', 'Customer,Deal,Party', 'Customer,Deal,Order,Party', ''), ('Deal', 'Order', 'Order', ''), ('Order', '', '', ''), ('Party', 'Customer', 'Customer', ''), ('Customer', '', '', ''), ('Part', '', '', ''), ('global', '', '', ''), ('Broken', '', '', 'failed'))
    AS t(class, children, descendants, state)""")
def schema_hierarchy(spark, sf_dir):
    from notelake.testing.vault_from_tables import registry

    r = registry()
    said = lambda names: ",".join(sorted(names))
    rows = [(n, said(r.children(n)), said(r.descendants(n)), "") for n in r.classes] + [(n, "", "", "failed") for n in r.failed]
    return spark.createDataFrame(rows, "class string, children string, descendants string, state string")


@query("source_file_field", f"SELECT path FROM {_C} UNION ALL SELECT path FROM {_O}")
def source_file_field(spark, sf_dir):
    """What file fields of classes may point to, as sources: of a class, and of folders with an extension."""
    from notelake.testing.vault_from_tables import registry

    v, r = vault(spark, sf_dir, *_FOUR), registry()
    return paths(v.pages(r.get("Order").field("customer").source())).unionByName(paths(v.pages(r.get("Customer").field("notes").source())))


@query("source_depth_changed", f"SELECT path, 1 AS depth FROM {_O} UNION ALL SELECT path, 2 FROM {_O} UNION ALL SELECT path, 2 FROM {_C}")
def source_depth_changed(spark, sf_dir):
    """The depth of a source's classes set afterwards; classes that aren't known match themselves alone."""
    from notelake.plans.source import parse_source, with_depth

    v = vault(spark, sf_dir, "orders", "customers")
    near, far = with_depth(parse_source("@Deal or @Unheard"), "children"), with_depth(parse_source("@Record+"), "descendants")
    return paths(v.pages(near)).withColumn("depth", F.lit(1)).unionByName(paths(v.pages(far)).withColumn("depth", F.lit(2)))


# ---- a directory, its index, and what changed since


@query("index_roundtrip", f"SELECT path, 'kept' AS state, balance FROM {_C} WHERE c_custkey % 10 <> 3 AND c_custkey % 10 <> 7 UNION ALL SELECT path, 'kept', -1.5 FROM {_C} WHERE c_custkey % 10 = 7 UNION ALL SELECT 'fresh/new.md', 'kept', 7 UNION ALL SELECT 'fresh/' || 'other.txt', 'kept', NULL")
def index_roundtrip(spark, sf_dir):
    """A directory is scanned, parsed, persisted and loaded; notes go, change and come, and a refresh reads these alone."""
    import os
    import tempfile

    from notelake.sources import index

    with tempfile.TemporaryDirectory(prefix="notelake-vault-") as root:
        put = lambda path, text: (os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True), open(f"{root}/{path}", "w").write(text))  # noqa: E731, SIM115
        own = vault(spark, sf_dir, "customers").contents.select("path", "content", F.regexp_extract("path", r"(\d+)\.md", 1).cast("long").alias("k")).collect()
        for r in own:
            put(r["path"], r["content"])
        put(".git/config", "no")
        first = index.build(spark, root)
        index.persist(first, f"{root}/.notelake/index")
        for r in own:
            if r["k"] % 10 == 3:
                os.unlink(f"{root}/{r['path']}")
            elif r["k"] % 10 == 7:
                put(r["path"], "---\nbalance: -1.5\n---\nanother size\n")
        put("fresh/new.md", "balance:: 7\n")
        put("fresh/other.txt", "balance:: 8\n")
        rows = index.refresh(spark, root, index.load(spark, f"{root}/.notelake/index")).pages()
        got = rows.values("balance").select("path", F.lit("kept").alias("state"), rows.column("balance")["n"].alias("balance")).collect()
    return spark.createDataFrame(got, "path string, state string, balance double")

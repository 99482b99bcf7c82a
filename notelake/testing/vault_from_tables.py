"""Notes derived from the driver's tables, so that plain SQL over those tables can answer what queries over the notes should."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.schema.registry import Registry
from notelake.sources.vault import Vault

#: The classes of the derived notes: an order is a kind of deal, a deal and a party are records.
CLASSES = {
    "global": {"fields": {"placed": {"type": "date", "format": "%Y-%m-%d", "required": True}}},
    "Record": {"fields": {"note": {"type": "input"}, "amount": {"type": "number", "min": 0}}},
    "Deal": {"extends": ["Record"], "fields": {"total": {"$ref": "#Record/amount", "max": 1000000}}},
    "Order": {"extends": ["Deal"], "excludes": ["amount"], "fields": {"placed": {"$ref": "#global/placed"}, "customer": {"type": "file", "class": "Customer"}}},
    "Party": {"extends": ["Record"], "fields": {"amount": {"type": "input"}}},
    "Customer": {"extends": ["Party", "Record", "Nobody"], "fields": {"segment": {"type": "select", "values": ["BUILDING", "MACHINERY"]}, "notes": {"type": "file", "folders": ["orders/"], "ext": ["md"]}}},
    "Part": {"fields": {"sizes": {"type": "number", "multi": True}}},
    "Broken": {"extends": ["Part"], "fields": {"wrong": {"type": "boolean", "values": ["x"]}}},
}


@functools.cache
def registry() -> Registry:
    return Registry(CLASSES)


def _lines(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str, tasks: bool = True) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    key, low = F.col("o_orderkey").cast("string"), F.lower("o_orderstatus")
    boxes = F.lit("")
    if tasks:
        line = _table(spark, sf_dir, "lineitem")
        box = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat(F.when(F.col("l_linestatus") == "F", "- [x] ").otherwise("- [ ] "), F.lit("ship part "), F.col("l_partkey").cast("string"), F.lit(" line "), F.col("l_linenumber").cast("string")).alias("t"))
        per = line.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(box)), lambda b: b["t"]), "\n").alias("boxes"))
        o = o.join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        boxes = F.coalesce(F.concat(F.lit("\n"), "boxes", F.lit("\n")), F.lit(""))
    total = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    content = _lines("---\nclass: Order\ntotal: ", total, "\nplaced: ", F.date_format("o_orderdate", "yyyy-MM-dd"), "\npriority: ", F.col("o_orderpriority"), "\n---\n#order/", low, "\n\nCustomer:: [[customer-", F.col("o_custkey").cast("string"), "]]\n", boxes)
    return o.select(_lines("orders/", low, "/order-", key, ".md").alias("path"), content.alias("content"), F.lit(None).cast("timestamp").alias("created_at"), F.col("o_orderdate").cast("timestamp").alias("modified_at"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    key, balance = F.col("c_custkey").cast("string"), F.col("c_acctbal").cast("decimal(18,2)").cast("string")
    content = _lines("---\nclass: Customer\nbalance: ", balance, "\nsegment: ", F.col("c_mktsegment"), "\n---\n#customer\n")
    return c.select(_lines("customers/", F.lower("c_mktsegment"), "/customer-", key, ".md").alias("path"), content.alias("content"), F.lit(None).cast("timestamp").alias("created_at"), F.lit("1995-01-01 00:00:00").cast("timestamp").alias("modified_at"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every third part the sizes are a list, of every third an empty one, and else a number."""
    p = _table(spark, sf_dir, "part")
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    sizes = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("["), size, F.lit(", "), (F.col("p_size") + 1).cast("string"), F.lit("]"))).when(F.col("p_partkey") % 3 == 1, "[]").otherwise(size)
    content = _lines("---\nclass: Part\nbrand: ", F.col("p_brand"), "\nsizes: ", sizes, "\nkinds: [a, '#part/", F.lower(F.element_at(F.split("p_type", " "), 1)), "']\nmade: \"[[maker|The maker]]\"\n---\nSize:: ", size, "\n")
    return p.select(_lines("parts/part-", key, ".md").alias("path"), content.alias("content"), F.lit(None).cast("timestamp").alias("created_at"), F.lit("1995-01-01 00:00:00").cast("timestamp").alias("modified_at"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are no notes."""
    d = _table(spark, sf_dir, "documents")
    path = _lines("docs/", F.coalesce("lang", F.lit("none")), "/", F.coalesce("source", F.lit("none")), "/doc-", F.col("doc_id").cast("string"), ".txt")
    return d.select(path.alias("path"), F.col("text").alias("content"), F.lit(None).cast("timestamp").alias("created_at"), F.lit("1995-01-01 00:00:00").cast("timestamp").alias("modified_at"))


KINDS = {"orders": orders, "customers": customers, "parts": parts, "documents": documents}


def vault(spark: SparkSession, sf_dir: str, *kinds: str, tasks: bool = True) -> Vault:
    """The vault of the notes derived from some of the tables; orders have no checkboxes without tasks."""
    files = None
    for k in kinds or tuple(KINDS):
        one = orders(spark, sf_dir, tasks) if k == "orders" else KINDS[k](spark, sf_dir)
        files = one if files is None else files.unionByName(one)
    files = files.withColumn("size", F.octet_length(F.coalesce("content", F.lit(""))).cast("long"))
    return Vault.of_contents(files, registry=registry())

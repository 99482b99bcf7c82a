"""Secret scans over an incremental blob ledger, in DataFrame functions alone.

Each version of a text is addressed by its SHA-256, its blob. The ledger is a table of rows (blob, rule_version, spans): what was found
in a blob under some rules, also when it was nothing. A scan reads only the blobs that the ledger lacks for these rules, each once
however many rows share it; what it finds is appended, and findings are joined back to all rows from the ledger.
The version of the rules is a hash of them, so that changed rules never reuse what others found.

Where the ledger lies is a setting, LEDGER_SETTING; without it a run has a ledger of its own, and reads every blob.

Positions: splitting a text at a rule's matches gives what lies between them, so a running sum over the
lengths of those pieces and of the matches gives each match's place.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_and_text, scratch_root, spread_join, written

#: The folder of a ledger that outlives a run.
LEDGER_SETTING = "spark.notelake.ledger"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The patterns of the base kinds, in the order in which ties are listed, then further ones.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
FURTHER = (
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)
RULES = BASE + FURTHER
RULES_VERSION = hashlib.sha256(repr([astuple(r) for r in RULES]).encode()).hexdigest()[:16]
MARK = "[SECRET]"

#: start and end in code points. In bytes: from first to last is the value, and before is where the values before it end.
_SPAN = "struct<start:bigint,ord:int,kind:string,end:bigint,first:bigint,last:bigint,before:bigint>"
LEDGER = f"blob string, rule_version string, spans array<{_SPAN}>"


def _blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def _blobs(docs: DataFrame) -> DataFrame:
    rows = id_and_text(docs)
    return rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _blob(F.col("text")).alias("blob"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, version: str = RULES_VERSION) -> DataFrame:
    """New ledger rows (blob, rule_version, spans) for the blobs of docs that `ledger` lacks.

    spans is sorted by start and rule, and empty where nothing is found. Null text is the empty blob. An empty table
    gives no rows; repeated rows are one blob.
    """
    return _scan(docs, _blobs(docs).groupBy("blob").agg(F.min("doc_id").alias("doc_id")), ledger, version)


def _scan(docs: DataFrame, todo: DataFrame, ledger: DataFrame | None, version: str) -> DataFrame:
    """`scan` for the blobs of todo (blob, and the least doc_id that has it)."""
    if ledger is not None:
        seen = ledger.filter(F.col("rule_version") == version).select("blob").distinct()
        todo = todo.join(seen, "blob", "left_anti")
    reps = todo.select(F.col("blob").alias("b"), F.col("doc_id").alias("d")).hint("shuffle_hash")
    # one row of a blob: of those with the least id, which is spread as ids are
    texts = _blobs(docs).join(reps, (F.col("blob") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")

    def found(k: int, r: Rule) -> Column:
        hit = F.arrays_zip(
            F.split("text", r.pattern).alias("gap"),
            F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)).alias("match"),
            F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)).alias("held"),
        )
        size = lambda c: F.char_length(c).cast("long")
        weight = lambda c: F.octet_length(c).cast("long")
        one = lambda x: F.struct(F.lit(k).alias("ord"), size(x["gap"]).alias("gap"), size(x["match"]).alias("size"), weight(x["gap"]).alias("gap_b"), weight(x["match"]).alias("size_b"), weight(x["held"]).alias("held_b"), (F.char_length(x["held"]) >= r.least).alias("kept"))
        # the last piece has no match after it
        return F.when(F.col("text").rlike(r.pattern), F.filter(F.transform(F.transform(hit, one), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda y: y["x"]["size"].isNotNull()))

    hits = (
        texts.select("blob", F.array(*[found(k, r) for k, r in enumerate(RULES)]).alias("h"))
        .select("blob", F.explode("h").alias("h"))
        .filter(F.col("h").isNotNull())
        .select("blob", F.explode("h").alias("h"))
        .select("blob", "h.i", "h.x.*")
        .dropDuplicates(["blob", "ord", "i"])  # rows that are the same in doc_id and text
    )
    order = Window.partitionBy("blob", "ord").orderBy("i")
    kinds = F.array(*[F.lit(r.kind) for r in RULES])
    placed = hits.select("blob", "ord", "kept", "size", "held_b", F.sum(F.col("gap") + F.col("size")).over(order).alias("end"), F.sum(F.col("gap_b") + F.col("size_b")).over(order).alias("last"))
    # a value is at the end of its match
    placed = placed.filter("kept").select("blob", "ord", F.get(kinds, F.col("ord")).alias("kind"), (F.col("end") - F.col("size")).alias("start"), "end", (F.col("last") - F.col("held_b")).alias("first"), "last")
    earlier = Window.partitionBy("blob").orderBy("first", "ord", "start").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("before", F.coalesce(F.max("last").over(earlier), F.lit(0).cast("long")))
    spans = placed.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "ord", "kind", "end", "first", "last", "before"))).alias("spans"))
    return todo.select("blob").join(spans, "blob", "left").select("blob", F.lit(version).alias("rule_version"), F.coalesce("spans", F.array().cast(f"array<{_SPAN}>")).alias("spans"))


def ledger_at(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger of a folder; an empty one if nothing is there yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    if there:
        return spark.read.schema(LEDGER).parquet(folder)
    # createDataFrame would start Python workers on the executors, which stay with nothing to do
    return spark.range(0).select(F.from_json(F.lit(None).cast("string"), LEDGER).alias("row")).select("row.*")


def record(docs: DataFrame, folder: str | None = None, version: str = RULES_VERSION) -> tuple[DataFrame, DataFrame]:
    """(ledger, blobs): the ledger of a folder with what it lacked of docs appended, and docs' blobs (blob, doc_id, n) with how many rows have each.

    Without a folder, that of LEDGER_SETTING, or else one of this run. Two runs that append the same blobs do no harm.
    """
    spark = docs.sparkSession
    folder = folder or spark.conf.get(LEDGER_SETTING, None) or f"{scratch_root(spark)}/notelake/ledger-{uuid.uuid4().hex}"
    blobs = written(_blobs(docs).groupBy("blob").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")), "blobs")
    _scan(docs, blobs.select("blob", "doc_id"), ledger_at(spark, folder), version).write.mode("append").parquet(folder)
    return ledger_at(spark, folder).filter(F.col("rule_version") == version), blobs


def _found(rows: DataFrame, known: DataFrame, blobs: DataFrame) -> DataFrame:
    """rows (blob, doc_id and others) with the spans of their blob, null where there are none."""
    some = known.filter(F.size("spans") > 0).dropDuplicates(["blob"]).select("blob", "spans")
    return spread_join(rows, some, "blob", blobs.select("blob", "n"), F.col("doc_id"))


def findings(docs: DataFrame, ledger: DataFrame | None = None, version: str = RULES_VERSION, folder: str | None = None) -> DataFrame:
    """doc_id, blob and spans of every row of docs: what `ledger` has of these rules, else what `record` does.

    A blob that a given ledger lacks is scanned now, and not kept.
    """
    if ledger is None:
        known, blobs = record(docs, folder, version)
    else:
        blobs = _blobs(docs).groupBy("blob").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
        own = ledger.filter(F.col("rule_version") == version).select("blob", "rule_version", "spans")
        known = own.unionByName(_scan(docs, blobs.select("blob", "doc_id"), ledger, version))
    rows = _found(_blobs(docs).select("doc_id", "blob"), known, blobs)
    return rows.select("doc_id", "blob", F.coalesce("spans", F.array().cast(f"array<{_SPAN}>")).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans as kind:start:end."""
    base = F.filter("spans", lambda s: s["ord"] < len(BASE))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["ord"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, folder: str | None = None, version: str = RULES_VERSION) -> DataFrame:
    """docs with every secret of the ledger replaced by MARK, other rows and columns as they are.

    Of `assign` only the value goes; values that overlap are one. n_chars, where there is one, is the new text's length. Null
    texts stay null. Columns of docs of any name stay; only text and n_chars change. An empty table stays empty.
    """
    known, blobs = record(docs, folder, version)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id"), _blob(F.col("text")).alias("blob"))
    found = _found(rows, known, blobs)
    raw = F.encode(F.col("row.text").cast("string"), "UTF-8")
    part = lambda begin, end: F.decode(F.substring(raw, (begin + 1).cast("int"), (end - begin).cast("int")), "UTF-8")
    # in the order of the values, those that begin after all before them have ended
    values = F.array_sort(F.filter("spans", lambda s: s["first"] >= s["before"]), lambda x, y: F.when(x["first"] < y["first"], -1).when(x["first"] > y["first"], 1).otherwise(0))
    pieces = F.concat(F.transform(values, lambda s: part(s["before"], s["first"])), F.array(part(F.array_max(F.transform("spans", lambda s: s["last"])), F.octet_length(raw).cast("long"))))
    found = found.select("row", F.when(F.size("spans") > 0, F.array_join(pieces, MARK)).alias("clean"))
    new = {"text": F.coalesce("clean", F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("clean").isNotNull(), F.char_length("clean")).otherwise(F.col("row.n_chars"))
    return found.select(*[new[f.name].cast(f.dataType).alias(f.name) if f.name in new else F.col("row")[f.name].alias(f.name) for f in docs.schema])

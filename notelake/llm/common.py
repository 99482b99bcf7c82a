"""What the operators share: input columns, scratch tables, Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[object, object]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only these two columns, so other columns of any name can't clash with what an operator adds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where it is unset, a temporary one, which only a local master can share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = jdir.get() if jdir.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="notelake-checkpoint-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def written(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder, read again: cuts the lineage, and outlives any executor."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/notelake/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._notelake_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


def discard(table_: DataFrame) -> None:
    """Remove one table that ``written`` made, once nothing reads it any more."""
    path = getattr(table_, "_notelake_path", None)
    if path:
        _made.remove((table_.sparkSession, path))
        _delete(table_.sparkSession, path)


def clear_scratch() -> None:
    """Remove the tables that ``written`` made; results that still read them become unreadable."""
    while _made:
        _delete(*_made.pop())


atexit.register(clear_scratch)


#: A key is hot if it has at least this share of the rows: there are at most so many of them.
HOT_KEYS = 1000


def spread_join(rows: DataFrame, found: DataFrame, key: str, sizes: DataFrame, spread_by: Column) -> DataFrame:
    """rows left-joined with found, which has a key once, so that no task gets all rows of a hot key.

    sizes (key, n) says how many rows have each key. Hot keys (at most HOT_KEYS, so that their table is small enough to send to every
    task) are split by the hash of spread_by into parts of about a HOT_KEYS-th of all rows, and found's row is repeated for each part.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    part = max(1, total // HOT_KEYS)
    hot = F.broadcast(sizes.filter((F.col("n") > part) & F.col(key).isNotNull()).select(F.col(key).alias("__hot"), F.ceil(F.col("n") / part).cast("int").alias("__parts")))
    split = rows.join(hot, F.col(key) == F.col("__hot"), "left")
    split = split.withColumn("__part", F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread_by), F.col("__parts")))).drop("__hot", "__parts")
    every = found.join(hot, F.col(key) == F.col("__hot"), "left")
    every = every.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), (F.coalesce("__parts", F.lit(1)) - 1).cast("long")))).drop("__hot", "__parts")
    return split.withColumn("__part", F.col("__part").cast("long")).join(every, [key, "__part"], "left").drop("__part")


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each string; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


#: The setting for the size of the Arrow batches that Spark sends to a worker, and the size where the session sets none.
ARROW_SETTING, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """df.mapInArrow with batches of bounded bytes: Spark's own bound is high, and both the JVM and the worker hold a batch whole."""
    conf = df.sparkSession.conf
    if conf.get(ARROW_SETTING, None) is None:
        conf.set(ARROW_SETTING, ARROW_BYTES)
    return df.mapInArrow(run, schema)


def small(parts: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many, so that what is made of a batch in Python takes little memory."""
    for batch in parts:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        _give_back()


def _give_back() -> None:
    """Return free memory to the system: workers wait for other stages with what they hold."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of bounded length."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def arrow_schema(ddl: dict[str, pa.DataType]) -> pa.Schema:
    return pa.schema([pa.field(k, v) for k, v in ddl.items()])

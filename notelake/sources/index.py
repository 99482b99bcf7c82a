"""The persisted index: three tables of one version, and a pointer that is set last.

A version's folder is written in full before CURRENT names it, so that readers see all three tables of one
version or of the one before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.operators.links import edges
from notelake.schema.registry import Registry
from notelake.sources.scan import contents_of, files_of
from notelake.sources.vault import NOTE, Vault, parse_notes

_POINTER = "CURRENT"
#: What makes a file another one than before.
_RECORD = ("created_at", "modified_at", "size")


def build(spark: SparkSession, root: str, class_field: str = "class", registry: Registry | None = None) -> Vault:
    """The vault of a directory, from nothing."""
    files = files_of(spark, root)
    notes = parse_notes(contents_of(files, root), class_field)
    return Vault(files, notes, edges(notes), registry)


def diff(current: DataFrame, before: DataFrame) -> DataFrame:
    """(path, change) of two relations of files: added, removed, changed or same, by all of their record."""
    a = current.select("path", F.struct(*_RECORD).alias("now"))
    b = before.select("path", F.struct(*_RECORD).alias("then"))
    change = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now").eqNullSafe(F.col("then")), "same").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


def refresh(spark: SparkSession, root: str, before: Vault, class_field: str = "class") -> Vault:
    """The vault of a directory now: only added and changed notes are read; nothing is persisted."""
    files = files_of(spark, root)
    changes = diff(files, before.files)
    same = changes.filter("change = 'same'").select("path")
    notes = before.notes.join(same, "path", "left_semi").unionByName(parse_notes(contents_of(files.join(same, "path", "left_anti"), root), class_field))
    moved = changes.filter("change <> 'same'").join(files.unionByName(before.files).filter("format = 'note'").select("path").distinct(), "path", "left_semi")
    links = before.links if moved.isEmpty() else edges(notes)
    return Vault(files, notes, links, before.registry)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def persist(vault: Vault, where: str) -> str:
    """Write the vault's tables as a new version below `where`, and point to it.

    Notes are parsed once: links come from the table just written, unless the vault has them read already. The pointer is replaced in one step
    where the file system can do that, so that a reader finds the old version or the new one.
    """
    spark = vault.files.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    vault.files.write.parquet(f"{where}/{version}/files")
    vault.notes.write.parquet(f"{where}/{version}/notes")
    edges(spark.read.schema(NOTE).parquet(f"{where}/{version}/notes")).write.parquet(f"{where}/{version}/links")
    pointer, fs = _fs(spark, f"{where}/{_POINTER}")
    fresh, _ = _fs(spark, f"{where}/{_POINTER}.{version}")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri() if fresh.toUri().getScheme() else fs.getUri(), hadoop).rename(fs.makeQualified(fresh), fs.makeQualified(pointer), options)
    return version


def load(spark: SparkSession, where: str, registry: Registry | None = None) -> Vault:
    """The version that the pointer names; a table that isn't there, or no index at all, is empty."""
    pointer, fs = _fs(spark, f"{where}/{_POINTER}")
    empty = {"files": "path string, created_at timestamp, modified_at timestamp, size long, path_parts array<string>, name string, folder string, ext string, format string", "notes": NOTE, "links": "target string, source string"}
    version = None
    if fs.exists(pointer):
        handle = fs.open(pointer)
        version = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(handle, "UTF-8")
        handle.close()

    def table(name: str) -> DataFrame:
        if version is not None and fs.exists(_fs(spark, f"{where}/{version}/{name}")[0]):
            return spark.read.parquet(f"{where}/{version}/{name}")
        return spark.createDataFrame([], empty[name])

    return Vault(table("files"), table("notes"), table("links"), registry)

"""A vault: the relations of files, notes and links, and the page and task relations over them.

Where notes aren't parsed yet, a query parses only those of the files that it keeps by their paths, names, sizes and dates, and
only the parts that it reads; a query over files alone parses nothing. `cached` parses each note once for several queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelake.operators.links import edges, inlinks
from notelake.operators.recordset import RecordSet
from notelake.plans.source import parse_source, source_steps, with_classes
from notelake.plans.steps import PARTS, Step, needed, run, split
from notelake.sources.scan import with_names
from notelake.values import FIELD, LINK

ITEM = T.StructType([
    T.StructField("ord", T.IntegerType()), T.StructField("parent_ord", T.IntegerType()), T.StructField("list_ord", T.IntegerType()), T.StructField("ordered", T.BooleanType()),
    T.StructField("text", T.StringType()), T.StructField("task_status", T.StringType()), T.StructField("fields", T.ArrayType(FIELD)),
])
TASK = T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("completed", T.BooleanType()), T.StructField("text", T.StringType())])
NOTE = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("has_frontmatter", T.BooleanType()), T.StructField("fields", T.ArrayType(FIELD)), T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("class_values", T.ArrayType(T.StringType())), T.StructField("outlinks", T.ArrayType(LINK)), T.StructField("tasks", T.ArrayType(TASK)), T.StructField("items", T.ArrayType(ITEM)),
])


#: Bytes of stored data that a task parses, where a scan gives fewer tasks than the cluster has cores.
PARSE_BYTES = 8 << 20
#: Bytes of stored data that a task of a scan reads, Spark's default.
SCAN_BYTES = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out over all cores where its scans are too small to be read by as many tasks; large scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(float(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return df if size >= cores * SCAN_BYTES else df.repartition(max(cores, -(-int(size) // PARSE_BYTES)))


def parsed(contents: DataFrame, parts: Iterable[str], class_field: str = "class") -> DataFrame:
    """contents (path, content and others) with parts of notes in place of content; of a null content all are null.

    The one step that runs Python on the executors, in Arrow batches.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    from notelake.sources.markdown import as_row, parse

    kept, parts = [f for f in contents.schema if f.name != "content"], tuple(parts)
    made = T.StructType([NOTE[p] for p in parts])
    made_arrow, names = to_arrow_schema(made), [f.name for f in kept]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                rows = [as_row(parse(t, parts), class_field, parts) if t is not None else {} for t in batch.column("content").to_pylist()]
                new = [pa.array([r.get(f.name) for r in rows], f.type) for f in made_arrow]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *new], names=[*names, *made_arrow.names])

    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in kept])
    return spread(contents).mapInArrow(go, T.StructType([*nullable.fields, *made.fields]))


def parse_notes(contents: DataFrame, class_field: str = "class", parts: Iterable[str] = (*PARTS, "items")) -> DataFrame:
    """notes of (path, content); a null content is an empty note."""
    return parsed(contents.select("path", F.coalesce(F.col("content").cast("string"), F.lit("")).alias("content")), parts, class_field)


class Vault:
    """files, notes and links (target, source), and the registry of file classes if there is one.

    contents, if given, are the files with their content, null for other files than notes: then each query parses the notes
    that it needs. notes and links may be functions that make them when they are first asked for.
    """

    def __init__(self, files: DataFrame, notes: DataFrame | Callable[[], DataFrame], links: DataFrame | Callable[[], DataFrame], registry=None, contents: DataFrame | None = None, class_field: str = "class"):
        self.files, self.registry, self.contents, self.class_field = files, registry, contents, class_field
        self._notes, self._links = notes, links

    @property
    def notes(self) -> DataFrame:
        if callable(self._notes):
            self._notes = self._notes()
        return self._notes

    @property
    def links(self) -> DataFrame:
        if callable(self._links):
            self._links = self._links()
        return self._links

    @staticmethod
    def of_contents(files: DataFrame, class_field: str = "class", registry=None) -> Vault:
        """The vault of a relation (path, content, created_at, modified_at, size)."""
        return Vault.unread(with_names(files).drop("content"), with_names(files), class_field, registry)

    @staticmethod
    def unread(files: DataFrame, contents: DataFrame, class_field: str = "class", registry=None) -> Vault:
        """The vault of files and of the same with their content, which is parsed by what asks for it."""
        own = contents.filter("format = 'note'").select("path", "content")
        contents = contents.withColumn("content", F.when(F.col("format") == "note", F.coalesce(F.col("content").cast("string"), F.lit(""))))
        paths = files.filter("format = 'note'").select("path")
        return Vault(files, lambda: parse_notes(own, class_field), lambda: edges(parse_notes(own, class_field, ["outlinks"]), paths), registry, contents, class_field)

    def cached(self) -> Vault:
        """The same vault with notes and links kept by the executors until `release`: several queries parse each note once."""
        notes = self.notes.persist()
        return Vault(self.files, notes, edges(notes).persist(), self.registry, None, self.class_field)

    def release(self) -> None:
        self.notes.unpersist()
        self.links.unpersist()

    def _build(self, steps: tuple[Step, ...], parts: frozenset[str], tasks: bool, inlinks_too: bool) -> DataFrame:
        before, after = split(steps)
        parts = parts | needed(after) | (frozenset(["tasks"]) if tasks else frozenset())
        some = [p for p in PARTS if p in parts]
        if self.contents is not None:
            rows = run(self.contents if some else self.contents.drop("content"), before)
            rows = parsed(rows, some, self.class_field) if some else rows
        else:
            rows = run(self.files, before)
            rows = rows.join(self.notes.select("path", *some), "path", "left") if some else rows
        if "inlinks" in parts:
            # links come from all notes, also from those that the source leaves out
            rows = rows.join(inlinks(self.links), "path", "left") if inlinks_too else rows.withColumn("inlinks", F.lit(None).cast("array<string>"))
        return run(rows if tasks else rows.withColumn("task", F.lit(None).cast(TASK)), after)

    def _records(self, source, level: str, ordering: tuple[str, ...], steps: tuple[Step, ...], inlinks_too: bool) -> RecordSet:
        expr = parse_source(source) if source is None or isinstance(source, str) else source
        chosen = source_steps(with_classes(expr, self.registry))
        return RecordSet(lambda s, parts: self._build(s, parts, level == "task", inlinks_too), tuple((o, False) for o in ordering), level, steps=(*chosen, *steps))

    def pages(self, source=None, inlinks: bool = True) -> RecordSet:
        """A row for each file that the source selects, in path order. Without inlinks, that list is empty."""
        return self._records(source, "page", ("path_parts",), (), inlinks)

    def tasks(self, source=None, inlinks: bool = True) -> RecordSet:
        """A row for each task of the notes that the source selects, in order of path and place."""
        each = Step(frozenset(["tasks"]), lambda df: df.select("*", F.posexplode("tasks").alias("__task", "task")))
        return self._records(source, "task", ("path_parts", "__task"), (each,), inlinks)

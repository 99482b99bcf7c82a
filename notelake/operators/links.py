"""Link resolution and the inbound-link graph.

A target's path part is tried as a note's path, then with `.md` if it has no extension, then, without a
slash, as the stem of the one note in the nearest folder; a tie for nearest resolves to nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def _above(folder: Column) -> Column:
    """A folder and all above it, each with the steps up to it; the root is the empty name."""
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, F.size(parts) - k), "/").alias("top"), k.alias("steps")))


def nearest_notes(names: DataFrame, paths: DataFrame) -> DataFrame:
    """(folder, stem, note) for those of names (folder, stem) with one note (of paths) of that stem in the nearest folder.

    The distance is the steps up from a folder and down to the note's. For each folder above a note, the notes
    of the stem at the fewest steps below it are summed up first, so that neither many notes of one stem nor many links to it
    meet each other; notes at the least distance are met at the folder where the two ways part, and nowhere else as near.
    """
    own = paths.select(F.col("path").alias("note"), _stem(F.regexp_extract("path", r"([^/]*)$", 1)).alias("stem"), F.explode(_above(_folder(F.col("path")))).alias("a"))
    # of a folder's notes the nearest, and how many are as near: summed up by steps first
    ties = own.groupBy("stem", F.col("a.top").alias("top"), F.col("a.steps").alias("down")).agg(F.count(F.lit(1)).alias("n"), F.min("note").alias("note"))
    below = ties.groupBy("stem", "top").agg(F.min(F.struct("down", "n", "note")).alias("best"))
    asked = names.select("folder", "stem", F.explode(_above(F.col("folder"))).alias("a")).select("folder", "stem", "a.top", "a.steps")
    met = asked.join(below, ["stem", "top"]).select("folder", "stem", (F.col("steps") + F.col("best.down")).alias("d"), "best.n", "best.note")
    by_distance = met.groupBy("folder", "stem", "d").agg(F.sum("n").alias("n"), F.min("note").alias("note"))
    return by_distance.groupBy("folder", "stem").agg(F.min(F.struct("d", "n", "note")).alias("best")).filter("best.n = 1").select("folder", "stem", "best.note")


def edges(notes: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Distinct (target, source) of the links of notes (path, outlinks) that resolve to a note; paths (path) are those of all notes."""
    paths = (notes if paths is None else paths).select("path")
    raw = notes.select(F.col("path").alias("source"), F.explode("outlinks").alias("o")).select("source", F.trim(F.element_at(F.split("o.target", "#", 2), 1)).alias("wanted"))
    raw = raw.filter("wanted != ''").distinct()
    dotless = ~F.regexp_extract("wanted", r"([^/]*)$", 1).rlike(r"(?<=.)\.[^.]*$")
    # what each link may mean, the first of these that there is counts
    stem = F.when(F.instr("wanted", "/") == 0, _stem(F.col("wanted")))
    links = raw.select("source", "wanted", F.when(dotless, F.concat("wanted", F.lit(".md"))).alias("with_md"), stem.alias("stem"), _folder(F.col("source")).alias("folder"))
    near = nearest_notes(links.filter("stem is not null").select("folder", "stem").distinct(), paths).withColumnRenamed("note", "near")
    links = links.join(paths.select(F.col("path").alias("exact")), F.col("wanted") == F.col("exact"), "left")
    links = links.join(paths.select(F.col("path").alias("second")), F.col("with_md") == F.col("second"), "left")
    links = links.join(near, ["folder", "stem"], "left")
    return links.select(F.coalesce("exact", "second", "near").alias("target"), "source").filter("target is not null").distinct()


def inlinks(links: DataFrame) -> DataFrame:
    """(path, inlinks): for each target its sources in path order."""
    order = F.array_sort(F.collect_set(F.struct(F.split("source", "/").alias("parts"), "source")))
    return links.groupBy(F.col("target").alias("path")).agg(F.transform(order, lambda s: s["source"]).alias("inlinks"))

"""An extension: notes parsed from a stream of files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.sources.vault import parse_notes


def note_stream(spark: SparkSession, folder: str, class_field: str = "class", pattern: str = "*.md") -> DataFrame:
    """The notes relation as a stream over a folder; each new file is a row once."""
    raw = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^.*?" + "\\Q" + folder.rstrip("/") + "/\\E", "")
    return parse_notes(raw.select(path.alias("path"), F.col("value").alias("content")), class_field)

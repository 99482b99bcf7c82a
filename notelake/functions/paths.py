"""Path functions on columns; separators are slashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _trimmed(p: Column) -> Column:
    return F.regexp_replace(p, r"(?<=.)/+$", "")


def path_filename(p: Column) -> Column:
    return F.regexp_extract(_trimmed(p), r"([^/]*)$", 1)


def path_basename(p: Column) -> Column:
    return F.regexp_replace(path_filename(p), r"(?<=.)\.[^.]*$", "")


def path_extension(p: Column) -> Column:
    return F.regexp_extract(path_filename(p), r".\.([^.]*)$", 1)


def path_parent(p: Column) -> Column:
    return F.regexp_replace(_trimmed(p), r"/?[^/]*$", "")


def is_file_path(paths: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of paths (path) that are files of a vault."""
    return paths.join(files.select("path").distinct(), "path", "left_semi")


def is_dir_path(paths: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of paths (path) that are folders of a vault."""
    parts = F.split("path", "/")
    folders = files.filter(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("path"))
    return paths.join(folders.distinct(), "path", "left_semi")


def path_exists(paths: DataFrame, files: DataFrame) -> DataFrame:
    return is_file_path(paths, files).unionByName(is_dir_path(paths, files))

"""Files of a directory tree as rows, dot-files included."""

from __future__ import annotations

import datetime as dt
import hashlib
import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILES_DDL = "path string, created_at timestamp, modified_at timestamp, size long"
#: Of the index itself, which isn't part of the vault; relative to the root.
INDEX_DIR = ".notelake/index"


def walk(root: str) -> Iterator[tuple[str, dt.datetime | None, dt.datetime, int]]:
    """Regular files below root but for `.git` and the index, ordered by path components; links aren't followed."""
    found = []
    for folder, names, files in os.walk(root, onerror=_raise):
        here = os.path.relpath(folder, root)
        names[:] = [n for n in names if n != ".git" and os.path.normpath(f"{here}/{n}") != INDEX_DIR]
        for name in files:
            full = os.path.join(folder, name)
            if os.path.islink(full) or not os.path.isfile(full):
                continue
            st = os.stat(full)
            born = getattr(st, "st_birthtime", None)
            at = lambda s: dt.datetime.fromtimestamp(s, dt.timezone.utc)
            found.append((os.path.relpath(full, root).replace(os.sep, "/"), at(born) if born else None, at(st.st_mtime), st.st_size))
    return iter(sorted(found, key=lambda f: f[0].split("/")))


def _raise(e: OSError):
    raise e


def files_of(spark: SparkSession, root: str) -> DataFrame:
    return with_names(spark.createDataFrame(list(walk(root)), FILES_DDL))


def contents_of(files: DataFrame, root: str) -> DataFrame:
    """path and content of the notes among files, read on the executors; each must be UTF-8."""
    import pandas as pd

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = []
            for p in part["path"]:
                with open(os.path.join(root, p), encoding="utf-8", newline="") as f:
                    texts.append(f.read())
            yield pd.DataFrame({"path": part["path"], "content": texts})

    return files.filter("format = 'note'").select("path").mapInPandas(read, "path string, content string")


def with_names(files: DataFrame) -> DataFrame:
    """files (path, ...) with path_parts, name (the stem), folder, ext and format."""
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    ext = F.regexp_extract(base, r".\.([^.]*)$", 1)
    return files.withColumns({
        "path_parts": F.split("path", "/"), "name": stem(base), "folder": F.regexp_replace("path", r"/?[^/]*$", ""), "ext": ext,
        "format": F.when(F.lower(ext).isin("md", "markdown"), "note").otherwise("other"),
    })


def stem(filename: Column) -> Column:
    """Without the last extension; a dot-file keeps its name."""
    return F.regexp_replace(filename, r"(?<=.)\.[^.]*$", "")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def path_hash(path: str) -> str:
    return hashlib.sha256(path.encode()).hexdigest()


def include(root: str, path: str) -> str:
    """The text of a file below root."""
    full, top = os.path.realpath(os.path.join(root, path)), os.path.realpath(root)
    if full != top and not full.startswith(top + os.sep):
        raise ValueError(f"{path} is outside of {root}")
    with open(full, encoding="utf-8") as f:
        return f.read()

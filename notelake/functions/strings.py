"""String functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _words(v: Column) -> Column:
    """Words between spaces, `_` and `-`, and where case changes: aB, ABc."""
    v = F.regexp_replace(v, r"(\p{Ll})(\p{Lu})", "$1 $2")
    v = F.regexp_replace(v, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return F.filter(F.split(v, r"[ _-]+"), lambda w: w != "")


def _capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 2**31 - 1)))


def snake_case(v: Column) -> Column:
    return F.array_join(F.transform(_words(v), F.lower), "_")


def kebab_case(v: Column) -> Column:
    return F.array_join(F.transform(_words(v), F.lower), "-")


def camel_case(v: Column) -> Column:
    return F.array_join(F.transform(_words(v), lambda w, i: F.when(i == 0, F.lower(w)).otherwise(_capital(w))), "")


def pascal_case(v: Column) -> Column:
    return F.array_join(F.transform(_words(v), _capital), "")


def title_case(v: Column) -> Column:
    return F.array_join(F.transform(_words(v), _capital), " ")


def trim_prefix(v: Column, prefix: str) -> Column:
    return F.when(v.startswith(prefix), F.substring(v, len(prefix) + 1, 2**31 - 1)).otherwise(v)


def trim_suffix(v: Column, suffix: str) -> Column:
    return F.when(v.endswith(suffix), F.left(v, F.char_length(v) - len(suffix))).otherwise(v)


def truncate(v: Column, n: int, ellipsis: str = "...") -> Column:
    """At most n characters, the ellipsis among them."""
    cut = F.lit(ellipsis[:n]) if len(ellipsis) >= n else F.concat(F.left(v, F.lit(n - len(ellipsis))), F.lit(ellipsis))
    return F.when(F.char_length(v) <= n, v).otherwise(cut)


def truncate_words(v: Column, n: int, ellipsis: str = "...") -> Column:
    words = F.filter(F.split(v, r"\s+"), lambda w: w != "")
    cut = F.lit(ellipsis) if n == 0 else F.concat(F.array_join(F.slice(words, 1, n), " "), F.lit(" " + ellipsis))
    return F.when(F.size(words) <= n, v).otherwise(cut)


def word_count(v: Column) -> Column:
    return F.size(F.filter(F.split(v, r"\s+"), lambda w: w != "")).cast("long")


def repeat(v: Column, n: int) -> Column:
    return F.repeat(v, n)


def regex_replace(v: Column, pattern: str, replacement: str) -> Column:
    """Java's dialect: `$1` is a group in the replacement."""
    return F.regexp_replace(v, pattern, replacement)


def regex_match(v: Column, pattern: str) -> Column:
    return v.rlike(pattern)

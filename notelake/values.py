"""The value model: one dynamic value per cell, as a struct with a kind.

Kinds: null, bool, number, string, date, duration, link, list, object. A list's elements are
scalars; what is nested deeper is kept as JSON text. Fields are an array, since their keys
repeat and their order matters.
"""

from __future__ import annotations

import functools
import json
import math
import re

from pyspark.sql import types as T

LINK = T.StructType([T.StructField("target", T.StringType()), T.StructField("text", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("embedded", T.BooleanType())])
_SCALAR_FIELDS = [T.StructField("kind", T.StringType()), T.StructField("b", T.BooleanType()), T.StructField("n", T.DoubleType()), T.StructField("s", T.StringType()), T.StructField("link", LINK), T.StructField("json", T.StringType())]
SCALAR = T.StructType(_SCALAR_FIELDS)
VALUE = T.StructType([*_SCALAR_FIELDS, T.StructField("items", T.ArrayType(SCALAR))])
FIELD = T.StructType([T.StructField("name", T.StringType()), T.StructField("canonical", T.StringType()), T.StructField("origin", T.StringType()), T.StructField("value", VALUE)])

#: Kinds whose payload is text in `s`.
TEXT_KINDS = ("string", "date", "duration")


@functools.lru_cache(4096)
def canonical_key(name: str) -> str:
    """The form by which keys are compared; empty if nothing is left of the name.

    ASCII white space becomes `-`; ASCII letters are lower-cased; `_`, `-`, digits and everything
    that isn't ASCII stay (lower-cased); other punctuation goes.
    """
    out = []
    for c in name:
        if c in " \t\n\r\x0c":
            out.append("-")
        elif c in "_-" or not c.isascii() or c.isalnum():
            out.append(c.lower())
    return "".join(out)


def value(kind: str, payload=None) -> dict:
    """A value of a kind, as a row of VALUE."""
    v = {"kind": kind, "b": None, "n": None, "s": None, "link": None, "json": None, "items": None}
    slot = {"bool": "b", "number": "n", "link": "link", "list": "items", "object": "json", "null": None}.get(kind, "s")
    if slot == "items":
        v["items"] = [scalar(x) for x in payload]
    elif slot == "json":
        v["json"] = json.dumps(payload, ensure_ascii=False)
    elif slot:
        v[slot] = payload
    return v


def scalar(v: dict) -> dict:
    """A value as an element of a list: a nested list becomes JSON text."""
    s = {k: v[k] for k in ("kind", "b", "n", "s", "link", "json")}
    if v["kind"] == "list":
        s["json"] = json.dumps([plain(x) for x in v["items"]], ensure_ascii=False)
    return s


def plain(v: dict):
    """A value as plain JSON-able Python."""
    kind = v["kind"]
    if kind == "bool":
        return v["b"]
    if kind == "number":
        return v["n"]
    if kind in TEXT_KINDS:
        return v["s"]
    if kind == "link":
        return v["link"]["target"]
    if kind == "list":
        return [plain(x) for x in v["items"]] if v.get("items") is not None else json.loads(v["json"] or "[]")
    if kind == "object":
        return json.loads(v["json"])
    return None


def number_text(n: float) -> str:
    """The shortest decimal digits that give n back, without an exponent and without `.0`."""
    if math.isnan(n):
        return "NaN"
    if math.isinf(n):
        return "inf" if n > 0 else "-inf"
    text = repr(float(n))
    m = re.fullmatch(r"(-?)(\d+)(?:\.(\d+))?(?:e([+-]\d+))?", text)
    sign, whole, part, shift = m[1], m[2], m[3] or "", int(m[4] or 0)
    if shift >= 0:
        part = part.ljust(shift, "0")
        whole, part = whole + part[:shift], part[shift:]
    else:
        whole = whole.rjust(-shift + 1, "0")
        whole, part = whole[:shift], whole[shift:] + part
    whole, part = whole.lstrip("0") or "0", part.rstrip("0")
    return sign + whole + ("." + part if part else "")


def value_text(v) -> str:
    """How a value is shown: null as nothing, links as their target, lists and objects joined by commas."""
    if v is None:
        return ""
    kind = v["kind"]
    if kind == "bool":
        return "true" if v["b"] else "false"
    if kind == "number":
        return number_text(v["n"])
    if kind in TEXT_KINDS:
        return v["s"]
    if kind == "link":
        return v["link"]["target"]
    if kind == "list" and "items" in _names(v) and v["items"] is not None:
        return ", ".join(value_text(x) for x in v["items"])
    if kind in ("list", "object"):
        return _json_text(json.loads(v["json"] or "null"))
    return ""


def _names(v) -> list[str]:
    return list(v) if isinstance(v, dict) else v.__fields__


def _json_text(x) -> str:
    if x is None:
        return ""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, int | float):
        return number_text(float(x))
    if isinstance(x, list):
        return ", ".join(map(_json_text, x))
    if isinstance(x, dict):
        return ", ".join(f"{k}: {_json_text(y)}" for k, y in x.items())
    return str(x)

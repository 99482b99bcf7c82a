"""The lowering of filters to columns against a row-at-a-time interpreter, over every kind of value."""

from __future__ import annotations

import math
import random

from pyspark.sql import types as T

from notelake.plans.field import order_keys, parse_path, resolve
from notelake.plans.filter import Contains, compile_filter, parse_filter
from notelake.values import FIELD, TEXT_KINDS, value

VALUES = [
    value("number", 7.0), value("number", 3.0), value("number", float("nan")), value("number", -0.0), value("number", 0.0), value("number", float("inf")), value("string", "7"), value("string", "abc"),
    value("date", "2024-01-02"), value("duration", "1h"), value("bool", True), value("bool", False), value("null"), None, value("list", [value("number", 7.0), value("string", "#book/x")]), value("list", []),
    value("list", [value("null"), value("number", float("nan"))]), value("link", {"target": "abc", "text": "abc", "kind": "wikilink", "embedded": False}), value("object", {"a": 1.0}),
]
LITERALS = ["7", "0", "3.5", '"7"', '"abc"', '"2024-01-02"', '"#book"', '"b"', '""', "true", "false", "null"]


def order(v, literal):
    """-1, 0 or 1, or None where a value can't be compared with a literal."""
    if v is None or literal is None:
        return None
    if isinstance(literal, bool):
        x = v["b"] if v["kind"] == "bool" else None
    elif isinstance(literal, float):
        x = v["n"] if v["kind"] == "number" and not math.isnan(v["n"]) else None
    else:
        x = v["s"] if v["kind"] in TEXT_KINDS else None
    return None if x is None else (x > literal) - (x < literal)


def equal(v, literal):
    if literal is None:
        return v is None or v["kind"] == "null"
    return order(v, literal) == 0


def holds(v, atom):
    if isinstance(atom, Contains):
        if v is not None and v["kind"] == "list":
            nested = lambda i: isinstance(atom.literal, str) and atom.literal.startswith("#") and (i["s"] or "").startswith(atom.literal + "/")
            return any(equal(i, atom.literal) or nested(i) for i in v["items"])
        return v is not None and v["kind"] in TEXT_KINDS and isinstance(atom.literal, str) and atom.literal in v["s"]
    if atom.op in ("==", "!="):
        return equal(v, atom.literal) == (atom.op == "==")
    o = order(v, atom.literal)
    return o is not None and {"<": o < 0, "<=": o <= 0, ">": o > 0, ">=": o >= 0}[atom.op]


def interpret(v, e):
    if e.op == "atom":
        return holds(v, e.atom)
    parts = [interpret(v, p) for p in e.parts]
    return not parts[0] if e.op == "not" else all(parts) if e.op == "and" else any(parts)


def frame(spark):
    rows = [(i, [] if v is None else [{"name": "x", "canonical": "x", "origin": "frontmatter", "value": v}]) for i, v in enumerate(VALUES)]
    return spark.createDataFrame(rows, T.StructType([T.StructField("i", T.IntegerType()), T.StructField("fields", T.ArrayType(FIELD))])).coalesce(1)


def test_filters(spark):
    rng = random.Random(8)
    texts = [f"x {op} {lit}" for op in ("==", "!=", "<", "<=", ">", ">=") for lit in LITERALS] + [f"contains(x, {lit})" for lit in LITERALS]
    for _ in range(40):
        a, b, c = (rng.choice(texts) for _ in range(3))
        texts.append(rng.choice(["not ({a}) and {b}", "{a} or {b} and not {c}", "not not {a} || ({b} && {c})"]).format(a=a, b=b, c=c))
    exprs = [parse_filter(t) for t in texts]
    got = frame(spark).select("i", *[compile_filter(e, {}).alias(f"c{k}") for k, e in enumerate(exprs)]).collect()
    for r in got:
        for k, e in enumerate(exprs):
            assert r[f"c{k}"] is interpret(VALUES[r["i"]], e), (texts[k], VALUES[r["i"]])


def test_order(spark):
    keys = order_keys(resolve(parse_path("x"), {}))
    up = [r["i"] for r in frame(spark).orderBy(*[k.asc_nulls_first() for k in keys], "i").collect()]
    down = [r["i"] for r in frame(spark).orderBy(*[k.desc_nulls_last() for k in keys], "i").collect()]
    assert up == [12, 13, 11, 10, 3, 4, 1, 0, 5, 2, 9, 8, 6, 7, 14, 15, 16, 17, 18]
    assert down == [14, 15, 16, 17, 18, 7, 6, 8, 9, 2, 5, 0, 1, 4, 3, 10, 11, 12, 13]

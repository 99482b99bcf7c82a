"""The two expression languages, the inline lexer, the markdown parser and the schema registry, without Spark."""

from __future__ import annotations

import pytest

from notelake.errors import FieldPathError, QuerySyntaxError, SchemaError
from notelake.operators.recordset import cell_text, markdown_table
from notelake.plans.field import parse_path
from notelake.plans.filter import Compare, Contains, parse_filter
from notelake.plans.source import ClassIs, Glob, Tag, parse_source, with_classes
from notelake.schema.registry import Registry
from notelake.sources import inline
from notelake.sources.markdown import as_row, parse
from notelake.sources.yaml_values import frontmatter
from notelake.values import canonical_key, number_text, value_text


def atoms(text):
    return list(parse_source(text).atoms())


def test_sources():
    assert parse_source(" ") is None and parse_source(None) is None
    assert atoms("#projects/active") == [Tag("#projects/active")]
    assert atoms('"books/dune.md"') == [Glob("books/dune.md")] and atoms("books/") == [Glob("books/**")]
    assert atoms("@Book+ or class(Book, descendants) or class('A b').with_children() or @C") == [ClassIs("Book", "children"), ClassIs("Book", "descendants"), ClassIs("A b", "children"), ClassIs("C")]
    e = parse_source("#a or b/ and not @C")
    assert e.op == "or" and e.parts[1].op == "and" and e.parts[1].parts[1].op == "not"
    assert parse_source("NOT not #a && #b || order/").op == "or"
    assert atoms("order/x and andrew.md") == [Glob("order/x"), Glob("andrew.md")]


@pytest.mark.parametrize("text", ["#a and", "(#a", "#a #b", '"x', "'x", "class()", "class(B, all)", "class(B, children).with_descendants()", "class(B).with_children() x", "@", "and"])
def test_wrong_sources(text):
    with pytest.raises(QuerySyntaxError):
        parse_source(text)


def test_filters():
    e = parse_filter('rating >= 7 and not (status == "do\\"ne" or CONTAINS(tags, "#x")) || done != null')
    assert e.op == "or"
    got = list(e.atoms())
    assert [type(a) for a in got] == [Compare, Compare, Contains, Compare]
    assert got[0].literal == 7.0 and got[1].literal == 'do"ne' and got[3].literal is None
    assert [a.literal for a in parse_filter("a == true and b == false and order > -1.5e2").atoms()] == [True, False, -150.0]


@pytest.mark.parametrize("text", ["", "rating", "rating >", "rating = 7", "rating > x", "7 > rating", "has(tags, 1)", "contains(tags)", "a == 'x'", "a == inf", "a == NaN", "(a == 1", "a == 1 b == 2"])
def test_wrong_filters(text):
    with pytest.raises(QuerySyntaxError):
        parse_filter(text)


def test_field_paths():
    assert parse_path(" file.name ").key == "file.name" and parse_path("Due Date").name == "due-date" and parse_path("Tags").space == "meta" and parse_path("tags").space == "list"
    for bad in ("", "file", "task", "a.b", "file.", "file.x.y", "!!"):
        with pytest.raises(FieldPathError):
            parse_path(bad)
    with pytest.raises(FieldPathError) as e:
        parse_path("file.nmae")
    assert e.value.suggestion == "file.name"


def test_values():
    assert [canonical_key(k) for k in ("Due Date", "A_b-C!", "Été", "(x)", "!!")] == ["due-date", "a_b-c", "été", "x", ""]
    assert [number_text(n) for n in (5.0, -0.5, 1e21, 1.5e-7, 123456789.25)] == ["5", "-0.5", "1000000000000000000000", "0.00000015", "123456789.25"]
    kinds = lambda t: (inline.typed(t)["kind"], value_text(inline.typed(t)))
    assert kinds("") == ("null", "") and kinds("TRUE") == ("bool", "true") and kinds("1e3") == ("number", "1000") and kinds("NaN") == ("string", "NaN")
    assert kinds("2024-01-02") == ("date", "2024-01-02") and kinds("2024-01-02 x")[0] == "string" and kinds("1h 30m") == ("duration", "1h 30m")
    assert kinds("[[A|b]]") == ("link", "A") and kinds('"x, y", 3,') == ("list", "x, y, 3") and kinds("a, b") == ("string", "a, b") and kinds('"q\\"q"') == ("string", 'q"q')


def test_inline_fields_and_tags():
    names = lambda t, task=False: [(k, value_text(v)) for k, v in inline.fields(t, task)]
    assert names("Key:: v [x:: 1]") == [("Key", "v [x:: 1]")]
    assert names("see [Due Date:: 2024-01-01] and (mood:: good (really)) [bad] (a[b:: c)") == [("Due Date", "2024-01-01"), ("mood", "good (really)")]
    assert names("do 🗓️ 2024-05-01 ✅2024-05-02 ➕ soon", True) == [("due", "2024-05-01"), ("completion", "2024-05-02")]
    assert names("do 🗓 2024-05-01") == []
    assert inline.tags("#a, (#b/c) x#no #1 #é-x_y ##d") == ["#a", "#b/c", "#é-x_y", "#d"]


def test_frontmatter():
    got = dict(frontmatter("a: yes\nb: 010\nc: 1.5\nd: 2024-01-02\ne: [x, 1, null]\nf: {k: 1}\ng: ''\nh: '[[N|n]]'\nA: later\n"))
    assert {k: v["kind"] for k, v in got.items()} == {"a": "string", "b": "number", "c": "number", "d": "date", "e": "list", "f": "object", "g": "null", "h": "link"}
    assert got["a"]["s"] == "later" and value_text(got["f"]) == "k: 1" and value_text(got["e"]) == "x, 1, "
    assert frontmatter(" \n") is None and frontmatter("- a") == [] and frontmatter("a: [") == [] and frontmatter("a: 1\na: 2") == []


NOTE = """---
class: [Book, Thing]
rating: 9
---
# Head #h
See [[Target|alias]] and [a #l](b/c.md#x) ![i](p.png) `#no [k:: v]`

- [ ] open #t
  - [x] done `code` [[z]]
- plain

```
#code Key:: v
```

    #indented

> Note:: quoted
"""


def test_markdown():
    row = as_row(parse(NOTE))
    assert row["class_values"] == ["Book", "Thing"] and row["tags"] == ["#h", "#l", "#t"]
    assert [(o["target"], o["text"], o["kind"]) for o in row["outlinks"]] == [("Target", "alias", "wikilink"), ("b/c.md#x", "a #l", "markdown"), ("z", "z", "wikilink")]
    assert [(t["completed"], t["text"]) for t in row["tasks"]] == [(False, "open #t"), (True, "done code z")]
    assert [(i["parent_ord"], i["list_ord"]) for i in row["items"]] == [(None, 0), (0, 1), (None, 0)]
    assert [(f["name"], f["origin"]) for f in row["fields"]] == [("class", "frontmatter"), ("rating", "frontmatter"), ("Note", "inline")]
    assert not parse("---\n---\ntext").has_frontmatter and parse("---\n- x\n---\n").has_frontmatter
    assert parse("text\n    #lazy").tags == ["#lazy"] and parse("a\n\n    #code").tags == [] and parse("~~~\n#x\n").tags == []


def test_tables():
    assert markdown_table([["Name", "Rating"], ["a", "5"]]) == "| Name | Rating |\n|------|--------|\n| a    | 5      |\n"
    assert cell_text("A | B\nC") == "A \\| B C"


def test_schema_registry():
    r = Registry({
        "global": {"fields": {"due": {"type": "date", "required": True}}}, "A": {"fields": {"x": {"type": "number", "min": 1}, "y": {"type": "input"}}}, "B": {"extends": ["A", "Missing", "A"], "excludes": ["y"], "fields": {"d": {"$ref": "#global/due"}, "z": {"$ref": "#A/x", "max": 3}}},
        "C": {"extends": ["A"]}, "D": {"extends": ["B", "C"], "fields": {"f": {"type": "file", "folders": ["p/"], "ext": ["md"], "class": "A"}}}, "Bad": {"fields": {"q": {"type": "number", "values": [1]}}},
    })
    assert list(r.get("B").fields) == ["x", "d", "z"] and r.get("B").field("z").options == {"min": 1, "max": 3} and not r.get("B").field("d").required
    assert r.descendants("A") == ["B", "C", "D"] and r.children("A") == ["B", "C"] and set(r.get("D").fields) == {"x", "d", "z", "y", "f"} and "Bad" in r.failed
    assert list(r.get("D").field("f").source().atoms()) == [Glob("p/**.md"), ClassIs("A")]
    assert next(with_classes(parse_source("@A*"), r).atoms()).matches == {"A", "B", "C", "D"}
    for bad in ({"A": {"extends": ["B"]}, "B": {"extends": ["A"]}}, {"A": {"what": 1}}):
        with pytest.raises(SchemaError):
            Registry(bad)
    with pytest.raises(SchemaError):
        r.get("a")

"""The `from` language: tags, paths and globs, file classes, and boolean operators."""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from notelake.errors import QuerySyntaxError
from notelake.plans.logic import Cursor, Expr, Token, parse, scan, unquote
from notelake.plans.steps import Step

log = logging.getLogger("notelake")

_TOKENS = [
    ("(", re.compile(r"\(")), (")", re.compile(r"\)")), (",", re.compile(r",")),
    ("and", re.compile(r"&&|and", re.I)), ("or", re.compile(r"\|\||or", re.I)), ("not", re.compile(r"!|not", re.I)),
    ("class", re.compile(r"class", re.I)), ("children", re.compile(r"\.with_children\(\)")), ("descendants", re.compile(r"\.with_descendants\(\)")),
    ("tag", re.compile(r"#[a-zA-Z0-9_\-./]+")), ("sigil", re.compile(r"@[a-zA-Z0-9_\-./]+[+*]?")),
    ("quoted", re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'', re.S)), ("bare", re.compile(r"""[^\s(),!&|#@'"]+""")),
]


@dataclass(frozen=True)
class Tag:
    name: str


@dataclass(frozen=True)
class Glob:
    pattern: str


@dataclass(frozen=True)
class ClassIs:
    """depth: exact, children or descendants; matches is filled by `with_classes`."""

    name: str
    depth: str = "exact"
    matches: frozenset = field(default=frozenset(), compare=False)


#: The marks after `@name`, the words in `class(name, word)` and the methods after `class(name)`, all for the same depths.
_DEPTHS = {"": "exact", "+": "children", "*": "descendants"}
_NAME = "the name of a class"


def _text(t: Token) -> str:
    return unquote(t.value) if t.kind == "quoted" else t.value


def _class(name: str, at: Token, c: Cursor, depth: str = "exact") -> ClassIs:
    return ClassIs(name, depth) if name else c.fail(_NAME, at)


def _sigil(t: Token, c: Cursor) -> ClassIs:
    name = t.value[1:].rstrip("+*")
    return _class(name, t, c, _DEPTHS[t.value[1 + len(name) :]])


def _path(t: Token, c: Cursor) -> Glob:
    """A folder stands for all that is below it."""
    return Glob(re.sub(r"/\Z", "/**", _text(t)))


def _call(t: Token, c: Cursor) -> ClassIs:
    """`class(name)`, with a depth either as a second argument or as a method, but not both."""
    c.need("an opening parenthesis", "(")
    name = c.need(_NAME, "quoted", "bare")
    asked = []
    if c.take(","):
        word = c.need("a depth", "bare")
        asked.append(word.value if word.value in ("children", "descendants") else c.fail("a depth, children or descendants", word))
    c.need("a closing parenthesis", ")")
    method = c.take("children", "descendants")
    if method:
        asked.append(method.kind if not asked else c.fail("a single depth", method))
    return _class(_text(name), t, c, *asked)


_ATOMS = {"tag": lambda t, c: Tag(t.value), "sigil": _sigil, "quoted": _path, "bare": _path, "class": _call}
_ANY = "a tag, a path or a class"


def _atom(c: Cursor):
    t = c.need(_ANY, *_ATOMS)
    return _ATOMS[t.kind](t, c)


def parse_source(text: str | None) -> Expr | None:
    """The expression; None, which selects every file, for a text that is omitted or blank."""
    if text is None or not text.strip():
        return None
    return parse(Cursor("source", text, scan("source", text, _TOKENS, _ANY)), _atom)


def with_depth(expr: Expr | None, depth: str) -> Expr | None:
    return expr and expr.map(lambda a: replace(a, depth=depth) if isinstance(a, ClassIs) else a)


def with_classes(expr: Expr | None, registry) -> Expr | None:
    """Fill in which classes each class atom stands for; an unknown class stands for itself."""

    def change(a):
        if not isinstance(a, ClassIs):
            return a
        more = registry.expand(a.name, a.depth) if registry and a.depth != "exact" else frozenset()
        if a.depth != "exact" and (registry is None or a.name not in registry):
            log.warning("class %r isn't known; only notes of just that class match", a.name)
        return replace(a, matches=frozenset(more) | {a.name})

    return expr and expr.map(change)


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def glob_column(path: Column, pattern: str) -> Column:
    """`*` is any run without a slash, `**` any run; without either, equality. A literal start is a prefix, which files can be pruned by."""
    head = pattern.split("*", 1)[0]
    if head == pattern:
        return path == pattern
    if pattern == head + "**":
        return path.startswith(head) if head else F.lit(True)
    regex = "".join("(?s:.*)" if p == "**" else "[^/]*" if p == "*" else "\\Q" + p.replace("\\E", "\\E\\\\E\\Q") + "\\E" for p in re.split(r"(\*\*|\*)", pattern) if p)
    whole = path.rlike("^" + regex + "\\z")
    return path.startswith(head) & whole if head else whole


def source_steps(expr: Expr | None) -> tuple[Step, ...]:
    """The expression as filters; what only files have to say goes ahead, also the part of it that holds for a mixed one."""
    out = []
    for part in expr.conjuncts() if expr else ():
        needs = frozenset("tags" if isinstance(a, Tag) else "class_values" for a in part.atoms() if not isinstance(a, Glob))
        files = part.bound(lambda a: isinstance(a, Glob))
        out += [Step(n, lambda df, keep=compile_source(e): df.filter(keep)) for n, e in ((frozenset(), files), (needs, part if needs else None)) if e]
    return tuple(out)


def compile_source(expr: Expr | None) -> Column | None:
    def atom(a) -> Column:
        if isinstance(a, Tag):
            return _yes(F.exists("tags", lambda t: (t == a.name) | t.startswith(a.name + "/")))
        if isinstance(a, Glob):
            return glob_column(F.col("path"), a.pattern)
        names = sorted(a.matches or {a.name})
        return _yes(F.arrays_overlap("class_values", F.array(*[F.lit(n) for n in names])))

    return None if expr is None else expr.fold(atom)


__all__ = ["ClassIs", "Glob", "QuerySyntaxError", "Tag", "compile_source", "glob_column", "parse_source", "source_steps", "with_classes", "with_depth"]

"""File classes from TOML: hierarchy, field inheritance, references, options.

A class is a file `<name>.toml` with `extends`, `excludes` and `fields`. The class `global` stands apart: it extends
nothing and only gives fields to refer to. Schemas describe; no note is checked against them.
"""

from __future__ import annotations

import logging
import os
import tomllib
from dataclasses import dataclass, field

from notelake.errors import SchemaError
from notelake.plans.field import nearest
from notelake.plans.logic import Expr
from notelake.plans.source import ClassIs, Glob
from notelake.values import canonical_key

log = logging.getLogger("notelake")
GLOBAL = "global"
#: The options that each type of field takes, and the Python types of their values.
OPTIONS = {
    "input": {}, "boolean": {}, "select": {"values": (list,)}, "number": {"min": (int, float), "max": (int, float), "step": (int, float)},
    "date": {"format": (str,)}, "file": {"folders": (list,), "ext": (list,), "class": (str, list)},
}
_CLASS_KEYS, _FIELD_KEYS = {"extends", "excludes", "fields"}, {"type", "$ref", "required", "multi"}


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    required: bool = False
    multi: bool = False
    options: dict = field(default_factory=dict)

    def source(self) -> Expr | None:
        """What a file field may point to: notes in its folders with its extensions, or of its class; None for all."""
        o = self.options
        exts, parts = o.get("ext") or [None], []
        for folder in o.get("folders", []):
            for e in exts:
                parts.append(Glob(f"{folder.rstrip('/')}/**" + (f".{e.lstrip('.')}" if e else "")))
        if not o.get("folders"):
            parts += [Glob(f"**.{e.lstrip('.')}") for e in exts if e]
        names = o.get("class", [])
        parts += [ClassIs(n) for n in ([names] if isinstance(names, str) else names)]
        atoms = tuple(Expr("atom", atom=p) for p in parts)
        return None if not atoms else atoms[0] if len(atoms) == 1 else Expr("or", atoms)


@dataclass(frozen=True)
class FileClass:
    name: str
    parents: tuple[str, ...]
    fields: dict[str, Field]

    def field(self, name: str) -> Field:
        if name not in self.fields:
            close = nearest(name, self.fields)
            raise SchemaError(f"class {self.name} has no field {name!r}" + (f"; did you mean {close!r}?" if close else ""))
        return self.fields[name]


class Registry:
    """Classes by name. `failed` holds those that couldn't be built, and why; their heirs go on without them."""

    def __init__(self, raw: dict[str, dict]):
        self.failed: dict[str, str] = {}
        self.raw = {n: _checked(n, r) for n, r in raw.items()}
        self.parents = {n: self._known_parents(n) for n in self.raw if n != GLOBAL}
        self.classes: dict[str, FileClass] = {}
        for name in ([GLOBAL] if GLOBAL in self.raw else []) + self._order():
            try:
                self.classes[name] = self._build(name)
            except SchemaError as e:
                self.failed[name] = str(e)
        self._children = {n: [c for c in self.parents if c in self.classes and n in self.parents[c]] for n in self.classes}

    @staticmethod
    def load(folder: str) -> Registry:
        """Every `*.toml` directly in a folder; a folder that isn't there has none."""
        raw = {}
        for f in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
            if f.endswith(".toml"):
                with open(os.path.join(folder, f), "rb") as h:
                    try:
                        raw[f[:-5]] = tomllib.load(h)
                    except tomllib.TOMLDecodeError as e:
                        raise SchemaError(f"{f}: {e}") from e
        return Registry(raw)

    def _known_parents(self, name: str) -> tuple[str, ...]:
        out: list[str] = []
        for p in self.raw[name].get("extends", []):
            if p not in self.raw or p == GLOBAL:
                log.warning("class %s extends %s, which isn't there", name, p)
            elif p in out:
                log.warning("class %s extends %s twice", name, p)
            else:
                out.append(p)
        return tuple(out)

    def _order(self) -> list[str]:
        """Parents before their heirs; what is left over is in a cycle."""
        left, out = dict(self.parents), []
        while left:
            ready = [n for n, ps in left.items() if not any(p in left for p in ps)]
            if not ready:
                raise SchemaError("classes extend each other in a circle: " + ", ".join(sorted(left)))
            out += ready
            for n in ready:
                del left[n]
        return out

    def ancestors(self, name: str) -> set[str]:
        found, todo = set(), list(self.parents.get(name, ()))
        while todo:
            p = todo.pop()
            if p not in found:
                found.add(p)
                todo += self.parents.get(p, ())
        return found

    def _build(self, name: str) -> FileClass:
        fields: dict[str, Field] = {}
        for p in self.parents.get(name, ()):
            if p in self.classes:
                for n, f in self.classes[p].fields.items():
                    fields.setdefault(n, f)  # the parent listed first wins
        for n in self.raw[name].get("excludes", []):
            fields.pop(n, None)
        for n, spec in self.raw[name].get("fields", {}).items():
            fields[n] = self._field(name, n, spec)
        seen: dict[str, str] = {}
        for n in fields:
            other = seen.setdefault(canonical_key(n), n)
            if other != n:
                raise SchemaError(f"class {name}: {other!r} and {n!r} are the same key")
        return FileClass(name, self.parents.get(name, ()), fields)

    def _field(self, owner: str, name: str, spec: dict) -> Field:
        base = None
        if "$ref" in spec:
            ref = spec["$ref"]
            schema, _, other = ref[1:].partition("/") if ref.startswith("#") else ("", "", "")
            if schema and schema != GLOBAL and schema not in self.ancestors(owner):
                raise SchemaError(f"{owner}.{name}: {ref!r} isn't a field of an ancestor or of {GLOBAL}")
            base = self.classes[schema].fields.get(other) if schema in self.classes else None
            if base is None:
                if "type" not in spec:
                    log.warning("%s.%s refers to %s, which isn't there", owner, name, ref)
                    return Field(name, "input")
                raise SchemaError(f"{owner}.{name}: nothing is at {ref!r}")
        kind = spec.get("type", base.type if base else None)
        if kind not in OPTIONS:
            raise SchemaError(f"{owner}.{name}: unknown type {kind!r}")
        options = dict(base.options) if base and base.type == kind else {}
        for k, v in spec.items():
            if k in _FIELD_KEYS:
                continue
            if k not in OPTIONS[kind] or not isinstance(v, OPTIONS[kind][k]) or isinstance(v, bool):
                raise SchemaError(f"{owner}.{name}: a field of type {kind} has no such option as {k} = {v!r}")
            options[k] = v
        required = bool(spec.get("required", base.required if base else False))
        if required and owner == GLOBAL:
            log.warning("%s.%s: required means nothing in %s", owner, name, GLOBAL)
            required = False
        return Field(name, kind, required, bool(spec.get("multi", base.multi if base else False)), options)

    def __contains__(self, name: str) -> bool:
        return name in self.classes

    def get(self, name: str) -> FileClass:
        if name not in self.classes:
            close = nearest(name, self.classes)
            raise SchemaError(f"no class {name!r}" + (f"; did you mean {close!r}?" if close else ""))
        return self.classes[name]

    def children(self, name: str) -> list[str]:
        return list(self._children.get(name, []))

    def descendants(self, name: str) -> list[str]:
        out: list[str] = []
        todo = self.children(name)
        while todo:
            c = todo.pop(0)
            if c not in out:
                out.append(c)
                todo += self.children(c)
        return out

    def expand(self, name: str, depth: str) -> frozenset[str]:
        return frozenset({"children": self.children, "descendants": self.descendants}.get(depth, lambda n: [])(name))


def _checked(name: str, raw: dict) -> dict:
    for k in raw:
        if k not in _CLASS_KEYS:
            raise SchemaError(f"class {name}: unknown key {k!r}")
    for n in raw.get("fields", {}):
        if not n.strip() or "/" in n:
            raise SchemaError(f"class {name}: {n!r} can't be a field's name")
    return raw

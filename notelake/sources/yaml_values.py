"""Frontmatter: YAML of the core schema, so that dates, `yes` and `010` stay what they look like."""

from __future__ import annotations

import re

import yaml

from notelake.sources.inline import wikilink
from notelake.values import canonical_key, value

_DATE_START = re.compile(r"\d{4}-\d{2}-\d{2}", re.ASCII)


class _CoreLoader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
    """Only null, true/false, integers and floats are resolved; a key written twice is an error."""

    yaml_implicit_resolvers = {}

    def construct_mapping(self, node, deep=False):
        seen = set()
        for k, _ in node.value:
            key = self.construct_object(k, deep=True)
            if isinstance(key, list | dict):
                continue
            if (type(key), key) in seen:
                raise yaml.constructor.ConstructorError(None, None, f"key {key!r} is there twice", k.start_mark)
            seen.add((type(key), key))
        return super().construct_mapping(node, deep)


def _resolve(tag: str, pattern: str, first: str) -> None:
    _CoreLoader.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(pattern), list(first))


_resolve("null", r"^(~|null|Null|NULL|)$", "~nN")
_CoreLoader.yaml_implicit_resolvers.setdefault("", []).append(("tag:yaml.org,2002:null", re.compile(r"^$")))
_resolve("bool", r"^(true|True|TRUE|false|False|FALSE)$", "tTfF")
_resolve("int", r"^([-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", "-+0123456789")
_resolve("float", r"^([-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?|[-+]?\.(inf|Inf|INF)|\.(nan|NaN|NAN))$", "-+0123456789.")


def _int(loader, node):
    text = node.value
    return int(text[2:], 8) if text.startswith("0o") else int(text[2:], 16) if text.startswith("0x") else int(text)


def _float(loader, node):
    text = node.value.lower()
    return float(text.replace(".inf", "inf").replace(".nan", "nan"))


def _untagged(loader, suffix, node):
    """A tag of its own is dropped: what is under it counts."""
    if isinstance(node, yaml.MappingNode):
        return loader.construct_mapping(node, deep=True)
    if isinstance(node, yaml.SequenceNode):
        return loader.construct_sequence(node, deep=True)
    return loader.construct_object(yaml.ScalarNode(loader.resolve(yaml.ScalarNode, node.value, (True, False)), node.value), deep=True)


_CoreLoader.add_constructor("tag:yaml.org,2002:int", _int)
_CoreLoader.add_constructor("tag:yaml.org,2002:float", _float)
_CoreLoader.add_multi_constructor("!", _untagged)


def _key(k) -> str | None:
    if isinstance(k, bool):
        return "true" if k else "false"
    if isinstance(k, int | float):
        from notelake.values import number_text

        return number_text(float(k))
    return k if isinstance(k, str) else None


def _plain(x):
    """For the JSON payload of objects: numbers as floats, keys as text."""
    if isinstance(x, dict):
        return {_key(k): _plain(v) for k, v in x.items() if _key(k) is not None}
    if isinstance(x, list):
        return [_plain(v) for v in x]
    if isinstance(x, bool) or x is None:
        return x
    return float(x) if isinstance(x, int | float) else x


def from_yaml(x) -> dict:
    """A typed value of a YAML value."""
    if x is None:
        return value("null")
    if isinstance(x, bool):
        return value("bool", x)
    if isinstance(x, int | float):
        return value("number", float(x))
    if isinstance(x, list):
        return value("list", [from_yaml(v) for v in x])
    if isinstance(x, dict):
        return value("object", _plain(x))
    text = x.strip()
    if not text:
        return value("null")
    link = wikilink(text)
    if link:
        return value("link", link)
    return value("date" if _DATE_START.match(x) else "string", x)


def frontmatter(block: str) -> list[tuple[str, dict]] | None:
    """(key, value) of a metadata block in order; None for a blank block, [] for one that isn't a mapping.

    Of keys that are the same in their canonical form the last one's value counts, at the first one's place.
    """
    if not block.strip():
        return None
    try:
        data = yaml.load(block, Loader=_CoreLoader)
    except (yaml.YAMLError, ValueError, TypeError):
        return []
    if not isinstance(data, dict):
        return []
    out: dict[str, tuple[str, dict]] = {}
    for k, v in data.items():
        name = _key(k)
        if name is None or not canonical_key(name):
            continue
        canonical = canonical_key(name)
        out[canonical] = (out[canonical][0] if canonical in out else name, from_yaml(v))
    return list(out.values())

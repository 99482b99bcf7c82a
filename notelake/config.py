"""A workspace's configuration: the nearest `.notelake/config.toml` at or above a folder, over an optional one of the user's.

The user's file is read first and the workspace's values go over it, key by key. Unknown keys are errors. A workspace's file counts
only once it is trusted as it is: its templates run commands of the engine. Trust is kept by the hash of the file.
"""

from __future__ import annotations

import hashlib
import json
import os
import tomllib
from dataclasses import dataclass, field

from notelake.errors import ConfigError, UntrustedError
from notelake.values import canonical_key

HOME = ".notelake"
FILE = f"{HOME}/config.toml"
#: Every key, with the kind of its value; a nested mapping is a table.
_DATE = {"name": str, "format": str}
KEYS = {
    "templates": {"directory": str, "output_dir": str}, "schemas": {"class_field": str, "directory": str},
    "frontmatter": {"title": str, "aliases": str, "date_created": _DATE, "date_modified": _DATE},
}
_FIELD_NAMES = ("class_field", "title", "aliases", "name")
START = '# Settings of this workspace; `notelake trust` makes them count.\n[templates]\ndirectory = "templates"\n\n[schemas]\nclass_field = "class"\n'


def _checked(table: dict, known: dict, where: str, source: str) -> dict:
    for k, v in table.items():
        here = f"{where}{k}"
        if k not in known:
            raise ConfigError(f"{source}: unknown key {here}")
        if isinstance(known[k], dict):
            if not isinstance(v, dict):
                raise ConfigError(f"{source}: {here} is a table")
            _checked(v, known[k], here + ".", source)
        elif not isinstance(v, known[k]):
            raise ConfigError(f"{source}: {here} is a text")
        elif k in _FIELD_NAMES and not canonical_key(v):
            raise ConfigError(f"{source}: {here} = {v!r} can't be a field's name")
    return table


def _over(low: dict, high: dict) -> dict:
    return {k: _over(low[k], high[k]) if isinstance(low.get(k), dict) and isinstance(high.get(k), dict) else high.get(k, low.get(k)) for k in {**low, **high}}


def read(path: str) -> dict:
    with open(path, "rb") as f:
        try:
            return _checked(tomllib.load(f), KEYS, "", path)
        except tomllib.TOMLDecodeError as e:
            raise ConfigError(f"{path}: {e}") from e


@dataclass(frozen=True)
class Config:
    root: str
    #: Folders of templates, the workspace's and the user's.
    templates: str | None
    common_templates: str | None
    output_dir: str
    schemas: str
    class_field: str = "class"
    frontmatter: dict = field(default_factory=dict)


def user_file() -> str:
    return os.path.join(os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config"), "notelake", "config.toml")


def find(folder: str) -> str | None:
    """The configuration file of the nearest folder at or above this one."""
    at = os.path.realpath(folder)
    while not os.path.isfile(os.path.join(at, FILE)):
        above = os.path.dirname(at)
        if above == at:
            return None
        at = above
    return os.path.join(at, FILE)


def _folder(table: dict, key: str, base: str, default: str | None = None) -> str | None:
    """A configured folder, relative to the folder of the workspace or of the user's file."""
    value = table.get(key, default)
    return None if value is None else os.path.normpath(os.path.join(base, value))


def load(folder: str, trust: Trust | None = None, common: str | None = None) -> Config:
    """The configuration for a folder; without any file, the defaults with the folder as root."""
    local, common = find(folder), user_file() if common is None else common
    if local and trust is not None and not trust.holds(local):
        raise UntrustedError(f"{local} isn't trusted as it is; see `notelake trust`")
    low = read(common) if os.path.isfile(common) else {}
    high = read(local) if local else {}
    root = os.path.dirname(os.path.dirname(local)) if local else folder
    merged = _over(low, high)
    templates, schemas = merged.get("templates", {}), merged.get("schemas", {})
    return Config(
        root, _folder(high.get("templates", {}), "directory", root, f"{HOME}/templates"), _folder(low.get("templates", {}), "directory", os.path.dirname(common)),
        _folder(templates, "output_dir", root, "."), _folder(schemas, "directory", root, f"{HOME}/schemas"), schemas.get("class_field", "class"), merged.get("frontmatter", {}),
    )


class Trust:
    """Which configuration files are trusted, by path and hash, in a JSON file of the user's."""

    def __init__(self, path: str | None = None):
        self.path = path or os.path.join(os.environ.get("XDG_STATE_HOME") or os.path.expanduser("~/.local/state"), "notelake", "trust.json")

    def all(self) -> dict[str, str]:
        if not os.path.isfile(self.path):
            return {}
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)

    def _write(self, known: dict[str, str]) -> None:
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        fresh = f"{self.path}.{os.getpid()}"
        with open(fresh, "w", encoding="utf-8") as f:
            json.dump(known, f, indent=1, sort_keys=True)
        os.replace(fresh, self.path)

    @staticmethod
    def _hash(path: str) -> str:
        with open(path, "rb") as f:
            return hashlib.sha256(f.read()).hexdigest()

    def holds(self, path: str) -> bool:
        return self.all().get(os.path.realpath(path)) == self._hash(path)

    def add(self, path: str) -> None:
        read(path)  # what isn't a configuration isn't trusted
        self._write({**self.all(), os.path.realpath(path): self._hash(path)})

    def remove(self, path: str) -> bool:
        known = self.all()
        gone = known.pop(os.path.realpath(path), None)
        self._write(known)
        return gone is not None

    def tracked(self) -> list[tuple[str, str]]:
        """(path, trusted, changed or missing) of every file there was trust in."""
        return [(p, "missing" if not os.path.isfile(p) else "trusted" if self._hash(p) == h else "changed") for p, h in sorted(self.all().items())]


def init(folder: str, trust: Trust) -> str:
    """A first configuration in a folder, trusted; one that is there already stays."""
    path = os.path.join(folder, FILE)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    try:
        with open(path, "x", encoding="utf-8") as f:
            f.write(START)
    except FileExistsError as e:
        raise ConfigError(f"{path} is there already") from e
    trust.add(path)
    return path

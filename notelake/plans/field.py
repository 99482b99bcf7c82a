"""Field paths, resolved to columns of the page and task relations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from notelake.errors import FieldPathError
from notelake.values import SCALAR, VALUE, canonical_key


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def nearest(name: str, known) -> str | None:
    """The known name that a mistyped one is closest to, within half its length."""
    best = min(known, key=lambda k: (edit_distance(name, k), k), default=None)
    return best if best is not None and edit_distance(name, best) <= max(1, -(-len(name) // 2)) else None


@dataclass(frozen=True)
class Cell:
    """A resolved path. kind: text, date, number, bool, texts (an array of strings), or value (a VALUE struct).

    A null column stands for the null value.
    """

    kind: str
    col: Column

    def value(self) -> Column:
        """As a VALUE struct."""
        if self.kind == "value":
            return self.col
        if self.kind == "texts":
            return _struct("list", items=F.transform(F.coalesce(self.col, F.array().cast("array<string>")), lambda s: _scalar("string", s=s)))
        name = {"text": "string", "date": "date", "number": "number", "bool": "bool"}[self.kind]
        slot = {"text": "s", "date": "s", "number": "n", "bool": "b"}[self.kind]
        return F.when(self.col.isNotNull(), _struct(name, **{slot: self.col}))


@dataclass(frozen=True)
class Accessor:
    """What a built-in path stands for: the parts of a note that it reads, and its cell."""

    needs: frozenset[str]
    kind: str
    col: Callable[[], Column]

    def cell(self) -> Cell:
        return Cell(self.kind, self.col())


def _column(kind: str, name: str, needs: tuple[str, ...] = ()) -> Accessor:
    return Accessor(frozenset(needs), kind, lambda: F.col(name))


def _stamp(pattern: str, *columns: str) -> Accessor:
    return Accessor(frozenset(), "date", lambda: F.date_format(F.coalesce(*columns), pattern))


def _texts(name: str) -> Accessor:
    return Accessor(frozenset([name]), "texts", lambda: F.coalesce(F.col(name), F.array().cast("array<string>")))


_DAY, _SECOND = "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss"
_BORN, _CHANGED = ("created_at", "modified_at"), ("modified_at",)
#: Every built-in path. The word before a dot is a namespace, and no field of its own.
ACCESSORS: dict[str, Accessor] = {
    "file.path": _column("text", "path"), "file.name": _column("text", "name"), "file.folder": _column("text", "folder"),
    "file.size": Accessor(frozenset(), "number", lambda: F.col("size").cast("double")),
    "file.created_at": _stamp(_SECOND, *_BORN), "file.ctime": _stamp(_SECOND, *_BORN), "file.cdate": _stamp(_DAY, *_BORN),
    "file.modified_at": _stamp(_SECOND, *_CHANGED), "file.mtime": _stamp(_SECOND, *_CHANGED), "file.mdate": _stamp(_DAY, *_CHANGED),
    "task.completed": _column("bool", "task.completed", ("tasks",)), "task.text": _column("text", "task.text", ("tasks",)),
    "tags": _texts("tags"), "inlinks": _texts("inlinks"),
}
NAMESPACES = sorted({k.partition(".")[0] for k in ACCESSORS if "." in k})


@dataclass(frozen=True)
class Path:
    """`file.x`, `task.x`, `tags`, `inlinks`, or a metadata key in its canonical form."""

    space: str
    name: str

    @property
    def key(self) -> str:
        return f"{self.space}.{self.name}"

    @property
    def accessor(self) -> Accessor | None:
        return ACCESSORS.get(self.name if self.space == "list" else self.key) if self.space != "meta" else None

    @property
    def needs(self) -> frozenset[str]:
        """The parts of a note that the path reads."""
        return self.accessor.needs if self.accessor else frozenset(["fields"])


def parse_path(text: str) -> Path:
    """The path of a text: a built-in one by its exact spelling, or else, if it has no dot, a metadata key."""
    wanted = text.strip()
    space, dot, member = wanted.partition(".")
    if wanted in ACCESSORS:
        return Path(space, member) if dot else Path("list", wanted)
    key = canonical_key(wanted)
    if key and not dot and wanted not in NAMESPACES:
        return Path("meta", key)
    names = [k.partition(".")[2] for k in ACCESSORS if k.startswith(space + ".")] if member and "." not in member else []
    close = nearest(member, names)
    raise FieldPathError(wanted, f"{space}.{close}" if close else None)


def _struct(kind: str, **slots: Column) -> Column:
    return F.struct(*[(F.lit(kind) if f.name == "kind" else slots.get(f.name, F.lit(None)).cast(f.dataType)).alias(f.name) for f in VALUE.fields])


def _scalar(kind: str, **slots: Column) -> Column:
    return F.struct(*[(F.lit(kind) if f.name == "kind" else slots.get(f.name, F.lit(None)).cast(f.dataType)).alias(f.name) for f in SCALAR.fields])


def text_value(col: Column) -> Column:
    return _struct("string", s=col)


def from_scalar(col: Column) -> Column:
    """An element of a list as a value of its own."""
    return F.struct(*[(col[f.name] if f.name != "items" else F.lit(None).cast(f.dataType)).alias(f.name) for f in VALUE.fields])


def resolve(path: Path, overrides: dict[str, str]) -> Cell:
    """The cell of a path; what a flatten put in its place comes first."""
    if path.key in overrides:
        return Cell("value", F.col(overrides[path.key]))
    if path.accessor:
        return path.accessor.cell()
    # fields are stored with the frontmatter first, and the first of a key counts
    return Cell("value", F.get(F.filter("fields", lambda f: f["canonical"] == path.name), 0)["value"])


def order_keys(cell: Cell) -> list[Column]:
    """Columns whose ascending order, nulls first, is the order of the cells.

    null, bool, number, text, then what can't be compared, which all tie. Numbers are in IEEE total order:
    -0.0 before 0.0, NaN last.
    """
    minus_zero = lambda n: F.when((n == 0) & n.cast("string").startswith("-"), 0).otherwise(1)
    if cell.kind in ("text", "date", "bool"):
        return [cell.col]
    if cell.kind == "number":
        return [cell.col, minus_zero(cell.col)]
    if cell.kind == "texts":
        return []
    v = cell.col
    kind = v["kind"]
    text = kind.isin("string", "date", "duration")
    rank = F.when(kind.isNull() | (kind == "null"), 0).when(kind == "bool", 1).when(kind == "number", 2).when(text, 3).otherwise(4)
    return [rank, v["b"], v["n"], F.when(kind == "number", minus_zero(v["n"])), F.when(text, v["s"])]

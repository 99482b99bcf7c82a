"""Relations of pages or tasks with an explicit order, and what can be done with them.

A RecordSet is lazy: each transform returns a new one with a step more, beside the columns that it is ordered by. The
relation is built where rows leave, from the steps and what is asked for: notes are read only for rows that the
steps on files alone keep, and only in the parts that are needed. The order is applied in limit, in terminals, in iteration.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from notelake.errors import LimitError, TableColumnCountError, TaskRowsError
from notelake.plans.field import Cell, from_scalar, order_keys, parse_path, resolve, text_value
from notelake.plans.filter import filter_steps, parse_filter
from notelake.plans.steps import ALL_PARTS, Step
from notelake.values import value_text


@dataclass(frozen=True)
class RecordSet:
    #: From steps to the relation that they give, with the parts of notes asked for. Steps on files alone go first.
    build: Callable[[tuple[Step, ...], frozenset[str]], DataFrame]
    #: (column name, descending) in order of weight; each sort puts its own before the ones it finds.
    ordering: tuple[tuple[str, bool], ...]
    level: str = "page"
    #: Paths that a flatten replaced, and the column that holds their value now.
    overrides: dict[str, str] = field(default_factory=dict)
    steps: tuple[Step, ...] = ()
    override_needs: dict[str, frozenset[str]] = field(default_factory=dict)

    @property
    def df(self) -> DataFrame:
        """The relation with every column."""
        return self.build(self.steps, frozenset(ALL_PARTS))

    @property
    def files(self) -> DataFrame:
        """The relation with the columns of files, and of notes only what the steps read."""
        return self.build(self.steps, frozenset())

    def _needs(self, paths: Sequence[str]) -> frozenset[str]:
        found = [parse_path(p) for p in paths]
        return frozenset().union(*(self.override_needs.get(p.key, p.needs) for p in found))

    def _then(self, *steps: Step, **changes) -> RecordSet:
        return replace(self, steps=(*self.steps, *steps), **changes)

    # ---- transforms

    def where(self, text: str) -> RecordSet:
        return self._then(*filter_steps(parse_filter(text), self.overrides, self.override_needs))

    filter = where

    def _name(self, what: str) -> str:
        return f"__{what}{len(self.steps)}"

    def sort(self, path: str, descending: bool = False) -> RecordSet:
        """Stable: what ties keeps the order it had. Null is least."""
        keys = {f"{self._name('o')}_{i}": k for i, k in enumerate(order_keys(self.cell(path)))}
        step = Step(self._needs([path]), lambda df: df.withColumns(keys) if keys else df)
        return self._then(step, ordering=(*((n, descending) for n in keys), *self.ordering))

    def group_by(self, path: str) -> RecordSet:
        """Rows of the same value next to each other: a stable ascending sort."""
        return self.sort(path)

    def order(self) -> list[Column]:
        return [F.col(n).desc_nulls_last() if d else F.col(n).asc_nulls_first() for n, d in self.ordering]

    def limit(self, n: int) -> RecordSet:
        if n < 0:
            raise LimitError(f"limit must not be negative: {n}")
        return self._then(Step(frozenset(), lambda df: df.orderBy(*self.order()).limit(n), fixed=True))

    def flatten(self, path: str) -> RecordSet:
        """A row for each element of a list; none for an empty list; others keep their row, also null ones."""
        p = parse_path(path)
        cell, needs = self.cell(path), self._needs([path])
        name, at = self._name("f"), self._name("p")
        if cell.kind == "texts":
            each = F.transform(cell.col, text_value)
        else:
            v = cell.value()
            # a list within a list is JSON text; its elements come out as texts
            inner = F.transform(F.coalesce(F.from_json(v["json"], "array<string>"), F.array().cast("array<string>")), text_value)
            own = F.when(v["items"].isNotNull(), F.transform(v["items"], from_scalar)).otherwise(inner)
            each = F.when(F.coalesce(v["kind"] == "list", F.lit(False)), own).otherwise(F.array(v))
        step = Step(needs, lambda df: df.select("*", F.posexplode(each).alias(at, name)))
        return self._then(step, ordering=(*self.ordering, (at, False)), overrides={**self.overrides, p.key: name}, override_needs={**self.override_needs, p.key: needs})

    # ---- terminals

    def cell(self, path: str) -> Cell:
        return resolve(parse_path(path), self.overrides)

    def column(self, path: str) -> Column:
        """The path's value as a VALUE struct."""
        return self.cell(path).value()

    def values(self, *paths: str) -> DataFrame:
        """The relation with the columns of files and what some paths read: enough for `column` of these."""
        return self.build(self.steps, self._needs(paths))

    def select(self, **paths: str) -> DataFrame:
        """An unordered DataFrame of plain columns: text, number, bool or, for lists, an array of text."""
        return self.values(*paths.values()).select(*[self.cell(p).col.alias(n) for n, p in paths.items()])

    def ordered(self, *paths: str) -> DataFrame:
        """`values` in order."""
        return self.values(*paths).orderBy(*self.order())

    def numbered(self, name: str = "position") -> DataFrame:
        """The relation with each row's place in the order, from 1.

        Rows are sorted in ranges, each numbered in its own task from where the ranges before it end.
        """
        ordered = self.files.orderBy(*self.order())
        return ordered.select("*", (InternalFunction.distributed_sequence_id() + 1).alias(name))

    def count(self) -> int:
        return self.files.count()

    __len__ = count

    def is_empty(self) -> bool:
        return self.files.isEmpty()

    def get(self, i: int):
        """The i-th row, or None out of range."""
        if i < 0:
            return None
        rows = self.df.orderBy(*self.order()).offset(i).limit(1).collect()
        return rows[0] if rows else None

    __getitem__ = get

    def __iter__(self) -> Iterator:
        return self.df.orderBy(*self.order()).toLocalIterator()

    def _texts(self, paths: Sequence[str]) -> Iterator[list[str]]:
        cols = [self.column(p).alias(f"c{i}") for i, p in enumerate(paths)]
        for row in self.ordered(*paths).select(*cols).toLocalIterator():
            yield [value_text(v) for v in row]

    def table(self, headers: Sequence[str], columns: Sequence[str]) -> str:
        if len(headers) != len(columns):
            raise TableColumnCountError(f"{len(headers)} headers for {len(columns)} columns")
        rows = [[cell_text(h) for h in headers], *([cell_text(t) for t in row] for row in self._texts(columns))]
        return markdown_table(rows)

    def list(self, path: str) -> str:
        return "".join(f"- {t[0]}\n" for t in self._texts([path]))

    def task_lines(self) -> DataFrame:
        """The lines of `task_list` as a relation (line, text), numbered from 0: for lists longer than the driver can hold."""
        if self.level != "task":
            if self.is_empty():
                return self.files.sparkSession.createDataFrame([], "line long, text string")
            raise TaskRowsError("a task list needs rows of tasks")
        said = F.concat(F.when(F.col("task.completed"), "- [x] ").otherwise("- [ ] "), F.coalesce("task.text", F.lit("")))
        # made before the sort, so that only it and the keys are sorted
        items = self.values("task.completed", "task.text").select(said.alias("__said"), *[n for n, _ in self.ordering]).orderBy(*self.order())
        lines = items.select(F.explode(F.split("__said", "\n")).alias("text"))
        return lines.select(InternalFunction.distributed_sequence_id().alias("line"), "text")

    def task_list(self) -> str:
        """A line for each task; the driver holds all of them."""
        if self.level != "task":
            if self.is_empty():
                return ""
            raise TaskRowsError("a task list needs rows of tasks")
        rows = self.ordered("task.completed", "task.text").select("task.completed", "task.text")
        return "".join(f"- [{'x' if r[0] else ' '}] {r[1] or ''}\n" for r in rows.toLocalIterator())


def cell_text(text: str) -> str:
    return text.replace("\n", " ").replace("|", "\\|")


def markdown_table(rows: list[list[str]]) -> str:
    """Rows, the first of them the header, as a table padded to the widest cell."""
    widths = [max(map(len, column)) for column in zip(*rows)]
    line = lambda row: "| " + " | ".join(t.ljust(w) for t, w in zip(row, widths)) + " |"
    rule = "|" + "|".join("-" * (w + 2) for w in widths) + "|"
    return "\n".join([line(rows[0]), rule, *map(line, rows[1:])]) + "\n"

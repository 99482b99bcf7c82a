"""Steps of a plan over files and their notes, and which of them can go before notes are read.

A step names the parts of a note that it reads. One that reads none works on files alone; as filters and sorts commute,
it may go before every step but a limit, and so before the markdown parser.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

#: Parts of a note that a step can read, and `inlinks`, which come from the links.
PARTS = ("has_frontmatter", "fields", "tags", "class_values", "outlinks", "tasks")
ALL_PARTS = (*PARTS, "inlinks")


@dataclass(frozen=True)
class Step:
    needs: frozenset[str]
    apply: Callable[[DataFrame], DataFrame]
    #: A step that others can't pass.
    fixed: bool = False


def needed(steps: Iterable[Step]) -> frozenset[str]:
    return frozenset().union(*(s.needs for s in steps))


def split(steps: Iterable[Step]) -> tuple[list[Step], list[Step]]:
    """(before, after): the steps on files alone that can go first, and the others, each in their order."""
    before: list[Step] = []
    after: list[Step] = []
    closed = False
    for s in steps:
        if s.needs or closed or (s.fixed and after):
            after.append(s)
            closed = closed or s.fixed
        else:
            before.append(s)
    return before, after


def run(df: DataFrame, steps: Iterable[Step]) -> DataFrame:
    for s in steps:
        df = s.apply(df)
    return df

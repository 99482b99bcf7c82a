"""A directory of notes end to end: scan, index, queries, rendering, refresh, commands."""

from __future__ import annotations

import io

import pytest

from notelake import cli
from notelake.errors import LimitError, TableColumnCountError, TaskRowsError
from notelake.sources import index

FILES = {
    "a/note.md": "---\nrating: 3\nstatus: draft\nlist: [1, 2]\n---\n#book/x [[target]]\n- [ ] first\n- [x] second\n",
    "b/note.md": "---\nrating: 7\nstatus: done\nlist: []\n---\n[[note]] [x](a/note) [[target]]\n", "b/c.md": "rating:: -0.0\n[[note]]\n", "target.md": "---\nrating: .nan\nlist: one\n---\n", ".hidden.txt": "x", "a-b.md": "[[../no]]", ".git/config": "skipped",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("vault")
    for p, text in FILES.items():
        (top / p).parent.mkdir(parents=True, exist_ok=True)
        (top / p).write_text(text)
    return top


@pytest.fixture(scope="module")
def vault(spark, root):
    return index.build(spark, str(root))


def paths(rows):
    return [r["path"] for r in rows]


def test_pages_in_component_order(vault):
    assert paths(vault.pages()) == [".hidden.txt", "a/note.md", "a-b.md", "b/c.md", "b/note.md", "target.md"]


def test_filters(vault):
    at = lambda w: paths(vault.pages().where(w))
    assert at("rating > 1") == ["a/note.md", "b/note.md"] and at("rating == 0") == ["b/c.md"] and len(at("rating != 7")) == 5
    assert len(at("rating == null")) == 2 and at("rating <= null") == [] and at('contains(list, 2) or contains(tags, "#book")') == ["a/note.md"]


def test_order_limit_flatten(vault):
    rows = vault.pages("*.md or a/ or b/")
    assert paths(rows.sort("rating")) == ["a-b.md", "b/c.md", "a/note.md", "b/note.md", "target.md"]
    assert paths(rows.sort("rating", True))[:2] == ["target.md", "b/note.md"] and paths(rows.sort("rating").limit(2)) == ["a-b.md", "b/c.md"]
    flat = rows.flatten("list")
    assert paths(flat) == ["a/note.md", "a/note.md", "a-b.md", "b/c.md", "target.md"] and flat.list("list") == "- 1\n- 2\n- \n- \n- one\n"
    assert rows.get(1)["path"] == "a-b.md" and rows[99] is None and rows.count() == 5 and not rows.is_empty()
    with pytest.raises(LimitError):
        rows.limit(-1)


def test_links(vault):
    got = {r["path"]: r["inlinks"] for r in vault.pages()}
    assert got["target.md"] == ["a/note.md", "b/note.md"] and got["b/note.md"] == ["b/c.md", "b/note.md"] and got["a/note.md"] == ["b/note.md"]


def test_rendering(vault):
    assert vault.pages("a/").table(["Name", "R|x"], ["file.name", "rating"]) == "| Name | R\\|x |\n|------|------|\n| note | 3    |\n"
    assert vault.tasks().task_list() == "- [ ] first\n- [x] second\n"
    with pytest.raises(TaskRowsError):
        vault.pages().task_list()
    assert vault.pages("none/").task_list() == ""
    with pytest.raises(TableColumnCountError):
        vault.pages().table(["a"], [])


def test_persist_refresh_and_commands(spark, root, vault, tmp_path):
    index.persist(vault, str(tmp_path / "i"))
    again = index.load(spark, str(tmp_path / "i"))
    assert paths(again.pages()) == paths(vault.pages())
    (root / "a/new.md").write_text("#new [[target]]")
    (root / "b/c.md").unlink()
    fresh = index.refresh(spark, str(root), again)
    assert paths(fresh.pages("#new")) == ["a/new.md"] and "b/c.md" not in paths(fresh.pages())
    assert {r["path"]: r["inlinks"] for r in fresh.pages()}["target.md"] == ["a/new.md", "a/note.md", "b/note.md"]
    assert index.load(spark, str(tmp_path / "none")).files.count() == 0

    def command(*argv):
        out, err = io.StringIO(), io.StringIO()
        assert cli.run(cli.parser().parse_args(["--root", str(root), *argv]), spark, out, err) == 0
        return out.getvalue(), err.getvalue()

    assert command("index")[1] == "indexed 6 files\n"
    assert command("list", "--from", "a/", "--sort", "file.name", "--order", "desc")[0] == "a/note.md\na/new.md\n"
    assert command("table", "--where", "rating == 7", "--column", "file.path")[0].splitlines()[2] == "| b/note.md |"
    assert command("task", "--where", "task.completed == true") == ("- [x] second (a/note.md)\n", "1 tasks\n")
    assert cli.main(["--root", str(root), "list", "--where", "rating >"]) == 1


def test_a_rendered_task_list_holds_every_task(spark):
    from notelake.testing.queries import render_task_list, vault

    sf = "/root/testdata/sf0.001"
    n = vault(spark, sf, "orders", tasks=True).tasks("orders/f/", inlinks=False).df.count()
    assert n > 30 and render_task_list(spark, sf).count() == n


def test_the_lines_of_a_task_list_are_made_by_the_executors(spark, tmp_path):
    from notelake.operators.recordset import RecordSet
    from notelake.testing.queries import render_task_list

    for i in range(12):
        (tmp_path / f"n{i}.md").write_text(f"- [x] done {i}\n- [ ]\n- [ ] two\n  lines\n")
    vault = index.build(spark, str(tmp_path))
    for tasks in (vault.tasks(), vault.tasks().sort("task.completed", True), vault.tasks("none/"), vault.pages("none/")):
        lines = [r["text"] for r in sorted(tasks.task_lines().collect())]
        assert "".join(f"{t}\n" for t in lines) == tasks.task_list()
    with pytest.raises(TaskRowsError):
        vault.pages().task_lines()

    def refused(*_):
        raise AssertionError("the driver holds the whole list")

    with pytest.MonkeyPatch.context() as m:
        m.setattr(RecordSet, "task_list", refused)
        got = sorted(render_task_list(spark, "/root/testdata/sf0.001").collect())
    assert len(got) > 30 and [r["line"] for r in got] == list(range(len(got)))

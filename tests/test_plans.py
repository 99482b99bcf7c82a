"""What a query reads: files alone, notes that files' predicates keep, and parts of notes."""

from __future__ import annotations

import itertools

import pytest

from notelake.operators.links import edges
from notelake.plans.logic import Expr
from notelake.plans.source import parse_source
from notelake.plans.steps import Step, split
from notelake.testing.vault_from_tables import vault

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def truth(e: Expr, values):
    if e.op == "atom":
        return values[e.atom]
    parts = [truth(p, values) for p in e.parts]
    return not parts[0] if e.op == "not" else all(parts) if e.op == "and" else any(parts)


@pytest.mark.parametrize("text", ["a/ and #x", "a/ or #x", "not (a/ or #x)", "not (a/ and #x)", "(a/ and #x) or (b/ and not #y)", "not not a/ and (#x or not (b/ and #y))", "#x"])
def test_bounds_hold(text):
    e = parse_source(text)
    known = lambda a: type(a).__name__ == "Glob"
    atoms = list(dict.fromkeys(e.atoms()))
    above, below = e.bound(known), e.bound(known, False)
    for bits in itertools.product([False, True], repeat=len(atoms)):
        values = dict(zip(atoms, bits))
        whole = truth(e, values)
        assert above is None or truth(above, values) or not whole
        assert below is None or whole or not truth(below, values)
    assert (above is None) == (text in ("a/ or #x", "not (a/ and #x)", "#x"))


def test_steps_on_files_go_first():
    file, note = Step(frozenset(), lambda d: d), Step(frozenset(["tags"]), lambda d: d)
    stop = Step(frozenset(), lambda d: d, fixed=True)
    assert split([note, file, note, file]) == ([file, file], [note, note])
    assert split([file, stop, note, file]) == ([file, stop, file], [note])
    assert split([note, stop, file]) == ([], [note, stop, file])


def test_only_what_is_needed_is_parsed(spark):
    v = vault(spark, SF, "orders", "customers")
    assert "MapInArrow" not in plan(v.pages("orders/f/").where('file.size > 10 and file.name != "x"').sort("file.path").limit(3).files)
    assert "MapInArrow" not in plan(v.pages().select(path="file.path", size="file.size"))
    text = plan(v.pages("#order and orders/f/").where("total > 1 and file.size > 5").select(path="file.path"))
    assert text.count("MapInArrow") == 1 and "Filter" in text[text.index("MapInArrow") :]
    assert "inlinks" not in plan(v.pages("#order").select(path="file.path"))
    assert v.pages("#order").limit(5).count() == 5 and v.pages("orders/").count() == v.pages("#order").count()


def test_limits_keep_their_place(spark):
    v = vault(spark, SF, "customers")
    first = [r["path"] for r in v.pages().select(path="file.path").collect()]
    first = sorted(first, key=lambda p: p.split("/"))[:30]
    got = [r["path"] for r in v.pages().limit(30).where("balance > 0 and file.name != \"customer-1\"").values("balance").collect()]
    want = [r["path"] for r in v.pages().where("balance > 0").values("balance").collect() if r["path"] in first and not r["path"].endswith("/customer-1.md")]
    assert sorted(got) == sorted(want) and 0 < len(got) < 30


def test_numbering_is_the_order(spark):
    rows = vault(spark, SF, "customers").pages().sort("balance", True)
    numbered = sorted((r["position"], r["path"]) for r in rows.numbered().select("position", "path").collect())
    assert [p for _, p in numbered] == [r["path"] for r in rows.ordered("file.path").collect()] and [n for n, _ in numbered] == list(range(1, len(numbered) + 1))


def test_cached_vaults_say_the_same(spark):
    v = vault(spark, SF, "orders", "customers")
    kept = v.cached()
    ask = lambda x: sorted(map(str, x.pages("#customer").where("balance > 0").select(path="file.path", links="inlinks").collect()))
    assert ask(kept) == ask(v) and ask(v)
    kept.release()


def test_hot_stems_resolve_like_brute_force(spark):
    folders = ["", "a/", "a/b/", "a/b/c/", "d/", "d/e/", "a/x/"]
    for have in itertools.combinations(folders[1:], 3):
        link = {"target": "index", "text": "index", "kind": "wikilink", "embedded": False}
        notes = [(f"{f}index.md", []) for f in have] + [(f"{f}from.md", [link]) for f in folders]
        got = {(r["source"], r["target"]) for r in edges(spark.createDataFrame(notes, "path string, outlinks array<struct<target:string,text:string,kind:string,embedded:boolean>>")).collect()}

        def steps(a, b):
            x, y = a.split("/")[:-1], b.split("/")[:-1]
            same = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            return len(x) + len(y) - 2 * same

        want = set()
        for f in folders:
            d = sorted((steps(f, h), h) for h in have)
            if d[0][0] < d[1][0]:
                want.add((f"{f}from.md", f"{d[0][1]}index.md"))
        assert got == want
        if have == ("a/", "a/b/", "d/"):
            break

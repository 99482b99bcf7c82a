"""Configuration, trust, and the commands that use them."""

from __future__ import annotations

import io

import pytest

from notelake import cli, config, template
from notelake.errors import CancelledError, ConfigError, OutputExistsError, OutsideError, UntrustedError


@pytest.fixture
def place(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "c"))
    monkeypatch.setenv("XDG_STATE_HOME", str(tmp_path / "s"))
    (tmp_path / "v/deep/er").mkdir(parents=True)
    return tmp_path


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return path


def test_defaults_without_a_file(place):
    c = config.load(str(place / "v"))
    assert c.root == str(place / "v") and c.class_field == "class" and c.templates.endswith(".notelake/templates") and c.common_templates is None


def test_the_workspace_goes_over_the_user(place):
    put(place / "c/notelake/config.toml", '[templates]\ndirectory = "t"\noutput_dir = "out"\n[schemas]\nclass_field = "kind"\n[frontmatter.date_created]\nname = "born"\nformat = "%Y"\n')
    put(place / "v/.notelake/config.toml", '[templates]\ndirectory = "mine"\n[frontmatter]\ntitle = "name"\n[frontmatter.date_created]\nname = "made"\n')
    c = config.load(str(place / "v/deep/er"))
    root = str(place / "v")
    assert (c.root, c.templates, c.common_templates, c.output_dir, c.class_field) == (root, f"{root}/mine", str(place / "c/notelake/t"), f"{root}/out", "kind")
    assert c.frontmatter == {"title": "name", "date_created": {"name": "made", "format": "%Y"}}


@pytest.mark.parametrize("text", ["x = 1", "[templates]\nfolder = 'x'", "[schemas]\nclass_field = 3", "[schemas]\nclass_field = '!!'", "templates = 1", "[frontmatter.date_created]\nzone = 'x'", "["])
def test_wrong_files(place, text):
    put(place / "v/.notelake/config.toml", text)
    with pytest.raises(ConfigError):
        config.load(str(place / "v"))


def test_trust_is_of_the_file_as_it_is(place):
    trust = config.Trust()
    path = config.init(str(place / "v"), trust)
    with pytest.raises(ConfigError):
        config.init(str(place / "v"), trust)
    assert config.load(str(place / "v"), trust).class_field == "class" and trust.tracked() == [(path, "trusted")]
    put(place / "v/.notelake/config.toml", '[schemas]\nclass_field = "kind"\n')
    assert trust.tracked() == [(path, "changed")]
    with pytest.raises(UntrustedError):
        config.load(str(place / "v"), trust)
    trust.add(path)
    assert config.load(str(place / "v"), trust).class_field == "kind" and trust.remove(path) and not trust.holds(path)


def test_names_of_both_folders(place):
    put(place / "a/one.md", "x"), put(place / "a/two.txt", "x"), put(place / "b/one.md", "x"), put(place / "b/three.md", "x")
    assert template.names(str(place / "a"), str(place / "b")) == ["one", "two", "three"] and template.names(str(place / "no"), None) == []
    assert template.find("three", str(place / "a"), str(place / "b")).endswith("b/three.md")


def test_paths_stay_inside(place):
    for path in ("../x", "a/../../x"):
        with pytest.raises(OutsideError):
            template.inside(str(place / "v"), path)
    assert template.inside(str(place / "v"), "deep/../deep").endswith("v/deep")


def test_a_person_answers():
    asked = io.StringIO()
    p = template.Prompt(io.StringIO("\nname\ny\n9\n2\n\n1,3\n").readline, asked)
    assert p.text_input("?", "d") == "d" and p.text_input("?") == "name" and p.confirm("?")
    assert p.select("?", ["a", "b"], 0) == 1 and p.select("?", ["a", "b"], 1) == 1 and p.multi_select("?", ["a", "b", "c"], []) == [0, 2]
    with pytest.raises(CancelledError):
        p.confirm("?")


def test_commands(spark, place):
    root = place / "v"

    def command(*argv, answers=None):
        out, err = io.StringIO(), io.StringIO()
        read = io.StringIO(answers).readline if answers is not None else None
        assert cli.run(cli.parser().parse_args(["--root", str(root / "deep"), *argv]), spark, out, err, read) == 0
        return out.getvalue(), err.getvalue()

    out, err = io.StringIO(), io.StringIO()
    assert cli.run(cli.parser().parse_args(["--root", str(root), "init"]), spark, out, err) == 0
    put(root / ".notelake/config.toml", '[templates]\ndirectory = "t"\noutput_dir = "made"\n[schemas]\nclass_field = "kind"\n')
    with pytest.raises(UntrustedError):
        command("list")
    command("trust")
    put(root / "n.md", "---\nkind: Book\nrating: 4\n---\n")
    put(root / "t/hello.md", 'Hi {{ ui.text_input("Who", "you") }} {{ query.from("@Book") | count }}')
    assert command("list", "--from", "@Book")[0] == "n.md\n" and command("template", "--list")[0] == "hello\n"
    assert command("template", "hello", "-n", "--no-input")[0] == "Hi you 1"
    assert command("template", "-i", answers="1\nme\n")[1].endswith("made/hello.md\n") and (root / "made/hello.md").read_text() == "Hi me 1"
    with pytest.raises(OutputExistsError):
        command("template", "hello", "--no-input")
    command("template", "hello", answers="me\nmade/again.md\n")
    assert (root / "made/again.md").read_text() == "Hi me 1"
    assert command("tracked")[0].startswith("trusted ") and "template" in command("completions", "bash")[0]
    command("untrust")
    assert cli.main(["--root", str(root), "list"]) == 1 and cli.main(["--root", str(root)]) == 1


def test_codes():
    assert cli.code_of(FileNotFoundError()) == "io::not_found" and cli.code_of(ValueError()) == "internal::error" and cli.code_of(UntrustedError()) == "config::untrusted"

"""Commands over a directory of notes: index, list, table, task, template, and those on its configuration.

Results go to stdout, counts and questions to stderr.
"""

from __future__ import annotations

import argparse
import os
import sys

from notelake import config
from notelake.errors import CancelledError, ConfigError, NotelakeError, OutputExistsError, TemplateError, UsageError
from notelake.plans.field import parse_path
from notelake.plans.filter import parse_filter
from notelake.plans.source import parse_source
from notelake.schema.registry import Registry
from notelake.sources import index
from notelake.sources.scan import INDEX_DIR


#: Commands that only touch the configuration, no notes.
WORKSPACE = ("init", "trust", "untrust", "tracked", "completions")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="notelake")
    p.add_argument("--root", default=".", help="the folder of notes, or one below it that is configured")
    p.add_argument("--schemas", help="instead of the configured folder of schemas")
    p.add_argument("--class-field", help="instead of the configured one")
    p.add_argument("-i", "--interactive", action="store_true", help="pick a template and answer its questions")
    sub = p.add_subparsers(dest="command")
    sub.add_parser("index")
    for name in ("list", "table", "task"):
        c = sub.add_parser(name)
        c.add_argument("--from", dest="source")
        c.add_argument("--where")
        if name != "task":
            c.add_argument("--sort")
            c.add_argument("--order", choices=("asc", "desc"), default="asc")
        if name == "table":
            c.add_argument("--column", action="append", required=True)
    t = sub.add_parser("template")
    t.add_argument("name", nargs="?")
    t.add_argument("--templates", help="instead of the configured folder")
    t.add_argument("--list", action="store_true", dest="names")
    t.add_argument("-i", "--interactive", action="store_true", dest="pick", help="pick a template")
    t.add_argument("-o", "--output")
    t.add_argument("-f", "--force", action="store_true")
    t.add_argument("-n", "--dry-run", action="store_true")
    t.add_argument("--no-input", action="store_true", help="questions are answered by their defaults")
    for name in ("init", "trust", "untrust"):
        sub.add_parser(name)
    sub.add_parser("tracked")
    sub.add_parser("completions").add_argument("shell", choices=("bash", "zsh"))
    return p


def run_workspace(args: argparse.Namespace, out, trust: config.Trust) -> int:
    """The commands on the configuration."""
    if args.command == "tracked":
        for path, state in trust.tracked():
            print(f"{state} {path}", file=out)
    elif args.command == "completions":
        words = " ".join(next(a for a in parser()._actions if isinstance(a, argparse._SubParsersAction)).choices)
        start = "autoload -U +X bashcompinit && bashcompinit\n" if args.shell == "zsh" else ""
        out.write(f"{start}complete -W '{words}' notelake\n")
    elif args.command == "init":
        print(config.init(args.root, trust), file=out)
    else:
        path = config.find(args.root)
        if path is None:
            raise ConfigError(f"no configuration at or above {args.root}")
        trust.add(path) if args.command == "trust" else trust.remove(path)
        print(path, file=out)
    return 0


def run_template(args: argparse.Namespace, spark, vault, registry, out, err, settings: config.Config, read) -> int:
    """Render a template to its target: -o, else what the template says, else the configured folder and the template's name."""
    from notelake import template

    local = os.path.join(settings.root, args.templates) if args.templates else settings.templates
    known = template.names(local, settings.common_templates)
    if args.names:
        out.write("".join(f"{n}\n" for n in known))
        return 0
    silent = args.no_input or not (args.pick or read is not sys.stdin.readline or sys.stdin.isatty())
    answers = template.Answers() if silent else template.Prompt(read, err)
    name = args.name
    if not name:
        if silent or not known:
            raise TemplateError("no template named" if known else "no templates to pick from")
        name = known[answers.select("Template", known, 0)]
    with open(template.find(name, local, settings.common_templates), encoding="utf-8") as f:
        text = f.read()
    engine = template.Engine(spark, vault, settings.root, registry, answers)
    done = engine.render(text)
    if args.dry_run:
        out.write(done)
        return 0
    default = os.path.join(os.path.relpath(settings.output_dir, settings.root), f"{os.path.splitext(os.path.basename(name))[0]}.md")
    target = args.output or engine.output or os.path.normpath(default)
    while True:
        try:
            print(template.write(settings.root, target, done, args.force), file=err)
            return 0
        except OutputExistsError:
            if silent:
                raise
            target = answers.text_input(f"{target} is there already; write to")


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("notelake").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def run(args: argparse.Namespace, spark=None, out=None, err=None, read=None, trust: config.Trust | None = None) -> int:
    out, err, read, trust = out or sys.stdout, err or sys.stderr, read or sys.stdin.readline, trust or config.Trust()
    if args.interactive and args.command is None:
        args = parser().parse_args(["--root", args.root, "template", "--interactive"])
    if args.command is None:
        raise UsageError("no command; see --help")
    if args.command in WORKSPACE:
        return run_workspace(args, out, trust)
    # whatever is wrong in the texts shows before any file is read
    source = parse_source(getattr(args, "source", None))
    if getattr(args, "where", None):
        parse_filter(args.where)
    for path in [getattr(args, "sort", None), *(getattr(args, "column", None) or [])]:
        if path:
            parse_path(path)
    settings = config.load(args.root, trust)
    field = args.class_field or settings.class_field
    spark = spark or session()
    registry = Registry.load(os.path.join(settings.root, args.schemas) if args.schemas else settings.schemas)
    where = os.path.join(settings.root, INDEX_DIR)
    if args.command == "index":
        full = index.build(spark, settings.root, field, registry)
        index.persist(full, where)
        print(f"indexed {full.files.count()} files", file=err)
        return 0
    vault = index.refresh(spark, settings.root, index.load(spark, where, registry), field)
    if args.command == "template":
        return run_template(args, spark, vault, registry, out, err, settings, read)
    rows = vault.tasks(source) if args.command == "task" else vault.pages(source)
    if args.where:
        rows = rows.where(args.where)
    if getattr(args, "sort", None):
        rows = rows.sort(args.sort, args.order == "desc")
    n = 0
    if args.command == "list":
        for r in rows.ordered("file.path").select("path").toLocalIterator():
            print(r["path"], file=out)
            n += 1
    elif args.command == "task":
        for r in rows.ordered("task.completed", "task.text").select("path", "task").toLocalIterator():
            print(f"- [{'x' if r['task']['completed'] else ' '}] {r['task']['text']} ({r['path']})", file=out)
            n += 1
    else:
        text = rows.table(args.column, args.column)
        out.write(text)
        n = text.count("\n") - 2
    print(f"{n} {'tasks' if args.command == 'task' else 'files'}", file=err)
    return 0


def main(argv: list[str] | None = None) -> int:
    """0 when done or given up by a person, 130 when interrupted, else 1 with a stable code on stderr."""
    try:
        return run(parser().parse_args(argv))
    except CancelledError:
        return 0
    except KeyboardInterrupt:
        return 130
    except Exception as e:
        print(f"{code_of(e)}: {e}", file=sys.stderr)
        return 1


def code_of(e: Exception) -> str:
    """The stable code of a failure."""
    if isinstance(e, NotelakeError):
        return e.code
    if isinstance(e, UnicodeDecodeError):
        return "io::encoding"
    if isinstance(e, OSError):
        return "io::" + {FileNotFoundError: "not_found", PermissionError: "denied", FileExistsError: "exists"}.get(type(e), "error")
    return "spark::error" if type(e).__module__.startswith(("pyspark", "py4j")) else "internal::error"


if __name__ == "__main__":
    sys.exit(main())

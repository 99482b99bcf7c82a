"""A note's structure from its markdown: frontmatter, body fields and tags, links, lists and tasks.

Blocks are scanned line by line with a stack of open containers (quotes and list items); what is code
is decided here, since code yields no fields and no tags. Covered: metadata block, headings of both kinds,
paragraphs with lazy continuation, fenced and indented code, nested lists, task marks, quotes, HTML blocks,
thematic breaks; inline: code spans, links (also by reference), images, autolinks, wikilinks, escapes.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

from notelake.sources import inline
from notelake.sources.yaml_values import frontmatter
from notelake.values import canonical_key

_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_QUOTE = re.compile(r" {0,3}> ?")
_MARKER = re.compile(r"( {0,3})([-+*]|(\d{1,9})[.)])(?=[ \t]|$)")
_TASK = re.compile(r"\[([ xX])\](?=\s)")
_HTML = re.compile(r" {0,3}<(?:!--|\?|![A-Za-z]|/?[A-Za-z][\w-]*(?:[\s/>]|$))")
_DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(?:<([^<>]*)>|(\S+))(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?[ \t]*$")
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>")
_INLINE_HTML = re.compile(r"<(?:/?[A-Za-z][^<>]*|!--.*?--|\?.*?\?|![A-Z][^>]*)>", re.S)
_ESCAPABLE = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
#: A run without anything that may stand for something else.
_PLAIN = re.compile(r"[^\\`!\[<&*_\n]+")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);")


@dataclass
class Item:
    ord: int
    parent_ord: int | None
    list_ord: int
    ordered: bool
    task: str | None = None
    text: str = ""
    scan: str = ""
    fields: list = field(default_factory=list)


@dataclass
class Note:
    has_frontmatter: bool = False
    frontmatter: list = field(default_factory=list)
    inline_fields: list = field(default_factory=list)
    tags: list = field(default_factory=list)
    outlinks: list = field(default_factory=list)
    items: list[Item] = field(default_factory=list)
    #: Whether inline fields and tags are looked for.
    metadata: bool = True


#: The columns of a note, those that its body is read for, and those that fields and tags are looked for.
ALL_PARTS = ("has_frontmatter", "fields", "tags", "class_values", "outlinks", "tasks", "items")
_BODY = frozenset(["fields", "tags", "outlinks", "tasks", "items"])
_METADATA = frozenset(["fields", "tags", "items"])


# ---- blocks ------------------------------------------------------------------------------------


@dataclass
class _Open:
    """An open container: a quote, or a list item with the column its content starts at."""

    kind: str
    indent: int = 0
    marker: str = ""
    item: Item | None = None


def _expand(line: str) -> str:
    return line.expandtabs(4) if "\t" in line else line


class _Blocks:
    def __init__(self, note: Note, definitions: dict[str, str]):
        self.note, self.definitions = note, definitions
        self.stack: list[_Open] = []
        self.lists = 0
        self.paragraph: list[str] = []
        self.fence: tuple[str, int] | None = None
        self.html = self.indented = False
        self.blanks: list[str] = []
        self.last_blank = False

    # -- leaves

    def item(self) -> Item | None:
        return next((o.item for o in reversed(self.stack) if o.item), None)

    def close_leaf(self) -> None:
        if self.paragraph:
            text = "\n".join(x.strip(" ") if i == len(self.paragraph) - 1 else x.lstrip(" ") for i, x in enumerate(self.paragraph))
            self.paragraph = []
            self.text(text)
        self.indented, self.blanks, self.html = False, [], False

    def text(self, text: str) -> None:
        item = self.item()
        if item:
            if item.scan:
                item.scan += "\n"
            shown, scanned = spans(text, self.definitions, self.note.outlinks)
            item.text += shown
            item.scan += scanned
        else:
            _, scanned = spans(text, self.definitions, self.note.outlinks)
            if self.note.metadata:
                self.note.inline_fields += inline.fields(scanned)
                self.note.tags += inline.tags(scanned)

    def code(self, text: str) -> None:
        item = self.item()
        if item:
            item.text += text + "\n"

    def flush(self, item: Item) -> None:
        """A parent's own metadata comes before that of the items below it."""
        if item.scan and self.note.metadata:
            item.fields = inline.fields(item.scan, item.task is not None)
            self.note.inline_fields += item.fields
            self.note.tags += inline.tags(item.scan)
        item.scan = ""

    def close(self, depth: int) -> None:
        """Close the containers from a depth on."""
        if len(self.stack) > depth:
            self.close_leaf()
            self.fence = None
            while len(self.stack) > depth:
                o = self.stack.pop()
                if o.item:
                    self.flush(o.item)

    # -- lines

    def line(self, raw: str) -> None:
        rest, depth = _expand(raw), 0
        for o in self.stack:
            if o.kind == "quote":
                m = _QUOTE.match(rest)
                if not m:
                    break
                rest = rest[m.end() :]
            elif rest[: o.indent].strip() == "" and (len(rest) >= o.indent and rest.strip()):
                rest = rest[o.indent :]
            elif not rest.strip():
                rest = ""
            else:
                break
            depth += 1
        blank = not rest.strip()
        matched = depth == len(self.stack)
        if self.fence:
            if matched:
                m = re.match(r" {0,3}(`+|~+)[ \t]*$", rest)
                if m and m[1][0] == self.fence[0][0] and len(m[1]) >= len(self.fence[0]):
                    self.fence = None
                else:
                    lead = min(self.fence[1], len(rest) - len(rest.lstrip(" ")))
                    self.code(rest[lead:])
                return
            self.close(depth)
        if blank:
            if not matched:  # a quote ends at a blank line
                self.close(depth)
            if self.indented:
                self.blanks.append(rest[4:])
            else:
                self.close_leaf()
            self.last_blank = True
            return
        if self.html and matched:
            return
        # new containers
        while True:
            indent = len(rest) - len(rest.lstrip(" "))
            lazy = bool(self.paragraph) and depth < len(self.stack)
            if indent >= 4 and not (self.stack[depth:] and self.stack[depth].kind == "item" and self.paragraph):
                break
            q = _QUOTE.match(rest)
            if q:
                self.close(depth)
                self.close_leaf()
                self.stack.append(_Open("quote"))
                depth, rest = depth + 1, rest[q.end() :]
                continue
            m = None if _RULE.match(rest) else _MARKER.match(rest)
            if m and self.paragraph and not lazy and depth == len(self.stack):
                # only a marker with text, and of numbers only 1, may end a paragraph
                if not rest[m.end() :].strip() or (m[3] and int(m[3]) != 1):
                    m = None
            if not m:
                break
            rest = self._start_item(depth, m, rest)
            depth = len(self.stack)
        if depth < len(self.stack):
            if self.paragraph and not self._starts_block(rest):  # lazy continuation
                self.paragraph.append(rest)
                return
            self.close(depth)
        self._leaf(rest)
        self.last_blank = False

    def _start_item(self, depth: int, m: re.Match, rest: str) -> str:
        marker = m[2] if m[3] is None else m[2][-1]
        sibling = depth < len(self.stack) and self.stack[depth].kind == "item" and self.stack[depth].marker == marker
        list_ord = self.stack[depth].item.list_ord if sibling else None
        self.close(depth)
        self.close_leaf()
        parent = self.item()
        if list_ord is None:
            if parent:
                self.flush(parent)
            list_ord, self.lists = self.lists, self.lists + 1
        after = rest[m.end() :]
        gap = len(after) - len(after.lstrip(" "))
        width = m.end() + (gap if 1 <= gap <= 4 and after.strip() else 1)
        item = Item(len(self.note.items), parent.ord if parent else None, list_ord, m[3] is not None)
        self.note.items.append(item)
        rest = rest[width:] if after.strip() else ""
        self.stack.append(_Open("item", width, marker, item))
        t = _TASK.match(rest)
        if t:
            item.task = "complete" if t[1] in "xX" else "incomplete"
            rest = rest[t.end() :].lstrip(" ")
        return rest

    def _starts_block(self, rest: str) -> bool:
        return bool(_FENCE.match(rest) or _HEADING.match(rest) or _RULE.match(rest) or _HTML.match(rest))

    def _leaf(self, rest: str) -> None:
        if not rest.strip():
            return
        indent = len(rest) - len(rest.lstrip(" "))
        if indent >= 4 and not self.paragraph:
            for b in self.blanks:
                self.code(b)
            self.blanks = []
            self.indented = True
            self.code(rest[4:])
            return
        if self.indented:
            self.close_leaf()
        f = _FENCE.match(rest) if indent < 4 else None
        if f:
            self.close_leaf()
            self.fence = (f[1], indent)
            return
        h = _HEADING.match(rest) if indent < 4 else None
        if h:
            self.close_leaf()
            if h[1]:
                self.text(h[1].strip())
            return
        u = _UNDERLINE.match(rest) if self.paragraph else None
        if u:
            self.close_leaf()
            return
        if indent < 4 and _RULE.match(rest):
            self.close_leaf()
            return
        if not self.paragraph:
            if _HTML.match(rest):
                self.close_leaf()
                self.html = True
                return
            d = _DEFINITION.match(rest)
            if d:
                return
        self.paragraph.append(rest)


# ---- spans -------------------------------------------------------------------------------------


def _label(text: str) -> str:
    return " ".join(text.split()).casefold()


def _code_span(text: str, at: int) -> tuple[str, int] | None:
    n = len(text) - len(text[at:].lstrip("`")) - at
    m = re.compile(rf"(?<!`)`{{{n}}}(?!`)").search(text, at + n)
    if not m:
        return None
    inner = text[at + n : m.start()].replace("\n", " ")
    if inner.startswith(" ") and inner.endswith(" ") and inner.strip():
        inner = inner[1:-1]
    return inner, m.end()


def _close_bracket(text: str, at: int) -> int | None:
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if c == "`":
            code = _code_span(text, i)
            if code:
                i = code[1]
                continue
        depth += (c == "[") - (c == "]")
        if not depth:
            return i
        i += 1
    return None


def _destination(text: str, at: int) -> tuple[str, int] | None:
    """The target of `(target "title")` that opens at `at`."""
    m = re.compile(r"\(\s*").match(text, at)
    if not m:
        return None
    i = m.end()
    if text[i : i + 1] == "<":
        a = re.compile(r"<((?:[^<>\n\\]|\\.)*)>").match(text, i)
        if not a:
            return None
        target, i = a[1], a.end()
    else:
        depth, start = 0, i
        while i < len(text) and not text[i].isspace():
            if text[i] == "\\" and i + 1 < len(text):
                i += 2
                continue
            if text[i] == "(":
                depth += 1
            elif text[i] == ")":
                if not depth:
                    break
                depth -= 1
            i += 1
        target = text[start:i]
    t = re.compile(r"(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)").match(text, i)
    return (_unescape(target), t.end()) if t else None


def _unescape(text: str) -> str:
    text = re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", text)
    return _ENTITY.sub(lambda m: html.unescape(m[0]), text)


def spans(text: str, definitions: dict[str, str], outlinks: list) -> tuple[str, str]:
    """(shown, scanned): a block's text as it reads, and without code and with brackets around link text.

    Links are appended to outlinks in order; images and embeds aren't links.
    """
    shown: list[str] = []
    scanned: list[str] = []
    i = 0

    def both(x: str) -> None:
        shown.append(x)
        scanned.append(x)

    while i < len(text):
        plain = _PLAIN.match(text, i)
        if plain:
            both(plain[0])
            i = plain.end()
            continue
        c = text[i]
        if c == "\\" and i + 1 < len(text) and text[i + 1] in _ESCAPABLE:
            both(text[i + 1])
            i += 2
        elif c == "\\" and text[i + 1 : i + 2] == "\n":
            i += 1
        elif c == "`":
            code = _code_span(text, i)
            if code:
                shown.append(code[0])
                i = code[1]
            else:
                n = len(text) - i - len(text[i:].lstrip("`"))
                both("`" * n)
                i += n
        elif c == "!" and text[i + 1 : i + 2] == "[":
            end = _image(text, i + 1, definitions)
            if end:
                i = end[1]
                both(end[0])
            else:
                both(c)
                i += 1
        elif c == "[" and text[i + 1 : i + 2] == "[":
            end = text.find("]]", i)
            link = inline.wikilink(text[i : end + 2]) if end > 0 else None
            if link:
                outlinks.append({**link})
                both(link["text"])
                i = end + 2
            else:
                both(c)
                i += 1
        elif c == "[":
            found = _link(text, i, definitions)
            if found:
                label, target, end = found
                inner: list = []
                s, t = spans(label, definitions, inner)
                shown.append(s)
                scanned.append(f"[{t}]")
                outlinks.append({"target": target, "text": s, "kind": "markdown", "embedded": False})
                i = end
            else:
                both(c)
                i += 1
        elif c == "<":
            a = _AUTOLINK.match(text, i)
            h = None if a else _INLINE_HTML.match(text, i)
            if a:
                target = a[1] if ":" in a[1] else "mailto:" + a[1]
                outlinks.append({"target": target, "text": a[1], "kind": "markdown", "embedded": False})
                shown.append(a[1])
                scanned.append(f"[{a[1]}]")
                i = a.end()
            elif h:
                i = h.end()
            else:
                both(c)
                i += 1
        elif c == "&":
            e = _ENTITY.match(text, i)
            both(html.unescape(e[0]) if e else c)
            i = e.end() if e else i + 1
        elif c in "*_":
            n = len(text[i:]) - len(text[i:].lstrip(c))
            if not _emphasis(text, i, n, c):
                both(c * n)
            i += n
        elif c == "\n":
            for out in (shown, scanned):
                while out and out[-1].endswith(" "):
                    out[-1] = out[-1].rstrip(" ")
                    if not out[-1]:
                        out.pop()
            both("\n")
            i += 1
        else:
            both(c)
            i += 1
    return "".join(shown), "".join(scanned)


def _emphasis(text: str, at: int, n: int, c: str) -> bool:
    """Whether a run of `*` or `_` opens or closes emphasis with another run in the text."""
    before, after = text[at - 1 : at] or " ", text[at + n : at + n + 1] or " "
    left = not after.isspace() and (after.isalnum() or before.isspace() or not before.isalnum())
    right = not before.isspace() and (before.isalnum() or after.isspace() or not after.isalnum())
    opens = left and (c == "*" or not right or not before.isalnum())
    closes = right and (c == "*" or not left or not after.isalnum())
    if opens and re.search(rf"(?<=[^\s{re.escape(c)}]){re.escape(c)}+", text[at + n :]):
        return True
    return closes and bool(re.search(rf"{re.escape(c)}+(?=[^\s{re.escape(c)}])", text[:at]))


def _link(text: str, at: int, definitions: dict[str, str]) -> tuple[str, str, int] | None:
    end = _close_bracket(text, at)
    if end is None:
        return None
    label = text[at + 1 : end]
    found = _destination(text, end + 1)
    if found:
        return label, found[0], found[1]
    if text[end + 1 : end + 2] == "[":
        close = _close_bracket(text, end + 1)
        if close is not None:
            name = text[end + 2 : close] or label
            if _label(name) in definitions:
                return label, definitions[_label(name)], close + 1
    if _label(label) in definitions:
        return label, definitions[_label(label)], end + 1
    return None


def _image(text: str, at: int, definitions: dict[str, str]) -> tuple[str, int] | None:
    """(text, end) of an image or an embed whose `[` is at `at`: its text is read, but it is no link."""
    if text[at : at + 2] == "[[":
        end = text.find("]]", at)
        link = inline.wikilink(text[at : end + 2]) if end > 0 else None
        return (link["text"], end + 2) if link else None
    found = _link(text, at, definitions)
    return (spans(found[0], definitions, [])[0], found[2]) if found else None


# ---- notes -------------------------------------------------------------------------------------


def parse(text: str, parts=ALL_PARTS) -> Note:
    """The note of a markdown text; only what some parts of its row need is worked out."""
    note = Note()
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if lines and lines[0].rstrip() == "---":
        end = next((i for i in range(1, len(lines)) if lines[i].rstrip() in ("---", "...")), None)
        if end is not None and not (len(lines) > 1 and not lines[1].strip() and end > 1):
            block = "\n".join(lines[1:end])
            note.has_frontmatter = bool(block.strip())
            if "fields" in parts or "class_values" in parts:
                note.frontmatter = frontmatter(block) or []
            lines = lines[end + 1 :]
    if not _BODY.intersection(parts):
        return note
    note.metadata = bool(_METADATA.intersection(parts))
    definitions = {}
    for x in lines:
        d = _DEFINITION.match(x)
        if d and not x.lstrip().startswith("[["):
            definitions.setdefault(_label(d[1]), _unescape(d[2] if d[2] is not None else d[3]))
    blocks = _Blocks(note, definitions)
    for x in lines:
        blocks.line(x)
    blocks.close_leaf()
    blocks.close(0)
    for item in note.items:
        item.text = item.text.strip("\n")
    return note


def as_row(note: Note, class_field: str = "class", parts=ALL_PARTS) -> dict:
    """A note as the columns of the `notes` relation but for its path; only those among parts."""

    def fields(pairs, origin):
        return [{"name": k, "canonical": canonical_key(k), "origin": origin, "value": v} for k, v in pairs]

    def classes():
        """Of the frontmatter alone: texts, or the texts in a list."""
        own = next((v for k, v in note.frontmatter if canonical_key(k) == canonical_key(class_field)), None)
        some = [] if own is None else own["items"] if own["kind"] == "list" else [own]
        return [x["s"] for x in some if x["s"] is not None and x["kind"] in ("string", "date", "duration")]

    made = {
        "has_frontmatter": lambda: note.has_frontmatter,
        "fields": lambda: fields(note.frontmatter, "frontmatter") + fields(note.inline_fields, "inline"),
        "tags": lambda: note.tags,
        "class_values": classes,
        "outlinks": lambda: note.outlinks,
        "tasks": lambda: [{"ord": n, "completed": i.task == "complete", "text": i.text} for n, i in enumerate(i for i in note.items if i.task)],
        "items": lambda: [{"ord": i.ord, "parent_ord": i.parent_ord, "list_ord": i.list_ord, "ordered": i.ordered, "text": i.text, "task_status": i.task, "fields": fields(i.fields, "inline")} for i in note.items],
    }
    return {p: made[p]() for p in parts}

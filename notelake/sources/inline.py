"""Inline metadata of a note's text: `Key:: value` fields, typed values, task dates, tags, links."""

from __future__ import annotations

import re

from notelake.values import canonical_key, value

# The units that a duration is written with.
DURATION_UNITS = frozenset(
    """year years yr yrs month months mo mos week weeks wk wks w day days d hour hours hr hrs h
    minute minutes min mins m second seconds sec secs s millisecond milliseconds ms""".split()
)
# The signs that stand before a date in a task, and the field each gives.
TASK_SIGNS = {"🗓️": "due", "🗓": "due", "➕": "created", "🛫": "start", "⏳": "scheduled", "✅": "completion"}

_ISO_DATE = re.compile(r"\d{4}-\d{2}-\d{2}", re.ASCII)
_NUMBER = re.compile(r"[0-9+\-.eE]+")
_FLOAT = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", re.ASCII)
_TAG_VALUE = re.compile(r"#(?=[^\W\d_])[\w/-]*")
_TAG = re.compile(r"(?<!\w)#((?=[^\W\d_])[\w/-]+)")
_TASK_DATE = re.compile("(" + "|".join(map(re.escape, TASK_SIGNS)) + r")[ \t]*(\d{4}-\d{2}-\d{2})")
_LINE_KEY = re.compile(r"[A-Za-z][A-Za-z0-9_-]*(?=::)")
_OPENERS = {"[": "]", "(": ")"}


def wikilink(text: str) -> dict | None:
    """A link value if the whole text is `[[target]]`, `[[target|alias]]`, or either after `!`."""
    embedded = text.startswith("!")
    body = text[1:] if embedded else text
    if not (body.startswith("[[") and body.endswith("]]")) or len(body) < 5:
        return None
    inner = body[2:-2]
    if "[[" in inner or "]]" in inner:
        return None
    at = re.search(r"(?<!\\)\|", inner)
    target, alias = (inner[: at.start()], inner[at.end() :]) if at else (inner, "")
    target, alias = target.replace("\\|", "|").strip(), alias.replace("\\|", "|").strip()
    if not target:
        return None
    return {"target": target, "text": alias or target, "kind": "wikilink", "embedded": embedded}


class _Reader:
    """Typed atoms of a value's text, by position."""

    def __init__(self, text: str):
        self.text, self.n = text, len(text)

    def blank(self, at: int) -> int:
        while at < self.n and self.text[at].isspace():
            at += 1
        return at

    def ends(self, at: int) -> bool:
        return at >= self.n or self.text[at].isspace() or self.text[at] == ","

    def atom(self, at: int) -> tuple[dict, int] | None:
        at = self.blank(at)
        for kind in (self.quoted, self.link, self.duration, self.keyword, self.date, self.number, self.tag):
            found = kind(at)
            if found:
                return found
        return None

    def quoted(self, at: int):
        if self.text[at : at + 1] != '"':
            return None
        out, i = [], at + 1
        while i < self.n:
            c = self.text[i]
            if c == "\\" and i + 1 < self.n:
                out.append(self.text[i + 1])
                i += 2
            elif c == '"':
                return value("string", "".join(out)), i + 1
            else:
                out.append(c)
                i += 1
        return None

    def link(self, at: int):
        start = at + (self.text[at : at + 1] == "!")
        if self.text[start : start + 2] != "[[":
            return None
        end = self.text.find("]]", start)
        found = wikilink(self.text[at : end + 2]) if end > 0 else None
        return (value("link", found), end + 2) if found else None

    def _part(self, at: int) -> int | None:
        """The end of one number with a unit."""
        m = _NUMBER.match(self.text, at)
        u = re.compile(r"[A-Za-z]+").match(self.text, self.blank(m.end())) if m else None
        return u.end() if u and u[0].lower() in DURATION_UNITS else None

    def duration(self, at: int):
        end = self._part(at)
        if end is None:
            return None
        while True:
            gap = self.blank(end)
            if gap == self.n:
                break
            after = self.blank(gap + 1) if self.text[gap] == "," else gap
            more = self._part(after)
            if more is None:
                if gap != end:
                    return None
                break
            end = more
        return value("duration", self.text[at:end]), end

    def keyword(self, at: int):
        for word, made in (("true", value("bool", True)), ("false", value("bool", False)), ("null", value("null"))):
            end = at + len(word)
            if self.text[at:end].lower() == word and self.ends(end):
                return made, end
        return None

    def date(self, at: int):
        m = _ISO_DATE.match(self.text, at)
        return (value("date", m[0]), m.end()) if m and self.ends(m.end()) else None

    def number(self, at: int):
        m = _NUMBER.match(self.text, at)
        if not m or not _FLOAT.fullmatch(m[0]) or not self.ends(m.end()):
            return None
        n = float(m[0])
        return (value("number", n), m.end()) if abs(n) != float("inf") else None

    def tag(self, at: int):
        m = _TAG_VALUE.match(self.text, at)
        return (value("string", m[0]), m.end()) if m and len(m[0]) > 1 else None

    def listed(self) -> list[dict] | None:
        """The atoms of a comma list; at least one comma, perhaps a trailing one."""
        found = self.atom(0)
        out: list[dict] = []
        while found:
            out.append(found[0])
            at = self.blank(found[1])
            if at == self.n:
                return out if len(out) > 1 else None
            if self.text[at] != ",":
                return None
            at = self.blank(at + 1)
            if at == self.n:
                return out
            found = self.atom(at)
        return None


def typed(text: str) -> dict:
    """The value that an inline field's text stands for."""
    text = text.strip()
    if not text:
        return value("null")
    r = _Reader(text)
    some = r.listed()
    if some is not None:
        return value("list", some)
    one = r.atom(0)
    if one and r.blank(one[1]) == r.n:
        return one[0]
    return value("string", text)


def _bracketed(text: str, at: int) -> tuple[str, str, int] | None:
    """(key, value, end) of a field in brackets that open at `at`."""
    opener = text[at]
    closer = _OPENERS[opener]
    colons = text.find("::", at)
    if colons < 0:
        return None
    key = text[at + 1 : colons]
    if not key.strip() or any(c in "[]()\n" for c in key):
        return None
    depth, i = 1, colons + 2
    while i < len(text) and text[i] != "\n":
        if text[i] == "\\":
            i += 2
            continue
        depth += (text[i] == opener) - (text[i] == closer)
        if not depth:
            return key.strip(), text[colons + 2 : i], i + 1
        i += 1
    return None


def fields(text: str, task: bool = False) -> list[tuple[str, dict]]:
    """(key, value) of each inline field of a text block, in order; in tasks also the dates after signs."""
    out: list[tuple[str, dict]] = []
    for line in text.split("\n"):
        at = len(line) - len(line.lstrip())
        m = _LINE_KEY.match(line, at)
        if m:  # the rest of the line is the value, whatever it looks like
            _add(out, m[0], line[m.end() + 2 :])
            continue
        # a field in brackets has colons, a task's date a sign
        i = 0 if "::" in line or (task and _TASK_DATE.search(line)) else len(line)
        while i < len(line):
            if line[i] in _OPENERS and not (i and line[i - 1] == "\\"):
                found = _bracketed(line, i)
                if found:
                    _add(out, found[0], found[1])
                    i = found[2]
                    continue
            d = _TASK_DATE.match(line, i) if task else None
            if d:
                out.append((TASK_SIGNS[d[1]], value("date", d[2])))
                i = d.end()
                continue
            i += 1
    return out


def _add(out: list[tuple[str, dict]], key: str, text: str) -> None:
    if canonical_key(key):
        out.append((key, typed(text)))


def tags(text: str) -> list[str]:
    """Tags with their `#`, in order, repeats kept."""
    return ["#" + m[1] for m in _TAG.finditer(text)]

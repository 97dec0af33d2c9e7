"""Fluent resources: a parser, a serializer and the two rules for arguments.

Values are plain tuples, so that they pickle and compare:
pattern = tuple of text strings and expressions; expressions are
("str", s) ("num", s) ("var", id) ("msg", id, attribute) ("term", id, attribute, arguments)
("func", id, arguments) ("place", expression) ("select", selector, variants),
arguments = (positional, named) or None, variant = (key, is_default, pattern).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

IDENT = re.compile(r"[A-Za-z][\w-]*", re.ASCII)
NUMBER = re.compile(r"-?\d+(?:\.\d+)?", re.ASCII)
COMMENT = re.compile(r"(#{1,3})(?: ([^\n]*))?(?:\n|$)")
STRING = re.compile(r'"((?:[^"\\\n]|\\["\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{6})*)"')
BLANK = re.compile(r"[ \n]*")
KINDS = {1: "comment", 2: "group_comment", 3: "resource_comment"}


class FluentError(ValueError):
    """A place where the text isn't Fluent."""


@dataclass
class Entry:
    kind: str  # message, term, comment, group_comment, resource_comment or junk
    key: str | None = None
    value: tuple | None = None
    attributes: list[tuple[str, tuple]] = field(default_factory=list)
    comment: list[str] | None = None
    line: int = 0


#: Placeables within placeables; more are an error, as is any other wrong syntax.
DEPTH = 100


class _Reader:
    def __init__(self, text: str):
        self.text = text.replace("\r\n", "\n")
        self.at, self.depth, self.counted = 0, 0, (0, 1)

    def fail(self, what: str):
        raise FluentError(f"line {self.text.count(chr(10), 0, self.at) + 1}: {what} expected")

    def peek(self, what: str) -> bool:
        return self.text.startswith(what, self.at)

    def take(self, what: str) -> bool:
        if self.peek(what):
            self.at += len(what)
            return True
        return False

    def need(self, what: str) -> None:
        if not self.take(what):
            self.fail(repr(what))

    def match(self, pattern: re.Pattern, what: str = "") -> re.Match | None:
        if m := pattern.match(self.text, self.at):
            self.at = m.end()
        elif what:
            self.fail(what)
        return m

    def inline_blank(self) -> None:
        while self.peek(" "):
            self.at += 1

    def name(self) -> str:
        return self.match(IDENT, "an identifier").group()

    # patterns

    def pattern(self) -> tuple | None:
        """A pattern with its common indentation removed; None without any content."""
        parts: list = []  # text, expressions, and [newlines, spaces] for line starts
        self.inline_blank()
        while self.at < len(self.text):
            if self.peek("{"):
                parts.append(self.placeable())
            elif self.peek("}"):
                self.fail("text")
            elif self.peek("\n"):
                m = re.compile(r"(?:[ ]*\n)+").match(self.text, self.at)
                spaces = re.compile(r" *").match(self.text, m.end()).group()
                nxt = self.text[m.end() + len(spaces) : m.end() + len(spaces) + 1]
                if not nxt or (nxt != "{" and (not spaces or nxt in "}.[*")):
                    break
                parts.append([m.group().count("\n"), len(spaces)])
                self.at = m.end() + len(spaces)
            else:
                end = re.compile(r"[^{}\n]+").match(self.text, self.at).end()
                parts.append(self.text[self.at : end])
                self.at = end
        common = min((p[1] for p in parts if isinstance(p, list)), default=0)
        out: list = []
        for i, p in enumerate(parts):
            if isinstance(p, list):
                p = " " * (p[1] - common) if i == 0 else "\n" * p[0] + " " * (p[1] - common)
            if isinstance(p, str) and out and isinstance(out[-1], str):
                out[-1] += p
            elif p != "":
                out.append(p)
        if out and isinstance(out[-1], str):
            out[-1] = out[-1].rstrip(" \n\r")
            if not out[-1]:
                out.pop()
        return tuple(out) or None

    def placeable(self) -> tuple:
        self.need("{")
        self.depth += 1
        if self.depth > DEPTH:
            self.fail(f"at most {DEPTH} nested placeables")
        self.match(BLANK)
        out = self.expression()
        self.match(BLANK)
        self.need("}")
        self.depth -= 1
        return out

    def expression(self) -> tuple:
        first = self.inline()
        self.match(BLANK)
        if not self.take("->"):
            if first[0] == "term" and first[2] is not None:
                self.fail("no attribute of a term as a value")
            return first
        if first[0] in ("msg", "place") or (first[0] == "term" and first[2] is None):
            self.fail("another selector")
        self.inline_blank()
        if not self.peek("\n"):
            self.fail("a line break")
        variants = []
        while True:
            self.match(BLANK)
            default = self.take("*")
            if not self.take("["):
                break
            self.match(BLANK)
            number = self.match(NUMBER)
            key = number.group() if number else self.name()
            self.match(BLANK)
            self.need("]")
            value = self.pattern()
            if value is None:
                self.fail("a value")
            variants.append((key, default, value))
        if sum(v[1] for v in variants) != 1:
            self.fail("one default variant")
        return ("select", first, tuple(variants))

    def inline(self) -> tuple:
        if self.peek("{"):
            return ("place", self.placeable())
        if self.peek('"'):
            return ("str", self.match(STRING, "a string").group(1))
        if m := self.match(NUMBER):
            return ("num", m.group())
        if self.take("$"):
            return ("var", self.name())
        if self.take("-"):
            name = self.name()
            attribute = self.name() if self.take(".") else None
            return ("term", name, attribute, self.arguments())
        name = self.name()
        arguments = self.arguments()
        if arguments is not None:
            if not re.fullmatch(r"[A-Z][A-Z0-9_-]*", name):
                self.fail("a function's name in capitals")
            return ("func", name, arguments)
        return ("msg", name, self.name() if self.take(".") else None)

    def arguments(self) -> tuple | None:
        start = self.at
        self.match(BLANK)
        if not self.take("("):
            self.at = start
            return None
        positional, named = [], []
        self.match(BLANK)
        while not self.peek(")"):
            value = self.inline()
            self.match(BLANK)
            if value[0] == "msg" and value[2] is None and self.take(":"):
                self.match(BLANK)
                literal = self.inline()
                if literal[0] not in ("str", "num"):
                    self.fail("a literal")
                named.append((value[1], literal))
            elif named:
                self.fail("a named argument")
            else:
                positional.append(value)
            self.match(BLANK)
            if not self.take(","):
                break
            self.match(BLANK)
        self.need(")")
        return (tuple(positional), tuple(named))

    # entries

    def line(self) -> int:
        """The line of the place, counted on from where it was asked for last."""
        if self.at < self.counted[0]:
            self.counted = (0, 1)
        self.counted = (self.at, self.counted[1] + self.text.count("\n", self.counted[0], self.at))
        return self.counted[1]

    def entry(self) -> Entry:
        line = self.line()
        kind = "term" if self.take("-") else "message"
        out = Entry(kind, self.name(), line=line)
        self.inline_blank()
        self.need("=")
        out.value = self.pattern()
        while m := re.compile(r"(?:[ ]*\n)+ *\.").match(self.text, self.at):
            self.at = m.end()
            name = self.name()
            self.inline_blank()
            self.need("=")
            value = self.pattern()
            if value is None:
                self.fail("a value")
            out.attributes.append((name, value))
        self.inline_blank()
        if self.at < len(self.text):
            self.need("\n")
        if out.value is None and (kind == "term" or not out.attributes):
            self.fail("a value")
        return out


def entries(text: str, strict: bool = False) -> Iterator[Entry]:
    """Entries in their order, one by one. What can't be parsed is junk or, if strict, an error."""
    r = _Reader(text)
    pending: Entry | None = None
    while r.at < len(r.text):
        if m := re.compile(r"(?: *\n)+| +$").match(r.text, r.at):
            if pending:
                yield pending
                pending = None
            r.at = m.end()
            continue
        start = r.at
        if r.peek("#") and (m := r.match(COMMENT)):
            kind, text_line = KINDS[len(m.group(1))], m.group(2) or ""
            if pending and pending.kind == kind:
                pending.comment.append(text_line)
            else:
                if pending:
                    yield pending
                pending = Entry(kind, comment=[text_line], line=0)
                end, r.at = r.at, start
                pending.line, r.at = r.line(), end
            continue
        try:
            entry = r.entry()
            if pending and pending.kind == "comment":
                entry.comment = pending.comment
            elif pending:
                yield pending
        except FluentError:
            r.depth = 0
            if strict:
                raise
            if pending:
                yield pending
            m = re.compile(r"\n(?=[A-Za-z#-])").search(r.text, start)
            r.at = m.end() if m else len(r.text)
            entry = Entry("junk", value=(r.text[start : r.at],))
        pending = None
        yield entry
    if pending:
        yield pending


def parse(text: str, strict: bool = False) -> list[Entry]:
    return list(entries(text, strict))


# serializer


def _arguments(args: tuple | None) -> str:
    return "" if args is None else "(" + ", ".join([*map(_inline, args[0]), *(f"{k}: {_inline(v)}" for k, v in args[1])]) + ")"


def _inline(e: tuple) -> str:
    kind = e[0]
    if kind == "str":
        return f'"{e[1]}"'
    if kind == "num":
        return e[1]
    if kind == "var":
        return "$" + e[1]
    if kind == "msg":
        return e[1] + (f".{e[2]}" if e[2] else "")
    if kind == "term":
        return "-" + e[1] + (f".{e[2]}" if e[2] else "") + _arguments(e[3])
    if kind == "func":
        return e[1] + _arguments(e[2])
    return "{ " + _expression(e[1], 0) + " }"


def _expression(e: tuple, depth: int) -> str:
    if e[0] != "select":
        return _inline(e)
    pad = "    " * (depth + 1)
    rows = [(pad[:-1] + "*[" if d else pad + "[") + key + "]" + _pattern(value, depth + 1) + "\n" for key, d, value in e[2]]
    return _inline(e[1]) + " ->\n" + "".join(rows) + "    " * depth


def _pattern(value: tuple, depth: int) -> str:
    lines = any("\n" in p if isinstance(p, str) else p[0] == "select" for p in value)
    own_line = lines and not (isinstance(value[0], str) and value[0].startswith("."))
    inner = depth + 1
    out = ["\n" + "    " * inner if own_line else " "]
    for p in value:
        if isinstance(p, str):
            out.append(re.sub(r"\n(?=[^\n])", "\n" + "    " * inner, p))
        elif p[0] == "place":
            out.append("{{ " + _expression(p[1], inner) + " }}")
        elif p[0] == "select":
            out.append("{ " + _expression(p, inner) + "}")
        else:
            out.append("{ " + _inline(p) + " }")
    return "".join(out)


def _comment(lines: list[str], sign: str) -> str:
    return "".join(f"{sign} {x}\n" if x else f"{sign}\n" for x in lines)


def serialize_entry(e: Entry) -> str:
    """One message, term or junk, with the comment attached to it."""
    if e.kind == "junk":
        return e.value[0]
    head = _comment(e.comment, "#") if e.comment else ""
    head += ("-" if e.kind == "term" else "") + e.key + " ="
    return head + (_pattern(e.value, 0) if e.value else "") + "".join(f"\n    .{n} =" + _pattern(v, 1) for n, v in e.attributes) + "\n"


def serialize(entries: list[Entry]) -> str:
    """A resource. Free comments have blank lines around them; junk is left out."""
    out: list[str] = []
    for e in entries:
        if e.kind in KINDS.values():
            sign = "#" * next(n for n, k in KINDS.items() if k == e.kind)
            out.append(("\n" if out else "") + _comment(e.comment, sign) + "\n")
        elif e.kind != "junk":
            out.append(serialize_entry(e))
    return "".join(out)


def commented(e: Entry, compat: bool = True) -> Entry:
    """The entry as a free comment. ``compat`` joins the last two lines, as is customary for such files."""
    if e.kind == "comment":
        return e
    lines = serialize_entry(e).splitlines() if e.kind in ("message", "term", "junk") else []
    if compat and len(lines) > 1:
        lines[-2:] = [lines[-2] + lines[-1]]
    return Entry("comment", e.key, comment=lines, line=e.line)


# rules for arguments


def reach(value: tuple | None) -> tuple[list[str], list[tuple[str, str]]]:
    """Variables, and (kind, key) of references, that reconciliation sees in a value.

    Functions, nested placeables and attributes aren't looked into.
    """
    names: list[str] = []
    refs: list[tuple[str, str]] = []

    def visit(e) -> None:
        if isinstance(e, str):
            return
        if e[0] == "var":
            names.append(e[1])
        elif e[0] == "msg":
            refs.append(("message", e[1]))
        elif e[0] == "term":
            refs.append(("term", e[1]))
        elif e[0] == "select":
            if e[1][0] == "var":
                names.append(e[1][1])
            for _, _, v in e[2]:
                for p in v:
                    visit(p)

    for p in value or ():
        visit(p)
    return list(dict.fromkeys(names)), list(dict.fromkeys(refs))


def signature(value: tuple | None) -> list[str]:
    """Variables that a stub's signature has, in order of first use: also arguments of
    functions and terms, and nested placeables; references aren't followed."""
    out: list[str] = []

    def visit(e) -> None:
        if isinstance(e, str):
            return
        if e[0] == "var":
            out.append(e[1])
        elif e[0] == "place":
            visit(e[1])
        elif e[0] in ("term", "func") and e[-1] is not None:
            for a in (*e[-1][0], *(v for _, v in e[-1][1])):
                visit(a)
        elif e[0] == "select":
            visit(e[1])
            for _, _, v in e[2]:
                for p in v:
                    visit(p)

    for p in value or ():
        visit(p)
    return list(dict.fromkeys(out))


def plain_text(value: tuple | None) -> str | None:
    """The text, trimmed; None without a value or with anything but text in it."""
    if value is None or any(not isinstance(p, str) for p in value):
        return None
    return "".join(value).strip()


def shown(value: tuple) -> str:
    """How a stub shows a value: its first line, with short forms of expressions."""

    def short(e) -> str:
        return {"var": lambda: f"{{ ${e[1]} }}", "msg": lambda: f"{{{e[1]}}}", "term": lambda: f"{{ -{e[1]} }}", "str": lambda: e[1], "num": lambda: e[1], "place": lambda: short(e[1])}.get(e[0], lambda: "{...}")()

    out = ""
    for p in value:
        out += p if isinstance(p, str) else short(p)
        if "\n" in out:
            return out.split("\n", 1)[0].removesuffix("\r")
    return out


_IGNORE = re.compile(r"[\w-]+: ignore-untranslated")


def ignores_untranslated(comment: list[str] | None) -> bool:
    """Whether a comment exempts its message: "ignore", or a tool's "...: ignore-untranslated"."""
    return any(x.strip().lower() == "ignore" or _IGNORE.search(x.strip().lower()) for x in comment or ())

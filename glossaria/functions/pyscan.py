"""Calls of translation functions in Python source."""

from __future__ import annotations

import ast
import warnings
from dataclasses import dataclass, field
from pathlib import PurePosixPath

KEYS = ("i18n", "L", "LazyProxy", "LazyFilter")
IGNORED_ATTRIBUTES = ("set_locale", "use_locale", "use_context", "set_context")
DEFAULT_FILE = "_default.ftl"


@dataclass(frozen=True)
class ScanOptions:
    keys: frozenset[str] = frozenset(KEYS)
    prefixes: frozenset[str] = frozenset()
    ignored_attributes: frozenset[str] = frozenset(IGNORED_ATTRIBUTES)
    ignored_kwargs: frozenset[str] = frozenset()
    default_file: str = DEFAULT_FILE

    def words(self) -> list[str]:
        """A file without any of these has no call."""
        return sorted(self.keys | self.prefixes)

    def fingerprint(self) -> str:
        return repr([sorted(self.keys), sorted(self.prefixes), sorted(self.ignored_attributes), sorted(self.ignored_kwargs), self.default_file])


@dataclass
class _Visitor(ast.NodeVisitor):
    options: ScanOptions
    found: list[tuple[str, str, list[str]]] = field(default_factory=list)

    def visit_Call(self, node: ast.Call) -> None:
        if (key := self.key(node)) is not None:
            self.found.append((key, self.file(node), [k.arg for k in node.keywords if k.arg and k.arg != "_path" and k.arg not in self.options.ignored_kwargs]))
        self.generic_visit(node)

    def literal(self, node: ast.Call) -> str | None:
        first = node.args[0] if node.args else None
        return first.value if isinstance(first, ast.Constant) and isinstance(first.value, str) else None

    def key(self, node: ast.Call) -> str | None:
        o, f, path = self.options, node.func, []
        if isinstance(f, ast.Name):
            return self.literal(node) if f.id in o.keys else None
        while isinstance(f, ast.Attribute):
            path.insert(0, f.attr)
            f = f.value
        if not isinstance(f, ast.Name):
            return None
        if f.id not in o.keys:
            if f.id not in o.prefixes or path[0] not in o.keys:
                return None
            path.pop(0)
        if path == ["get"]:
            return self.literal(node)
        return "-".join(path) if path and path[0] not in o.ignored_attributes else None

    def file(self, node: ast.Call) -> str:
        """The file that ``_path`` names: a directory unless its last part has a suffix."""
        given = next((k.value for k in node.keywords if k.arg == "_path"), None)
        if not (isinstance(given, ast.Constant) and isinstance(given.value, str) and given.value):
            return self.options.default_file
        path = PurePosixPath(given.value)
        return str(path) if "." in path.name[1:] else str(path / self.options.default_file)


def _repeats_keyword(tree: ast.AST) -> bool:
    return any(len(names) != len(set(names)) for n in ast.walk(tree) if isinstance(n, ast.Call) for names in [[k.arg for k in n.keywords if k.arg]])


def scan(content: bytes, options: ScanOptions) -> tuple[list[tuple[str, str, list[str]]], str | None]:
    """Calls (key, file, arguments) in their order, and why there are none, if so."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(content.decode("utf-8").removeprefix("﻿"))
        if _repeats_keyword(tree):
            return [], "repeated keyword"
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [], type(e).__name__
    visitor = _Visitor(options)
    visitor.visit(tree)
    good = [c for c in visitor.found if _encodable(c[0]) and _encodable(c[1])]
    return good, None


def _encodable(text: str) -> bool:
    try:
        text.encode()
    except UnicodeEncodeError:
        return False
    return True

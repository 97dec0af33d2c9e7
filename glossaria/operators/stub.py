"""The tree of keys, and typed stubs made of it."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import TextIO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import literal_escape, pascal_case, prefixes

#: Nodes of a partition of the stub's text, which the driver holds one at a time.
NODES = 50_000
#: Sorts behind every part of a key.
END = "\U0010ffff"


def last_messages(entries: DataFrame) -> DataFrame:
    """(key, args, translation): of a repeated key the last by (file, position); only messages with a value."""
    named = entries.filter("kind = 'message' and has_value")
    best = named.groupBy("key").agg(F.max_by(F.struct("args", "shown"), F.struct("abs_path", "position")).alias("m"))
    return best.select("key", F.col("m.args").alias("args"), F.col("m.shown").alias("translation"))


def prefix_tree(messages: DataFrame) -> DataFrame:
    """One row for each node: path, parent, name, depth, whether a message ends there and has
    children, its arguments and translation, and the forms that a stub needs.

    Keys are split at dashes; every beginning is a node. One aggregate over the paths:
    hot beginnings are combined before the shuffle.
    """
    nodes = messages.select(F.explode(prefixes(F.col("key"))).alias("path"), F.size(F.split("key", "-")).alias("parts"), "args", "translation")
    ends = F.col("parts") == F.size("path")
    tree = nodes.groupBy("path").agg(F.max(ends).alias("has_meta"), F.max(~ends).alias("has_children"), F.max(F.when(ends, F.struct("args", "translation"))).alias("meta"))
    name = F.element_at("path", -1)
    return tree.select("path", F.slice("path", 1, F.size("path") - 1).alias("parent"), name.alias("name"), F.size("path").alias("depth"), "has_meta", "has_children", "meta.args", "meta.translation", F.concat(F.lit("__"), pascal_case(name)).alias("class_name"), F.concat(F.lit("'"), literal_escape(F.col("meta.translation")), F.lit("'")).alias("literal"))


def _method(name: str, args: str, result: str, pad: str, marks: tuple[str, ...] = (), word: str = "def") -> list[str]:
    return [*(f"{pad}@{m}" for m in marks), f"{pad}{word} {name}({args}) -> {result}:", f"{pad}    ...", ""]


def stub_head(empty: bool, proxy_module: str = "aiogram_i18n") -> str:
    """What a stub module has before its messages, or all of it if there are none."""
    any_kw, pad = "**kwargs: Any", "    "
    imports = [("collections.abc", "Generator"), ("contextlib", "contextmanager"), ("typing", "Any, Literal, overload"), (proxy_module, "LazyProxy")]
    out = ["# mypy: ignore-errors", "# This is auto-generated file, do not edit!", *(f"from {m} import {n}" for m, n in imports), ""]
    context = [
        _method("get", f"self, key: str, /, {any_kw}", "str", pad),
        _method("set_locale", f"self, locale: str, {any_kw}", "None", pad, word="async def"),
        *(_method(n, f"self, {a}", "Generator[I18nContext]", pad, ("contextmanager",)) for n, a in (("use_locale", "locale: str"), ("use_context", any_kw))),
        _method("set_context", f"self, {any_kw}", "None", pad),
    ]
    out += ["class I18nContext(I18nStub):", "", *sum(context, [])]
    factory = [_method("set_separator", "self, key_separator: str", "None", pad), _method("__call__", "self, key: str, /, **kwargs: dict[str, Any]", "LazyProxy", pad)]
    out += ["class LazyFactory(I18nStub):", f"{pad}key_separator: str", "", *sum(factory, [])]
    out += ["L: LazyFactory", "", "class I18nStub:", "", f"{pad}pass" if empty else ""]
    return "\n".join(out) + "\n"


def _opened(path, has_meta: bool, has_children: bool, args, translation: str | None, class_name: str, literal: str | None) -> tuple[list[str], str]:
    """Lines of the stub, and JSON without the comma before it, where a node begins."""
    pad, inner, lines = "    " * len(path), "  " * (len(path) + 1), []
    tree = f"\n{'  ' * len(path)}{json.dumps(path[-1], ensure_ascii=False)}: {{"
    if has_meta:
        typed = "".join(f"{a}: Any, " for a in args)
        marks = ("staticmethod", "overload") if has_children else ("staticmethod",)
        lines += _method(path[-1], ("*, " if typed else "") + typed + "**kwargs: Any", f"Literal[{literal}]", pad, marks)
        tree += f'\n{inner}"$_meta$": ' + json.dumps({"args": list(args), "translation": translation}, indent=2, ensure_ascii=False).replace("\n", f"\n{inner}")
    return (lines + [f"{pad}class {class_name}:", ""], tree) if has_children else (lines, tree + f"\n{'  ' * len(path)}}}")


def texts(tree: DataFrame) -> DataFrame:
    """(stub, tree, continues, opens): pieces of the stub's messages and of the tree's JSON, in order.

    A node's text is where it begins, and for one with children also where it ends, behind all of
    them. Sorted by path that is the order of the text, so the tree is cut into ranges, each a
    partition of bounded size. Whether a comma belongs before a piece is seen from the one before:
    ``continues`` says that it begins with a node, ``opens`` that it ends where a first child would follow.
    """
    n = 1 + tree.count() // NODES
    ends = F.concat("path", F.array(F.lit(END)))
    events = tree.withColumn("at", F.explode(F.when(F.col("has_children"), F.array("path", ends)).otherwise(F.array("path"))))
    events = events.select("at", F.when(F.col("at") == F.col("path"), F.col("has_meta")).alias("has_meta"), "has_children", "args", "translation", "class_name", "literal")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lines, json_text, begins, opens = [], [], [], True
            for path, has_meta, *rest in frame.itertuples(index=False, name=None):
                begins.append(has_meta is not None)
                if has_meta is not None:
                    own, text = _opened(path, has_meta, *rest)
                    lines += own
                    json_text.append(text if opens else "," + text)
                    opens = bool(rest[0]) and not has_meta
                else:
                    lines.append(f"{'    ' * (len(path) - 1)}{path[-2]} = {rest[3]}")
                    json_text.append(f"\n{'  ' * (len(path) - 1)}}}")
                    opens = False
            if lines or json_text:
                yield pd.DataFrame({"stub": ["".join(x + "\n" for x in lines)], "tree": ["".join(json_text)], "continues": begins[:1], "opens": [opens]})

    return events.repartitionByRange(n, "at").sortWithinPartitions("at").mapInPandas(run, "stub string, tree string, continues boolean, opens boolean")


def write_stub(pieces: DataFrame, stub: TextIO, tree: TextIO | None = None) -> None:
    """Writes the module, and the tree as JSON with messages under "$_meta$", a partition of ``texts`` at a time."""
    opens, empty = True, True
    for r in pieces.toLocalIterator():
        if empty:
            stub.write(stub_head(False))
        stub.write(r.stub)
        if tree:
            tree.write(("{" if empty else "") + ("," if r.continues and not opens else "") + r.tree)
        opens, empty = r.opens, False
    if empty:
        stub.write(stub_head(True))
    if tree:
        tree.write("{}" if empty else "\n}")

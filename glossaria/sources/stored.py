"""Tables of catalog files and of calls in source files."""

from __future__ import annotations

import json
import pickle
import tempfile
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fluent
from ..functions.pyscan import ScanOptions, scan
from .files import read_content

#: Rows that a Python worker holds at a time.
ROWS = 5000
CALLS = "code_path string, ordinal int, key string, ftl_path string, kwargs array<string>, error string"
ENTRIES = (
    "locale string, abs_path string, rel_path string, position int, kind string, key string, text string, has_value boolean, "
    "ignore_untranslated boolean, src string, source_line int, vars array<string>, refs array<struct<ref_kind: string, ref: string>>, args array<string>, shown string, error string"
)


def code_calls(files: DataFrame, options: ScanOptions) -> DataFrame:
    """One row for each call, in its file's order, and one with ``error`` for a file that isn't Python.

    Files without any of the wanted words, empty ones and those that aren't UTF-8 are
    dropped before Python sees them.
    """
    wanted = F.lit(False)
    for w in options.words():
        wanted = wanted | F.contains(F.col("content"), F.lit(w.encode()))
    kept = files.filter((F.col("size") > 0) & wanted & F.is_valid_utf8(F.col("content").cast("string"))).select("path", "content")

    names = ["code_path", "ordinal", "key", "ftl_path", "kwargs", "error"]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                calls, error = scan(bytes(content), options)
                yield from ((path, i, *c, None) for i, c in enumerate(calls))
                if error:
                    yield (path, None, None, None, None, error)

    return kept.mapInPandas(lambda frames: _frames(rows(frames), names), CALLS)


def _frames(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    while block := list(islice(rows, ROWS)):
        yield pd.DataFrame(block, columns=columns)


def entry_rows(locale: str, path: str, rel: str, content: bytes) -> Iterator[tuple]:
    """The rows of a file, or a single "error" row. Since an error at its end leaves none of the
    others, those of a large file wait on disk until it has been read."""
    with tempfile.SpooledTemporaryFile(max_size=4 << 20) as kept:
        rows, blocks = [], 0
        try:
            for i, e in enumerate(fluent.entries(content.decode("utf-8"), strict=True)):
                rows.append(_entry_row(locale, path, rel, i, e))
                if len(rows) == ROWS:
                    pickle.dump(rows, kept)
                    rows, blocks = [], blocks + 1
        except (UnicodeDecodeError, fluent.FluentError) as e:
            yield (locale, path, rel, -1, "error", None, None, None, None, None, None, None, None, None, None, str(e))
            return
        kept.seek(0)
        for _ in range(blocks):
            yield from pickle.load(kept)
        yield from rows


def _entry_row(locale: str, path: str, rel: str, i: int, e: fluent.Entry) -> tuple:
    named = e.kind in ("message", "term")
    names, refs = fluent.reach(e.value) if named else ([], [])
    return (
        locale, path, rel, i, e.kind, e.key, fluent.plain_text(e.value) if named else None, e.value is not None, fluent.ignores_untranslated(e.comment) if named else False,
        fluent.serialize([e]).lstrip("\n") if not named else fluent.serialize_entry(e), e.line, names, [{"ref_kind": k, "ref": r} for k, r in refs], fluent.signature(e.value) if named else [], fluent.shown(e.value) if named and e.value else None, None,
    )


def stored_entries(files: DataFrame, locale_of: str = "root") -> DataFrame:
    """All entries of Fluent files, a row each; a file that can't be parsed gives an "error" row.

    The locale is the last part of the column ``locale_of``. Files that come without content are
    read here, one at a time.
    """
    names = [c.split(" ")[0] for c in ENTRIES.replace("ref_kind: string, ref: string", "").split(", ")]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for frame in frames:
            for root, path, rel, content in zip(frame["at"], frame["path"], frame["rel_path"], frame["content"], strict=True):
                content = read_content(path) if content is None else bytes(content)
                if content is not None:
                    yield from entry_rows(root.rstrip("/").rsplit("/", 1)[-1], path, rel, content)

    return files.select(F.col(locale_of).alias("at"), "path", "rel_path", "content").mapInPandas(lambda frames: _frames(rows(frames), names), ENTRIES)


def raise_on_errors(entries: DataFrame) -> None:
    """Fails with every file that couldn't be parsed."""
    bad = entries.filter("kind = 'error'").select("abs_path", "error").orderBy("abs_path").collect()
    if bad:
        raise fluent.FluentError("; ".join(f"{p}: {e}" for p, e in bad))


def as_json(value) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2)

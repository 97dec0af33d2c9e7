"""Catalog files from reconciled entries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fluent
from ..functions.text import line_endings


def new_message(key: str, kwargs: list[str]) -> fluent.Entry:
    """The placeholder of a key: its name, then its arguments."""
    return fluent.Entry("message", key, (key, *(("var", k) for k in kwargs)))


def render_entry(src: str | None, kind: str, key: str, kwargs: list[str] | None, commented: bool, compat: bool) -> tuple[str, int]:
    """An entry's text in its file, and whether it is a message. Blank lines around a free comment are its own."""
    if src is None:
        entry = new_message(key, list(kwargs if kwargs is not None else []))
    else:
        entry = next(fluent.entries(src), fluent.Entry(kind, comment=[""]))
    entry = fluent.commented(entry, compat) if commented else entry
    return ("\n" if entry.kind in fluent.KINDS.values() else "") + fluent.serialize([entry]), int(entry.kind == "message")


def render_files(rows: DataFrame, endings: str = "default", compat: bool = True) -> DataFrame:
    """(locale, rel_path, content, n_messages) from rows (locale, rel_path, position, key, kind, src,
    kwargs, commented): stored entries by position, then new ones (no src) by key.

    Entries are rendered one by one; Python never holds a file. A file's text, which a person edits,
    is put together by one task.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [render_entry(*r, compat) for r in zip(frame["src"], frame["kind"], frame["key"], frame["kwargs"], frame["commented"], strict=True)]
            yield pd.concat([frame[["locale", "rel_path", "position", "key"]], pd.DataFrame(made, columns=["piece", "n"], index=frame.index)], axis=1)

    pieces = rows.mapInPandas(run, "locale string, rel_path string, position int, key string, piece string, n int")
    order = F.struct(F.col("position").isNull().alias("new"), "position", "key", "piece")
    files = pieces.groupBy("locale", "rel_path").agg(F.sort_array(F.collect_list(order)).alias("pieces"), F.sum("n").cast("int").alias("n_messages"))
    content = F.regexp_replace(F.array_join(F.transform("pieces", lambda p: p["piece"]), ""), r"\A\n", "")
    return files.select("locale", "rel_path", line_endings(content, endings).alias("content"), "n_messages")

"""Files written from rows, each to the path that its row names."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import TextIO

from pyspark.sql import DataFrame


@contextmanager
def whole_file(path: str) -> Iterator[TextIO]:
    """A file to write. The folder is made if need be; the file appears whole or not at all."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "w", encoding="utf-8", newline="") as f:
        yield f
    os.replace(part, path)


def write_text(path: str, content: str) -> None:
    with whole_file(path) as f:
        f.write(content)


def write_files(df: DataFrame, path_col: str = "path", content_col: str = "content") -> None:
    """Every row's content to its path, from the executors; a repeated task writes the same."""

    def run(rows: Iterator) -> None:
        for path, content in rows:
            write_text(path, content)

    df.select(path_col, content_col).foreachPartition(run)


def normal_output_path(path: str, form: str) -> str:
    """``path`` with .txt or .json, if it has no suffix."""
    return path if os.path.splitext(path)[1] else path + {"json": ".json"}.get(form, ".txt")

"""Files of a tree as a table, hidden and underscored names included as asked.

Spark's own file sources pass over names that begin with "_" or "."; this one lists
the tree itself, applies ignore rules and globs while it lists, and gives every task
a chunk of many small files.
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "root string, path string, rel_path string, size bigint, mtime_ns bigint, content binary"
#: A task reads so many files or bytes at most. Files read with their content are one batch of its Python worker.
FILES, BYTES = 2000, 8 << 20


def glob_regex(glob: str) -> re.Pattern:
    """A glob over whole paths, in which * also crosses slashes, and {a,b} are choices."""
    out, depth, i = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            while glob[i + 1 : i + 2] == "*":
                i += 1
            if glob[i + 1 : i + 2] == "/" and glob[i - 1 : i] == "*":
                out.append("(?:.*/)?")
                i += 1
            else:
                out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (j := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : j].replace("\\", "\\\\")
            out.append(f"[{'^' + body[1:] if body[0] in '!^' else body}]")
            i = j
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    return re.compile("".join(out) + r"\Z", re.DOTALL)


class IgnoreRules:
    """The patterns of one ignore file, for paths below its folder."""

    def __init__(self, folder: str, lines: list[str]):
        self.folder, self.rules = folder, []
        for line in lines:
            line = line.rstrip("\n").rstrip("\r")
            line = line if line.endswith("\\ ") else line.rstrip(" ")
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line.removeprefix("\\")
            folders_only = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            parts = [".*" if p == "**" else fnmatch.translate(p)[:-2].replace("(?s:.*)", "[^/]*").replace(".*", "[^/]*") for p in line.lstrip("/").split("/")]
            body = "/".join(parts).replace(".*/", "(?:.*/)?").replace("/.*", "/.*")
            self.rules.append((keep, folders_only, re.compile(("" if anchored else "(?:.*/)?") + body + r"\Z", re.DOTALL)))

    def verdict(self, path: str, folder: bool) -> bool | None:
        """True: ignored; False: kept by a "!" rule; None: no rule fits."""
        rel = os.path.relpath(path, self.folder).replace(os.sep, "/")
        out = None
        for keep, folders_only, regex in self.rules:
            if (folder or not folders_only) and regex.match(rel):
                out = not keep
        return out


def walk(root: str, suffix: str, ignore_files: tuple[str, ...] = (), hidden: bool = False) -> Iterator[str]:
    """Files below ``root`` with the suffix, sorted in each folder; errors are passed over."""
    if os.path.isfile(root):
        if root.endswith(suffix):
            yield root
        return

    def below(folder: str, rules: list[IgnoreRules]) -> Iterator[str]:
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for name in reversed(ignore_files):  # the first named wins: its rules are asked first
            try:
                with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                    rules = [*rules, IgnoreRules(folder, f.readlines())]
            except OSError:
                pass
        for e in entries:
            if not hidden and e.name.startswith("."):
                continue
            is_folder = e.is_dir(follow_symlinks=False)
            said = next((v for r in reversed(rules) if (v := r.verdict(e.path, is_folder)) is not None), None)
            if said:
                continue
            if is_folder:
                yield from below(e.path, rules)
            elif e.name.endswith(suffix) and e.is_file():
                yield e.path

    yield from below(root, [])


def read_content(path: str) -> bytes | None:
    """None, if it can't be read."""
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return None


class _Chunk(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        super().__init__(0)
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[_Chunk]:
        o = self.options
        drop = [glob_regex(g) for g in filter(None, o.get("exclude", "").split("\n"))]
        ignore = tuple(filter(None, o.get("ignorefiles", "").split("\n")))
        chunks, files, size = [], [], 0
        for root in filter(None, o["roots"].split("\n")):
            for path in walk(root, o.get("suffix", ""), ignore, o.get("hidden", "false").lower() == "true"):
                if any(d.match(path) for d in drop):
                    continue
                files.append((root, path))
                size += os.stat(path).st_size
                if len(files) >= FILES or size >= BYTES:
                    chunks.append(_Chunk(files))
                    files, size = [], 0
        return [*chunks, _Chunk(files)] if files or not chunks else chunks

    def read(self, partition: _Chunk) -> Iterator[tuple]:
        wanted = self.options.get("content", "true").lower() == "true"
        for root, path in partition.files:
            try:
                s = os.stat(path)
            except OSError:
                continue
            content = read_content(path) if wanted else None
            if wanted and content is None:
                continue
            yield root, path, os.path.relpath(path, root).replace(os.sep, "/"), s.st_size, s.st_mtime_ns, content


class SourceFiles(DataSource):
    """Format "srcfiles"; options roots, suffix, exclude, ignorefiles (line-separated), hidden, content (false: null)."""

    @classmethod
    def name(cls) -> str:
        return "srcfiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_files(spark: SparkSession, roots: list[str], suffix: str, exclude: tuple[str, ...] = (), ignore_files: tuple[str, ...] = (".gitignore",), hidden: bool = False, content: bool = True) -> DataFrame:
    """Files below the roots that are still there, with their content if asked for. Missing roots have no files."""
    spark.dataSource.register(SourceFiles)
    options = {"roots": "\n".join(roots), "suffix": suffix, "exclude": "\n".join(exclude), "ignorefiles": "\n".join(ignore_files), "hidden": str(hidden).lower(), "content": str(content).lower()}
    return spark.read.format("srcfiles").options(**options).load()


def discover_locales(path: str) -> list[str]:
    """Names of the folders in ``path``, sorted; an error if it can't be read."""
    return sorted(e.name for e in os.scandir(path) if e.is_dir())

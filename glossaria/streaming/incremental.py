"""Calls of unchanged files taken from state instead of parsing again."""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pyscan import ScanOptions
from ..sources.stored import code_calls

VERSION = 1
STATE = "path string, size long, mtime_ns long, calls array<struct<ordinal: int, key: string, ftl_path: string, kwargs: array<string>>>"


def fingerprint(options: ScanOptions) -> str:
    """Of all that decides what a file's calls are; other state is another's."""
    return hashlib.sha256(f"{VERSION}:{options.fingerprint()}".encode()).hexdigest()[:16]


def cache_folder(path: str | None) -> str:
    return path or ".glossaria-cache"


def load_state(spark: SparkSession, path: str, options: ScanOptions, clear: bool = False) -> DataFrame:
    """The newest complete state, or an empty table if there is none that fits or can be read."""
    home = os.path.join(path, f"v{VERSION}-{fingerprint(options)}")
    if clear:
        shutil.rmtree(path, ignore_errors=True)
    try:
        done = sorted(d for d in os.listdir(home) if os.path.exists(os.path.join(home, d, "_SUCCESS")))
        state = spark.read.schema(STATE).parquet(os.path.join(home, done[-1]))
        state.isEmpty()
        return state
    except Exception:  # whatever is wrong with a cache, work goes on without it
        return spark.createDataFrame([], STATE)


def split_files(files: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to parse, state to use again): equal path, size and time mean an unchanged file."""
    key = ["path", "size", "mtime_ns"]
    return files.join(state.select(*key), key, "left_anti"), state.join(files.select(*key), key, "left_semi")


def next_state(parsed: DataFrame, files: DataFrame, kept: DataFrame) -> DataFrame:
    """State after a run; files without calls and files that are gone aren't in it."""
    calls = parsed.filter("key is not null").groupBy("code_path").agg(F.sort_array(F.collect_list(F.struct("ordinal", "key", "ftl_path", "kwargs"))).alias("calls"))
    new = files.select("path", "size", "mtime_ns").join(calls, F.col("path") == F.col("code_path")).select("path", "size", "mtime_ns", "calls")
    return new.unionByName(kept)


def save_state(state: DataFrame, path: str, options: ScanOptions) -> str:
    """Writes a new version beside the old ones, then removes those."""
    home = os.path.join(path, f"v{VERSION}-{fingerprint(options)}")
    old = os.listdir(home) if os.path.isdir(home) else []
    out = os.path.join(home, f"{len(old) and max((int(d.split('-')[0]) for d in old if d.split('-')[0].isdigit()), default=0) + 1:08d}-{uuid.uuid4().hex[:8]}")
    state.write.parquet(out)
    for d in old:
        shutil.rmtree(os.path.join(home, d), ignore_errors=True)
    return out


def incremental_calls(files: DataFrame, options: ScanOptions, path: str, clear: bool = False) -> DataFrame:
    """All files' calls, parsing only new and changed files, and the state brought up to date."""
    state = load_state(files.sparkSession, path, options, clear)
    changed, kept = split_files(files, state)
    parsed = code_calls(changed, options)
    where = save_state(next_state(parsed, changed, kept), path, options)
    fresh = files.sparkSession.read.schema(STATE).parquet(where)
    return fresh.select(F.col("path").alias("code_path"), F.explode("calls").alias("c")).select("code_path", "c.ordinal", "c.key", "c.ftl_path", "c.kwargs", F.lit(None).cast("string").alias("error"))

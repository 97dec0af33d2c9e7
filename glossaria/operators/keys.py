"""Calls merged to one row a key, with the conflicts between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class KeyConflict(ValueError):
    """Keys that calls use with different files or arguments."""


def merge_calls(calls: DataFrame) -> DataFrame:
    """One row for each key: its first call by (code_path, ordinal), and counts of variants.

    One partial and final aggregate; a hot key costs one row a task.
    """
    first = F.min_by(F.struct("code_path", "ftl_path", "kwargs"), F.struct("code_path", "ordinal"))
    merged = calls.filter("key is not null").groupBy("key").agg(first.alias("first"), F.count_distinct("ftl_path").alias("n_paths"), F.count_distinct(F.to_json(F.struct("kwargs"))).alias("n_messages"), F.count(F.lit(1)).alias("n_calls"))
    return merged.select("key", "first.ftl_path", "first.kwargs", "first.code_path", "n_paths", "n_messages", "n_calls")


def conflicts(merged: DataFrame) -> DataFrame:
    """Keys whose calls differ in file, or in arguments or their order."""
    reason = F.when(F.col("n_paths") > 1, "path").otherwise("message")
    return merged.filter("n_paths > 1 or n_messages > 1").select("key", "n_paths", "n_messages", "n_calls", reason.alias("reason"))


def checked(merged: DataFrame) -> DataFrame:
    """``merged``, or an error with all conflicts."""
    bad = conflicts(merged).orderBy("key").collect()
    if bad:
        raise KeyConflict("; ".join(f"{r.key}: {r.n_paths} files, {r.n_messages} forms" for r in bad))
    return merged

"""Reachability over references."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _shared_folder(spark: SparkSession) -> None:
    """Checkpoints go to the folder that the session names; only a local session may do without."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir isn't set: it must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="glossaria-"))


def spread(edges: DataFrame, labels: DataFrame, on: list[str] | None = None) -> DataFrame:
    """(on..., node, label): the labels of each node, which move along ``edges`` (on..., src, dst).

    Every round moves only labels that are new at their node, so cycles end; it costs one
    join and one anti-join, and what is new is checkpointed. Rounds follow the longest
    chain. The result has a row for each label of each node, not for pairs of nodes.
    """
    on = on or []
    _shared_folder(edges.sparkSession)
    edges = edges.select(*on, F.col("src").alias("node"), "dst").distinct().checkpoint()
    seen = new = labels.select(*on, "node", "label").distinct().checkpoint()
    while not new.isEmpty():
        step = new.join(edges, [*on, "node"]).select(*on, F.col("dst").alias("node"), "label").distinct()
        new = step.join(seen, [*on, "node", "label"], "left_anti").checkpoint()
        seen = seen.union(new)
    return seen


def reachable(edges: DataFrame, sources: DataFrame, on: list[str] | None = None) -> DataFrame:
    """(on..., source, node): all nodes that one step or more of ``edges`` (on..., src, dst) reaches
    from ``sources`` (on..., source), as pairs."""
    on = on or []
    first = sources.select(*on, "source").distinct().join(edges.withColumnRenamed("src", "source"), [*on, "source"]).select(*on, F.col("dst").alias("node"), F.col("source").alias("label"))
    return spread(edges, first, on).select(*on, F.col("label").alias("source"), "node")

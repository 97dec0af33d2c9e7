"""Shards by proportional stratified interleaving, in DataFrame operations only (operator 3).

Within each source, rows are ranked in a seeded-shuffled order. A row's fractional
rank is (rank - 1/2) / rows of its source. Rows sorted by it are cut into shards of
equal counts, so every shard holds the sources in the proportions of the whole.

No window is used. Rows are sorted over range partitions, whose bounds Spark samples from
the sort key itself, and a row's place is its partition's offset and its number in there:
once in (source, shuffle) order, for ranks, and once in fractional order. A source that
holds a third of all rows, a million sources of one row, and equal ids are cut like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

ROW_BYTES = 16
#: Bits of a row's number within its partition, in numbers that rise over partitions.
_BITS = 33


def placed(df: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
    """``df`` with ``place``, from 0 in the given order over all rows, and the number of rows.

    One row for each partition is added up in one task and broadcast.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = materialise(rows, "placed")
    part = F.shiftright("at", _BITS)
    sums = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = materialise(sums.select("part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "parts")
    total = sums.agg(F.sum("n")).first()[0] or 0
    out = rows.join(F.broadcast(sums.select("part", "before")), part == F.col("part"))
    return out.withColumn("place", F.col("before") + F.col("at").bitwiseAND((1 << _BITS) - 1)).drop("at", "part", "before"), total


def interleave(df: DataFrame, n_shards: int = 40, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of ``df``: the id, ``size`` (UTF-8 bytes of the text plus 16),
    ``text_crc32``, ``law`` ("rows"), ``shard``, ``slot`` and ``grown_shard`` (null).

    The law is ``rows``: shards' counts differ by one at most. ``slot`` is gapless
    from 0 in each shard, in the interleaved order. A null text counts as empty; null
    sources are a source of their own; null ids come first. Ties are broken by id,
    checksum and size; rows equal in all of them get neighbouring places in any order.
    An empty table gives an empty table; other columns are not read. Texts, however long,
    are read once and never shuffled: only id, size and checksum move, twice by ranges.
    """
    text, where = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.col(f"`{source_col}`")
    shuffled = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary"))
    rows = df.select(
        F.col(f"`{id_col}`").alias("id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.when(where.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), where)).alias("stratum"),
        shuffled.alias("key"),
        F.monotonically_increasing_id().alias("row"),  # cuts runs of equal rows, too
    )
    rows = materialise(rows, "rows")
    order = [F.col("stratum"), F.col("key"), F.col("id").asc_nulls_first(), F.col("crc"), F.col("size"), F.col("row")]
    ranked, total = placed(rows, order)
    strata = ranked.groupBy("stratum").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    ranked = ranked.join(strata, "stratum").withColumn("fraction", (F.col("place") - F.col("first") + 0.5) / F.col("n")).drop("place", "first", "n")
    out, total = placed(ranked, [F.col("fraction"), *order])
    out = out.withColumn("shard", F.expr(f"(place * {n_shards}) div {max(1, total)}"))
    first = F.expr(f"(shard * {total} + {n_shards - 1}) div {n_shards}")
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("place") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )

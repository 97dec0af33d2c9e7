"""Keys in code against stored keys, for every locale at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .closure import spread


def argument_set(c: Column) -> Column:
    return F.sort_array(F.array_distinct(c))


def statuses(code: DataFrame, stored: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """The status of each key of each locale by one full outer join on (locale, key).

    ``code`` and ``stored`` have locale, key, ftl_path and kwargs; ``protected`` has
    (locale, key) that stored keys in use refer to. The first that fits: added, moved,
    kwargs_changed, unchanged, retained, obsolete.
    """
    c = code.select("locale", "key", F.col("ftl_path").alias("code_file"), F.col("kwargs").alias("code_kwargs"), F.lit(True).alias("in_code"))
    s = stored.select("locale", "key", F.col("ftl_path").alias("stored_file"), F.col("kwargs").alias("stored_kwargs"), F.lit(True).alias("in_store"))
    both = c.join(s, ["locale", "key"], "full")
    safe = F.lit(None).cast("boolean")
    if protected is not None:
        both = both.join(protected.select("locale", "key").distinct().withColumn("safe", F.lit(True)), ["locale", "key"], "left")
        safe = F.col("safe")
    status = (
        F.when(F.col("in_store").isNull(), "added")
        .when(F.col("in_code").isNull(), F.when(safe, "retained").otherwise("obsolete"))
        .when(F.col("code_file") != F.col("stored_file"), "moved")
        .when(argument_set(F.col("code_kwargs")) != argument_set(F.col("stored_kwargs")), "kwargs_changed")
        .otherwise("unchanged")
    )
    return both.select("locale", "key", status.alias("status"), "code_file", "code_kwargs", "stored_file", "stored_kwargs")


def statistics(status: DataFrame) -> DataFrame:
    """Counters a locale; warn mode doesn't change them."""
    return status.groupBy("locale").agg(
        F.count_if(F.col("status") == "added").alias("added"),
        F.count_if(F.col("status").isin("moved", "kwargs_changed")).alias("updated"),
        F.count_if(F.col("status").isin("moved", "kwargs_changed", "obsolete")).alias("commented"),
        F.count_if(F.col("status") == "unchanged").alias("unchanged"),
        F.count_if(F.col("status") == "retained").alias("retained"),
    )


def winners(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(winners, duplicates) of stored messages and terms: of a repeated key the last by (file, position)."""
    named = entries.filter("kind in ('message', 'term')")
    last = named.groupBy("locale", "kind", "key").agg(F.max(F.struct("rel_path", "position")).alias("last"), F.count(F.lit(1)).alias("n"))
    best = named.join(last.select("locale", "kind", "key", F.col("last.rel_path").alias("rel_path"), F.col("last.position").alias("position")), ["locale", "kind", "key", "rel_path", "position"])
    return best, last.filter("n > 1").select("locale", "kind", "key", "n", F.col("last.rel_path").alias("kept_in"))


def reference_edges(entries: DataFrame) -> DataFrame:
    """(locale, src, dst) with nodes "message:key" and "term:key"; references to what isn't there are left out."""
    edges = entries.select("locale", F.concat_ws(":", "kind", "key").alias("src"), F.explode("refs").alias("r")).select("locale", "src", F.concat_ws(":", "r.ref_kind", "r.ref").alias("dst"))
    known = entries.select("locale", F.concat_ws(":", "kind", "key").alias("dst")).distinct()
    return edges.join(known, ["locale", "dst"], "left_semi").select("locale", "src", "dst")


def unresolved(entries: DataFrame) -> DataFrame:
    """(locale, key, ref_kind, ref) of references to what isn't stored."""
    refs = entries.select("locale", "kind", "key", F.explode("refs").alias("r")).select("locale", "kind", "key", "r.ref_kind", "r.ref")
    known = entries.select("locale", F.col("kind").alias("ref_kind"), F.col("key").alias("ref")).distinct()
    return refs.join(known, ["locale", "ref_kind", "ref"], "left_anti").select("locale", "kind", "key", "ref_kind", "ref")


def transitive_arguments(best: DataFrame) -> DataFrame:
    """(locale, key, kwargs) of stored messages: their own variables and those of all they reach.

    Variables move from what is referred to, against the references.
    """
    nodes = best.select("locale", F.concat_ws(":", "kind", "key").alias("node"), "vars")
    back = reference_edges(best).select("locale", F.col("dst").alias("src"), F.col("src").alias("dst"))
    all_of = spread(back, nodes.select("locale", "node", F.explode("vars").alias("label")), ["locale"])
    merged = all_of.filter("node like 'message:%'").groupBy("locale", "node").agg(F.sort_array(F.collect_set("label")).alias("kwargs"))
    none = F.array().cast("array<string>")
    out = nodes.filter("node like 'message:%'").select("locale", "node").distinct().join(merged, ["locale", "node"], "left")
    return out.select("locale", F.expr("substring(node, 9)").alias("key"), F.coalesce("kwargs", none).alias("kwargs"))


def protected_keys(best: DataFrame, sources: DataFrame, through_terms: bool = False) -> DataFrame:
    """(locale, key) of messages that the messages ``sources`` (locale, key) reach.

    Without crossing a term, unless ``through_terms``.
    """
    edges = reference_edges(best)
    if not through_terms:
        edges = edges.filter("src like 'message:%' and dst like 'message:%'")
    start = sources.select("locale", F.concat(F.lit("message:"), "key").alias("src"))
    first = edges.join(start, ["locale", "src"], "left_semi").select("locale", F.col("dst").alias("node"), F.lit(True).alias("label"))
    return spread(edges, first, ["locale"]).filter("node like 'message:%'").select("locale", F.expr("substring(node, 9)").alias("key"))

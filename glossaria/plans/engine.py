"""The verbs: extract, check_untranslated and generate_stub."""

from __future__ import annotations

import os
from contextlib import nullcontext
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fluent import KINDS
from ..functions.pyscan import ScanOptions
from ..operators import closure, keys, reconcile, render, stub
from ..operators import untranslated as report
from ..sources.files import discover_locales, read_files
from ..sources.sinks import whole_file, write_files
from ..sources.stored import code_calls, raise_on_errors, stored_entries
from ..streaming.incremental import cache_folder, incremental_calls

EXCLUDED = (".venv", "venv", ".git", "__pycache__", ".pytest_cache")


@dataclass(frozen=True)
class ExtractConfig:
    code_path: str
    output_path: str
    languages: tuple[str, ...] = ("en",)
    scan: ScanOptions = field(default_factory=ScanOptions)
    exclude: tuple[str, ...] = tuple(f"*/{d}/*" for d in EXCLUDED)
    comment_junks: bool = False
    comment_keys_mode: str = "comment"  # or warn
    line_endings: str = "default"
    dry_run: bool = False
    cache: bool = False
    cache_path: str | None = None
    clear_cache: bool = False
    protect_through_terms: bool = False
    compat: bool = True


@dataclass
class ExtractResult:
    statistics: dict
    status: DataFrame
    files: DataFrame
    duplicates: DataFrame
    unresolved: DataFrame


def _read_catalog(spark: SparkSession, folders: list[str], ignore: bool = True) -> DataFrame:
    entries = stored_entries(read_files(spark, folders, ".ftl", ignore_files=(".ignore", ".gitignore") if ignore else (), hidden=not ignore, content=False))
    return entries


def code_keys(spark: SparkSession, cfg: ExtractConfig) -> tuple[DataFrame, DataFrame]:
    """(calls, keys) of the code; conflicts between calls raise."""
    files = read_files(spark, [cfg.code_path], ".py", cfg.exclude)
    cached = cfg.cache or cfg.cache_path or cfg.clear_cache
    calls = (incremental_calls(files, cfg.scan, cache_folder(cfg.cache_path), cfg.clear_cache) if cached else code_calls(files, cfg.scan)).persist()
    return calls, keys.checked(keys.merge_calls(calls))


def plan(code: DataFrame, entries: DataFrame, languages: DataFrame, cfg: ExtractConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(status, rows to render, duplicates) from keys in code and stored entries.

    The table of languages is a list that a person gives, so it is broadcast.
    """
    best, duplicates = reconcile.winners(entries)
    messages = best.filter("kind = 'message'")
    wanted = code.withColumn("locale", F.explode(F.array(*[F.lit(r[0]) for r in languages.collect()])))
    stored = messages.select("locale", "key", F.col("rel_path").alias("ftl_path")).join(reconcile.transitive_arguments(best), ["locale", "key"], "left").withColumn("kwargs", F.coalesce("kwargs", F.array().cast("array<string>")))
    in_use = stored.join(wanted.select("locale", "key", F.col("ftl_path").alias("code_file")), ["locale", "key"]).filter("ftl_path = code_file").select("locale", "key")
    status = reconcile.statuses(wanted, stored, reconcile.protected_keys(best, in_use, cfg.protect_through_terms)).checkpoint()
    out_of_use = F.col("status").isin("moved", "kwargs_changed", "obsolete")
    old = messages.select("locale", "rel_path", "position", "key", "kind", "src").join(status.select("locale", "key", "status"), ["locale", "key"], "left")
    old = old.select("locale", "rel_path", "position", "key", "kind", "src", F.lit(None).cast("array<string>").alias("kwargs"), (out_of_use & F.lit(cfg.comment_keys_mode == "comment")).alias("commented"))
    lost = entries.filter("kind in ('message', 'term')").join(best.select("locale", "kind", "key", "rel_path", "position"), ["locale", "kind", "key", "rel_path", "position"], "left_anti")
    kept = best.filter("kind = 'term'").unionByName(lost).select("locale", "rel_path", "position", "key", "kind", "src", F.lit(None).cast("array<string>").alias("kwargs"), F.lit(False).alias("commented"))
    added = status.filter(F.col("status").isin("added", "moved", "kwargs_changed") if cfg.comment_keys_mode == "comment" else F.col("status") == "added")
    added = added.select("locale", F.col("code_file").alias("rel_path"), F.lit(None).cast("int").alias("position"), "key", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("src"), F.col("code_kwargs").alias("kwargs"), F.lit(False).alias("commented"))
    rows = old.union(kept).union(added)
    free = entries.filter(F.col("kind").isin(*KINDS.values(), "junk")).join(rows.select("locale", "rel_path").distinct(), ["locale", "rel_path"], "left_semi")
    free = free.select("locale", "rel_path", "position", "key", "kind", "src", F.lit(None).cast("array<string>").alias("kwargs"), (F.lit(cfg.comment_junks) & (F.col("kind") == "junk")).alias("commented"))
    return status, rows.union(free), duplicates


def extract(spark: SparkSession, cfg: ExtractConfig) -> ExtractResult:
    """Brings the catalogs of all languages up to date with the code."""
    closure._shared_folder(spark)
    calls, code = code_keys(spark, cfg)
    folders = [os.path.join(cfg.output_path, x) for x in cfg.languages]
    entries = _read_catalog(spark, folders).persist()
    raise_on_errors(entries)
    languages = spark.createDataFrame([(x,) for x in dict.fromkeys(cfg.languages)], "locale string")
    status, rows, duplicates = plan(code, entries, languages, cfg)
    files = render.render_files(rows, cfg.line_endings, cfg.compat).persist()
    if not cfg.dry_run:
        write_files(files.select(F.concat_ws("/", F.lit(cfg.output_path), "locale", "rel_path").alias("path"), "content"))
    numbers = {r.locale: r.asDict() for r in reconcile.statistics(status).collect()}
    stored = {r.locale: r.n for r in files.groupBy("locale").agg(F.sum("n_messages").alias("n")).collect()}
    on_disk = {r.locale: r.n for r in entries.groupBy("locale").agg(F.count_distinct("abs_path").alias("n")).collect()}
    statistics = {
        "py_files_count": calls.filter("key is not null").select("code_path").distinct().count(),
        "ftl_in_code_keys_count": code.count(),
        "ftl_files_count": {x: on_disk.get(x, 0) for x in cfg.languages},
        "ftl_stored_keys_count": {x: stored.get(x, 0) for x in cfg.languages},
        **{f"ftl_keys_{k}": {x: numbers.get(x, {}).get(k, 0) for x in cfg.languages} for k in ("updated", "added", "commented")},
    }
    return ExtractResult(statistics, status, files, duplicates, reconcile.unresolved(reconcile.winners(entries)[0]))


@dataclass(frozen=True)
class UntranslatedConfig:
    locales_path: str
    languages: tuple[str, ...] = ()
    suggest_from: tuple[str, ...] = ()


@dataclass
class UntranslatedResult:
    untranslated: DataFrame
    checked_locales: list[str]
    fully_translated: DataFrame

    def report(self) -> report.Report:
        complete = {r[0] for r in self.fully_translated.collect()}
        return report.Report(report.in_order(self.untranslated).collect(), self.checked_locales, [x for x in self.checked_locales if x in complete])


def check_untranslated(spark: SparkSession, cfg: UntranslatedConfig) -> UntranslatedResult:
    """Messages whose value is their key, in the asked-for locales (all, if none is)."""
    there = discover_locales(cfg.locales_path)
    checked = list(dict.fromkeys(cfg.languages or there))
    missing = [x for x in (*checked, *cfg.suggest_from) if x not in there]
    if missing:
        raise ValueError(f"locales not found in {cfg.locales_path}: {', '.join(dict.fromkeys(missing))}")
    read = checked + [x for x in dict.fromkeys(cfg.suggest_from) if x not in checked]
    entries = _read_catalog(spark, [os.path.join(cfg.locales_path, x) for x in read]).persist()
    raise_on_errors(entries)
    order = F.create_map(*[F.lit(v) for i, x in enumerate(read) for v in (x, i)]) if read else F.create_map()
    messages = entries.filter("kind = 'message'").select("locale", F.concat_ws("/", "locale", "rel_path").alias("file_path"), "key", F.col("text").alias("value"), (F.col("position") + 1).alias("line"), "ignore_untranslated", order[F.col("locale")].alias("scan"))
    ranks = spark.createDataFrame([(x, i) for i, x in enumerate(dict.fromkeys(cfg.suggest_from))], "locale string, rank int")
    found = report.untranslated(messages.filter(F.col("locale").isin(checked)), messages, ranks).persist()
    return UntranslatedResult(found, checked, report.fully_translated(spark.createDataFrame([(x,) for x in checked], "locale string"), found))


def generate_stub(spark: SparkSession, ftl_path: str, output_path: str, export_tree: bool = False) -> DataFrame:
    """Writes a typed stub of all messages below ``ftl_path``, and the tree as JSON if asked for."""
    closure._shared_folder(spark)
    entries = _read_catalog(spark, [ftl_path], ignore=False).persist()
    raise_on_errors(entries)
    tree = stub.prefix_tree(stub.last_messages(entries)).persist()
    pieces = stub.texts(tree).checkpoint()
    entries.unpersist()
    with whole_file(output_path) as out, whole_file(os.path.splitext(output_path)[0] + ".json") if export_tree else nullcontext() as json_out:
        stub.write_stub(pieces, out, json_out)
    return tree

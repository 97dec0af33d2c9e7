"""Messages that are still their own key, with suggestions from other locales."""

from __future__ import annotations

import json
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import path_key


def placeholders(messages: DataFrame) -> DataFrame:
    """Messages whose value equals their key, unless marked to be ignored."""
    return messages.filter((F.col("key") == F.col("value")) & ~F.coalesce("ignore_untranslated", F.lit(False)))


def suggestions(messages: DataFrame, locales: DataFrame) -> DataFrame:
    """(key, suggestions): for each key the first real value of each of ``locales`` (locale, rank), by rank.

    The first is the one whose scan order is least; keys are pre-aggregated, so no
    group is collected that is larger than the list of locales.
    """
    real = messages.filter("value is not null and value <> '' and value <> key").join(F.broadcast(locales), "locale")
    first = real.groupBy("key", "locale", "rank").agg(F.min_by("value", F.struct("scan", path_key(F.col("file_path")), "line")).alias("value"))
    listed = first.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "locale", "value"))).alias("s"))
    return listed.select("key", F.transform("s", lambda x: F.struct(x["locale"].alias("locale"), x["value"].alias("value"))).alias("suggestions"))


def untranslated(checked: DataFrame, all_messages: DataFrame, suggest_from: DataFrame) -> DataFrame:
    """Placeholders with their suggestions (an empty list if there are none).

    Columns of messages: locale, file_path, key, value, line, ignore_untranslated, scan.
    """
    kept = placeholders(checked.filter("value is not null and value <> ''"))
    out = kept.join(suggestions(all_messages, suggest_from), "key", "left")
    none = F.array().cast("array<struct<locale: string, value: string>>")
    return out.select("locale", "file_path", "key", "value", "line", F.coalesce("suggestions", none).alias("suggestions"))


def in_order(report: DataFrame) -> DataFrame:
    return report.orderBy("locale", path_key(F.col("file_path")), "key")


def fully_translated(locales: DataFrame, report: DataFrame) -> DataFrame:
    """Checked locales without an untranslated message."""
    return locales.join(report.select("locale").distinct(), "locale", "left_anti")


def numbered(report: DataFrame) -> DataFrame:
    """Rows with their number within their locale."""
    return report.withColumn("number", F.row_number().over(Window.partitionBy("locale").orderBy(path_key(F.col("file_path")), "key", "line")))


def counts(report: DataFrame) -> DataFrame:
    return report.groupBy("locale").agg(F.count(F.lit(1)).alias("n")).orderBy("locale")


@dataclass
class Report:
    """The rows of a report in order, for the renderers: a person reads them."""

    rows: list
    checked: list[str]
    complete: list[str]

    def text(self) -> str:
        head = {"total_untranslated": len(self.rows), "checked_locales": ", ".join(self.checked), "fully_translated_locales": ", ".join(self.complete)}
        out = [f"{k}: {v}" for k, v in head.items()] + [""]
        for r in self.rows:
            out.append(f"[{r.locale}] {r.file_path}:{r.line or 0} key={r.key}")
            out += [f"  suggestion({s.locale}): {s.value}" for s in r.suggestions]
        return "\n".join(out) + "\n"

    def json(self) -> str:
        rows = [{"locale": r.locale, "file_path": r.file_path, "line": r.line, "key": r.key, "suggestions": [s.asDict() for s in r.suggestions]} for r in self.rows]
        report = {"total_untranslated": len(rows), "checked_locales": self.checked, "fully_translated_locales": self.complete, "untranslated": rows}
        return json.dumps(report, indent=2, sort_keys=True, ensure_ascii=False)

    def terminal(self) -> str:
        if not self.rows:
            return "No untranslated keys found."
        out, sizes = [], {}
        for locale, group in groupby(sorted(self.rows, key=lambda r: r.locale), key=lambda r: r.locale):
            items = list(group)
            sizes[locale] = len(items)
            out += ["", f"Found {len(items)} untranslated keys in {locale} locale:", ""]
            for n, r in enumerate(items, 1):
                out += [f"{n}. {r.file_path}:{r.line or 0}", f"   Key: {r.key}"]
                out += [f"   Suggestion from '{s.locale}': {r.key} = {s.value}" for s in r.suggestions] + [""]
        out += ["Summary:", f"- Total untranslated keys: {len(self.rows)}", "- Locales checked: " + ", ".join(f"{k} ({n})" for k, n in sizes.items())]
        if self.complete:
            out.append("- Locales fully translated: " + ", ".join(self.complete))
        return "\n".join(out).rstrip()

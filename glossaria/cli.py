"""python -m glossaria.cli extract|stub|untranslated|config"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans import config, engine
from .sources.sinks import normal_output_path, write_text

LISTS = {"extract": ("languages", "i18n-keys", "i18n-keys-append", "i18n-keys-prefix", "exclude-dirs", "exclude-dirs-append", "ignore-attributes", "append-ignore-attributes", "ignore-kwargs"), "stub": (), "untranslated": ("languages", "suggest-from")}
VALUES = {"extract": ("default-ftl-file", "comment-keys-mode", "line-endings", "cache-path"), "stub": (), "untranslated": ("output", "output-format")}
FLAGS = {"extract": ("comment-junks", "dry-run", "cache", "clear-cache"), "stub": ("export-tree",), "untranslated": ("fail-on-untranslated",)}
#: One-letter forms, as far as a verb has the setting.
SHORT = {"languages": "-l", "i18n-keys": "-k", "i18n-keys-append": "-K", "i18n-keys-prefix": "-p", "exclude-dirs": "-e", "exclude-dirs-append": "-E", "ignore-attributes": "-i", "append-ignore-attributes": "-I"}
PLACES = {"extract": ("code-path", "output-path"), "stub": ("ftl-path", "output-path"), "untranslated": ("locales-path",)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glossaria")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    for name in config.SECTIONS:
        c = sub.add_parser(name)
        for x in PLACES[name]:
            c.add_argument(x.replace("-", "_"), nargs="?")
        for x in LISTS[name]:
            c.add_argument(*([SHORT[x]] if x in SHORT else []), f"--{x}", action="append")
        for x in VALUES[name]:
            c.add_argument(f"--{x}")
        for x in FLAGS[name]:
            c.add_argument(f"--{x}", action="store_true")
    c = sub.add_parser("config")
    c.add_argument("sample", nargs="?", choices=("sample", *config.SECTIONS))
    c.add_argument("section", nargs="?", choices=config.SECTIONS)
    c.add_argument("--command", dest="section_asked", choices=config.SECTIONS)
    return p


def session() -> SparkSession:
    return SparkSession.builder.appName("glossaria").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = vars(parser().parse_args(argv))
    command = args.pop("command")
    if command == "config":
        first = args["sample"] if args["sample"] != "sample" else None
        print(config.sample(args["section_asked"] or args["section"] or first), end="")
        return 0
    try:
        section = config.load(args.pop("config")).get(command, {})
        s = config.Settings(args, section)
        if command == "extract":
            cfg = config.extract_config(args, section)
            for k, v in engine.extract(spark or session(), cfg).statistics.items():
                print(f"{k}: {v}", file=sys.stderr)
        elif command == "stub":
            engine.generate_stub(spark or session(), s.need("ftl-path"), s.need("output-path"), s.flag("export-tree"))
        else:
            got = engine.check_untranslated(spark or session(), config.untranslated_config(args, section)).report()
            print(got.terminal())
            if output := s.get("output"):
                form = s.get("output-format", "txt")
                write_text(normal_output_path(output, form), got.json() if form == "json" else got.text())
            if got.rows and s.flag("fail-on-untranslated"):
                return 1
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

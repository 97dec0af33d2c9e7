import json

import pytest

from glossaria import cli
from glossaria.functions.fluent import FluentError
from glossaria.operators import keys
from glossaria.operators.keys import KeyConflict
from glossaria.plans import config, engine
from glossaria.sources.files import read_files


def put(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return root


def test_source_reads_what_spark_hides(spark, tmp_path):
    put(tmp_path, {"__init__.py": "x", "a/_b.py": "y", ".hidden/c.py": "z", ".gitignore": "skip/\n*.gen.py\n!keep.gen.py\n", "skip/d.py": "", "e.gen.py": "", "keep.gen.py": "", "tests/f.py": ""})
    got = {r.rel_path for r in read_files(spark, [str(tmp_path)], ".py", exclude=("*/tests/*",)).collect()}
    assert got == {"__init__.py", "a/_b.py", "keep.gen.py"}
    assert read_files(spark, [str(tmp_path / "none")], ".py").count() == 0


CODE = 'i18n.new(a=1)\ni18n.same(x=1)\ni18n.args(y=1)\nL("moved", _path="other.ftl")\ni18n.uses()\n'
STORED = """# kept
same = Hi { $x }
args = Bye { $z }
moved = Here
uses = See { helper }
helper = Help { $deep }
gone = Old
-term = T
"""


@pytest.mark.parametrize("mode", ["comment", "warn"])
def test_extract(spark, tmp_path, mode):
    put(tmp_path, {"app/m.py": CODE.replace("i18n.uses()", "i18n.uses(deep=1)"), "loc/en/_default.ftl": STORED})
    cfg = engine.ExtractConfig(str(tmp_path / "app"), str(tmp_path / "loc"), ("en", "de"), comment_keys_mode=mode)
    got = engine.extract(spark, cfg)
    status = {(r.locale, r.key): r.status for r in got.status.collect()}
    assert {k: v for (loc, k), v in status.items() if loc == "en"} == {"new": "added", "same": "unchanged", "args": "kwargs_changed", "moved": "moved", "uses": "unchanged", "helper": "retained", "gone": "obsolete"}
    assert got.statistics["ftl_keys_added"] == {"en": 1, "de": 5}
    assert got.statistics["ftl_keys_updated"]["en"] == 2 and got.statistics["ftl_keys_commented"]["en"] == 3
    text = (tmp_path / "loc/en/_default.ftl").read_text()
    assert "new = new{ $a }" in text and "-term = T" in text and "# kept\nsame = Hi { $x }" in text
    if mode == "comment":
        assert "# args = Bye { $z }" in text and "args = args{ $y }" in text and "# gone = Old" in text and "# moved = Here" in text
        assert (tmp_path / "loc/en/other.ftl").read_text() == "moved = moved\n"
    else:
        assert "\nargs = Bye { $z }" in text and "args = args" not in text and not (tmp_path / "loc/en/other.ftl").exists()
    assert (tmp_path / "loc/de/other.ftl").read_text() == "moved = moved\n"


def test_dry_run_cache_and_conflicts(spark, tmp_path):
    put(tmp_path, {"app/m.py": "i18n.a(x=1)", "app/n.py": "i18n.b()"})
    cfg = engine.ExtractConfig(str(tmp_path / "app"), str(tmp_path / "loc"), dry_run=True, cache_path=str(tmp_path / "cache"))
    assert engine.extract(spark, cfg).statistics["ftl_stored_keys_count"] == {"en": 2} and not (tmp_path / "loc").exists()
    put(tmp_path, {"app/n.py": "i18n.c()  # longer"})
    assert {r.key for r in engine.extract(spark, cfg).status.collect()} == {"a", "c"}
    (tmp_path / "app/n.py").unlink()
    assert {r.key for r in engine.extract(spark, cfg).status.collect()} == {"a"}
    put(tmp_path, {"app/o.py": "i18n.a(y=1)"})
    with pytest.raises(KeyConflict, match="a: 1 files, 2 forms"):
        engine.extract(spark, cfg)


def test_all_conflicts_are_in_the_error(spark):
    calls = spark.range(2400).selectExpr("concat('k', id div 2) AS key", "'a.ftl' AS ftl_path", "array(string(id % 2)) AS kwargs", "'m.py' AS code_path", "id AS ordinal")
    with pytest.raises(KeyConflict) as error:
        keys.checked(keys.merge_calls(calls))
    assert str(error.value).count("1 files, 2 forms") == 1200


def test_reference_cycles_and_unresolved(spark, tmp_path):
    put(tmp_path, {"app/m.py": "i18n.a(x=1, y=1)", "loc/en/_default.ftl": "a = { b } { $x }\nb = { a } { $y }\nc = { nowhere }\n"})
    got = engine.extract(spark, engine.ExtractConfig(str(tmp_path / "app"), str(tmp_path / "loc"), dry_run=True))
    assert {r.key: r.status for r in got.status.collect()} == {"a": "unchanged", "b": "retained", "c": "obsolete"}
    assert [r.ref for r in got.unresolved.collect()] == ["nowhere"]


def test_bad_catalog_stops(spark, tmp_path):
    put(tmp_path, {"app/m.py": "i18n.a()", "loc/en/_default.ftl": "JUNK!!!\n"})
    with pytest.raises(FluentError):
        engine.extract(spark, engine.ExtractConfig(str(tmp_path / "app"), str(tmp_path / "loc")))


def test_line_endings(spark, tmp_path):
    put(tmp_path, {"app/m.py": "i18n.a(); i18n.b()"})
    engine.extract(spark, engine.ExtractConfig(str(tmp_path / "app"), str(tmp_path / "loc"), line_endings="crlf"))
    assert (tmp_path / "loc/en/_default.ftl").read_bytes() == b"a = a\r\nb = b\r\n"


def test_untranslated(spark, tmp_path, capsys):
    put(tmp_path, {"en/a.ftl": "hi = Hello\nwelcome = Welcome\n", "uk/a.ftl": "hi = Privit\nwelcome = welcome\n# ignore\nskip = skip\n", "empty/x.txt": ""})
    got = engine.check_untranslated(spark, engine.UntranslatedConfig(str(tmp_path), (), ("en",))).report()
    assert [(r.locale, r.file_path, r.line, r.key) for r in got.rows] == [("uk", "uk/a.ftl", 2, "welcome")]
    assert got.complete == ["empty", "en"]
    assert got.text() == "total_untranslated: 1\nchecked_locales: empty, en, uk\nfully_translated_locales: empty, en\n\n[uk] uk/a.ftl:2 key=welcome\n  suggestion(en): Welcome\n"
    assert json.loads(got.json())["untranslated"][0]["suggestions"] == [{"locale": "en", "value": "Welcome"}]
    assert "Suggestion from 'en': welcome = Welcome" in got.terminal()
    with pytest.raises(ValueError, match="xx"):
        engine.check_untranslated(spark, engine.UntranslatedConfig(str(tmp_path), ("xx",)))
    assert cli.main(["untranslated", str(tmp_path), "--fail-on-untranslated", "--output", str(tmp_path / "r/out"), "--output-format", "JSON"], spark) == 1
    assert json.loads((tmp_path / "r/out.json").read_text())["total_untranslated"] == 1


def test_stub(spark, tmp_path):
    put(tmp_path, {"en/a.ftl": "menu = Menu\nmenu-item_x = It's { $n } { DATETIME($d) }\nb-c =\n    Two\n    lines\n-term = T\n"})
    engine.generate_stub(spark, str(tmp_path / "en"), str(tmp_path / "out/stub.pyi"), True)
    text = (tmp_path / "out/stub.pyi").read_text()
    assert "    @staticmethod\n    @overload\n    def menu(**kwargs: Any) -> Literal['Menu']:\n        ...\n\n    class __Menu:\n\n        @staticmethod\n        def item_x(*, n: Any, d: Any, **kwargs: Any) -> Literal['It\\'s { $n } {...}']:" in text
    assert "def c(**kwargs: Any) -> Literal['Two']:" in text and "    menu = __Menu\n" in text and text.index("class __B") < text.index("class __Menu")
    assert json.loads((tmp_path / "out/stub.json").read_text())["menu"]["item_x"]["$_meta$"]["args"] == ["n", "d"]
    compile(text, "stub", "exec")


def test_config(tmp_path, monkeypatch):
    put(tmp_path, {"pyproject.toml": '[tool.any.extract]\ncode-path = "src"\noutput-path = "loc"\nlanguages = ["de"]\ni18n-keys-append = ["_"]\nline-endings = "LF"\n[tool.other]\nx = 1\n', "sub/x": ""})
    monkeypatch.chdir(tmp_path / "sub")
    section = config.load()["extract"]
    cfg = config.extract_config({"languages": ["fr"]}, section)
    assert cfg.code_path == str(tmp_path / "src") and cfg.languages == ("fr",) and "_" in cfg.scan.keys and cfg.line_endings == "lf"
    with pytest.raises(config.ConfigError):
        config.extract_config({"line_endings": "x"}, section)
    with pytest.raises(config.ConfigError):
        config.load("none.toml")
    assert config.load.__doc__ and "[tool.glossaria.stub]" in config.sample()


def test_first_ignore_file_wins(tmp_path):
    from glossaria.sources.files import walk

    (tmp_path / "a.ftl").write_text("a = 1\n")
    (tmp_path / "b.ftl").write_text("b = 1\n")
    (tmp_path / ".gitignore").write_text("a.ftl\n")
    (tmp_path / ".ignore").write_text("!a.ftl\nb.ftl\n")
    assert [p.rsplit("/", 1)[-1] for p in walk(str(tmp_path), ".ftl", (".ignore", ".gitignore"))] == ["a.ftl"]


def test_short_flags_and_samples(capsys):
    from glossaria import cli

    args = cli.parser().parse_args(["extract", "a", "b", "-l", "en", "-l", "de", "-k", "T", "-K", "U", "-p", "self", "-e", "x", "-E", "y", "-i", "q", "-I", "r"])
    assert args.languages == ["en", "de"] and args.i18n_keys == ["T"] and args.i18n_keys_append == ["U"] and args.i18n_keys_prefix == ["self"]
    assert (args.exclude_dirs, args.exclude_dirs_append, args.ignore_attributes, args.append_ignore_attributes) == (["x"], ["y"], ["q"], ["r"])
    assert cli.parser().parse_args(["untranslated", "x", "-l", "de"]).languages == ["de"]
    cli.main(["config", "sample", "--command", "stub"])
    one = capsys.readouterr().out
    cli.main(["config", "stub"])
    assert one == capsys.readouterr().out and "[tool.glossaria.stub]" in one and "extract" not in one


def test_labels_move_over_long_chains_and_cycles(spark):
    from glossaria.operators import closure

    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(12, 4), (20, 20)], "src long, dst long")
    got = closure.spread(edges, spark.createDataFrame([(0, "a"), (9, "b"), (20, "c")], "node long, label string"))
    assert {(r.node, r.label) for r in got.collect()} == {(i, "a") for i in range(13)} | {(i, "b") for i in range(4, 13)} | {(20, "c")}


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and 'extract_files' in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent).returncode == 0

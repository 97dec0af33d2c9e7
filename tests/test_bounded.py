"""Verbs whose catalogs don't fit the driver, or a Python worker."""

import json
import tracemalloc

from pyspark.sql.classic.dataframe import DataFrame

from glossaria.operators import render
from glossaria.plans import engine
from glossaria.sources.files import read_files
from glossaria.sources.stored import entry_rows, stored_entries


def brute_stub(messages):
    """(lines of the stub's messages, tree) from key: (args, translation), all at once."""

    def body(keys, depth):
        pad, out = "    " * depth, [""]
        for name in sorted({k[0] for k in keys}):
            below, meta = {k[1:]: v for k, v in keys.items() if k[0] == name and k[1:]}, keys.get((name,))
            if meta:
                args = "".join(f"{a}: Any, " for a in meta[0])
                out += [f"{pad}@staticmethod", *[f"{pad}@overload"] * bool(below), f"{pad}def {name}({'*, ' if args else ''}{args}**kwargs: Any) -> Literal['{meta[1]}']:", f"{pad}    ...", ""]
            if below:
                out += [f"{pad}class __{name.capitalize()}:", *body(below, depth + 1), f"{pad}{name} = __{name.capitalize()}"]
        return out

    def tree(keys):
        out = {}
        for name in sorted({k[0] for k in keys}):
            out[name] = ({"$_meta$": {"args": keys[(name,)][0], "translation": keys[(name,)][1]}} if (name,) in keys else {}) | tree({k[1:]: v for k, v in keys.items() if k[0] == name and k[1:]})
        return out

    keys = {tuple(k.split("-")): v for k, v in messages.items()}
    return "\n".join(body(keys, 1)) + "\n", json.dumps(tree(keys), indent=2, ensure_ascii=False)


def test_stub_is_written_in_parts(spark, tmp_path, monkeypatch):
    messages = {"menu": ([], "Menü"), "menu-item-a": (["n"], "A { $n }"), "z": ([], "Last"), "a-b-c-d": ([], "Deep"), "a-b": (["x", "y"], "{ $x }{ $y }")} | {f"k{i % 7}-n{i}": ([], f"Text {i}") for i in range(1500)}
    (tmp_path / "en").mkdir()
    (tmp_path / "en/a.ftl").write_text("".join(f"{k} = {v}\n" for k, (_, v) in messages.items()))
    collect, most = DataFrame.collect, []
    monkeypatch.setattr(DataFrame, "collect", lambda self: most.append(rows := collect(self)) or rows)
    for nodes in (100, 50_000):
        monkeypatch.setattr("glossaria.operators.stub.NODES", nodes, raising=False)
        engine.generate_stub(spark, str(tmp_path / "en"), str(tmp_path / "stub.pyi"), True)
        lines, tree = brute_stub(messages)
        text = (tmp_path / "stub.pyi").read_text()
        assert text.endswith("\nclass I18nStub:\n\n" + lines)
        assert (tmp_path / "stub.json").read_text() == tree
        compile(text, "stub", "exec")
    assert max(map(len, most)) < 100


def test_stub_of_nothing(spark, tmp_path):
    (tmp_path / "en").mkdir()
    engine.generate_stub(spark, str(tmp_path / "en"), str(tmp_path / "stub.pyi"), True)
    assert (tmp_path / "stub.pyi").read_text().endswith("\nclass I18nStub:\n\n    pass\n") and (tmp_path / "stub.json").read_text() == "{}"


def test_rows_of_a_large_file_wait_on_disk():
    text = "".join(f"part-{i} = large ring {{ $a }}\n" for i in range(30_000)).encode()
    tracemalloc.start()
    n = sum(1 for _ in entry_rows("en", "x", "x", text))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 30_000 and most < 40e6
    assert [r[4] for r in entry_rows("en", "x", "x", text + b"junk\n")] == ["error"]


def test_catalogs_are_read_by_path_in_bounded_frames(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("glossaria.sources.stored.ROWS", 7, raising=False)
    for name in ("a.ftl", "b/c.ftl"):
        (tmp_path / "en" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "en" / name).write_text("".join(f"k{i} = Text {i}\n" for i in range(20)))
    files = read_files(spark, [str(tmp_path / "en")], ".ftl", content=False)
    assert [r.content for r in files.collect()] == [None, None]
    got = stored_entries(files).collect()
    assert sorted((r.locale, r.rel_path, r.position, r.key, r.text) for r in got) == [("en", n, i, f"k{i}", f"Text {i}") for n in ("a.ftl", "b/c.ftl") for i in range(20)]


def test_files_are_rendered_without_python_groups(spark):
    rows = [
        ("en", "a.ftl", 2, "b", "message", "b = B\n", None, False), ("en", "a.ftl", 0, None, "comment", "# Free\n\n", None, False), ("en", "a.ftl", 1, "x", "message", "# own\nx = X\n    .y = Z\n", None, True),
        ("en", "a.ftl", 3, None, "junk", "junk\n", None, False), ("en", "a.ftl", 10, "c", "term", "-c = C\n", None, False), ("en", "a.ftl", None, "z", "message", None, ["n"], False), ("en", "a.ftl", None, "Z", "message", None, [], False),
        ("de", "a.ftl", 0, None, "junk", "junk\n", None, False), ("de", "a.ftl", 1, None, "group_comment", "## G\n\n", None, False), ("de", "a.ftl", 2, "m", "message", "m = M\n", None, False),
    ]
    files = render.render_files(spark.createDataFrame(rows, "locale string, rel_path string, position int, key string, kind string, src string, kwargs array<string>, commented boolean"))
    got = {r.locale: (r.content, r.n_messages) for r in files.collect()}
    assert got == {"de": ("## G\n\nm = M\n", 1), "en": ("# Free\n\n\n# # own\n# x = X    .y = Z\n\nb = B\n-c = C\nZ = Z\nz = z{ $n }\n", 3)}
    assert "FlatMapGroupsInPandas" not in files._jdf.queryExecution().toString()

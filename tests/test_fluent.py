import pytest
from hypothesis import given
from hypothesis import strategies as st

from glossaria.functions import fluent
from glossaria.functions.pyscan import ScanOptions, scan

TEXT = """### Top

## Group

# free

# attached
hello = Hello, { $name }!
-brand = Brand
    .gender = m
many =
    One { $n ->
        [one] piece
       *[other] { NUMBER($n, digits: 2) } pieces of { -brand(case: "x") }
    }
    and more
only =
    .attr = { hello.attr } {{ $x }}
"""


def test_round_trip():
    entries = fluent.parse(TEXT, strict=True)
    assert [e.kind for e in entries] == ["resource_comment", "group_comment", "comment", "message", "term", "message", "message"]
    assert entries[3].comment == ["attached"]
    assert entries[6].value is None and entries[6].attributes[0][0] == "attr"
    again = fluent.serialize(entries)
    assert [(e.kind, e.key, e.value, e.attributes, e.comment) for e in fluent.parse(again, strict=True)] == [(e.kind, e.key, e.value, e.attributes, e.comment) for e in entries]
    assert fluent.serialize(fluent.parse(again)) == again


def test_golden():
    entries = fluent.parse("m = A message.\n-t = A term.\n\n# A comment.\n")
    entries.append(fluent.Entry("junk", value=("junk",)))
    assert fluent.serialize(entries) == "m = A message.\n-t = A term.\n\n# A comment.\n\n"


def test_junk_and_strict():
    assert [e.kind for e in fluent.parse("a = b\nJUNK!!!\nc = d\n")] == ["message", "junk", "message"]
    with pytest.raises(fluent.FluentError):
        fluent.parse("JUNK!!!\n", strict=True)


def test_rules():
    e = fluent.parse("k = { $a } { m } { -t(x: 1) } { DATETIME($d) } {{ $p }} { $s ->\n   *[o] { $v }\n }\n", strict=True)[0]
    assert fluent.reach(e.value) == (["a", "s", "v"], [("message", "m"), ("term", "t")])
    assert fluent.signature(e.value) == ["a", "d", "p", "s", "v"]
    assert fluent.shown(e.value) == "{ $a } {m} { -t } {...} { $p } {...}"


def test_commented_joins_last_two_lines():
    e = fluent.parse("# c\nk = v\n")[0]
    assert fluent.serialize([fluent.commented(e)]) == "# # ck = v\n\n"
    assert fluent.serialize([fluent.commented(e, compat=False)]) == "# # c\n# k = v\n\n"


def test_markers():
    assert fluent.ignores_untranslated(["Ignore "]) and fluent.ignores_untranslated(["x some-tool: ignore-untranslated"])
    assert not fluent.ignores_untranslated(["ignored"]) and not fluent.ignores_untranslated(None)


@given(st.lists(st.tuples(st.from_regex(r"[a-z][a-z0-9_-]{0,8}", fullmatch=True), st.from_regex(r"[A-Za-z0-9][A-Za-z0-9 ,.]{0,20}[a-z]", fullmatch=True), st.booleans()), max_size=8))
def test_any_messages_survive(rows):
    text = "".join(f"{k} = {v}{' { $x }' if var else ''}\n" for k, v, var in rows)
    got = fluent.parse(fluent.serialize(fluent.parse(text, strict=True)), strict=True)
    assert [(e.key, fluent.plain_text(e.value)) for e in got] == [(k, None if var else v) for k, v, var in rows]


def calls(source, **options):
    return [(k, f, a) for k, f, a in scan(source.encode() if isinstance(source, str) else source, ScanOptions(**options))[0]]


def test_calls():
    assert calls('i18n.get("key", a=1, **kw); L("other", _path="dir"); i18n.one.two_x(b=2, _path="f.ftl")') == [("key", "_default.ftl", ["a"]), ("other", "dir/_default.ftl", []), ("one-two_x", "f.ftl", ["b"])]
    assert calls('i18n.set_locale("en"); i18n.get(); i18n.get(x); L(key="x"); other("y"); f().i18n.a()') == []
    assert calls('self.i18n.a.b(); self.i18n("x"); cls.other.c()', prefixes=frozenset({"self"})) == [("a-b", "_default.ftl", [])]
    assert calls('f"{i18n.inner(x=1)}"; i18n.outer(a=L("deep"))') == [("inner", "_default.ftl", ["x"]), ("outer", "_default.ftl", ["a"]), ("deep", "_default.ftl", [])]
    assert calls("﻿i18n.bom()") == [("bom", "_default.ftl", [])]


def test_files_that_are_not_python():
    for bad in ("def", "f(a=1, a=2); i18n.x()", b"\xff"):
        found, why = scan(bad if isinstance(bad, bytes) else bad.encode(), ScanOptions())
        assert not found and why


def test_deep_nesting_is_an_error_and_lines_are_counted_once():
    deep = "a = " + "{ " * 3000 + "$x" + " }" * 3000 + "\n"
    with pytest.raises(fluent.FluentError):
        fluent.parse(deep, strict=True)
    assert [e.kind for e in fluent.parse(deep + "b = x\n")] == ["junk", "message"]
    text = "".join(f"# c{i}\n\nk{i} = v\n    w\n" for i in range(300))
    assert [e.line for e in fluent.parse(text) if e.kind == "message"] == [3 + 4 * i for i in range(300)]
    assert [e.line for e in fluent.parse(text) if e.kind == "comment"] == [1 + 4 * i for i in range(300)]

"""Settings from a pyproject file and from arguments."""

from __future__ import annotations

import os
import tomllib

from ..functions.pyscan import DEFAULT_FILE, IGNORED_ATTRIBUTES, KEYS, ScanOptions
from ..functions.text import LINE_ENDINGS
from .engine import EXCLUDED, ExtractConfig, UntranslatedConfig

SECTIONS = ("extract", "stub", "untranslated")
PATHS = {"code-path", "output-path", "cache-path", "ftl-path", "locales-path", "output"}
CHOICES = {"comment-keys-mode": ("comment", "warn"), "line-endings": LINE_ENDINGS, "output-format": ("txt", "json")}
SAMPLE = {
    "extract": {"code-path": "app", "output-path": "app/locales", "languages": ["en", "de"], "i18n-keys-append": ["gettext"], "exclude-dirs-append": ["./tests/*"], "ignore-kwargs": ["when"], "comment-keys-mode": "comment", "line-endings": "lf", "cache": True},
    "stub": {"ftl-path": "app/locales/en", "output-path": "app/stub.pyi", "export-tree": False},
    "untranslated": {"locales-path": "app/locales", "languages": ["de"], "suggest-from": ["en"], "fail-on-untranslated": True, "output": "reports/untranslated", "output-format": "json"},
}


class ConfigError(ValueError):
    """A setting that is missing or wrong."""


def find_pyproject(start: str = ".") -> str | None:
    folder = os.path.abspath(start)
    while True:
        if os.path.isfile(path := os.path.join(folder, "pyproject.toml")):
            return path
        if folder == (folder := os.path.dirname(folder)):
            return None


def load(path: str | None = None, tool: str = "glossaria") -> dict[str, dict]:
    """The sections of [tool.<tool>], or of the only tool whose tables are all among ours."""
    if path and not os.path.isfile(path):
        raise ConfigError(f"{path} isn't there")
    path = path or find_pyproject()
    if not path:
        return {}
    with open(path, "rb") as f:
        tools = tomllib.load(f).get("tool", {})
    alike = [t for t in tools.values() if isinstance(t, dict) and t and set(t) <= set(SECTIONS)]
    own = tools.get(tool) or (alike[0] if len(alike) == 1 else {})
    base = os.path.dirname(os.path.abspath(path))
    return {s: {k: os.path.join(base, v) if k in PATHS else v for k, v in own.get(s, {}).items()} for s in SECTIONS}


class Settings:
    """Arguments before the file's settings before defaults."""

    def __init__(self, args: dict, section: dict):
        self.args, self.section = args, section

    def get(self, name: str, default=None):
        """A list or value: what arguments give replaces the file's, which replaces the default."""
        value = self.args.get(name.replace("-", "_"))
        if value in (None, [], ()):
            value = self.section.get(name, default)
        if name in CHOICES and value is not None:
            value = str(value).lower()
            if value not in CHOICES[name]:
                raise ConfigError(f"{name}: {value!r} isn't one of {', '.join(CHOICES[name])}")
        return value

    def need(self, name: str):
        value = self.get(name)
        if value in (None, ""):
            raise ConfigError(f"{name} is needed")
        return value

    def flag(self, name: str) -> bool:
        """True if either says so."""
        return bool(self.args.get(name.replace("-", "_")) or self.section.get(name))

    def extended(self, name: str, default, *also: str) -> list[str]:
        """A list and what is to be appended to it."""
        return sorted({*self.get(name, list(default)), *(x for a in (f"{name}-append", *also) for x in (self.get(a) or []))})


def extract_config(args: dict, section: dict) -> ExtractConfig:
    s = Settings(args, section)
    scan = ScanOptions(frozenset(s.extended("i18n-keys", KEYS)), frozenset(s.get("i18n-keys-prefix", [])), frozenset(s.extended("ignore-attributes", IGNORED_ATTRIBUTES, "append-ignore-attributes")), frozenset(s.get("ignore-kwargs", [])), s.get("default-ftl-file", DEFAULT_FILE))
    exclude = tuple(s.extended("exclude-dirs", [f"*/{d}/*" for d in EXCLUDED]))
    return ExtractConfig(
        s.need("code-path"), s.need("output-path"), tuple(s.get("languages", ["en"])), scan, exclude, s.flag("comment-junks"), s.get("comment-keys-mode", "comment"),
        s.get("line-endings", "default"), s.flag("dry-run"), s.flag("cache"), s.get("cache-path"), s.flag("clear-cache"),
    )


def untranslated_config(args: dict, section: dict) -> UntranslatedConfig:
    s = Settings(args, section)
    return UntranslatedConfig(s.need("locales-path"), tuple(s.get("languages", [])), tuple(s.get("suggest-from", [])))


def sample(section: str | None = None, tool: str = "glossaria") -> str:
    """TOML with settings to begin with, for one section or all."""
    show = lambda v: str(v).lower() if isinstance(v, bool) else "[" + ", ".join(f'"{x}"' for x in v) + "]" if isinstance(v, list) else f'"{v}"'
    return "\n".join(f"[tool.{tool}.{s}]\n" + "".join(f"{k} = {show(v)}\n" for k, v in SAMPLE[s].items()) for s in ([section] if section else SECTIONS))

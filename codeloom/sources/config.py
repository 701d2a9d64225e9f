"""A repository's own settings: a TOML file at its root, and what its script tools leave out of their builds."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field

from ..functions.paths import LANGUAGES

NAME = ".codeloom.toml"
MAX_BYTES = 2_000_000


def _texts(v) -> bool:
    return isinstance(v, list) and all(isinstance(x, str) for x in v)


def _text(v) -> bool:
    return isinstance(v, str) and bool(v.strip())


def _flag(v) -> bool:
    return isinstance(v, bool)


def _size(v) -> bool:
    return isinstance(v, int) and not isinstance(v, bool) and v > 0


def _languages(v) -> bool:
    return _texts(v) and set(v) <= set(LANGUAGES.values())


#: Section, key: (what a value must be, its check, its default).
SETTINGS: dict[str, dict[str, tuple[str, Callable, object]]] = {
    "index": {"ignore": ("a list of strings", _texts, []), "languages": (f"a list out of {sorted(set(LANGUAGES.values()))}", _languages, []), "max_file_bytes": ("a positive integer", _size, MAX_BYTES)},
    "explorer": {"auto_mount": ("true or false", _flag, True), "mount_path": ("a path that begins with /", lambda v: _text(v) and v.startswith("/"), "/explorer"), "playground": ("true or false", _flag, False), "playground_mode": ("readonly or all", lambda v: v in ("readonly", "all"), "readonly")},
    "agent": {"log_calls": ("true or false", _flag, False)},
    "specs": {"sync_from": ("a list of strings", _texts, []), "links_seed": ("a path", lambda v: isinstance(v, str), None), "spec_dir": ("a path", _text, None)},
    "graph": {"external": ("a path", _text, None)},
    "workspace": {"group_db": ("a path", _text, None)},
}


@dataclass(frozen=True)
class RepoConfig:
    """``ignore``: the script tools' excludes, then the file's own patterns, which win. ``languages``: none for all."""

    ignore: tuple[str, ...] = ()
    languages: frozenset[str] = frozenset()
    max_bytes: int = MAX_BYTES
    settings: dict = field(default_factory=dict)


def parse_config(text: str) -> dict[str, dict]:
    """Every section with every key, defaults filled in; ValueError names what is wrong."""
    try:
        given = tomllib.loads(text)
    except tomllib.TOMLDecodeError as bad:
        raise ValueError(f"{NAME}: {bad}") from bad
    out = {}
    for section, keys in SETTINGS.items():
        own = given.get(section, {})
        if not isinstance(own, dict):
            raise ValueError(f"{NAME}: [{section}] must be a table")
        if strange := sorted(set(own) - set(keys)):
            raise ValueError(f"{NAME}: [{section}] doesn't know {strange}, only {sorted(keys)}")
        for key, (what, fits, _) in keys.items():
            if key in own and not fits(own[key]):
                raise ValueError(f"{NAME}: [{section}] {key} must be {what}")
        out[section] = {key: own.get(key, default) for key, (_, _, default) in keys.items()}
    return out


_QUOTED = r'"(?:\\.|[^"\\])*"'


def parse_jsonc(text: str) -> dict | None:
    """JSON with comments and trailing commas; None if it is no object even so."""
    keep = lambda m: m[0] if m[0].startswith('"') else ""
    bare = re.sub(rf"{_QUOTED}|//[^\r\n]*|(?s:/\*.*?(?:\*/|\Z))", keep, text)
    try:
        found = json.loads(re.sub(rf"{_QUOTED}|,(?=\s*[}}\]])", keep, bare))
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def excludes(read: Callable[[str], str | None]) -> tuple[str, ...]:
    """Patterns that deno.json (else deno.jsonc) and tsconfig.json exclude, each once. read: a root file's text or None."""
    found: list[str] = []
    deno = next((d for d in (parse_jsonc(read(n) or "") for n in ("deno.json", "deno.jsonc")) if d is not None), None)
    for tool in (deno, parse_jsonc(read("tsconfig.json") or "")):
        listed = (tool or {}).get("exclude")
        found += [x.strip().removeprefix("./") for x in (listed if isinstance(listed, list) else []) if isinstance(x, str)]
    return tuple(dict.fromkeys(x for x in found if x))


def load_config(read: Callable[[str], str | None]) -> RepoConfig:
    """Settings of a tree whose root files ``read`` gives; defaults without a settings file."""
    settings = parse_config(read(NAME) or "")
    own = settings["index"]
    return RepoConfig(excludes(read) + tuple(own["ignore"]), frozenset(own["languages"]), own["max_file_bytes"], settings)

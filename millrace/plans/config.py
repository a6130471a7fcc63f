"""Settings of a corpus: read from TOML, with defaults; checked as a whole."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

KINDS = ("md", "pdf", "image", "code", "audio", "video")
_UNITS = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 0.001}


@dataclass
class Scan:
    folders: list[str] = field(default_factory=list)
    keep: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=lambda: ["**/node_modules/**", "**/.git/**", "**/vendor/**", "**/.venv/**", "**/__pycache__/**"])
    kinds: list[str] = field(default_factory=lambda: list(KINDS))


@dataclass
class Pair:
    md: str = ""
    pdf: str = ""


@dataclass
class Index:
    pdf_page_images: bool = True


@dataclass
class Chunk:
    tokens: int = 256
    overlap: int = 32


@dataclass
class Cache:
    query_max: int = 10_000
    query_ttl: str = "720h"


@dataclass
class Embed:
    profile: str = "hashed-tokens"
    dim: int = 64


@dataclass
class Config:
    scan: Scan = field(default_factory=Scan)
    pairs: list[Pair] = field(default_factory=list)
    index: Index = field(default_factory=Index)
    chunk: Chunk = field(default_factory=Chunk)
    embed: Embed = field(default_factory=Embed)
    cache: Cache = field(default_factory=Cache)


def seconds(duration: str) -> float:
    """A duration such as 720h or 1h30m, in seconds."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|h|m|s)", duration.lstrip("-"))
    if "".join(a + b for a, b in parts) != duration.lstrip("-") or not duration:
        raise ValueError(f"{duration!r} is no duration")
    return (-1 if duration.startswith("-") else 1) * sum(float(n) * _UNITS[unit] for n, unit in parts)


def _fill(target: Any, told: dict[str, Any], prefix: str, unknown: list[str]) -> Any:
    names = {f.name for f in fields(target)}
    for key, value in told.items():
        if key not in names:
            unknown.append(prefix + key)
        elif key == "pairs":
            target.pairs = [_fill(Pair(), pair, "pairs.", unknown) for pair in value]
        elif is_dataclass(getattr(target, key)):
            _fill(getattr(target, key), value, f"{prefix}{key}.", unknown)
        else:
            setattr(target, key, value)
    return target


def load(text: str) -> Config:
    """Settings from TOML; what isn't told keeps its default, and a key that no setting has is refused."""
    unknown: list[str] = []
    config = _fill(Config(), tomllib.loads(text), "", unknown)
    if unknown:
        raise ValueError(f"unknown keys: {', '.join(unknown)}")
    return config


def from_dict(told: dict[str, Any]) -> Config:
    """Settings from what dataclasses.asdict() made of some."""
    return _fill(Config(), told, "", [])


def _bad_path(path: str) -> str:
    """What keeps a path from naming a place below the corpus, or nothing."""
    steps = path.split("/")
    faults = {"is blank": not path, "has a backslash": "\\" in path, "starts at the root": path[:1] == "/", "climbs out of the corpus": ".." in steps}
    return next((told for told, wrong in faults.items() if wrong), "")


def _bad_duration(told: str) -> str:
    try:
        return "" if seconds(told) >= 0 else "is negative"
    except ValueError:
        return "is no duration"


def _range(low: int, high: float) -> Callable[[int], str]:
    return lambda n: "" if low <= n <= high else f"lies outside {low} to {high:g}" if high < float("inf") else f"lies below {low}"


#: Where a setting's values come from, and what may be wrong with one. The bounds.
RULES: list[tuple[str, Callable[[Config], Iterable], Callable[[Any], str]]] = [
    ("scan.folders", lambda c: c.scan.folders, _bad_path),
    ("scan.keep", lambda c: c.scan.keep, _bad_path),
    ("scan.kinds", lambda c: c.scan.kinds, lambda kind: "" if kind in KINDS else "is no kind"),
    ("scan.ignore", lambda c: c.scan.ignore, lambda glob: "" if glob else "is blank"),
    ("pairs", lambda c: [p for p in c.pairs if p.md and p.pdf], lambda p: next(filter(None, map(_bad_path, (p.md, p.pdf))), "")),
    ("pairs", lambda c: c.pairs, lambda p: "" if p.md and p.pdf else "names one folder of two"),
    ("chunk.tokens", lambda c: [c.chunk.tokens], _range(32, 8192)),
    ("chunk.overlap", lambda c: [c.chunk.overlap], _range(0, float("inf"))),
    ("chunk.overlap", lambda c: [c.chunk], lambda k: "" if k.overlap < k.tokens else "is no less than chunk.tokens"),
    ("embed.dim", lambda c: [c.embed.dim], _range(1, float("inf"))),
    ("cache.query_max", lambda c: [c.cache.query_max], _range(0, float("inf"))),
    ("cache.query_ttl", lambda c: [c.cache.query_ttl], _bad_duration),
]


def problems(config: Config) -> list[str]:
    """All that is wrong with the settings, at once."""
    return [f"{name}: {value!r} {wrong}" for name, values, rule in RULES for value in values(config) if (wrong := rule(value))]


def covers(folder: str, path: str) -> bool:
    return folder in (".", path) or path.startswith(f"{folder}/")


def add_folder(folders: list[str], new: str) -> list[str]:
    """The folders with `new`, sorted and free of overlaps: it changes nothing if covered, and replaces those it covers."""
    if any(covers(f, new) for f in folders):
        return folders
    return sorted([f for f in folders if not covers(new, f)] + [new])


def remove_folder(folders: list[str], old: str) -> list[str]:
    """The folders without `old`, which must be one of them as it stands."""
    if old not in folders:
        raise ValueError(f"{old!r} is not listed")
    return [f for f in folders if f != old]

"""Settings from the environment and ``.env`` files, and per-domain rules from YAML."""

from __future__ import annotations

import os
import re
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path

import yaml

REQUIRED = ("domain", "keywords", "top_n", "max_chars")


def dotenv(path: str, environ: dict | None = None) -> dict:
    """``NAME=value`` lines of a file, without overriding what is set already; quotes and comments are understood."""
    environ = dict(os.environ if environ is None else environ)
    if Path(path).is_file():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            m = re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^#\n]*))", line)
            if m:
                environ.setdefault(m[1], next(g for g in m.groups()[1:] if g is not None).strip())
    return environ


@dataclass(frozen=True)
class Settings:
    """Limits and folders; every field can be set by a variable ``MILLRACE_<FIELD>``."""

    root: str = "kb"
    store: str = "store"
    chunk_size: int = 3500
    chunk_overlap: int = 200
    chunk_cap: int = 0
    top_n: int = 5
    max_chars: int = 6000
    session_hours: float = 2.0
    max_turns: int = 20
    feedback_days: int = 90
    stale_days: int = 90
    log_mb: int = 50
    ignored: tuple[str, ...] = ()

    @classmethod
    def load(cls, environ: dict) -> Settings:
        values = {}
        for f in fields(cls):
            raw = environ.get(f"MILLRACE_{f.name.upper()}")
            if raw is not None:
                kind = type(f.default)
                values[f.name] = tuple(x.strip() for x in raw.split(",") if x.strip()) if kind is tuple else kind(raw)
        return cls(**values)


@dataclass(frozen=True)
class Domain:
    """How a domain is searched: its keywords, sizes, files that come first, names that are raised, own patterns."""

    domain: str
    keywords: tuple[str, ...] = ()
    description: str = ""
    top_n: int = 5
    max_chars: int = 6000
    pins: tuple[str, ...] = ()
    boosts: tuple[str, ...] = ()
    data_patterns: tuple[str, ...] = ()
    complex_patterns: tuple[str, ...] = ()

    def to_yaml(self) -> str:
        return yaml.safe_dump({k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}, sort_keys=False, allow_unicode=True)


def domain(text: str, name: str) -> Domain:
    """A domain's rules from YAML; what is missing has its default, single values become lists, patterns that don't
    compile are left out."""
    raw = yaml.safe_load(text) or {}
    known = {f.name: f for f in fields(Domain)}
    values: dict = {"domain": name}
    for key, value in raw.items() if isinstance(raw, dict) else ():
        if key in known and value is not None:
            if isinstance(known[key].default, tuple):
                value = tuple(str(v) for v in (value if isinstance(value, list) else [value]))
            values[key] = type(known[key].default)(value) if key in ("top_n", "max_chars") else value
    for key in ("data_patterns", "complex_patterns"):
        values[key] = tuple(p for p in values.get(key, ()) if _compiles(p))
    return Domain(**values)


def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def missing_keys(text: str) -> list[str]:
    """Required keys that a domain's YAML lacks."""
    raw = yaml.safe_load(text)
    return [k for k in REQUIRED if not isinstance(raw, dict) or k not in raw]


def overlay(base: Domain, **changes) -> Domain:
    return replace(base, **{k: v for k, v in changes.items() if v is not None})

"""Settings: defaults, then a file of KEY=VALUE lines, then the environment, then what the caller gives."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path
from urllib.parse import urlparse

PREFIX = "MNEMORA_"
_LOCAL = ("localhost", "127.0.0.1", "::1")
_YES, _NO = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


class ConfigError(ValueError):
    """A setting has a value that it can't have."""


@dataclass
class Config:
    base_url: str = "http://localhost:11434"
    model: str = "gemma3:4b"
    timeout_seconds: float = 120.0
    temperature: float = 0.0
    num_ctx: int = 4096
    max_retries: int = 2
    rules_only: bool = False
    allow_non_local: bool = False
    require_evidence: bool = True
    chunk_max_chars: int = 1500
    top_k: int = 8
    max_decisions: int = 3
    min_coverage: float = 0.6

    def __post_init__(self) -> None:
        host = urlparse(self.base_url)
        for wrong, message in (
            (host.scheme not in ("http", "https") or not host.hostname, f"base_url isn't one: {self.base_url!r}"),
            (not self.allow_non_local and (host.hostname or "").lower() not in _LOCAL, "base_url must be on this machine unless allow_non_local is set"),
            (not str(self.model).strip(), "model must not be empty"), (self.timeout_seconds <= 0, "timeout_seconds must be above 0"), (self.max_retries < 0, "max_retries must be 0 or more"),
            (self.chunk_max_chars < 200, "chunk_max_chars must be 200 or more"), (min(self.top_k, self.max_decisions) < 1, "top_k and max_decisions must be 1 or more"), (not 0 <= self.min_coverage <= 1, "min_coverage must be between 0 and 1"),
        ):
            if wrong:
                raise ConfigError(message)


def parse_bool(value: str, key: str = "value") -> bool:
    said = value.strip().lower()
    if said in _YES + _NO:
        return said in _YES
    raise ConfigError(f"{key} must be true or false, not {value!r}")


def read_env(path: str) -> dict[str, str]:
    """The file's KEY=VALUE lines; comments, and quotes around a value, go. A file that isn't there has none."""
    out: dict[str, str] = {}
    if not Path(path).is_file():
        return out
    for line in Path(path).read_text("utf-8-sig").splitlines():
        key, found, value = line.strip().partition("=")
        if not found or key.startswith("#"):
            continue
        value = value.strip()
        quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "'\""
        out[key.strip()] = value[1:-1] if quoted else value.partition(" #")[0].strip()
    return out


def load(env_file: str | None = ".env", environ: Mapping[str, str] | None = None, **given) -> Config:
    said = {**(read_env(env_file) if env_file else {}), **(os.environ if environ is None else environ)}
    read = {bool: parse_bool, int: lambda v, _: int(v), float: lambda v, _: float(v), str: lambda v, _: v.strip()}
    out = {}
    for f in fields(Config):
        key = PREFIX + f.name.upper()
        if said.get(key, "").strip():
            try:
                out[f.name] = read[type(f.default)](said[key], key)
            except ConfigError:
                raise
            except ValueError as e:
                raise ConfigError(f"{key} has an invalid value: {said[key]!r}") from e
    return Config(**{**out, **given})

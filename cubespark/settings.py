"""Settings of a user: a TOML or JSON file under the defaults of a session, and changes for a while."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, fields, replace
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Settings:
    """``fail_mode`` of nodes that name none; folders of data and caches; rows a look at a step shows."""

    fail_mode: str = "fail"
    data_folder: str = ""
    cache_folder: str = ""
    probe_rows: int = 20


_now = Settings()


def current() -> Settings:
    return _now


def load(path: str | Path) -> Settings:
    """The settings of a file laid over the current ones, which it replaces; unknown names are an error."""
    raw = Path(path).read_text()
    return _set(json.loads(raw) if str(path).endswith(".json") else tomllib.loads(raw))


def _set(values: dict[str, Any]) -> Settings:
    global _now
    if unknown := set(values) - {f.name for f in fields(Settings)}:
        raise KeyError(f"unknown settings {sorted(unknown)}")
    _now = replace(_now, **values)
    return _now


@contextmanager
def override(**values: Any) -> Iterator[Settings]:
    """Other settings within a block."""
    global _now
    before = _now
    try:
        yield _set(values)
    finally:
        _now = before

"""Requests: which slice of a cube is wanted, and with which parameters."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from typing import Any


def deep_merge(base: Mapping, over: Mapping) -> dict:
    """``base`` with ``over`` put on top, mappings merged key by key; neither is changed."""
    out = dict(base)
    for key, value in over.items():
        out[key] = deep_merge(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else value
    return out


def flatten(nested: Mapping, sep: str = ".", prefix: str = "") -> dict:
    out: dict = {}
    for key, value in nested.items():
        name = f"{prefix}{sep}{key}" if prefix else str(key)
        out |= flatten(value, sep, name) if isinstance(value, Mapping) and value else {name: value}
    return out


def unflatten(flat: Mapping, sep: str = ".") -> dict:
    out: dict = {}
    for name, value in flat.items():
        *path, last = str(name).split(sep)
        at = out
        for key in path:
            at = at.setdefault(key, {})
        at[last] = value
    return out


def to_datetime(value: Any) -> datetime:
    """A naive UTC time from a time, a date string (with or without a zone) or epoch seconds."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    elif isinstance(value, int | float):
        value = datetime.fromtimestamp(value, timezone.utc)
    return value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value


def is_datetime(value: Any) -> bool:
    try:
        to_datetime(value)
    except (ValueError, TypeError, AttributeError):
        return False
    return not isinstance(value, bool)


def jsonable(value: Any) -> Any:
    if isinstance(value, Mapping):
        return {str(k): jsonable(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set | frozenset):
        return [jsonable(v) for v in (sorted(value) if isinstance(value, set | frozenset) else value)]
    if isinstance(value, datetime):
        return to_datetime(value).isoformat()
    if isinstance(value, timedelta):
        return value.total_seconds()
    return value.mark if hasattr(value, "mark") else value


@dataclass(frozen=True)
class Request:
    """Immutable: each step of planning makes a new one. Layers of ``config`` are global, types and keys."""

    indexers: Mapping[str, Any] = field(default_factory=dict)
    config: Mapping[str, Any] = field(default_factory=dict)

    @classmethod
    def of(cls, value: Mapping | Request) -> Request:
        return value if isinstance(value, Request) else cls(value.get("indexers", {}), value.get("config", {}))

    def with_indexers(self, **indexers: Any) -> Request:
        return Request({**self.indexers, **indexers}, self.config)

    def covering(self, other: Request) -> Request:
        """One request for both: equal but for ranges, which are widened to hold both. Other differences are an error."""
        if self.config != other.config or set(self.indexers) != set(other.indexers):
            raise ValueError("requests differ in more than their ranges")
        out = {}
        for dim, at in self.indexers.items():
            also = other.indexers[dim]
            if isinstance(at, Mapping) and isinstance(also, Mapping):
                ends = {k: [x.get(k) for x in (at, also)] for k in ("start", "stop")}
                out[dim] = {k: (min if k == "start" else max)(v) for k, v in ends.items() if None not in v}
            elif at == also:
                out[dim] = at
            else:
                raise ValueError(f"requests differ in {dim}")
        return Request(out, self.config)

    def config_for(self, key: str, kind: str, own: Mapping | None = None) -> dict:
        """A node's parameters; later layers win: its own, indexers, unscoped, global, its type's, its key's."""
        scoped = ("global", "types", "keys")
        out = {**(own or {}), **self.indexers, **{k: v for k, v in self.config.items() if k not in scoped}, **self.config.get("global", {})}
        out = deep_merge(out, self.config.get("types", {}).get(kind, {}))
        return deep_merge(out, self.config.get("keys", {}).get(key, {}))

    def canonical(self, without: Iterable[str] = ("self",)) -> str:
        body = {"indexers": jsonable(self.indexers), "config": {k: v for k, v in jsonable(self.config).items() if k not in set(without)}}
        return json.dumps(body, sort_keys=True, separators=(",", ":"))

    def digest(self) -> str:
        return hashlib.sha256(self.canonical().encode()).hexdigest()


def controls_to_request(controls: Mapping[str, Any], time: str = "ts") -> Request:
    """A request from flat controls: ``start`` and ``stop`` bound ``time``, dotted names are parameters, others indexers."""
    given = {k: v for k, v in controls.items() if v is not None}
    span = {k: to_datetime(given.pop(k)) for k in ("start", "stop") if k in given}
    config = unflatten({k: v for k, v in given.items() if "." in k})
    return Request(({time: span} if span else {}) | {k: v for k, v in given.items() if "." not in k}, config)

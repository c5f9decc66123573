"""A registry of operators by kind and name, and a runner for dependent stages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

_FACTORIES: dict[tuple[str, str], Callable[[], Any]] = {}
_MADE: dict[tuple[str, str], Any] = {}


def register(kind: str, name: str) -> Callable[[Callable[[], Any]], Callable[[], Any]]:
    def add(make: Callable[[], Any]) -> Callable[[], Any]:
        _FACTORIES[kind, name] = make
        _MADE.pop((kind, name), None)
        return make

    return add


def get(kind: str, name: str) -> Any:
    """The one instance of a registered operator; an unknown name says which there are."""
    if (kind, name) not in _FACTORIES:
        known = sorted(n for k, n in _FACTORIES if k == kind)
        raise KeyError(f"no {kind} named {name!r}; there are: {', '.join(known) or 'none'}")
    if (kind, name) not in _MADE:
        _MADE[kind, name] = _FACTORIES[kind, name]()
    return _MADE[kind, name]


@dataclass
class Stage:
    name: str
    run: Callable[[], Any]
    requires: tuple[str, ...] = ()
    critical: bool = False
    done: Callable[[], bool] = field(default=lambda: False)


def run_stages(stages: list[Stage]) -> tuple[str, dict[str, str]]:
    """Run stages in order: those whose output exists are cached, those whose requirements failed are
    skipped, a failed critical one ends the job. Returns ready, partial or failed, and each stage's status."""
    status: dict[str, str] = {}
    for s in stages:
        if any(status.get(r) not in ("done", "cached") for r in s.requires):
            status[s.name] = "skipped"
            continue
        if s.done():
            status[s.name] = "cached"
            continue
        try:
            s.run()
            status[s.name] = "done"
        except Exception:
            status[s.name] = "failed"
            if s.critical:
                return "failed", status
    return ("ready" if all(v in ("done", "cached") for v in status.values()) else "partial"), status

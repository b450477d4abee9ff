"""One cache per Python worker: workers live longer than an operator, so what
one operator remembers must not weigh on the next."""

from __future__ import annotations

from collections.abc import Callable

_HELD: dict = {}


def held(name, make: Callable):
    """The worker's cache ``name``; another operator's is dropped first."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def drop() -> None:
    _HELD.clear()

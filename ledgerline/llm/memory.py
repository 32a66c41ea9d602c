"""One operator's memory at a time in a Python worker.

Workers are reused from stage to stage, and operators remember words, pieces and dictionaries there. The one that
works takes over; what the others remember goes.
"""

from __future__ import annotations

from collections.abc import Callable

_release: dict[str, Callable[[], object]] = {}
_owner: list[str] = []


def claim(name: str, release: Callable[[], object]) -> None:
    """Called at each batch. ``release`` drops what the operator remembers."""
    _release[name] = release
    if _owner != [name]:
        for other, drop in _release.items():
            if other != name:
                drop()
        _owner[:] = [name]

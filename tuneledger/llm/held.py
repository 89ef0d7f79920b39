"""What a Python worker keeps from task to task, for one operator at a time.

Spark uses its Python workers again for the next stage. What an operator keeps there to save work, such as an
opened model or hashes of words, is dropped as soon as another operator keeps something in the same worker.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_HELD: dict[str, Any] = {}


def held(name: str, make: Callable[[], Any]) -> Any:
    """The value kept under this name, made if the worker holds none; all other values go."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def release() -> None:
    """Drop whatever the worker holds."""
    _HELD.clear()

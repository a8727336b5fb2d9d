"""What Python workers remember from task to task, and let go of when another operator's task comes to them.

Spark uses a worker again for whatever runs next, so what one stage of a
pipeline has remembered would stay in memory beside what the next one needs.
"""

from __future__ import annotations

import ctypes
import gc
from typing import Any

_held: list[Any] = []
_owner = ""


def remembered(cache: Any) -> Any:
    """Registers something with a clear method."""
    _held.append(cache)
    return cache


def enter(owner: str) -> None:
    """A task of owner begins: if the last one wasn't its own, all that is remembered goes back to the system."""
    global _owner
    if owner == _owner:
        return
    if _owner:
        for cache in _held:
            cache.clear()
        gc.collect()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library keeps what it has
            pass
    _owner = owner

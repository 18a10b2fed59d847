"""What worker processes remember between tasks.

Workers are reused, so a pipeline's stages would pile up their tables in the
same process. A stage claims the process first; the tables of others go.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_clear: dict[str, Callable[[], None]] = {}
_owner: list[str] = []


def register(name: str, clear: Callable[[], None]) -> None:
    _clear[name] = clear


def claim(name: str) -> None:
    """Forget what all others have remembered, and give the memory back."""
    if _owner == [name]:
        return
    _owner[:] = [name]
    for other, clear in _clear.items():
        if other != name:
            clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass

"""What Python workers keep between tasks belongs to one operator at a time.

Workers are used again by later stages. An operator that remembers something in a worker enters with its name; what another operator
remembered there is dropped first, and the memory goes back to the system where the C library can do that.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_drops: dict[str, Callable[[], object]] = {}
_owner: str | None = None


def remembers(owner: str, drop: Callable[[], object]) -> None:
    """Name the function that drops what ``owner`` remembers in this process."""
    _drops[owner] = drop


def enter(owner: str) -> None:
    """To be called when a task of ``owner`` starts in a worker."""
    global _owner
    if _owner == owner:
        return
    for name, drop in _drops.items():
        if name != owner:
            drop()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
    _owner = owner

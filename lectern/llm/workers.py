"""What Python workers keep between tasks.

A worker serves one stage after the other, and what an operator keeps in it (models, known words, powers) would lie beside all
that later stages do.  Every kind of task says at its start what it is going to use; the rest is let go, and made again if it
is asked for once more.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_kept: dict[str, Callable[[], None]] = {}


def keeps(name: str, clear: Callable[[], None]) -> None:
    """A module of this worker keeps something under a name, and clears it so."""
    _kept[name] = clear


def begin(*used: str) -> None:
    """A task begins that uses what is kept under these names, and nothing else."""
    for name, clear in _kept.items():
        if name not in used:
            clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # what was let go stays this process's otherwise
        trim(0)

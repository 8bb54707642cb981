"""Memory of Python workers: what is freed goes back to the system, so that idle workers beside the JVM stay small."""

from __future__ import annotations

import ctypes
import functools

import pyarrow as pa

#: Blocks from this size are mapped by themselves and unmapped when freed; smaller ones would cost more in page faults than they give back.
LEAST, TRIM = 8 << 20, 16 << 20


@functools.cache
def thrifty() -> None:
    """Called in a worker before its first batch. Without glibc it changes nothing but Arrow's pool."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        c = ctypes.CDLL(None)
        c.mallopt(-3, LEAST)  # M_MMAP_THRESHOLD, which also stops its growth
        c.mallopt(-1, TRIM)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):
        pass

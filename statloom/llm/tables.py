"""Look-up tables of whole numbers in numpy arrays, and the tables that a worker keeps between batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """Whole numbers from 0 to 2^63 - 2 by key, in open addressing; keys and values are looked up and put in by arrays.

    At most half of the slots are taken: put() starts anew when more would be.
    """

    def __init__(self, bits: int, kind: type = np.int32):
        self.bits, self.mask = bits, np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, kind)
        self.taken = 0

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray, kind: type = np.int32) -> Table:
        out = cls(max(4, int(len(keys) * 3).bit_length()), kind)
        out.put(keys.astype(np.int64), values)
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULTIPLY) >> np.uint64(64 - self.bits)).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys are distinct and not there yet."""
        if 2 * (self.taken + len(keys)) > len(self.keys):
            self.keys[:] = -1
            self.taken = 0
            most = len(self.keys) // 2
            keys, values = keys[:most], values[:most]
        self.taken += len(keys)
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            s = slot[left]
            free = self.keys[s] == -1
            self.keys[s[free]] = keys[left[free]]  # of several for one slot, one stays
            won = self.keys[s] == keys[left]
            self.values[s[won]] = values[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & self.mask

    def get(self, keys: np.ndarray, none: int = -1) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], none)
        left = np.flatnonzero((found != keys) & (found != -1))
        while len(left):
            s = slot[left] = (slot[left] + 1) & self.mask
            found = self.keys[s]
            hit = found == keys[left]
            out[left[hit]] = self.values[s[hit]]
            left = left[~hit & (found != -1)]
        return out


_owner = ""
_kept: dict[str, object] = {}


def claim(owner: str) -> None:
    """Drop the tables of another operator that ran in this worker before, and give freed memory back to the system."""
    global _owner
    if owner != _owner:
        _kept.clear()
        _owner = owner
    release()


def worker_table(owner: str, name: str, make: Callable[[], object] = dict) -> object:
    """This worker's table `name` of the operator `owner`, made on first use.

    When another operator asks, the tables of the one before go, so that a worker that runs one stage after another holds
    the tables of one.
    """
    if owner != _owner:
        claim(owner)
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which has no such call
        return

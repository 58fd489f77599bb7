"""A cache of small answers, bounded in entries and bytes, that computes each key once."""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Callable, Hashable


class BoundedCache:
    def __init__(self, entries: int, size: int, weigh: Callable[[object], int] = len):
        self.entries, self.size, self.weigh = entries, size, weigh
        self.held: OrderedDict[Hashable, tuple[object, int]] = OrderedDict()
        self.bytes = 0
        self._lock = threading.Lock()
        self._at_work: dict[Hashable, threading.Lock] = {}

    def get(self, key: Hashable, make: Callable[[], object]) -> object:
        """The value of ``key``; made by one caller while others of that key wait."""
        with self._lock:
            mine = self._at_work.setdefault(key, threading.Lock())
        with mine:
            with self._lock:
                if key in self.held:
                    self.held.move_to_end(key)
                    return self.held[key][0]
            value = make()
            self._put(key, value)
        with self._lock:
            self._at_work.pop(key, None)
        return value

    def _put(self, key: Hashable, value: object) -> None:
        weight = self.weigh(value)
        with self._lock:
            if weight > self.size:
                return  # larger than the whole cache
            self.held[key] = value, weight
            self.bytes += weight
            while len(self.held) > self.entries or self.bytes > self.size:
                _, (_, gone) = self.held.popitem(last=False)
                self.bytes -= gone

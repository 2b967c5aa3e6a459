"""Results kept for a while: a persisted DataFrame for each function and its arguments."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import DataFrame


class TimedCache:
    """Keeps what make() returns for `seconds`; an older entry is made anew on access.

    With a capacity, the entry that was asked for least recently goes when there are more. clear() drops all and tells how
    many there were.
    """

    def __init__(self, seconds: float = 3600, clock: Callable[[], float] = time.monotonic, capacity: int | None = None) -> None:
        self.seconds, self.clock, self.capacity = seconds, clock, capacity
        self._kept: OrderedDict[tuple[Hashable, ...], tuple[float, DataFrame]] = OrderedDict()

    def get(self, name: str, make: Callable[[], DataFrame], **arguments: Any) -> DataFrame:
        key, now = (name, *sorted(arguments.items())), self.clock()
        if key in self._kept:
            since, df = self._kept[key]
            if now - since < self.seconds:
                self._kept.move_to_end(key)
                return df
            self._drop(key)
        df = make().persist()
        self._kept[key] = now, df
        if self.capacity is not None and len(self._kept) > self.capacity:
            self._drop(next(iter(self._kept)))
        return df

    def _drop(self, key: tuple[Hashable, ...]) -> None:
        self._kept.pop(key)[1].unpersist()

    def clear(self) -> int:
        n = len(self._kept)
        for key in [*self._kept]:
            self._drop(key)
        return n

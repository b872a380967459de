"""Per-worker work on distinct pieces of text: each is handled once, then looked up."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark import Broadcast
from pyspark.sql import SparkSession

#: Characters with the Unicode property White_Space besides the plain space.
OTHER_SPACE = "\t\n\x0b\x0c\r\x85\xa0                　"


def bounded_batches(spark: SparkSession, size: str = "4m") -> SparkSession:
    """Cut Arrow batches by bytes: the default of 10,000 rows of long texts would fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return spark


def kept(shared: Broadcast, make: Callable):
    """``make(value)`` once per Python worker: a worker loads a broadcast dict once, and what is put in
    it there lasts over the worker's tasks."""
    if "kept" not in shared.value:
        shared.value["kept"] = make(shared.value)
    return shared.value["kept"]


class Memo:
    """Values of ``make`` by key, computed for all missing keys of a block at once.

    Holds at most ``limit`` entries between blocks; beyond it starts afresh, which costs time only."""

    def __init__(self, make: Callable[[list], Iterable], limit: int = 400_000):
        self.make, self.limit, self.known = make, limit, {}

    def table(self, keys: set) -> dict:
        new = keys.difference(self.known)  # walks the keys, where - walks all that is known
        if len(self.known) + len(new) > self.limit and self.known:
            self.known, new = {}, keys
        new = list(new)
        self.known.update(zip(new, self.make(new)))
        return self.known


def blocks(values: Iterable, chars: int = 4_000_000) -> Iterator[list]:
    """Runs of values with about ``chars`` characters each (a longer value is a block of its own)."""
    block, size = [], 0
    for v in values:
        block.append(v)
        size += len(v)
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block

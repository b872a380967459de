"""Blocks of text with words numbered within the block, and the exchange that numbers them in the corpus.

A block holds about ``WORDS`` words of whole texts as 32-bit numbers of its own distinct words.  Distinct
words go to slices by hash, one row per (slice, block); a slice adds the counts of its words and answers
every block that asked.  So the corpus vocabulary is spread over slices and never whole in one place,
and a word that is everywhere is one entry per block.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tideframe.llm.filters import pack_numbers, unpack_numbers

WORDS = 1_500_000
ENTRIES_PER_SLICE = 500_000
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))  # A-Z in lower case


class Numbers(dict):
    """Numbers words from ``first`` on as they are met."""

    def __init__(self, first: int = 0):
        self.first = first

    def __missing__(self, word):
        self[word] = number = self.first + len(self)
        return number


def block_number() -> Iterator[int]:
    """Numbers of blocks that no other task of the job gives."""
    first = TaskContext.get().partitionId() << 32
    while True:
        yield first
        first += 1


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now.

    Its cleaner follows the garbage collection of the driver, which may not come for long while a job has
    round after round of shuffles.  What the first collection finalises, the second one frees."""
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def word_requests(blocks: DataFrame) -> DataFrame:
    """(slice, block, grp, words, own, n) rows from blocks with a column ``vocab`` of (grp, words, own, n, size).

    ``words`` are joined by a space, ``own`` are their packed numbers in the block, ``n`` their packed counts."""
    entries = blocks.select(F.explode("vocab").alias("v")).agg(F.sum("v.size")).first()[0] or 0
    slices = -(-entries // ENTRIES_PER_SLICE)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, vocab in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for v in vocab:
                    words = v["words"].split(b" ")
                    own, n = unpack_numbers(v["own"]), unpack_numbers(v["n"])
                    part = np.fromiter((zlib.crc32(w) % slices for w in words), dtype=np.int64, count=len(words))
                    order = np.argsort(part, kind="stable")
                    found, starts = np.unique(part[order], return_index=True)
                    for k, lo, hi in zip(found.tolist(), starts, [*starts[1:], len(order)]):
                        at = order[lo:hi]
                        rows.append((k, block, v["grp"], b" ".join([words[i] for i in at.tolist()]), pack_numbers(own[at]), pack_numbers(n[at])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()))], ["slice", "block", "grp", "words", "own", "n"])

    return blocks.select("block", "vocab").mapInArrow(deal, "slice long, block long, grp string, words binary, own binary, n binary")


def numbered(table: pa.Table) -> tuple[list[tuple[str, bytes]], list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """A slice's distinct (group, word), and of each request their places among them, own numbers and counts."""
    index: dict[str, Numbers] = {}
    places, owns, counts, names = [], [], [], []
    for grp, words, own, n in zip(*(table.column(c).to_pylist() for c in ("grp", "words", "own", "n"))):
        known = index.setdefault(grp, {})
        place = []
        for word in words.split(b" "):
            if word not in known:
                known[word] = len(names)
                names.append((grp, word))
            place.append(known[word])
        places.append(np.array(place, dtype=np.int64))
        owns.append(unpack_numbers(own))
        counts.append(unpack_numbers(n))
    return names, places, owns, counts

"""Near-duplicate groups of whole texts by SimHash and multi-index hashing.

Fingerprint: letters A-Z are lower-cased; words are runs other than space and \\x09-\\x0D; every
3-word shingle (repeats count; a shorter text is one shingle) is hashed with XXH64, seed 42; a bit is
1 if set in over half the hashes.  No words: fingerprint zero.

Search: a fingerprint has two segments of 32 bits.  Of two fingerprints at 3 or fewer differing bits
one segment differs in at most 1 bit.  Each distinct fingerprint stands in the table of each segment
under its value and enumerates the small Hamming ball around it; only flips of 1 bits to 0 are
needed, since of two values one bit apart exactly one has the 1.  A task reads the table and ball
entries of a value together, verifies the complete distance of the entries, and hands on one link
per fingerprint and value that connects what the verified pairs connect.  Values with many entries
are split by the four bytes of the other segment, of which one must agree.

Defined results: null text is empty; rows with null id are linked and grouped, a group's id is its
smallest non-null id (null if none); rows repeated with the same id are in the same group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from tideframe.llm.graphs import components, forest
from tideframe.llm.words import bounded_batches
from tideframe.session import staged

UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Entries of one value from which it is split by bytes of the other segment.
SPLIT = 1024


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    words = text.translate(UPPER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = [0, *ends[:-shingle].tolist()]
        hashed = xxhash.xxh64_intdigest
        hashes = [hashed(joined[lo:hi], seed) for lo, hi in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
    counts = np.zeros(64, dtype=np.int64)
    h = np.array(hashes, dtype="<u8")
    for lo in range(0, len(h), 65_536):
        counts += np.unpackbits(h[lo : lo + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


@F.arrow_udf(LongType())
def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The fingerprint as a signed 64-bit number."""
    for batch in batches:
        prints = [fingerprint(t or b"") for t in batch.cast(pa.binary()).to_pylist()]
        yield pa.array(np.array(prints, dtype=np.uint64).view(np.int64))


def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Table entries (ball = 0) and ball entries (1) of each fingerprint: value = segment number and segment."""
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for segment in (0, 1):
            part = (prints >> np.uint64(32 * segment)) & np.uint64(0xFFFFFFFF)
            base = np.uint64(segment << 32)
            bits = (part[:, None] >> np.arange(32, dtype=np.uint64)) & np.uint64(1)
            row, bit = np.nonzero(bits)
            ball = part[row] ^ (np.uint64(1) << bit.astype(np.uint64))
            value = np.concatenate([part, ball]) | base
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(np.concatenate([prints, prints[row]]).view(np.int64)), pa.array(np.repeat(np.array([0, 1], dtype=np.int32), [len(part), len(ball)]))], ["value", "print", "ball"])


def verified(group: np.ndarray, prints: np.ndarray, ball: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs at ``bits`` or fewer differing bits that share a group, one of them a table entry.
    Rows are sorted by group, table entries first."""
    at = np.flatnonzero((ball[:-1] == 0) & (group[:-1] == group[1:])) if len(group) else np.array([], dtype=np.int64)
    step = 1
    while len(at):
        near = np.bitwise_count(prints[at] ^ prints[at + step]) <= bits
        yield prints[at[near]], prints[at[near] + step]
        step += 1
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]


def by_other_bytes(value: np.ndarray, prints: np.ndarray, ball: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of a crowded value, four times, grouped by value and one byte of the other segment."""
    other = np.where(value >> np.uint64(32) == 0, prints >> np.uint64(32), prints) & np.uint64(0xFFFFFFFF)
    _, number = np.unique(value, return_inverse=True)
    group = np.concatenate([number * 1024 + k * 256 + ((other >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64) for k in range(4)])
    prints, ball = np.tile(prints, 4), np.tile(ball, 4)
    order = np.lexsort((ball, group))
    return group[order], prints[order], ball[order]


def linker(bits: int):
    def link(value: np.ndarray, prints: np.ndarray, ball: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        sizes = np.diff(np.append(starts, len(value)))
        crowded = np.repeat(sizes > SPLIT, sizes)
        a, b, held = [], [], 0
        sets = [(value[~crowded], prints[~crowded], ball[~crowded])]
        if crowded.any():
            sets.append(by_other_bytes(value[crowded], prints[crowded], ball[crowded]))
        for s in sets:
            for x, y in verified(*s, bits):
                a.append(x)
                b.append(y)
                held += len(x)
                if held > 1_000_000:
                    x, y = forest(np.concatenate(a), np.concatenate(b))
                    a, b, held = [x], [y], len(x)
        if a:
            x, y = forest(np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64))
        else:
            x = y = np.array([], dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)))
            rows += batch.num_rows
            if rows >= 200_000:
                value, prints, ball = (np.concatenate(c) for c in zip(*held))
                cut = int(np.searchsorted(value, value[-1]))  # the last value may go on in the next batch
                if cut:
                    yield link(value[:cut].view(np.uint64), prints[:cut].view(np.uint64), ball[:cut])
                held, rows = [(value[cut:], prints[cut:], ball[cut:])], len(value) - cut
        if rows:
            value, prints, ball = (np.concatenate(c) for c in zip(*held))
            yield link(value.view(np.uint64), prints.view(np.uint64), ball)

    return run


def near_links(prints: DataFrame, bits: int = 3) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints in column ``print`` as all pairs at ``bits``
    (at most 3) or fewer differing bits do."""
    if not 0 <= bits <= 3:
        raise ValueError("two segments with balls of radius 1 find up to 3 differing bits")
    rows = prints.mapInArrow(entries, "value long, print long, ball int")
    return rows.repartition("value").sortWithinPartitions("value", "ball").mapInArrow(linker(bits), "a long, b long")


def grouped(rows: DataFrame, bits: int) -> DataFrame:
    """rows: id, print and more.  The same rows with root (a fingerprint that names the group) and
    component_id (smallest id of the group)."""
    smallest = rows.groupBy("print").agg(F.min("id").alias("least"))
    roots = components(near_links(smallest.select("print"), bits))
    of = smallest.join(roots, smallest["print"] == roots["node"], "left").select("print", F.coalesce("root", "print").alias("root"), "least")
    groups = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(of.join(groups, "root").select("print", "root", "component_id"), "print")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id."""
    bounded_batches(docs.sparkSession)
    rows = staged(docs.select(F.col(id_col).alias("id"), simhash(F.col(text_col)).alias("print")))
    return grouped(rows, bits).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 3) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row with the smallest id stays,
    of several rows with that id (or of a group without ids) the one whose text has the smallest hash.
    A row is known by its id and the hash of its text, so rows that share an id, or have none, are
    decided each in their own group."""
    bounded_batches(docs.sparkSession)
    names = docs.columns
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = staged(docs.select(F.col(id_col).alias("id"), mark.alias("mark"), simhash(F.col(text_col)).alias("print")))
    found = staged(grouped(rows, bits).select("id", "mark", "root").distinct())
    # a pair of id and mark lies in one group, so the rows that stay are taken off without joining by group
    stays = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "mark")).alias("first")).select(F.col("first.id").alias("own_id"), F.col("first.mark").alias("own_mark"))
    gone = found.join(stays, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("mark") == F.col("own_mark")), "left_anti").select(F.col("id").alias("gone_id"), F.col("mark").alias("gone_mark"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).alias("id"), mark.alias("mark"))
    rest = row.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("mark") == F.col("gone_mark")), "left_anti")
    # rows with the same id and text: one of them
    first = Window.partitionBy("id", "mark").orderBy("row")
    return rest.withColumn("place", F.row_number().over(first)).where("place = 1").select("row.*")

"""Shards of near equal bytes by histogram sort, in DataFrame operations only.

Order: rows are sorted by the key (hash of the text, hash of the id), so equal texts lie side by
side.  Splitters: the bytes below candidate boundaries are counted exactly over all partitions; for
every target (a multiple of the total over the number of pieces) the bin that holds it is cut into
finer bins and counted again, until every boundary between shards is within ``tolerance`` (a share of a shard) of its target.  A round refines the hash
of the text by ``BITS`` bits; then, where the copies of one text lie across a boundary, the hash of
the id refines within them.  A boundary between shards does so only when its target is more than
``uncut`` (a share of a shard) away from both ends of the copies, so that smaller groups of equal
texts stay in one shard.  A round brings at most pieces x 2^BITS sums to the driver, whatever the
input (pieces within a shard are settled after two rounds, 2^20 sums, or before).

A shard consists of ``parts`` pieces with splitters of their own (by default enough for two pieces per
shuffle partition), so neither the numbering nor a task
ever sees a whole shard: one exchange deals the rows to pieces, a row's slot is the number of rows
in the shard's pieces before plus its place in its piece.

Defined results: a null text has no bytes, and every row counts one byte more, so empty tables give
no rows and tables of empty texts are dealt evenly; a null id sorts by the hash of null; repeated
rows take slots of their own.  Columns of the input stay, save those named like the results.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideframe.session import staged

BITS = 10
#: How far off a boundary between two pieces of one shard may be, as a share of a piece.
INNER = 0.1
LEVELS = ["high"] * 6 + ["low"] * 6  # 60 bits of the text's hash, then 60 of the id's


def size_of(text: Column) -> Column:
    """UTF-8 bytes plus one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def keys(text: Column, row_id: Column) -> list[Column]:
    """(high, low): 60 bits each, so they never are negative."""
    return [F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 4).alias("high"), F.shiftrightunsigned(F.xxhash64(row_id, F.lit(7)), 4).alias("low")]


def splitters(sized: DataFrame, shards: int, parts: int, tolerance: float, uncut: float) -> list[tuple[int, int]]:
    """Keys (high, low) at which pieces 1 to shards x parts - 1 begin.  sized: high, low, size."""
    total, pieces = sized.agg(F.sum("size")).first()[0] or 0, shards * parts
    if not total:
        return []
    # an open target: its bytes, the prefix (high, low) of the bin that holds it, the bytes before that bin and in it
    open_ = [(total * k / pieces, 0, 0, 0, total) for k in range(1, pieces)]
    between_shards = {total * k / pieces for k in range(parts, pieces, parts)}
    slack = {o[0]: tolerance * total / shards if o[0] in between_shards else INNER * total / pieces for o in open_}
    done: dict[float, tuple[int, int]] = {}
    for level, part in enumerate(LEVELS):
        left = 60 - BITS * (level % 6 + 1)
        if level == 6:  # bins are now the copies of one text: a boundary goes to the nearer side of small ones
            small = [o for o in open_ if o[0] in between_shards and min(o[0] - o[3], o[3] + o[4] - o[0]) <= uncut * total / shards]
            done |= {t: (high if t - at <= at + size - t else high + 1, 0) for t, high, _, at, size in small}
            open_ = [o for o in open_ if o[0] not in done]
        if not open_:
            break
        bins = sorted({(high, low) for _, high, low, _, _ in open_})
        if level == 0:
            rows = sized
        elif part == "high":
            rows = sized.where(F.shiftright("high", left + BITS).isin([high >> (left + BITS) for high, _ in bins]))
        else:
            rows = sized.where(F.col("high").isin(sorted({high for high, _ in bins})))
            if level > 6:
                rows = rows.where(F.struct("high", F.shiftright("low", left + BITS).alias("low")).isin([F.struct(F.lit(h).cast("long").alias("high"), F.lit(lo >> (left + BITS)).cast("long").alias("low")) for h, lo in bins]))
        names = ["high"] if part == "high" else ["high", "low"]
        cut = [F.shiftleft(F.shiftright(n, left), left).alias(n) if n == part else F.col(n) for n in names]
        counted: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r in rows.groupBy(*cut).agg(F.sum("size").alias("size")).collect():
            low = r["low"] if part == "low" else 0
            mask = ~((1 << (left + BITS)) - 1)
            home = (r["high"] & mask, 0) if part == "high" else (r["high"], low & mask)
            counted.setdefault(home, []).append(((r["high"] if part == "high" else low), r["size"]))
        still = []
        for target, high, low, at, _ in open_:
            for value, size in sorted(counted[high, low]):
                key = (value, 0) if part == "high" else (high, value)
                if at + size > target:
                    break
                at += size
            if target - at <= slack[target]:
                done[target] = key
            elif at + size - target <= slack[target]:
                done[target] = (value + (1 << left), 0) if part == "high" else (high, value + (1 << left))
            else:
                still.append((target, *key, at, size))
        open_ = still
    done |= {target: (high, low) for target, high, low, _, _ in open_}  # rows with one key can't be cut
    return [done[t] for t in sorted(done)]


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, tolerance: float = 0.001, uncut: float = 0.02) -> DataFrame:
    """The rows of ``docs`` with size, shard (0 to shards - 1) and slot (gapless from 0 in a shard)."""
    parts = parts or max(16, math.ceil(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) / shards))
    names = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    text, row_id = F.col(text_col), F.col(id_col)
    sized = staged(docs.select(*keys(text, row_id), size_of(text).alias("size")))
    at = splitters(sized, shards, parts, tolerance, uncut)
    # boundaries by the first bits of the key: a row is compared with those of its own bin only
    bins: list[list[tuple[int, int]]] = [[] for _ in range(1 << BITS)]
    for bound in at:
        bins[min(bound[0] >> (60 - BITS), len(bins) - 1)].append(bound)
    kind = "array<struct<high: bigint, low: bigint>>"
    inside = F.array(*[F.array(*[F.struct(F.lit(h).cast("long").alias("high"), F.lit(lo).cast("long").alias("low")) for h, lo in b]).cast(kind) for b in bins])
    before = F.array(*[F.lit(n) for n in accumulate([0, *map(len, bins[:-1])])])

    def piece_of(high: Column, low: Column) -> Column:
        place = F.shiftright(high, 60 - BITS).cast("int")
        return F.get(before, place) + F.size(F.filter(F.get(inside, place), lambda b: b <= F.struct(high.alias("high"), low.alias("low"))))

    counts = sized.groupBy(piece_of(F.col("high"), F.col("low")).alias("piece")).agg(F.count("*").alias("rows"))
    shard_of = F.floor(F.col("piece") / parts)
    earlier = Window.partitionBy("of_shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("of_shard", shard_of).select(F.col("piece").alias("of_piece"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("first"))
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    high, low = keys(F.col("row")[text_col], F.col("row")[id_col])
    keyed = docs.select(row.alias("row")).select("row", high, low).withColumn("piece", piece_of(F.col("high"), F.col("low")))
    place = F.row_number().over(Window.partitionBy("piece").orderBy("high", "low", F.col("row")[id_col]))
    # one row per piece, so its size is bounded by shards x parts
    placed = keyed.withColumn("place", place).join(F.broadcast(firsts), F.col("piece") == F.col("of_piece"))
    return placed.select("row.*", size_of(F.col("row")[text_col]).alias("size"), shard_of.cast("int").alias("shard"), (F.col("first") + F.col("place") - 1).alias("slot"))

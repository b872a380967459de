"""Phrase collocations mined with counting quotient filters.

Words that occur often enough in their group (language) are numbered; a phrase of n words is packed into
64 bits as (number of its first n - 1 words, number of its last word).  A phrase can only be frequent if
the two phrases of n - 1 words in it are, so each round packs just the places where they are: an exact
rule, which drops no frequent phrase.  Every block counts its packed phrases in quotient filters, cut
into slices of the permuted key space; a slice merges the sorted filters of all blocks, adds the
counters, inverts the permutation and answers each block with the numbers of its frequent phrases.
Every block has one entry per phrase, so a phrase that is everywhere weighs no more than another.

Scores are integers: floor(1000 a n / (l r)) in 38-digit decimals, whose integer division is exact.

Defined results: a null group is ``und``; null and empty texts have no words; repeated rows count as often as
they are there; equal scores are ordered by count, then by the phrase's bytes.  An empty table gives no rows.
Bits of phrase number and word number must be 64 at most together (an error otherwise).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tideframe.llm import filters
from tideframe.llm.shards import LETTERS, WORDS, Numbers, block_number, numbered, release, word_requests
from tideframe.llm.words import bounded_batches
from tideframe.session import STAGED, drop_folder, staged

#: Bytes that end a piece become 0xFF, which no UTF-8 text has; tabs become spaces.
ENDS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes(0xFF if b in ENDS else 32 if b == 9 else LETTERS[b] for b in range(256))


def word_blocks(docs: DataFrame, group: Column, text: Column) -> DataFrame:
    """(block, ids, vocab) rows: 0 in ids is an end of a piece."""
    schema = "block long, ids binary, vocab array<struct<grp:string,words:binary,own:binary,n:binary,size:long,total:long>>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = block_number()
        groups: dict[str, list[np.ndarray]] = {}
        words: dict[str, Numbers] = {}
        size = 0

        def block() -> pa.RecordBatch:
            vocab, ids, first = [], [], 0
            for grp, parts in groups.items():
                own = np.concatenate(parts)
                known = list(words[grp])[1:]
                if known:
                    n = np.bincount(own, minlength=len(known) + 1)[1:]
                    vocab.append({"grp": grp, "words": b" ".join(known), "own": filters.pack_numbers(np.arange(first + 1, first + len(known) + 1)), "n": filters.pack_numbers(n), "size": len(known), "total": int(n.sum())})
                ids.append(np.where(own > 0, own + first, 0))
                first += len(known)
            return pa.RecordBatch.from_pylist([{"block": next(new), "ids": filters.pack_numbers(np.concatenate(ids)), "vocab": vocab}], schema=ARROW_BLOCK)

        for batch in batches:
            for grp, body in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                tokens = body.translate(TABLE).replace(b"\xff", b" \xff ").split()
                known = words.get(grp)
                if known is None:
                    known = words[grp] = Numbers()
                    known[b"\xff"] = 0
                    groups[grp] = []
                groups[grp] += [np.fromiter(map(known.__getitem__, tokens), dtype=np.int32, count=len(tokens)), np.zeros(1, dtype=np.int32)]
                size += len(tokens)
                if size >= WORDS:
                    yield block()
                    groups, words, size = {}, {}, 0
        if groups:
            yield block()

    return docs.select(group.alias("grp"), text.alias("body")).mapInArrow(cut, schema)


ARROW_BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("vocab", pa.list_(pa.struct([("grp", pa.string()), ("words", pa.binary()), ("own", pa.binary()), ("n", pa.binary()), ("size", pa.int64()), ("total", pa.int64())])))])
#: What a slice puts out: a frequent word or phrase (block is null), or its answer to a block.
ANSWER = "block long, id long, left long, right long, f long, grp string, word string, keys binary, ids binary"
ARROW_ANSWER = pa.schema([("block", pa.int64()), ("id", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("f", pa.int64()), ("grp", pa.string()), ("word", pa.string()), ("keys", pa.binary()), ("ids", pa.binary())])
#: A block between rounds, or its request to a slice.
REQUEST = "block long, slice long, words binary, phrases binary, filter binary, places long"
ARROW_REQUEST = pa.schema([("block", pa.int64()), ("slice", pa.int64()), ("words", pa.binary()), ("phrases", pa.binary()), ("filter", pa.binary()), ("places", pa.int64())])


def answers(columns: dict, n: int) -> pa.Table:
    return pa.Table.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in ARROW_ANSWER], schema=ARROW_ANSWER)


def numbers_of(sums: np.ndarray, least: int, slice_number: int, slices: int) -> np.ndarray:
    """Numbers of the frequent entries of a slice, from 1 on and dense over equal slices; 0 for the others."""
    often = sums >= least
    return np.where(often, (np.cumsum(often) - 1) * slices + slice_number + 1, 0)


def frequent_words(requests: DataFrame, least: int, slices: int) -> DataFrame:
    def add(key: tuple, table: pa.Table) -> pa.Table:
        names, places, owns, counts = numbered(table)
        sums = np.bincount(np.concatenate(places), weights=np.concatenate(counts), minlength=len(names)).astype(np.int64)
        ids = numbers_of(sums, least, key[0].as_py(), slices)
        often = np.flatnonzero(ids)
        out = [answers({"id": ids[often], "f": sums[often], "grp": [names[k][0] for k in often], "word": [names[k][1].decode("utf-8", "replace") for k in often]}, len(often))]
        hits = [(b, filters.pack_numbers(own[ids[p] > 0]), filters.pack_numbers(ids[p][ids[p] > 0])) for b, p, own in zip(table.column("block").to_pylist(), places, owns) if (ids[p] > 0).any()]
        out.append(answers(dict(zip(("block", "keys", "ids"), zip(*hits))), len(hits)) if hits else answers({}, 0))
        return pa.concat_tables(out)

    return requests.groupBy("slice").applyInArrow(add, ANSWER)


def frequent_phrases(requests: DataFrame, least: int, bits: int, slice_bits: int, word_bits: int) -> DataFrame:
    """Merge of the filters of all blocks, slice by slice."""
    def add(key: tuple, table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        runs = [filters.unpack(f) for f in table.column("filter").to_pylist()]
        keys, places = filters.merge([r[0] for r in runs])
        sums = np.bincount(np.concatenate(places), weights=np.concatenate([r[1] for r in runs]), minlength=len(keys)).astype(np.int64)
        ids = numbers_of(sums, least, number, 1 << slice_bits)
        packed = filters.Permutation(bits).unmix(filters.whole_keys(number, keys, bits, slice_bits))
        often = np.flatnonzero(ids)
        low = np.uint64(word_bits)
        out = [answers({"id": ids[often], "left": (packed[often] >> low).astype(np.int64), "right": (packed[often] & np.uint64(2**word_bits - 1)).astype(np.int64), "f": sums[often]}, len(often))]
        hits = [(b, filters.pack_numbers(packed[p][ids[p] > 0]), filters.pack_numbers(ids[p][ids[p] > 0])) for b, p in zip(table.column("block").to_pylist(), places) if (ids[p] > 0).any()]
        out.append(answers(dict(zip(("block", "keys", "ids"), zip(*hits))), len(hits)) if hits else answers({}, 0))
        return pa.concat_tables(out)

    return requests.groupBy("slice").applyInArrow(add, ANSWER)


def answered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All keys that the slices answered to a block, ascending, and their numbers."""
    keys, ids = (np.concatenate([*map(filters.unpack_numbers, table.column(c).to_pylist()), np.zeros(0, np.int64)]) for c in ("keys", "ids"))
    keys = keys.view(np.uint64)
    order = np.argsort(keys)
    return keys[order], ids[order]


def looked_up(keys: np.ndarray, known: np.ndarray, ids: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), dtype=np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, ids[at], 0)


def packed_at(words: np.ndarray, phrases: np.ndarray, n: int, word_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where both phrases of n - 1 words in n words are frequent, and the packed n words."""
    at = np.flatnonzero((phrases[:-1] > 0) & (phrases[1:] > 0))
    return at, (phrases[at].astype(np.uint64) << np.uint64(word_bits)) | words[at + n - 1].astype(np.uint64)


def kept_runs(words: np.ndarray, phrases: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Words in a frequent phrase of n words, with a 0 between runs."""
    edge = np.zeros(len(words) + n + 1, dtype=np.int64)
    at = np.flatnonzero(phrases)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    inside = np.cumsum(edge)[: len(words)] > 0
    take = inside.copy()
    take[1:] |= inside[:-1]
    return np.where(inside, words, 0)[take], np.where(inside, phrases, 0)[take]


def request_rows(block: int, words: np.ndarray, phrases: np.ndarray, n: int, word_bits: int, bits: int, slice_bits: int) -> pa.Table:
    """A block's row for the next round, and its filters of n-word phrases."""
    at, keys = packed_at(words, phrases, n, word_bits)
    mixed, counts = np.unique(filters.Permutation(bits).mix(keys), return_counts=True)
    rows = [{"block": block, "words": filters.pack_numbers(words), "phrases": filters.pack_numbers(phrases) if n > 2 else None, "places": len(at)}]
    rows += [{"block": block, "slice": k, "filter": f} for k, f in filters.slices(mixed, counts, bits, slice_bits)]
    return pa.Table.from_pylist(rows, schema=ARROW_REQUEST)


def carried(n: int, word_bits: int, bits: int, slice_bits: int):
    """A function from a block and the answers to it to its requests for phrases of ``n`` words."""
    def carry(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return ARROW_REQUEST.empty_table()
        known, ids = answered(right)
        if n == 2:
            own = filters.unpack_numbers(left.column("ids")[0].as_py())
            of = np.zeros(int(max(own.max(initial=0), known.max(initial=0))) + 1, dtype=np.int64)
            of[known] = ids
            words = phrases = of[own]
        else:
            words = filters.unpack_numbers(left.column("words")[0].as_py())
            before = left.column("phrases")[0].as_py()
            at, keys = packed_at(words, words if before is None else filters.unpack_numbers(before), n - 1, word_bits)
            phrases = np.zeros(len(words), dtype=np.int64)
            phrases[at] = looked_up(keys, known, ids)
        words, phrases = kept_runs(words, phrases, n - 1)
        return request_rows(key[0].as_py(), words, phrases, n, word_bits, bits, slice_bits)

    return carry


class Held:
    """Staged tables of a round, dropped once the next round no longer needs them."""

    def __init__(self):
        self.folders: list = []

    def stage(self, df: DataFrame) -> DataFrame:
        out = staged(df)
        self.folders.append(STAGED[-1])
        return out

    def drop(self, count: int) -> None:
        for folder in self.folders[:count]:
            STAGED.remove(folder)
            drop_folder(*folder)
        del self.folders[:count]
        release(SparkSession.active())


def phrase_counts(docs: DataFrame, group: Column, text: Column, longest: int = 5, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """((grp, phrase, words, f) of all phrases of up to ``longest`` words that occur ``least`` times in their group,
    (grp, n) of all words of each group)."""
    spark = bounded_batches(docs.sparkSession)
    held = Held()
    blocks = held.stage(word_blocks(docs, group, text))
    totals = staged(blocks.select(F.explode("vocab").alias("v")).groupBy(F.col("v.grp").alias("grp")).agg(F.sum("v.total").alias("n")))
    requests = held.stage(word_requests(blocks))
    slices = (requests.agg(F.max("slice")).first()[0] or 0) + 1
    found = staged(frequent_words(requests, least, slices))
    top, words_in = found.where("block IS NULL").agg(F.max("id"), F.sum("f")).first()
    words = found.where("block IS NULL").select("id", "grp", F.col("word").alias("phrase"), "f")
    tables = [words]
    places, bits_of_left, word_bits = words_in or 0, (top or 1).bit_length(), (top or 1).bit_length()
    state, kind = blocks.select("block", "ids"), "<i4"
    for n in range(2, longest + 1):
        if not top:
            break
        bits = bits_of_left + word_bits
        slice_bits = filters.slice_bits_for(places, bits)

        replies = found.where("block IS NOT NULL").select("block", "keys", "ids")
        asked = held.stage(state.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(carried(n, word_bits, bits, slice_bits), REQUEST))
        held.drop(len(held.folders) - 1)
        found = staged(frequent_phrases(asked.where("slice IS NOT NULL").select("slice", "block", "filter"), least, bits, slice_bits, word_bits))
        state = asked.where("slice IS NULL").select("block", "words", "phrases")
        top, places = found.where("block IS NULL").agg(F.max("id"), F.sum("f")).first()
        places, bits_of_left = places or 0, (top or 1).bit_length()
        first, last = tables[-1].alias("p"), words.alias("w")
        grown = found.where("block IS NULL").alias("t").join(first, F.col("t.left") == F.col("p.id")).join(last, F.col("t.right") == F.col("w.id"))
        tables.append(staged(grown.select("t.id", "p.grp", F.concat_ws(" ", "p.phrase", "w.phrase").alias("phrase"), "t.f")))
    out = None
    for n, table in enumerate(tables, 1):
        rows = table.select("grp", "phrase", F.lit(n).alias("words"), "f")
        out = rows if out is None else out.unionByName(rows)
    out = staged(out)
    held.drop(len(held.folders))
    return out, totals


def ranked(counts: DataFrame, totals: DataFrame, first: int, share: int = 100, per_mille: int = 1000) -> DataFrame:
    """The ``first`` phrases of each group by score: (grp, rank, phrase, a, l, r, n, score).

    A phrase scores its lowest-scoring cut; phrases inside a longer one with ``share`` per cent of their count are left out."""
    phrase = counts.where("words > 1").select("grp", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"), "words")
    cuts = phrase.select("grp", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "w", "words")
    joined = lambda words: F.array_join(words, " ")
    cuts = cuts.select("grp", "phrase", "a", "k", joined(F.slice("w", F.lit(1), F.col("k"))).alias("head"), joined(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k"))).alias("tail"))
    side = lambda key, name: counts.select("grp", F.col("phrase").alias(key), F.col("f").alias(name))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.join(side("head", "l"), ["grp", "head"]).join(side("tail", "r"), ["grp", "tail"]).join(totals, "grp")
    scored = scored.withColumn("top", F.lit(per_mille).cast("decimal(5,0)") * (wide("a") * wide("n")).cast("decimal(33,0)")).withColumn("bottom", wide("l") * wide("r"))
    scored = scored.withColumn("score", F.expr("top div bottom"))
    best = scored.groupBy("grp", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spans = phrase.where("words > 2").select("grp", "a", "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    spans = spans.select("grp", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    inside = spans.select("grp", joined(F.slice("w", F.col("at"), F.col("size"))).alias("phrase"), "a").groupBy("grp", "phrase").agg(F.max("a").alias("longer"))
    left = best.join(inside, ["grp", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {share} * a")
    by_score = Window.partitionBy("grp").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    top = left.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= first)
    return top.select("grp", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, group_col: str = "lang", text_col: str = "text", longest: int = 5, least: int = 100, first: int = 2000) -> DataFrame:
    """The ``first`` collocations of each group, best first: group, rank, phrase, a, l, r, n, score."""
    counts, totals = phrase_counts(docs, F.coalesce(F.col(group_col), F.lit("und")), F.coalesce(F.col(text_col), F.lit("")), longest, least)
    return ranked(counts, totals, first).withColumnRenamed("grp", group_col)

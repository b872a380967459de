"""Deleted interpolation: maximum-likelihood n-gram estimates mixed by the frequency of their context.

P2(w | v) = k2(b) c(v w) / c(v) + (1 - k2(b)) P1(w), with b the bucket of c(v) (its number of binary digits), and
P1(w) = k1 c(w) / N + (1 - k1) / (V + 1): N tokens and V distinct ones in training, one class for all unknown words.
The weights k come from expectation-maximisation on held-out counts: training texts fall into parts, each part is
deleted in turn, and its n-grams are the held-out events of the estimates from the other parts.  An event matters
only by its bucket and by the ratio of the two estimates it mixes; ratios are counted in cells of 1/32 of a factor 2
(a table of fixed size), so the rounds of the maximisation read no data again.

Texts of one part form blocks with words numbered within the block (``shards``).  Distinct words, then distinct
word pairs of a block go to slices as quotient filters (``filters``); a slice adds the counts of all training
blocks and answers every block with the count of each pair, and with the share of the block's own part.  Nothing
is looked up row by row and no table of the model is ever whole in one place.

Defined results: a null or empty text is one end token; repeated rows count as often as they are there; a null id
is in the part of the empty text.  Without training texts every token has the probability 1 / (V + 1) = 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tideframe.llm import filters
from tideframe.llm.shards import LETTERS, WORDS, Numbers, block_number, numbered, release, word_requests
from tideframe.llm.words import bounded_batches
from tideframe.session import STAGED, drop_folder, staged

START, END = 0, 1  # numbers of the context before a text and of its end, in blocks and in the corpus
CELLS_PER_OCTAVE, CELLS = 32, 4096
BLOCK = "block long, part int, docs array<long>, lengths array<int>, ids binary, vocab array<struct<grp:string,words:binary,own:binary,n:binary,size:long>>"
ARROW_BLOCK = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("ids", pa.binary()), ("vocab", pa.list_(pa.struct([("grp", pa.string()), ("words", pa.binary()), ("own", pa.binary()), ("n", pa.binary()), ("size", pa.int64())])))])


def part_blocks(docs: DataFrame, doc_id: Column, part: Column, text: Column, parts: int) -> DataFrame:
    """Blocks of whole texts of one part each (the remainder of the block's number); words 0 and 1 are start and end."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, held = block_number(), {}

        def block(part: int, docs: list, texts: list[np.ndarray], words: Numbers) -> pa.RecordBatch:
            ids, vocab = np.concatenate(texts), []
            if words:
                n = np.bincount(ids, minlength=len(words) + 2)[2:]
                order = np.argsort(-n, kind="stable")  # frequent words get low numbers, whose upper bytes are alike
                number, known = np.arange(len(words) + 2), list(words)
                number[order + 2] = np.arange(2, len(words) + 2)
                ids, n, words = number[ids], n[order], [known[k] for k in order.tolist()]
                vocab = [{"grp": "", "words": b" ".join(words), "own": filters.pack_numbers(np.arange(2, len(words) + 2)), "n": filters.pack_numbers(n), "size": len(words)}]
            return pa.RecordBatch.from_pylist([{"block": next(new) * parts + part, "part": part, "docs": docs, "lengths": [len(t) for t in texts], "ids": filters.pack_numbers(ids), "vocab": vocab}], schema=ARROW_BLOCK)

        for batch in batches:
            for doc, part, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                tokens = body.translate(LETTERS).split()
                if part not in held:
                    held[part] = [[], [], Numbers(2), 0]
                docs, texts, words, _ = held[part]
                ids = np.fromiter(map(words.__getitem__, tokens), dtype=np.int32, count=len(tokens))
                docs.append(doc)
                texts.append(np.append(ids, np.int32(END)))
                held[part][3] += len(tokens) + 1
                if sum(h[3] for h in held.values()) >= 2 * WORDS:  # the fullest part makes room
                    most = max(held, key=lambda p: held[p][3])
                    yield block(most, *held.pop(most)[:3])
        for part, (docs, texts, words, _) in held.items():
            yield block(part, docs, texts, words)

    return docs.select(doc_id.alias("id"), part.alias("part"), text.alias("body")).mapInArrow(cut, BLOCK)


#: Answers to a block: counts in training and in the own part; of words (round 1) also own numbers, corpus numbers and the block's counts.
ANSWER = "block long, slice long, round int, own binary, ids binary, size long, sums binary, parts binary, n binary, known long"
ARROW_ANSWER = pa.schema([("block", pa.int64()), ("slice", pa.int64()), ("round", pa.int32()), ("own", pa.binary()), ("ids", pa.binary()), ("size", pa.int64()), ("sums", pa.binary()), ("parts", pa.binary()), ("n", pa.binary()), ("known", pa.int64())])


def part_sums(places: list[np.ndarray], counts: list[np.ndarray], parts: list[int], held_out: int, size: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Counts of a slice's keys in all training parts, and in each of them."""
    sums = {p: np.zeros(size, dtype=np.int64) for p in parts}
    for p, place, n in zip(parts, places, counts):
        if p != held_out:
            sums[p] += np.bincount(place, weights=n, minlength=size).astype(np.int64)
    return sum(sums.values(), np.zeros(size, dtype=np.int64)), sums


def answer_rows(round_: int, key: int, table: pa.Table, places: list[np.ndarray], counts: list[np.ndarray], total: np.ndarray, sums: dict[int, np.ndarray], own: list[np.ndarray] | None = None, ids: np.ndarray | None = None, known: int = 0) -> pa.Table:
    rows = []
    for k, (block, part, place) in enumerate(zip(table.column("block").to_pylist(), table.column("part").to_pylist(), places)):
        rows.append({"block": block, "slice": key, "round": round_, "own": filters.pack_numbers(own[k]) if own else None, "ids": filters.pack_numbers(ids[place] + 1) if ids is not None else None,
                     "size": len(place), "sums": filters.pack_numbers(total[place]), "parts": filters.pack_numbers(sums[part][place]), "n": filters.pack_numbers(counts[k]) if own else None, "known": known if not k else 0})
    return pa.Table.from_pylist(rows, schema=ARROW_ANSWER)


def word_counts(requests: DataFrame, slices: int, held_out: int) -> DataFrame:
    """Round 1: words known from training get corpus numbers from 2 on, the others -1."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        names, places, owns, counts = numbered(table)
        total, sums = part_sums(places, counts, table.column("part").to_pylist(), held_out, len(names))
        seen = total > 0
        ids = np.where(seen, (np.cumsum(seen) - 1) * slices + key[0].as_py() + 2, -1)
        return answer_rows(1, key[0].as_py(), table, places, counts, total, sums, owns, ids, int(seen.sum()))

    return requests.groupBy("slice").applyInArrow(add, ANSWER)


def pair_counts(requests: DataFrame, bits: int, slice_bits: int, held_out: int) -> DataFrame:
    """Round 2: counts of word pairs, in the order of the block's own permuted pairs."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        runs = [filters.unpack(f) for f in table.column("filter").to_pylist()]
        keys, places = filters.merge([r[0] for r in runs])
        total, sums = part_sums(places, [r[1] for r in runs], table.column("part").to_pylist(), held_out, len(keys))
        return answer_rows(2, key[0].as_py(), table, places, [r[1] for r in runs], total, sums)

    return requests.groupBy("slice").applyInArrow(add, ANSWER)


class Corpus:
    """What all tasks need to know: bounded by the number of parts and buckets."""

    def __init__(self, tokens: dict[int, int], docs: dict[int, int], distinct: int, held_out: int, word_bits: int):
        self.held_out, self.word_bits = held_out, word_bits
        train = [p for p in tokens if p != held_out]
        self.tokens, self.docs = sum(tokens[p] for p in train), sum(docs[p] for p in train)
        self.part_tokens = {p: tokens[p] if p in train else 0 for p in tokens}
        self.part_docs = {p: docs[p] if p in train else 0 for p in docs}
        self.distinct = distinct + (self.docs > 0)
        self.k1, self.k2 = 0.0, np.zeros(64)


class Block:
    """A block with the answers to it: counts of each word and each pair, in training and in its own part."""

    def __init__(self, row: dict, replies: list[dict], corpus: Corpus, bits: int):
        self.row, self.corpus = row, corpus
        self.ids = filters.unpack_numbers(row["ids"])
        self.lengths = np.array(row["lengths"], dtype=np.int64)
        self.ends = np.cumsum(self.lengths)
        size = max(int(self.ids.max()), END) + 1
        self.number, self.sums, self.own = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        part = row["part"]
        self.number[[START, END]] = START, END
        self.sums[[START, END]], self.own[[START, END]] = corpus.docs, corpus.part_docs[part]
        for r in replies:
            if r["round"] == 1:
                at = filters.unpack_numbers(r["own"])
                self.number[at], self.sums[at], self.own[at] = filters.unpack_numbers(r["ids"]) - 1, filters.unpack_numbers(r["sums"]), filters.unpack_numbers(r["parts"])
        if not corpus.docs:
            self.number[[START, END]] = -1
        before = np.empty_like(self.ids)
        before[1:] = self.ids[:-1]
        before[np.append(0, self.ends[:-1])] = START
        self.before = before
        # pairs of known words; a pair's key is permuted, so a block's distinct pairs come in the order of the slices
        self.pair_at = np.flatnonzero((self.number[before] >= 0) & (self.number[self.ids] >= 0))
        at = self.pair_at
        mixed = filters.Permutation(bits).mix((self.number[before[at]].astype(np.uint64) << np.uint64(corpus.word_bits)) | self.number[self.ids[at]].astype(np.uint64))
        self.pairs, self.pair_of, self.pair_n = np.unique(mixed, return_inverse=True, return_counts=True)
        second = sorted((r for r in replies if r["round"] == 2), key=lambda r: r["slice"])
        self.pair_sums = np.concatenate([*(filters.unpack_numbers(r["sums"]) for r in second), np.zeros(0, np.int64)])
        self.pair_own = np.concatenate([*(filters.unpack_numbers(r["parts"]) for r in second), np.zeros(0, np.int64)])

    def first(self, total: np.ndarray, tokens: int) -> np.ndarray:
        k, c = self.corpus.k1, self.corpus
        return k * total / max(tokens, 1) + (1 - k) / (c.distinct + 1)

    def held_out_cells(self) -> np.ndarray:
        """Events by bucket and cell of the block's pairs with its own part deleted."""
        c, part = self.corpus, self.row["part"]
        at = np.zeros(len(self.pairs), dtype=np.int64)
        at[self.pair_of] = self.pair_at
        context = (self.sums - self.own)[self.before[at]]
        seen = context > 0
        low = self.first((self.sums - self.own)[self.ids[at]], c.tokens - c.part_tokens[part])
        ratio = (self.pair_sums - self.pair_own)[seen] / context[seen] / low[seen]
        return np.bincount(buckets(context[seen]) * CELLS + cells(ratio), weights=self.pair_n[seen], minlength=64 * CELLS).astype(np.int64).reshape(64, CELLS)

    def scores(self) -> dict[str, np.ndarray]:
        c = self.corpus
        one = self.first(self.sums, c.tokens)[self.ids]
        context, ml = self.sums[self.before], np.zeros(len(self.ids))
        k = c.k2[buckets(context)]
        ml[self.pair_at] = self.pair_sums[self.pair_of] / np.maximum(context[self.pair_at], 1)
        known = self.sums[self.ids]
        base = np.log10((known + 0.5) / (c.tokens + 0.5 * (c.distinct + 1)))
        starts = np.append(0, self.ends[:-1])
        return {"n_known": np.add.reduceat((known > 0).astype(np.int64), starts), "base": np.add.reduceat(base, starts), "score": np.add.reduceat(np.log10(k * ml + (1 - k) * one), starts)}


def buckets(context: np.ndarray) -> np.ndarray:
    """Number of binary digits of each context count."""
    return np.frexp(context.astype(np.float64))[1].astype(np.int64)


def cells(ratio: np.ndarray) -> np.ndarray:
    """Cell of each ratio of two estimates; 0 for the ratio 0."""
    with np.errstate(divide="ignore"):
        place = np.floor(np.log2(ratio) * CELLS_PER_OCTAVE)
    return np.where(ratio > 0, np.clip(place, -CELLS // 2 + 1, CELLS // 2 - 1) + CELLS // 2, 0).astype(np.int64)


def cell_rows(events: np.ndarray) -> pa.RecordBatch:
    """(bucket, cell, events) rows of a (buckets, cells) table."""
    bucket, cell = np.nonzero(events)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(cell, pa.int64()), pa.array(events[bucket, cell], pa.int64())], ["bucket", "cell", "n"])


def weight(cell: np.ndarray, events: np.ndarray, rounds: int = 500) -> float:
    """Weight of the higher estimate by expectation-maximisation over its ratios to the lower one; one event more
    for the lower estimate keeps every weight below 1."""
    ratio = np.where(cell > 0, 2.0 ** ((cell - CELLS // 2 + 0.5) / CELLS_PER_OCTAVE), 0.0)
    k = 0.5
    for _ in range(rounds):
        new = float((events * k * ratio / (k * ratio + 1 - k)).sum() / (events.sum() + 1))
        if abs(new - k) < 1e-9:
            break
        k = new
    return k


def learned(rows: list) -> np.ndarray:
    """Weight by bucket from (bucket, cell, events) rows."""
    out = np.zeros(64)
    table = np.array([tuple(r) for r in rows], dtype=np.float64).reshape(-1, 3)
    for b in np.unique(table[:, 0]):
        own = table[table[:, 0] == b]
        out[int(b)] = weight(own[:, 1], own[:, 2])
    return out


def drop(folder: tuple) -> None:
    STAGED.remove(folder)
    drop_folder(*folder)


class Model:
    """Blocks of a corpus with the counts that they need, and the learned weights."""

    def __init__(self, docs: DataFrame, doc_id: Column, part: Column, text: Column, parts: int, held_out: int):
        bounded_batches(docs.sparkSession)
        blocks = staged(part_blocks(docs, doc_id, part, text, parts))
        folders = [STAGED[-1]]
        sizes = blocks.groupBy("part").agg(F.sum(F.size("docs")).alias("docs"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)).alias("tokens")).collect()  # one row per part
        part_of = (F.col("block") % parts).cast("int")
        asked = staged(word_requests(blocks).withColumn("part", part_of))
        folders.append(STAGED[-1])
        slices = (asked.agg(F.max("slice")).first()[0] or 0) + 1
        words = staged(word_counts(asked, slices, held_out))
        drop(folders.pop())
        folders.append(STAGED[-1])
        release(words.sparkSession)
        distinct, = words.agg(F.coalesce(F.sum("known"), F.lit(0))).first()
        word_bits = (slices * (words.agg(F.max("known")).first()[0] or 0) + 2).bit_length()
        corpus = Corpus({r.part: r.tokens for r in sizes}, {r.part: r.docs for r in sizes}, distinct, held_out, word_bits)
        bits = 2 * word_bits
        slice_bits = filters.slice_bits_for(corpus.tokens, bits)
        corpus.k1 = float(learned(first_cells(words.withColumn("part", part_of), corpus).collect())[0]) if corpus.tokens else 0.0

        request = "slice long, block long, part int, filter binary"
        arrow_request = pa.schema([("slice", pa.int64()), ("block", pa.int64()), ("part", pa.int32()), ("filter", pa.binary())])

        def ask(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            rows = left.to_pylist()
            if not rows:
                return arrow_request.empty_table()
            b = Block(rows[0], right.to_pylist(), corpus, bits)
            return pa.Table.from_pylist([{"slice": k, "block": rows[0]["block"], "part": rows[0]["part"], "filter": f} for k, f in filters.slices(b.pairs, b.pair_n, bits, slice_bits)], schema=arrow_request)

        columns, words = blocks.select("block", "part", "docs", "lengths", "ids"), words.drop("n", "known")
        pairs = staged(pair_counts(columns.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(ask, request), bits, slice_bits, held_out))
        folders.append(STAGED[-1])
        release(blocks.sparkSession)
        joined_schema = "block long, part int, docs array<long>, lengths array<int>, ids binary, replies array<struct<slice:long,round:int,own:binary,ids:binary,size:long,sums:binary,parts:binary>>"
        reply = pa.list_(pa.struct([("slice", pa.int64()), ("round", pa.int32()), ("own", pa.binary()), ("ids", pa.binary()), ("size", pa.int64()), ("sums", pa.binary()), ("parts", pa.binary())]))
        arrow_joined = pa.schema([*(ARROW_BLOCK.field(c) for c in ("block", "part", "docs", "lengths", "ids")), ("replies", reply)])

        def join(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return arrow_joined.empty_table()
            return left.append_column("replies", pa.array([right.select([f.name for f in reply.value_type]).to_pylist()], reply)).select(arrow_joined.names).cast(arrow_joined)

        self.blocks = staged(columns.groupBy("block").cogroup(words.unionByName(pairs.drop("n", "known")).groupBy("block")).applyInArrow(join, joined_schema))
        for folder in folders:
            drop(folder)
        release(blocks.sparkSession)
        self.corpus, self.bits = corpus, bits

        def held_out_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            events = np.zeros((64, CELLS), dtype=np.int64)
            for batch in batches:
                for row in batch.to_pylist():
                    events += Block(row, row["replies"], corpus, bits).held_out_cells()
            yield cell_rows(events)

        train = self.blocks.where(F.col("part") != held_out)
        # at most 64 buckets of CELLS rows
        corpus.k2 = learned(train.mapInArrow(held_out_cells, "bucket long, cell long, n long").groupBy("bucket", "cell").agg(F.sum("n").alias("n")).collect())

    def scored(self) -> DataFrame:
        """id, part, n_tokens, n_known, train_tokens, base_score, score of every text."""
        corpus, bits = self.corpus, self.bits

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    b = Block(row, row["replies"], corpus, bits)
                    s, n = b.scores(), len(b.lengths)
                    yield pa.RecordBatch.from_arrays([pa.array(row["docs"], pa.int64()), pa.array([row["part"]] * n, pa.int32()), pa.array(b.lengths, pa.int64()), pa.array(s["n_known"], pa.int64()), pa.array([corpus.tokens] * n, pa.int64()), pa.array(s["base"]), pa.array(s["score"])], ["id", "part", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        return self.blocks.mapInArrow(score, "id long, part int, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def first_cells(words: DataFrame, corpus: Corpus) -> DataFrame:
    """(bucket 0, cell, events) of single tokens: ratios of their estimate without the block's part to the uniform one."""
    rows = words.where(F.col("part") != corpus.held_out).select("part", "n", "sums", "parts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        events = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for part, n, sums, parts in zip(*(batch.column(c).to_pylist() for c in range(4))):
                rest = corpus.tokens - corpus.part_tokens[part]
                if rest:
                    ratio = (filters.unpack_numbers(sums) - filters.unpack_numbers(parts)) / rest * (corpus.distinct + 1)
                    events += np.bincount(cells(ratio), weights=filters.unpack_numbers(n), minlength=CELLS).astype(np.int64)
        yield cell_rows(events[None, :])

    ends = []
    for part, docs in corpus.part_docs.items():
        rest = corpus.tokens - corpus.part_tokens[part]
        if docs and rest:
            ends.append((0, int(cells(np.array([(corpus.docs - docs) / rest * (corpus.distinct + 1)]))[0]), docs))
    out = rows.mapInArrow(count, "bucket long, cell long, n long")
    if ends:
        out = out.unionByName(words.sparkSession.createDataFrame(ends, "bucket long, cell long, n long"))
    return out.groupBy("bucket", "cell").agg(F.sum("n").alias("n"))


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 5, held_out: int = 1) -> DataFrame:
    """Scores of every text by a model of the texts whose crc32(id as text) mod ``parts`` is not ``held_out``."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    model = Model(docs, F.col(id_col).cast("long"), (F.crc32(name.cast("binary")) % parts).cast("int"), F.coalesce(F.col(text_col), F.lit("")), parts, held_out)
    return model.scored().select(F.col("id").alias(id_col), (F.col("part") == held_out).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

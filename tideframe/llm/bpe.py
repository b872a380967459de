"""Byte-level BPE encoding and decoding by merge replay over a block of texts.

The texts of a block are cut into pretoken groups; the distinct ones form the block's corpus.  An
inverted index from token pair to the positions of that pair in the corpus is kept by merge rank.
Merges are applied in rank order, each at all its positions at once; only the pairs to the left and
right of a merged position are looked up again and enter the index.  The merges of one pretoken do
not depend on any other, so blocks and tasks can be cut anywhere without changing an id.

Defined results: null text gives a null id array (``encode_texts`` of a coalesced column: empty);
empty text gives an empty array; decoding a null array gives null, ids outside the vocabulary raise.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession, functions as F

from tideframe.llm.words import OTHER_SPACE, Memo, blocks, bounded_batches, kept


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id (its merge rank) of a rank file."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class MergeTable:
    """Ids of single bytes and, for every pair of tokens whose joined bytes are a token, its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 2  # one id more than any token: the end of a word
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, to = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    to.append(rank)
        order = np.argsort(keys)
        self.keys, self.to = np.array(keys, dtype=np.int64)[order], np.array(to, dtype=np.int64)[order]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, -1 where there is none."""
        want = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.to[at], -1)

    def merge_one(self, word: bytes) -> list[int]:
        """One word, lowest rank first, leftmost first."""
        ids = [int(self.byte_id[b]) for b in word]
        while len(ids) > 1:
            found = self.rank(np.array(ids[:-1]), np.array(ids[1:]))
            if (found < 0).all():
                break
            at = int(np.where(found < 0, np.iinfo(np.int64).max, found).argmin())
            ids[at : at + 2] = [int(found[at])]
        return ids

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and where each word's ids begin (one more at the end)."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        first = np.concatenate([[0], np.cumsum(lengths)])
        n = int(first[-1])
        ids = np.empty(n + 1, dtype=np.int64)
        ids[:n] = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        ids[n] = self.size - 1
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[n], before = n, np.append(before, n)[: n + 1]
        full = lengths > 0
        after[first[1:][full] - 1] = n
        before[first[:-1][full]] = n
        alive = np.ones(n + 1, dtype=bool)
        pair = np.full(n + 1, -1, dtype=np.int64)  # rank of the pair that starts here
        index: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []
        early: set[int] = set()  # words in which a merge makes a pair of lower rank

        def note(at: np.ndarray, now: int) -> None:
            found = self.rank(ids[at], ids[after[at]])
            pair[at] = found
            at, found = at[found >= 0], found[found >= 0]
            if not len(at):
                return
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            starts = [0, *cuts.tolist()]
            if found[0] < now:
                early.update((np.searchsorted(first, at[found < now], side="right") - 1).tolist())
            for rank, lo, hi in zip(found[starts].tolist(), starts, [*starts[1:], len(at)]):
                if rank in index:
                    index[rank].append(at[lo:hi])
                else:
                    index[rank] = [at[lo:hi]]
                    heapq.heappush(ranks, rank)

        note(np.arange(n), -1)
        while ranks:
            rank = heapq.heappop(ranks)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = np.unique(at[pair[at] == rank])
            if not len(at):
                continue
            follows = np.concatenate([[False], after[at[:-1]] == at[1:]])
            if follows.any():  # of a run such as a-a-a every second position merges, from the left
                k = np.arange(len(at))
                at = at[(k - np.maximum.accumulate(np.where(follows, 0, k))) % 2 == 0]
            right = after[at]
            beyond = after[right]
            ids[at], after[at], before[beyond] = rank, beyond, at
            alive[right], pair[right] = False, -1
            left = before[at]
            note(np.concatenate([at, left[left < n]]), rank)
        alive[n] = False
        kept = np.concatenate([[0], np.cumsum(alive[:n])])
        out, starts = ids[:n][alive[:n]], kept[first]
        if early:
            parts = [self.merge_one(words[k]) if k in early else out[starts[k] : starts[k + 1]] for k in range(len(words))]
            out = np.concatenate([np.asarray(p, dtype=np.int64) for p in parts])
            starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return out, starts


def splitter():
    """A function from text to pieces whose pretokens are together those of the whole text.

    A pretoken of the pattern never reaches over a plain space that a non-space follows, other than by
    starting with that space.  So the text may be cut before each such space; every piece but the
    first then begins with it.  Pieces are returned without that space, the first one apart."""
    inner = regex.compile(f" (?=[ {OTHER_SPACE}]|$)")
    cut = regex.compile(f" (?=[^ {OTHER_SPACE}])")

    def pieces(text: str) -> list[str]:
        return cut.split(text) if inner.search(text) else text.split(" ")

    return pieces


class Encoder:
    """Encodes texts block by block; one per Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.table = MergeTable(ranks)
        self.pieces, self.pattern = splitter(), regex.compile(pattern)
        self.memo = Memo(self.encode_pieces)

    def encode_pieces(self, keys: list[str]) -> list[bytes]:
        """The ids of each piece as packed 32-bit integers.  A key is a piece without its leading space;
        the first piece of a text, which has none, is marked by a space."""
        words: dict[str, int] = {}
        find = self.pattern.findall
        split = [[words.setdefault(w, len(words)) for w in find(k[1:] if k[:1] == " " else " " + k)] for k in keys]
        ids, starts = self.table.replay([w.encode("utf-8", "replace") for w in words])
        packed, at = ids.astype("<i4").tobytes(), (starts * 4).tolist()
        of = [packed[lo:hi] for lo, hi in zip(at, at[1:])]
        return [of[s[0]] if len(s) == 1 else b"".join([of[k] for k in s]) for s in split]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for block in blocks(texts):
            keys: set[str] = set()
            for text in block:
                head, *rest = self.pieces(text)
                keys.add(" " + head)
                keys.update(rest)
            known = self.memo.table(keys)
            for text in block:
                head, *rest = self.pieces(text)
                yield known[" " + head] + b"".join(map(known.__getitem__, rest))


def id_arrays(packed: list[bytes | None]) -> pa.ListArray:
    """Packed 32-bit ids as an Arrow list column."""
    lengths = np.array([0 if p is None else len(p) // 4 for p in packed], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    values = np.frombuffer(b"".join(p for p in packed if p), dtype="<i4")
    mask = pa.array([p is None for p in packed], type=pa.bool_()) if any(p is None for p in packed) else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=mask)


def encoder(spark: SparkSession, path: str, pattern: str):
    """A column function text -> array<int> of ids by the rank file at ``path`` (read on the driver
    and broadcast: a vocabulary, of fixed size)."""
    shared = bounded_batches(spark).sparkContext.broadcast({"ranks": read_ranks(path)})

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = kept(shared, lambda value: Encoder(value["ranks"], pattern))
        for batch in batches:
            texts = batch.to_pylist()
            got = enc.encode([t for t in texts if t is not None])
            yield id_arrays([None if t is None else next(got) for t in texts])

    return encode


def decoder(spark: SparkSession, path: str):
    """A column function array<int> -> binary: the bytes of the tokens, one after the other."""
    ranks = bounded_batches(spark).sparkContext.broadcast(read_ranks(path))

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = {rank: text for text, rank in ranks.value.items()}
        for batch in batches:
            offsets, values, whole = batch.offsets.to_pylist(), batch.values.to_numpy(zero_copy_only=False), batch.is_valid().to_pylist()
            yield pa.array([b"".join([token[i] for i in values[lo:hi].tolist()]) if ok else None for lo, hi, ok in zip(offsets, offsets[1:], whole)], type=pa.binary())

    return decode


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " ").cast("binary"), 256)

"""Token counts by greedy longest-match word pieces, in time linear in the text.

The vocabulary has pieces that start a word and pieces that go on within one.  Both tries are one
automaton.  At build time every node gets the number of pieces that must be taken off its path
before a shorter path can go on (``popped``) and the node of the continuation trie where matching
goes on (``fail``).  Counting follows one edge per byte and adds ``popped`` numbers on failures: no
piece is ever built and no byte is looked at again from an earlier start.

Words are runs of bytes other than space and \\x09-\\x0D.  Where no start piece fits, the space before
the word is a piece of its own (if the vocabulary has it) and the word goes on in continuation pieces.
A word that the vocabulary can't cover even so counts as one token (the unknown token).  Null text: null; empty text: 0.  Words are counted once
per block of texts and worker; a text is never cut.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession, functions as F

from tideframe.llm.bpe import read_ranks
from tideframe.llm.words import Memo, blocks, bounded_batches, kept


def split_vocabulary(tokens) -> tuple[set[bytes], set[bytes]]:
    """Start pieces (tokens with a leading space, which is cut off; empty for the space alone) and continuation pieces (tokens without)."""
    return {t[1:] for t in tokens if t[:1] == b" "}, {t for t in tokens if t[:1] != b" "}


class Automaton:
    """Trie nodes are numbers: 0 is the start of a word, 1 the start of a continuation.  An empty start
    piece (the space alone) makes 1 the failure of 0."""

    def __init__(self, starts: set[bytes], inner: set[bytes]):
        self.edges: list[dict[int, int]] = [{}, {}]
        whole = {}
        for root, vocabulary in ((0, starts), (1, inner)):
            for piece in sorted(vocabulary):
                node = root
                for byte in piece:
                    if byte not in self.edges[node]:
                        self.edges.append({})
                        self.edges[node][byte] = len(self.edges) - 1
                    node = self.edges[node][byte]
                if node != root:
                    whole[node] = True
        n = len(self.edges)
        self.fail: list[int] = [-1] * n
        self.popped: list[int] = [0] * n
        if b"" in starts:
            self.fail[0], self.popped[0] = 1, 1
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for byte, child in self.edges[node].items():
                if child in whole:
                    self.fail[child], self.popped[child] = 1, 1
                else:
                    at, count = self.fail[node], self.popped[node]
                    while at >= 0 and byte not in self.edges[at]:
                        count += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[child], self.popped[child] = self.edges[at][byte], count
                queue.append(child)

    def count(self, word: bytes) -> int:
        """Pieces of one word; 1 if it can't be covered."""
        edges, fail, popped = self.edges, self.fail, self.popped
        node = total = 0
        for byte in word:
            while (to := edges[node].get(byte)) is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = to
        while node > 1:
            total += popped[node]
            node = fail[node]
        return total if node == 1 else int(bool(word))


def token_counter(spark: SparkSession, path: str):
    """A column function text -> bigint; the vocabulary is read on the driver and broadcast (fixed size)."""
    shared = bounded_batches(spark).sparkContext.broadcast({"tokens": list(read_ranks(path))})

    def memo_of(value: dict) -> Memo:
        automaton = Automaton(*split_vocabulary(value["tokens"]))
        return Memo(lambda words: [automaton.count(w) for w in words])

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = kept(shared, memo_of)
        for batch in batches:
            texts = batch.cast(pa.binary()).to_pylist()
            out = [None if t is None else 0 for t in texts]
            at = (k for k, v in enumerate(out) if v is not None)
            for block in blocks(t for t in texts if t is not None):
                words: set[bytes] = set()
                for text in block:
                    words.update(text.split())
                known = memo.table(words)
                for text in block:
                    out[next(at)] = sum(map(known.__getitem__, text.split()))
            yield pa.array(out, type=pa.int64())

    return count

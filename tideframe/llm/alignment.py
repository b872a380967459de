"""Alignment of two tokenizers over a corpus: byte offsets where tokens of both end, and how often ids meet there.

A text's tokens by A (byte-level BPE) and by B (pieces with byte fallback) are laid over the same bytes,
a space and the text.  Offsets where both end cut them into groups; the last tokens of a group are
linked.  Two linked tokens end together, so the bytes of one are a suffix of the bytes of the other: the
pairs that can ever be linked follow from the vocabularies alone, at most one per token and suffix
(``Pairs``), a few hundred thousand for any corpus.  Links are kept as numbers of such pairs.

Most groups are one A token and the one B token with the same bytes.  ``Pairs.same`` holds that B id for
every A id, and such links are counted in one vector of vocabulary length per task.  Only the other
links (the irregular groups) are counted by pair and shuffled.

No token of either reaches from a character other than white space into the space after it, so texts are cut there
and each distinct piece of a block is encoded and aligned once.

Defined results: a null or empty text, and one whose tokens by A or B don't give its bytes back (B reads
U+2581 as a space), has no tokens: numbers 0 and an empty digest.  Rows are not merged: a repeated row counts
twice.  Rows without id are kept.  Other columns of the input are not looked at.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from tideframe.llm.words import Memo, blocks, bounded_batches, kept
from tideframe.session import staged

SPACE_MARK = "▁"


def byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable bytes stand for themselves, the others are numbered from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def a_bytes(tokenizer: Tokenizer) -> list[bytes]:
    letters = byte_letters()
    return [bytes(letters[c] for c in tokenizer.id_to_token(i)) if all(c in letters for c in tokenizer.id_to_token(i)) else tokenizer.id_to_token(i).encode() for i in range(tokenizer.get_vocab_size())]


def b_bytes(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    return [bytes([int(model.id_to_piece(i)[1:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(SPACE_MARK, " ").encode() for i in range(model.get_piece_size())]


class Pairs:
    """All (A id, B id) whose bytes are equal or one a suffix of the other, in ascending order."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.n_a, self.n_b = len(a), len(b)
        by_a, by_b = ({}, {})
        for by, tokens in ((by_a, a), (by_b, b)):
            for k, token in enumerate(tokens):
                by.setdefault(token, []).append(k)
        keys = {i * self.n_b + j for i, t in enumerate(a) for cut in range(len(t)) for j in by_b.get(t[cut:], ())}
        keys |= {i * self.n_b + j for j, t in enumerate(b) for cut in range(1, len(t)) for i in by_a.get(t[cut:], ())}
        self.keys = np.array(sorted(keys), dtype=np.int64)
        #: of each A id the last B id with the same bytes (a piece of its own rather than a byte of the fallback), -1 without one
        self.same = np.array([by_b.get(t, [-1])[-1] for t in a], dtype=np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, a * self.n_b + b)


class Aligner:
    """Encodes and aligns pieces of text; one per Python worker."""

    def __init__(self, definition: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a, self.b = Tokenizer.from_str(definition), sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a.encode_special_tokens = True
        self.a_bytes, self.b_bytes = a_bytes(self.a), b_bytes(self.b)
        self.pairs = Pairs(self.a_bytes, self.b_bytes)
        self.a_len, self.b_len = (np.array(list(map(len, t)), dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        self.memo = Memo(self.align, limit=500_000)
        self.blank, self.run = re.compile(r"\s "), re.compile(r"(?<=\S) (?=.)", re.DOTALL)
        self.pair_text = [f"{k // self.pairs.n_b}|{k % self.pairs.n_b}" for k in self.pairs.keys.tolist()]

    def pieces(self, text: str) -> list[str]:
        """The text cut at each space after a character other than white space, without that space; not at the last character."""
        return self.run.split(text) if text[0] == " " or text[-1] == " " or self.blank.search(text) else text.split(" ")

    def align(self, pieces: list[str]) -> list[tuple[int, int, bytes, str] | None]:
        """(A tokens, B tokens, packed pair numbers of the links, groups as text) of a space and each piece;
        None where the tokens of either don't give its bytes back."""
        out: dict[str, tuple[int, int, bytes, str] | None] = {}
        alone = [p for p in pieces if p[-1].isspace()]  # ends of texts: the next space would join their white space
        among = [p for p in pieces if not p[-1].isspace()]
        for run in [*([p] for p in alone), *(among[lo : lo + 2_000] for lo in range(0, len(among), 2_000))]:
            out.update(zip(run, self.align_run(run)))
        return [out[p] for p in pieces]

    def align_run(self, pieces: list[str]) -> list[tuple[int, int, bytes, str] | None]:
        """Pieces are encoded together, as one text: its tokens end wherever a piece ends."""
        text = " ".join(pieces)
        whole = f" {text}".encode()
        a = np.array(self.a.encode(f" {text}", add_special_tokens=False).ids, dtype=np.int64)
        b = np.array(self.b.encode(text, num_threads=1), dtype=np.int64)
        if any(b"".join(map(names.__getitem__, ids.tolist())) != whole for names, ids in ((self.a_bytes, a), (self.b_bytes, b))):
            if len(pieces) == 1:
                return [None]
            half = len(pieces) // 2
            return self.align_run(pieces[:half]) + self.align_run(pieces[half:])
        a_ends, b_ends = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        ends, a_last, b_last = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
        number = self.pairs.of(a[a_last], b[b_last])
        links = number.astype("<u4").tobytes()
        edges = np.cumsum(np.fromiter((len(p.encode()) + 1 for p in pieces), dtype=np.int64, count=len(pieces)))
        cuts = [0, *(np.searchsorted(ends, edges) + 1).tolist()]  # groups before the end of each piece
        groups = list(map(self.pair_text.__getitem__, number.tolist()))
        a_cut, b_cut = np.append(0, a_last + 1), np.append(0, b_last + 1)
        several = np.flatnonzero((np.diff(a_cut) > 1) | (np.diff(b_cut) > 1)).tolist()
        a_cut, b_cut, a_ids, b_ids = a_cut.tolist(), b_cut.tolist(), a.tolist(), b.tolist()
        for g in several:
            groups[g] = f"{','.join(map(str, a_ids[a_cut[g] : a_cut[g + 1]]))}|{','.join(map(str, b_ids[b_cut[g] : b_cut[g + 1]]))}"
        return [(a_cut[hi] - a_cut[lo], b_cut[hi] - b_cut[lo], links[4 * lo : 4 * hi], ";".join(groups[lo:hi])) for lo, hi in zip(cuts, cuts[1:])]

    def aligned(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, str]]:
        """(A tokens, B tokens, pair numbers of the links, digest of the groups) of each text."""
        nothing = (0, 0, np.zeros(0, dtype=np.uint32), "")
        for block in blocks(texts):
            cut = [self.pieces(text) if text else [] for text in block]
            known = self.memo.table(set().union(*cut))
            for pieces in cut:
                parts = list(map(known.__getitem__, pieces))
                if not parts or None in parts:
                    yield nothing
                    continue
                yield sum([p[0] for p in parts]), sum([p[1] for p in parts]), np.frombuffer(b"".join([p[2] for p in parts]), dtype="<u4"), sha256(";".join([p[3] for p in parts]).encode()).hexdigest()


def align(docs: DataFrame, a_definition: str, b_model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best (links whose pair count is the
    highest of their B id in the corpus), count_sum (pair counts over the links), groups_sha256.

    Encodes every text once; links are staged as (pair number, times) per row, a few bytes a link."""
    spark = bounded_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast({"a": a_definition, "b": b_model})
    schema = "id long, n_a long, n_b long, n_links long, groups_sha256 string, pair array<int>, times array<int>"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept(shared, lambda value: Aligner(value["a"], value["b"]))
        for batch in batches:
            ids, rows = batch.column(0), []
            for n_a, n_b, links, digest in aligner.aligned(batch.column(1).to_pylist()):
                pair, times = np.unique(links, return_counts=True)
                rows.append((n_a, n_b, len(links), digest, pair.astype(np.int32), times.astype(np.int32)))
            n_a, n_b, n_links, digests, pair, times = zip(*rows) if rows else ((),) * 6
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in pair])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*part, np.zeros(0, np.int32)]).astype(np.int32))) for part in (pair, times)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(n_links, pa.int64()), pa.array(digests, pa.string()), *lists], ["id", "n_a", "n_b", "n_links", "groups_sha256", "pair", "times"])

    rows = staged(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).mapInArrow(encode, schema))
    counts, best = link_counts(rows, Pairs(*vocabularies(a_definition, b_model)))
    known = spark.sparkContext.broadcast((counts, best))  # one number per possible pair: bounded by the vocabularies

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = known.value
        for batch in batches:
            pair, times = batch.column("pair"), batch.column("times").flatten().to_numpy()
            at, numbers = pair.offsets.to_numpy(), pair.flatten().to_numpy()
            at = at - at[0]
            sums = [np.concatenate([[0], np.cumsum(v)]) for v in (times * best[numbers], times * counts[numbers])]
            n_best, count_sum = (pa.array(s[at[1:]] - s[at[:-1]], pa.int64()) for s in sums)
            get = batch.column
            yield pa.RecordBatch.from_arrays([get("id"), get("n_a"), get("n_b"), get("n_links"), get("n_links"), n_best, count_sum, get("groups_sha256")], [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return rows.mapInArrow(read, f"{id_col} long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def vocabularies(a_definition: str, b_model: bytes) -> tuple[list[bytes], list[bytes]]:
    return a_bytes(Tokenizer.from_str(a_definition)), b_bytes(sentencepiece.SentencePieceProcessor(model_proto=b_model))


def link_counts(rows: DataFrame, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """For every possible pair its links in the corpus, and whether no pair of its B id has more."""
    shared = rows.sparkSession.sparkContext.broadcast(pairs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = shared.value
        a, b = pairs.keys // pairs.n_b, pairs.keys % pairs.n_b
        equal = pairs.same[a] == b
        vector, irregular = np.zeros(pairs.n_a, dtype=np.int64), np.zeros(len(pairs.keys), dtype=np.int64)
        for batch in batches:
            number, times = batch.column("pair").flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            fast = equal[number]
            vector += np.bincount(a[number[fast]], weights=times[fast], minlength=pairs.n_a).astype(np.int64)
            irregular += np.bincount(number[~fast], weights=times[~fast], minlength=len(pairs.keys)).astype(np.int64)
        if vector.any():
            yield pa.RecordBatch.from_arrays([pa.array([vector.tolist()], pa.list_(pa.int64())), pa.array([None], pa.int64()), pa.array([None], pa.int64())], ["vector", "number", "n"])
        met = np.flatnonzero(irregular)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(met), pa.list_(pa.int64())), pa.array(met, pa.int64()), pa.array(irregular[met], pa.int64())], ["vector", "number", "n"])

    counted = staged(rows.select("pair", "times").mapInArrow(count, "vector array<long>, number long, n long"))
    equal = counted.where("vector IS NOT NULL").select(F.posexplode("vector").alias("a", "n")).where("n > 0").groupBy("a").agg(F.sum("n").alias("n"))
    other = counted.where("number IS NOT NULL").groupBy("number").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(pairs.keys), dtype=np.int64)
    # at most one row per A id, and one per possible pair
    for a, n in equal.collect():
        counts[pairs.of(np.int64(a), pairs.same[a])] = n
    for number, n in other.collect():
        counts[number] = n
    b = pairs.keys % pairs.n_b
    top = np.zeros(pairs.n_b, dtype=np.int64)
    np.maximum.at(top, b, counts)
    return counts, counts == top[b]

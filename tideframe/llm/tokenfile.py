"""Token-id files: one id array per segment, with Elias-Fano coded document boundaries and ids.

A file is a sequence of segments, each followed by one newline byte.  A segment is

    magic "TIDS1" | width of an id in bytes (1) | part (8) | number in part (8) | documents (8)
    | documents without id (8) | tokens (8) | first doc_id (8) | two monotone sequences | ids

with little-endian numbers.  The sequences are the ascending doc_ids (as distances from the first)
and the documents' end offsets in the id array.  A monotone sequence of n numbers up to u keeps
floor(log2(u / n)) low bits of each number packed, and the high parts as a bit vector with one 1 per
number, about two bits each; the position of every ``STEP``-th 1 is stored, so ``select`` reads one
sample and a short stretch of bits, and reading a run of documents scans from its sample to the next.

Documents are dealt into ranges of doc_id once; each task encodes and writes its range in ascending
order through Spark's committer, so a lost task leaves nothing behind.  A task holds one segment at
a time.  Documents without doc_id come first, in order of text; equal ids in order of text.
Null texts are empty; every document gets the end id.
"""

from __future__ import annotations

import os
import string
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from tideframe.llm.words import Memo, blocks, bounded_batches, kept

WORD_END, TAIL = "</w>", string.punctuation + string.digits
MAGIC, HEAD, STEP = b"TIDS1", "<BqqqqqQ", 512


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        digits = ((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        marks = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        marks[ones] = 1
        return cls(n, bits, np.packbits(digits.ravel(), bitorder="little"), np.packbits(marks, bitorder="little"), ones[::STEP].astype("<i8"))

    def select(self, k: int) -> int:
        """The k-th number, by one sample and a scan of the bits after it."""
        at = int(self.samples[k // STEP])
        left = k % STEP
        while left:
            stretch = np.flatnonzero(np.unpackbits(self.high[(at + 1) // 8 : (at + 1) // 8 + STEP // 4], bitorder="little"))
            stretch = stretch[stretch >= (at + 1) % 8] + (at + 1) // 8 * 8
            take = min(left, len(stretch))
            at = int(stretch[take - 1]) if take else ((at + 1) // 8 + STEP // 4) * 8 - 1
            left -= take
        bit = k * self.low_bits
        raw = np.unpackbits(self.low[bit // 8 : (bit + self.low_bits + 7) // 8], bitorder="little")[bit % 8 : bit % 8 + self.low_bits]
        return (at - k) << self.low_bits | sum(int(b) << i for i, b in enumerate(raw))

    def stretch(self, k: int) -> np.ndarray:
        """The ``STEP`` numbers from the k-th on (fewer at the end), for a k that has a sample: a scan from the sample to the next."""
        n, first = min(STEP, self.n - k), int(self.samples[k // STEP])
        last = int(self.samples[k // STEP + 1]) if k + STEP < self.n else 8 * len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[first // 8 : -(-last // 8)], bitorder="little")) + first // 8 * 8
        ones = ones[ones >= first][:n]
        bit = k * self.low_bits
        raw = np.unpackbits(self.low[bit // 8 : -(-(bit + n * self.low_bits) // 8)], bitorder="little")[bit % 8 : bit % 8 + n * self.low_bits]
        low = (raw.reshape(n, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return ((ones - np.arange(k, k + n)).astype(np.uint64) << np.uint64(self.low_bits)) | low

    def pack(self) -> bytes:
        return struct.pack("<qqqqq", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def unpack(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, bits, low, high, samples = struct.unpack_from("<qqqqq", data, at)
        at += 40
        parts = []
        for size, kind in ((low, np.uint8), (high, np.uint8), (samples, "<i8")):
            parts.append(np.frombuffer(data, dtype=kind, count=size, offset=at))
            at += size * np.dtype(kind).itemsize
        return cls(n, bits, *parts), at


def pack_segment(part: int, number: int, doc_ids: list[int | None], docs: list[bytes], width: int) -> bytes:
    """``docs``: the ids of each document as packed integers of ``width`` bytes."""
    nulls = sum(d is None for d in doc_ids)
    known = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
    first = int(known[0]) if len(known) else 0
    ends = np.cumsum([len(d) // width for d in docs])
    # uint64 arithmetic wraps, so distances are right over the whole range of doc_id
    gaps = EliasFano.of(known.astype(np.uint64) - np.uint64(first % 2**64))
    return MAGIC + struct.pack(HEAD, width, part, number, len(docs), nulls, int(ends[-1]), first % 2**64) + gaps.pack() + EliasFano.of(ends).pack() + b"".join(docs)


class Segment:
    """One segment of a file; ``ids(k)`` reads the k-th document through ``select``."""

    def __init__(self, data: memoryview, at: int):
        if bytes(data[at : at + 5]) != MAGIC:
            raise ValueError("not a token-id segment")
        self.width, self.part, self.number, self.n, self.nulls, self.tokens, self.first = struct.unpack_from(HEAD, data, at + 5)
        self.gaps, at = EliasFano.unpack(data, at + 5 + struct.calcsize(HEAD))
        self.ends, at = EliasFano.unpack(data, at)
        self.array = np.frombuffer(data, dtype=f"<u{self.width}", count=self.tokens, offset=at)
        self.end = at + self.tokens * self.width + 1

    def ids(self, k: int) -> np.ndarray:
        return self.array[self.ends.select(k - 1) if k else 0 : self.ends.select(k)]

    def doc_ids(self) -> list[int | None]:
        known = (d for k in range(0, self.gaps.n, STEP) for d in (self.gaps.stretch(k) + np.uint64(self.first)).astype(np.int64).tolist())
        return [*[None] * self.nulls, *known]

    def runs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first document, starts, ends) of runs of up to ``STEP`` documents, each from its sample."""
        for lo in range(0, self.n, STEP):
            ends = self.ends.stretch(lo).astype(np.int64)
            yield lo, np.concatenate([[self.ends.select(lo - 1) if lo else 0], ends[:-1]]), ends


def segments(data: bytes) -> Iterator[Segment]:
    at = 0
    while at < len(data):
        segment = Segment(memoryview(data), at)
        yield segment
        at = segment.end


class LibraryEncoder:
    """Ids of whole texts by the tokenizers library, which sees each distinct word once while it is known.

    The library's own rules are applied to the words: its pattern never matches white space, and its
    normalisation does not reach over a space, so a text's ids are those of its words in turn.  That
    holds for definitions like the public one, which lower-case and whose runs of letters, digits and
    other marks are matches of their own."""

    def __init__(self, definition: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.width = Tokenizer.from_str(definition), width
        vocabulary = self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.word_end[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.memo = Memo(self.encode_words, limit=800_000)
        self.parts = cache(self.parts_after)

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def parts_after(self, letter: str) -> bool:
        """Whether a match of the library ends between ``letter`` and a mark: so it does after all letters
        that its pattern knows as such and that stay one when normalised."""
        both, alone, mark = self.library([f"{letter}.", letter, "."])
        return both == alone + mark

    def packed(self, words: list[str]) -> list[bytes]:
        """Ids of each word.  ASCII marks and digits after letters are matches of their own, so a word is known by
        what stands before them."""
        stems = [s if len(s := w.rstrip(TAIL)) == len(w) or s.isalpha() and self.parts(s[-1]) else w for w in words]
        tails = [(k, w[len(s) :]) for k, (w, s) in enumerate(zip(words, stems)) if len(s) < len(w)]
        known = self.memo.table({*stems, *(tail for _, tail in tails)})
        out = list(map(known.__getitem__, stems))
        for k, tail in tails:
            out[k] += known[tail]
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Words of letters only are one match each, which the last token's word end shows: they are
        encoded many to a text and cut apart there."""
        out: dict[str, bytes] = {}
        letters = [w for w in words if w.isalpha()]
        for lo in range(0, len(letters), 500):
            some = letters[lo : lo + 500]
            ids = np.array(self.library([" ".join(some)])[0], dtype=f"<u{self.width}")
            at = [0, *((np.flatnonzero(self.word_end[ids]) + 1) * self.width).tolist()]
            if len(at) == len(some) + 1:
                packed = ids.tobytes()
                out.update(zip(some, [packed[a:b] for a, b in zip(at, at[1:])]))
        rest = [w for w in words if w not in out]
        for lo in range(0, len(rest), 20_000):
            out.update(zip(rest[lo : lo + 20_000], [np.array(ids, dtype=f"<u{self.width}").tobytes() for ids in self.library(rest[lo : lo + 20_000])]))
        return [out[w] for w in words]

    def prepared(self, text: str) -> str:
        """The text with fewer different words and the same ids: in lower case where that is certain not to change an id."""
        text = text.replace("\n", " ")
        if "<|" in text:  # may be a control string, which is matched as it stands
            return text
        if text.isascii():
            return text.lower()
        if "Σ" not in text and is_normalized("NFC", text) and is_normalized("NFC", lower := text.lower()):
            return lower
        return text

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Arrow numbers a block's distinct words and puts their ids back in the order of the texts."""
        for block in blocks(texts):
            cut = pc.split_pattern(pa.array(map(self.prepared, block), type=pa.large_string(), size=len(block)), " ")
            numbered = cut.values.dictionary_encode()
            # no word holds a space, and to_pylist would take as long as the rest
            words = pc.binary_join(pa.LargeListArray.from_arrays([0, len(numbered.dictionary)], numbered.dictionary), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")
            ids = pa.array(self.packed(words), type=pa.large_binary()).take(numbered.indices)
            _, places, packed = ids.buffers()
            at = np.frombuffer(places, dtype=np.int64)[cut.offsets.to_numpy()].tolist()
            for a, b in zip(at, at[1:]):
                yield packed[a:b].to_pybytes() if b > a else b""


def write_token_files(docs: DataFrame, path: str, definition: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", width: int = 2, tokens_per_segment: int = 4_000_000) -> None:
    """Encode every text of ``docs`` and write token-id files below ``path`` in ascending id order."""
    shared = bounded_batches(docs.sparkSession).sparkContext.broadcast({"definition": definition})
    close = int(end_id).to_bytes(width, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(shared, lambda value: LibraryEncoder(value["definition"], width))
        part, number, ids, held, size = TaskContext.get().partitionId(), 0, [], [], 0

        def segment() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pack_segment(part, number, ids, held, width)], type=pa.binary())], ["segment"])

        for batch in batches:
            for doc_id, packed in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                ids.append(doc_id)
                held.append(packed + close)
                size += len(held[-1]) // width
                if size >= tokens_per_segment:
                    yield segment()
                    number, ids, held, size = number + 1, [], [], 0
        if ids:
            yield segment()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "body")
    # the text writer puts the raw bytes of a string and one newline after each row
    ordered.mapInArrow(encode, "segment binary").select(F.col("segment").cast("string").alias("value")).write.option("compression", "none").text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, read from the files: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and the ids."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s.part, s.number, s.tokens) for content in batch.column(0) for s in segments(content.as_py())]
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "number", "tokens"), r)) for r in rows], schema=pa.schema([("part", pa.int64()), ("number", pa.int64()), ("tokens", pa.int64())]))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for s in segments(content.as_py()):
                    ids = s.doc_ids()
                    for lo, starts, ends in s.runs():
                        n, base = len(ends), int(starts[0])
                        wide = s.array[base : ends[-1]].astype("<u4")
                        crc = [zlib.crc32(wide[a:b]) for a, b in zip((starts - base).tolist(), (ends - base).tolist())]
                        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1]) - base, type=pa.int32()), pa.array(wide.astype(np.int32)))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + n], type=pa.int64()), pa.array([s.part] * n, type=pa.int64()), pa.array([s.number] * n, type=pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array(crc, type=pa.int64()), lists], ["doc_id", "part", "number", "at", "n_tokens", "ids_crc32", "ids"])

    files = read_files(bounded_batches(spark), path)
    # one row per segment
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.mapInArrow(heads, "part long, number long, tokens long").select("part", "number", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    rows = files.mapInArrow(documents, "doc_id long, part long, number long, at long, n_tokens long, ids_crc32 long, ids array<int>")
    return rows.join(bases, ["part", "number"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")

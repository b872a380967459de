"""Quality classifier from weak labels.

Labellers: overlapping rules look at a whole text and vote junk (1), good (0) or abstain (2).  Their votes are
counted by pattern over all documents, which leaves at most 3^7 rows; on these, expectation-
maximisation estimates the share of junk and each labeller's vote probabilities in both classes
(votes independent given the class).  The posterior of a vote pattern is the training label.

Scorer: a logistic model on hashed features of the text (roots of the shares of word shapes and of
words equal to the word before, share of words seen before in a run of words).  It is fitted on a sample of at most ``train_rows``
documents (by a hash of the id and text, so it does not depend on the order or partitions), the
only bounded sample here; counts, votes and scores cover all documents.

Defined results: null text is empty; a text without words is judged by the model's bias alone;
on texts of under 20 words only the rules per character vote, from 20 characters on and without
the stops and commas at the ends of words; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tideframe.llm.words import Memo, bounded_batches, kept
from tideframe.session import staged

LABELLERS = ("symbols", "capitals", "variety", "repeats", "marks", "sentences", "word_length")
PER_CHARACTER = ("symbols", "capitals")
SIZE = 1024
#: Words from which the rules per word vote; characters for the rules per character.
FEW = 20
#: Words of a run in which distinct words are counted, and of a passage whose repetition lowers the variety.
RUN, PASSAGE = 200, 5
#: Variety from which a text is good.
VARIED = 0.55
#: Documents added to every count of the estimation; small, since it pulls rare kinds towards good.
FLOOR = 1e-4
#: Score from which a text counts as junk; above one half, so that doubtful texts stay.
JUNK_FROM = 0.8


def word_facts(word: str) -> tuple[int, int, int, int, int]:
    """(hashed shape, symbols, capitals, ends with a stop or comma, has marks besides one at its end)."""
    letters = re.sub(r"[^\W\d_]+", lambda m: ("X" if m[0][0].isupper() else "") + ("X" if m[0][1:].isupper() else "x" if len(m[0]) > 1 or m[0].islower() else ""), word)
    shape = re.sub(r"\d+", "0", letters)[:12]
    symbols = sum(not c.isalnum() for c in word)
    return crc32(shape.encode("utf-8", "replace")) % (SIZE - 3) + 3, symbols, sum(map(str.isupper, word)), int(word[-1] in ".,"), int(symbols > (not word[-1].isalnum()))


def vote(value: np.ndarray, good: tuple[float, float], junk: tuple[float, float]) -> np.ndarray:
    """0 within the first bounds, 1 outside the second, 2 between."""
    return np.where((good[0] <= value) & (value <= good[1]), 0, np.where((value < junk[0]) | (value > junk[1]), 1, 2))


def variety(words: list[str], distinct: dict[str, int]) -> float:
    """Share of distinct words within runs of ``RUN`` words, over all runs, times the share of distinct passages.

    The share of distinct words of a whole text falls with its length, these don't.  Passages are looked
    at where the words of the whole text repeat enough to hide copies further apart than a run."""
    n = len(words)
    if n <= RUN:
        return len(distinct) / max(n, 1)
    share = sum(len(set(words[k : k + RUN])) for k in range(0, n, RUN)) / n
    if len(distinct) < VARIED * n:
        number = dict(zip(distinct, range(1, len(distinct) + 1)))
        ids = np.fromiter(map(number.__getitem__, words), dtype=np.uint64, count=n)
        passages = np.zeros(n - PASSAGE + 1, dtype=np.uint64)
        for k in range(PASSAGE):
            passages = (passages ^ ids[k : n - PASSAGE + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            passages ^= passages >> np.uint64(29)
        share *= len(np.unique(passages)) / len(passages)
    return share


class Facts:
    """Numbers of the distinct facts of words, and their table; one per Python worker."""

    def __init__(self) -> None:
        self.numbers: dict[tuple[int, ...], int] = {}
        self.memo = Memo(lambda words: [self.numbers.setdefault(word_facts(w), len(self.numbers)) for w in words], limit=300_000)

    def table(self) -> np.ndarray:
        return np.array(list(self.numbers), dtype=np.int64).reshape(-1, 5)


class Read:
    """Votes of some texts, and their features as (text, feature, value)."""

    def __init__(self, texts: list[str], facts: Facts):
        split = [t.split() for t in texts]
        counters = [Counter(words) for words in split]
        known = facts.memo.table(set().union(*counters))
        number = np.fromiter((k for c in counters for k in map(known.__getitem__, c)), dtype=np.int64)
        count = np.fromiter(chain.from_iterable(c.values() for c in counters), dtype=np.int64)
        distinct, n = np.array([len(c) for c in counters]), np.array([len(w) for w in split])
        same = np.array([sum(map(eq, w, islice(w, 1, None))) for w in split])
        chars, some = np.maximum([len(t) for t in texts], 1), np.maximum(n, 1)
        text = np.repeat(np.arange(len(texts)), distinct)
        found = facts.table()[number] if len(number) else np.zeros((0, 5), dtype=np.int64)
        symbols, capitals, ends, marks = (np.bincount(text, weights=found[:, k] * count, minlength=len(texts)) for k in range(1, 5))
        varied, enough = np.array([variety(w, c) for w, c in zip(split, counters)]), n >= FEW
        readable = (n > 0) & (chars >= FEW)
        votes = np.stack([
            vote((symbols - np.where(enough, 0, ends)) / chars, (0, 0.045), (0, 0.075)),
            vote(capitals / chars, (0, 0.06), (0, 0.2)),
            vote(varied, (VARIED, 1), (0.4, 1)),
            vote(same / some, (0, 0.02), (0, 0.1)),
            vote(marks / some, (0, 0.03), (0, 0.15)),
            vote(ends / some, (0.06, 0.25), (0.03, 0.4)),
            vote(chars / some, (5, 7), (4.2, 8)),
        ], axis=1)
        votes_at = np.where(np.isin(LABELLERS, PER_CHARACTER), (enough | readable)[:, None], enough[:, None])
        self.patterns = np.where(votes_at, votes, 2) @ 3 ** np.arange(len(LABELLERS))
        cell, at = np.unique(text * SIZE + found[:, 0], return_inverse=True)
        shares = np.sqrt(np.bincount(at, weights=count, minlength=len(cell)) / some[cell // SIZE])
        every = np.arange(len(texts))
        self.text = np.concatenate([every, every, every, cell // SIZE])
        self.feature = np.concatenate([np.repeat([0, 1, 2], len(texts)), cell % SIZE])
        self.value = np.concatenate([np.ones(len(texts)), np.where(enough, 1 - varied, 0), np.sqrt(same / some), shares])


def reader(shared):
    """texts -> ``Read`` of a few hundred at a time, with the facts of each distinct word found once."""
    def run(texts: list[str | None]) -> Iterator[Read]:
        facts = kept(shared, lambda _: Facts())
        for lo in range(0, len(texts), 500):
            yield Read([t or "" for t in texts[lo : lo + 500]], facts)
    return run


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior P(junk) of each vote pattern by expectation-maximisation.

    The hidden state is good or one of several kinds of junk, since a rule that looks for one defect
    says good of texts with another: its accuracy is estimated per kind.  A kind starts from the
    documents on which the same labellers vote junk, for every such set with at least 1 % of the
    flagged documents; rarer sets start from the kinds with which they share labellers."""
    n, labellers = patterns.shape
    flags = patterns == 1
    codes = flags @ (1 << np.arange(labellers))
    sums = np.bincount(codes, weights=counts, minlength=1 << labellers)
    sums[0] = 0
    kinds = np.flatnonzero(sums >= max(0.01 * sums.sum(), 1e-9)) if sums.sum() else np.array([], dtype=int)
    bits = (kinds[:, None] >> np.arange(labellers)) & 1
    states = np.zeros((n, len(kinds) + 1))
    states[:, 1:] = flags @ bits.T / np.maximum(np.maximum(flags.sum(axis=1)[:, None], bits.sum(axis=1)), 1)
    states[:, 1:] = np.where((codes[:, None] == kinds).any(axis=1)[:, None], codes[:, None] == kinds, states[:, 1:])
    states[:, 0] = codes == 0
    states[states.sum(axis=1) == 0, 0] = 1
    states /= states.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        weight = states * counts[:, None]
        log_odds = np.tile(np.log(weight.sum(axis=0) + FLOOR), (n, 1))
        for j in range(labellers):
            for v in (0, 1):  # how often a labeller abstains is no evidence
                at = patterns[:, j] == v
                voted = weight[patterns[:, j] != 2].sum(axis=0)
                log_odds[at] += np.log((weight[at].sum(axis=0) + FLOOR) / (voted + 2 * FLOOR))
        new = np.exp(log_odds - log_odds.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        done = np.abs(new - states).max() < 1e-9
        states = new
        if done:
            break
    return 1 - states[:, 0]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 500, rate: float = 0.1, ridge: float = 1e-5) -> np.ndarray:
    """Logistic regression on probabilistic labels by full-batch gradient steps with momentum and scaling."""
    w, m, v = (np.zeros(x.shape[1], dtype=np.float32) for _ in range(3))
    for k in range(1, rounds + 1):
        g = x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
    return w.astype(np.float64)


def features(spark: SparkSession):
    """A column function text -> (pattern of votes, numbers and values of the features), packed in 2 and 4 bytes."""
    run = reader(bounded_batches(spark).sparkContext.broadcast({}))
    kind = pa.struct([("pattern", pa.int32()), ("at", pa.binary()), ("value", pa.binary())])

    @F.arrow_udf("struct<pattern: int, at: binary, value: binary>")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for r in run(batch.to_pylist()):
                order = np.argsort(r.text, kind="stable")
                cuts = np.searchsorted(r.text[order], np.arange(len(r.patterns) + 1))
                at, value = r.feature[order].astype("<u2"), r.value[order].astype("<f4")
                rows += [{"pattern": p, "at": at[lo:hi].tobytes(), "value": value[lo:hi].tobytes()} for p, lo, hi in zip(r.patterns.tolist(), cuts, cuts[1:])]
            yield pa.array(rows, type=kind)

    return read


def train(read: DataFrame, train_rows: int) -> np.ndarray | None:
    """Weights of the scorer (``SIZE`` numbers) from rows of (draw, read), or None without rows."""
    found = read.groupBy(F.col("read.pattern").alias("pattern")).agg(F.count("*").alias("n")).collect()  # at most 3^7 rows
    if not found:
        return None
    codes, counts = np.array([r["pattern"] for r in found]), np.array([r["n"] for r in found], dtype=float)
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    junk = dict(zip(codes.tolist(), estimate(codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3, counts)))
    share = min(1.0, 1.2 * train_rows / counts.sum())
    sample = read.where(F.col("draw") <= F.lit(min(int(share * 2**63), 2**63 - 1))).orderBy("draw").limit(train_rows)
    rows = sample.select("read.*").collect()
    x, y = np.zeros((len(rows), SIZE), dtype=np.float32), np.zeros(len(rows), dtype=np.float32)
    for k, r in enumerate(rows):
        x[k, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["value"], "<f4")
        y[k] = junk[r["pattern"]]
    return fit(x, y)


def scorer(spark: SparkSession, weights: np.ndarray):
    """A column function (numbers, values of features) -> double: probability that the text is junk."""
    shared = spark.sparkContext.broadcast(weights)  # SIZE numbers

    @F.arrow_udf("double")
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for at, value in batches:
            sums = [float(shared.value[np.frombuffer(a, "<u2")] @ np.frombuffer(v, "<f4")) for a, v in zip(at.to_pylist(), value.to_pylist())]
            yield pa.array(1 / (1 + np.exp(-np.clip(np.array(sums), -500, 500))))

    return score


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 8_000, keep: list[str] | None = None) -> tuple[DataFrame, Column]:
    """The columns ``keep`` (all without it) of ``docs`` with a column junk_score (an input column of that name is replaced), and
    the score column.  Each text is read once: votes and features are staged beside the kept columns."""
    columns = [c for c in docs.columns if c != "junk_score" and (keep is None or c in keep)]
    draw = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col)), 1)
    rows = staged(docs.select(F.struct(*columns).alias("row"), draw.alias("draw"), features(docs.sparkSession)(F.col(text_col)).alias("read")))
    weights = train(rows.select("draw", "read"), train_rows)
    score = F.lit(None).cast("double") if weights is None else scorer(docs.sparkSession, weights)(F.col("read.at"), F.col("read.value"))
    return rows.select("row.*", score.alias("junk_score")), F.col("junk_score")

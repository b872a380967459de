"""Deleted interpolation against plain counts, plain expectation-maximisation and held-out likelihood."""

import re
import zlib
from collections import Counter, defaultdict
from math import log10

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tideframe.llm import interpolation, queries, shards


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def part(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 5


def plain_em(events):
    """events: (bucket, ratio, n)."""
    out, by = defaultdict(float), defaultdict(list)
    for b, r, n in events:
        by[b].append((r, n))
    for b, es in by.items():
        r, n = np.array([e[0] for e in es]), np.array([e[1] for e in es], dtype=float)
        k = 0.5
        for _ in range(3_000):
            k = float((n * k * r / (k * r + 1 - k)).sum() / (n.sum() + 1))
        out[b] = k
    return out


class Plain:
    def __init__(self, rows):
        self.uni, self.bi, self.ctx = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
        for doc, text in rows:
            p = part(doc)
            if p != 1:
                t = tokens(text)
                self.uni[p].update(t)
                self.bi[p].update(zip(["<start>", *t], t))
                self.ctx[p].update(["<start>", *t[:-1]])
        add = lambda d: sum(d.values(), Counter())
        self.u, self.b, self.c = add(self.uni), add(self.bi), add(self.ctx)
        self.n, self.v = sum(self.u.values()), len(self.u)

    def learn(self):
        events, n = [], self.n
        for p, u in self.uni.items():
            rest = n - sum(u.values())
            events += [(0, (self.u[w] - c) / rest * (self.v + 1), c) for w, c in u.items() if rest]
        self.k1 = plain_em(events)[0]
        events = []
        for p, b in self.bi.items():
            rest = n - sum(self.uni[p].values())
            for (v, w), c in b.items():
                h = self.c[v] - self.ctx[p][v]
                if h:
                    low = self.k1 * (self.u[w] - self.uni[p][w]) / max(rest, 1) + (1 - self.k1) / (self.v + 1)
                    events.append((h.bit_length(), (self.b[v, w] - b[v, w]) / h / low, c))
        self.k2 = plain_em(events)
        return self

    def row(self, doc, text, k1, k2):
        t = tokens(text)
        base = sum(log10((self.u[w] + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in t)
        score = 0.0
        for v, w in zip(["<start>", *t], t):
            one, h = k1 * self.u[w] / max(self.n, 1) + (1 - k1) / (self.v + 1), self.c[v]
            k = k2[h.bit_length()] if h else 0.0
            score += log10(k * self.b[v, w] / max(h, 1) + (1 - k) * one)
        return (doc, part(doc) == 1, len(t), sum(self.u[w] > 0 for w in t), self.n, round(base, 6), round(score, 6))


def rounded(frame):
    return Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in frame.collect())


def model_of(frame):
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return interpolation.Model(frame, F.col("doc_id"), (F.crc32(name.cast("binary")) % 5).cast("int"), F.coalesce("text", F.lit("")), 5, 1)


@pytest.mark.parametrize("words", [40, 2_000_000])
def test_counts_weights_and_scores(spark, docs, monkeypatch, words):
    monkeypatch.setattr(interpolation, "WORDS", words)
    monkeypatch.setattr(shards, "ENTRIES_PER_SLICE", 5)
    monkeypatch.setattr(interpolation.filters, "slice_bits_for", lambda entries, bits: min(3, bits - 1))
    rows = [(r.doc_id, r.text) for r in docs.where("coalesce(length(text), 0) < 1000").collect()]
    rows += [(100 + k, " ".join(["the cat sat", "a dog Ran", f"word{k % 7}"][j % 3] for j in range(k % 11))) for k in range(80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("x")).withColumn("ids", F.lit(0)).repartition(3)
    model, plain = model_of(frame), Plain(rows).learn()
    assert model.corpus.k1 == pytest.approx(plain.k1, abs=2e-2)
    assert all(model.corpus.k2[b] == pytest.approx(k, abs=2e-2) for b, k in plain.k2.items())
    got = interpolation.scored(frame)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert rounded(got) == Counter(plain.row(*r, model.corpus.k1, model.corpus.k2) for r in rows)


def test_cells_hold_every_ratio():
    ratios = np.array([0, 1e-30, 1e-3, 1, 1.01, 7e5, 1e30])
    cell = interpolation.cells(ratios)
    assert cell[0] == 0 and (cell[1:] > 0).all() and (np.diff(cell[1:]) >= 0).all() and cell.max() < interpolation.CELLS
    middle = 2.0 ** ((cell - interpolation.CELLS // 2 + 0.5) / interpolation.CELLS_PER_OCTAVE)
    assert np.allclose(middle[1:-1][1:], ratios[1:-1][1:], rtol=0.012)
    assert interpolation.weight(cell, np.full(len(cell), 1e9)) < 1


def test_no_rows_and_no_training(spark, docs):
    assert interpolation.scored(docs.limit(0)).count() == 0
    held_out = [k for k in range(60) if part(k) == 1]
    rows = [(k, "some words") for k in held_out]
    got = interpolation.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got} == {(True, 3, 0, 0, 0.0, 0.0)}
    only = spark.createDataFrame([(k, "some words") for k in range(60) if part(k) == 0], "doc_id long, text string")
    assert interpolation.scored(only).where("score < base_score * 3 OR isnan(score)").count() == 0


def test_op12(spark, small):
    rows = duckdb.sql(f"select doc_id, text from '{small}/documents.parquet'").fetchall()
    frame = spark.read.parquet(f"{small}/documents.parquet")
    model, plain = model_of(frame), Plain(rows).learn()
    assert model.corpus.k1 == pytest.approx(plain.k1, abs=5e-3)
    got = queries.op12_lm_scores(spark, small)
    assert rounded(got) == Counter(plain.row(*r, model.corpus.k1, model.corpus.k2) for r in rows)
    held = got.where("held_out").agg(F.sum("base_score").alias("base"), F.sum("score").alias("score"), F.sum("n_tokens").alias("n")).first()
    assert held.score > held.base + 0.05 * held.n

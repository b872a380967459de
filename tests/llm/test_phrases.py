"""Quotient filters, phrase counts and collocations against plain versions."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tideframe.llm import filters, phrases, queries, shards


def test_permutation_is_invertible():
    rng = np.random.default_rng(0)
    for bits in (1, 2, 5, 8, 16, 17, 30, 44, 63, 64):
        p, keys = filters.Permutation(bits), rng.integers(0, 2**bits - 1, 1_000, dtype=np.uint64, endpoint=True)
        assert (p.unmix(p.mix(keys)) == keys).all()
        if bits <= 16:
            assert len(np.unique(p.mix(np.arange(2**bits)))) == 2**bits
    with pytest.raises(ValueError):
        filters.Permutation(65)


def test_filters_lose_nothing():
    rng = np.random.default_rng(1)
    for bits in (1, 5, 16, 30, 44, 63, 64):
        for n in (0, 1, 7, 3_000):
            keys, counts = np.unique(rng.integers(0, 2**bits - 1, n, dtype=np.uint64, endpoint=True), return_counts=True)
            counts = counts * rng.choice([1, 2, 254, 255, 2**40], len(counts))
            for slice_bits in range(min(4, bits)):
                parts = [(filters.whole_keys(s, filters.unpack(f)[0], bits, slice_bits), filters.unpack(f)[1]) for s, f in filters.slices(keys, counts, bits, slice_bits)]
                assert [k for p in parts for k in p[0].tolist()] == keys.tolist() and [c for p in parts for c in p[1].tolist()] == counts.tolist()
    even = filters.pack(np.arange(0, 2**30, 2**20, dtype=np.uint64), np.ones(1024, dtype=np.int64), 30)
    assert len(even) < 1024 * 5


def test_merge_adds_equal_keys():
    rng = np.random.default_rng(2)
    runs = [np.unique(rng.integers(0, 500, rng.integers(0, 300))).astype(np.uint64) for _ in range(6)]
    keys, places = filters.merge(runs)
    assert keys.tolist() == sorted(set(np.concatenate(runs).tolist()))
    assert all((keys[p] == r).all() for p, r in zip(places, runs)) and filters.merge([])[1] == []


def plain(rows, longest, least, first):
    """Collocations of (lang, text) rows by counting every phrase."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                for i in range(len(w) - size + 1):
                    f[lang][tuple(w[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        found = []
        for p, a in counts.items():
            if len(p) < 2 or a < least:
                continue
            longer = [q for q in counts if len(q) > len(p) and counts[q] >= a and counts[q] >= least and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not longer:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((score, a, " ".join(p), counts[p[:k]], counts[p[k:]]))
        found.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, rank, p, a, l, r, n[lang], s) for rank, (s, a, p, l, r) in enumerate(found[:first], 1)]
    return sorted(out)


def corpus(k=400):
    rnd = random.Random(7)
    words = ["A", "b", "Ce", "é", "ß", "new", "york", "x" * 300]
    texts = [None, "", " \t\n", "...", "new york new york new york"]
    texts += [" ".join(rnd.choice(words) + rnd.choice(["", "", "", ",", "\n", "!?", "\t", "\x0c", " "]) for _ in range(rnd.randrange(30))) for _ in range(k)]
    return [(rnd.choice(["en", "en", "de", None, "und"]), t) for t in texts]


@pytest.mark.parametrize("words", [50, 2_000_000])
def test_collocations_equal_plain_counts(spark, monkeypatch, words):
    monkeypatch.setattr(phrases, "WORDS", words)
    monkeypatch.setattr(shards, "ENTRIES_PER_SLICE", 10)
    whole = filters.slice_bits_for
    monkeypatch.setattr(filters, "slice_bits_for", lambda entries, bits: whole(entries, bits, 100))
    rows = corpus()
    frame = spark.createDataFrame(rows, "lang string, text string").withColumn("grp", F.lit(1)).withColumn("n", F.lit("x")).repartition(5)
    for least, first in ((3, 40), (20, 2_000)):
        got = phrases.collocations(frame, least=least, first=first)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == plain(rows, 5, least, first)


def test_nothing_to_mine(spark, docs):
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs.where("length(text) < 4"), least=2).count() == 0
    texts = [(r.lang, r.text) for r in docs.where("length(text) < 1000").collect()]
    assert sorted(map(tuple, phrases.collocations(docs.where("coalesce(length(text), 0) < 1000"), least=2).collect())) == plain([t for t in texts], 5, 2, 2_000)


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**12
    counts = spark.createDataFrame([("g", "a b", 2, big), ("g", "a", 1, big), ("g", "b", 1, big + 1)], "grp string, phrase string, words int, f long")
    totals = spark.createDataFrame([("g", 7 * 10**12)], "grp string, n long")
    assert [r.score for r in phrases.ranked(counts, totals, 5).collect()] == [1000 * big * 7 * 10**12 // (big * (big + 1))]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_op11_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf{sf}/documents.parquet'")
    want = con.execute(queries.ORACLES["op11_collocations"]).fetchall()
    assert sorted(tuple(r) for r in queries.op11_collocations(spark, f"/root/testdata/sf{sf}").collect()) == sorted(want) and want

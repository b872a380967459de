"""Alignment of two tokenizers against a plain version by sets of ends."""

import random
from collections import Counter
from hashlib import sha256

import duckdb
import public_tokenizers as P
import pytest

from tideframe.llm import alignment, queries


@pytest.fixture(scope="module")
def files():
    return open(P.path("byte_bpe_50k.json")).read(), open(P.path("piece_bpe_32k.model"), "rb").read()


@pytest.fixture(scope="module")
def aligner(files):
    return alignment.Aligner(*files)


def plain(aligner, text):
    """(A ids, B ids, groups) of a text encoded as a whole."""
    a, b = aligner.a.encode(" " + (text or ""), add_special_tokens=False).ids, aligner.b.encode(text or "")
    whole = (" " + (text or "")).encode()
    if not text or any(b"".join(names[i] for i in ids) != whole for names, ids in ((aligner.a_bytes, a), (aligner.b_bytes, b))):
        return [], [], []
    at = [[sum(len(names[i]) for i in ids[: k + 1]) for k in range(len(ids))] if len(ids) < 400 else ends(names, ids) for names, ids in ((aligner.a_bytes, a), (aligner.b_bytes, b))]
    groups, i, j = [], 0, 0
    for end in sorted(set(at[0]) & set(at[1])):
        k, m = at[0].index(end, i) + 1, at[1].index(end, j) + 1
        groups.append((a[i:k], b[j:m]))
        i, j = k, m
    return a, b, groups


def ends(names, ids):
    out, at = [], 0
    for i in ids:
        at += len(names[i])
        out.append(at)
    return out


def plain_rows(aligner, rows):
    found = [(doc, *plain(aligner, text)) for doc, text in rows]
    counts = Counter((x[-1], y[-1]) for *_, groups in found for x, y in groups)
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return Counter(
        (doc, len(a), len(b), len(groups), len(groups), sum(counts[x[-1], y[-1]] == best[y[-1]] for x, y in groups), sum(counts[x[-1], y[-1]] for x, y in groups),
         sha256(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups).encode()).hexdigest() if groups else "")
        for doc, a, b, groups in found
    )


def test_every_text_equals_the_plain_version(aligner):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("  \n\t\x1c　\xa0ab'sé1!=▁́") for _ in range(rnd.randrange(40))) for _ in range(3_000)] + ["<|endoftext|> a <s> <0x41>", "a\0b", " x", "x ", "  ", " ", "x" * 3_000, "日本語 テキスト 𝔘 한국어"]
    for text, (n_a, n_b, links, digest) in zip(texts, aligner.aligned(texts)):
        a, b, groups = plain(aligner, text)
        assert (n_a, n_b, len(links)) == (len(a), len(b), len(groups)), text
        assert digest == (sha256(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups).encode()).hexdigest() if groups else "")
        assert [divmod(k, aligner.pairs.n_b) for k in aligner.pairs.keys[links].tolist()] == [(x[-1], y[-1]) for x, y in groups]


def test_pairs_are_bounded_by_the_vocabularies(aligner):
    pairs = aligner.pairs
    assert len(pairs.keys) <= sum(map(len, aligner.a_bytes)) + sum(map(len, aligner.b_bytes)) + 256
    for key in random.Random(2).sample(pairs.keys.tolist(), 2_000):
        a, b = aligner.a_bytes[key // pairs.n_b], aligner.b_bytes[key % pairs.n_b]
        assert a.endswith(b) or b.endswith(a)
    assert aligner.a_bytes[aligner.a.token_to_id("Ġthe")] == b" the" == aligner.b_bytes[pairs.same[aligner.a.token_to_id("Ġthe")]]


def test_frame(spark, docs, files, aligner):
    got = alignment.align(docs.withColumn("pair", docs.ids).withColumn("times", docs.ids), *files)
    assert Counter(map(tuple, got.collect())) == plain_rows(aligner, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert alignment.align(docs.limit(0), *files).count() == 0


def test_op13(spark, small, aligner):
    rows = duckdb.sql(f"select doc_id, text from '{small}/documents.parquet'").fetchall()
    assert Counter(map(tuple, queries.op13_tokenizer_alignment(spark, small).collect())) == plain_rows(aligner, rows)

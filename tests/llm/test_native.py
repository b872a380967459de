"""Mixing, order min-hash and sharding against plain versions."""

import os
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tideframe.llm import mixing, order_minhash, queries, sharding


def fill(budget, children):
    """children: name -> (room, weight).  Fair shares by repeated dealing."""
    given, open_ = {}, dict(children)
    while open_:
        left, weights = budget - sum(given.values()), sum(w for _, w in open_.values())
        full = {c: r for c, (r, w) in open_.items() if r * weights <= left * w}
        if not full:
            return given | {c: left * w / weights for c, (r, w) in open_.items()}
        given |= full
        open_ = {c: v for c, v in open_.items() if c not in full}
    return given


def test_budgets_follow_weights_and_shortages_go_to_siblings_first(spark):
    leaves = {("a", "x", "1"): 100, ("a", "x", "2"): 1_000, ("a", "y", "1"): 50, ("b", "x", "1"): 5_000, ("b", None, "9"): 300, (None, "x", None): 7}
    weights = {("a",): 3, ("b",): 2, ("a", "y"): 5, ("b", None): 4}
    frame = spark.createDataFrame([(*k, t) for k, t in leaves.items()], "p string, q string, r string, tokens long")
    for budget, epochs in ((1_500, 1), (4_000, 2), (20_000, 2), (10, 1), (0, 1), (None, 1)):
        got = {(r.p, r.q, r.r): r.budget for r in mixing.leaf_budgets(frame, ["p", "q", "r"], weights, budget, epochs, 1).collect()}
        want = {(): min(sum(leaves.values()) if budget is None else budget, epochs * sum(leaves.values()))}
        for depth in (1, 2, 3):
            below = {}
            for node, b in want.items():
                rooms = Counter()
                for k, t in leaves.items():
                    if k[: depth - 1] == node:
                        rooms[k[:depth]] += t * epochs
                below |= fill(b, {c: (r, weights.get(c, 1)) for c, r in rooms.items()})
            want = below
        assert all(abs(got[k] - want[k]) <= 4 for k in leaves), (budget, epochs, got, want)
        assert sum(got.values()) == min(sum(leaves.values()) if budget is None else budget, epochs * sum(leaves.values()))


def test_mix_takes_whole_epochs_and_a_prefix(spark, docs):
    rows = spark.range(6_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"), F.lit("en").alias("lang"), (F.col("id") % 50).alias("n"), F.lit(0).alias("mix_tokens"))
    out = mixing.mix(rows, ["lang", "source"], {("en", "hot"): 2}, F.col("n"), epochs=3, seed=4)
    taken = Counter((r.source, r.doc_id) for r in out.collect())
    tokens = defaultdict(int)
    for (s, d), n in taken.items():
        tokens[s] += n * (d % 50)
    total = sum(d % 50 for d in range(6_000))
    assert abs(sum(tokens.values()) - total) <= 50 * 8
    for s in tokens:
        times = {n for (x, d), n in taken.items() if x == s and d % 50}
        assert max(times) - min(times) <= 1 and max(times) <= 3
    assert sorted(out.columns) == ["doc_id", "lang", "mix_epoch", "mix_tokens", "n", "source"]
    again = Counter((r.source, r.doc_id) for r in mixing.mix(rows.repartition(7), ["lang", "source"], {("en", "hot"): 2}, F.col("n"), epochs=3, seed=4).collect())
    assert again == taken
    odd = mixing.mix(docs, ["lang", "source"], {}, mixing.word_tokens(F.col("text")))
    assert odd.count() <= docs.count() and mixing.mix(docs.limit(0), ["lang", "source"], {}, F.lit(1)).count() == 0


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_op2_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf{sf}/documents.parquet'")
    want = con.execute(queries.ORACLES["op2_mixing"]).fetchall()
    got = [tuple(r) for r in queries.op2_mixing(spark, f"/root/testdata/sf{sf}").collect()]
    assert Counter(got) == Counter(want) and got


def test_sources_without_a_number_are_books(spark, tmp_path):
    """Sources that don't end in an int must not end the mix (ANSI casts), and get the domain of the SQL."""
    sources = ["", "wiki", "src123456789012", "src7\n", "src٣", "src0", "src09", "src12", "7", None]
    rows = [(k, f"some words here {k}", "en", sources[k % len(sources)]) for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    frame.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["op2_mixing"]).fetchall()
    got = [tuple(r) for r in queries.op2_mixing(spark, str(tmp_path)).collect()]
    assert Counter(got) == Counter(want) and {r[3] for r in got} >= {"", "wiki", "src123456789012"}
    stage = dict(corpus_pipeline.STAGES)["mixture"](spark, frame, str(tmp_path))
    assert Counter(r.doc_id for r in stage.collect()) == Counter(r[0] for r in want)


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def plain_prints(text, k=3, bits=6, take=2):
    words = text.strip(" \t\n\x0b\f\r").split() if text.strip(" \t\n\x0b\f\r") else [""]
    hashes = []
    for i in range(max(len(words) - k + 1, 1)):
        h = 42
        for w in words[i : i + k]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        hashes.append(h)
    seen, packed = Counter(), []
    for i, h in enumerate(hashes):
        top = h >> 23
        e = xxhash.xxh64_intdigest((signed(h) >> 23).to_bytes(8, "little", signed=True), 42)
        e = xxhash.xxh64_intdigest(seen[top].to_bytes(4, "little"), e)
        seen[top] += 1
        packed.append(e >> 23 << 23 | i)
    bins = defaultdict(list)
    for p in sorted(packed, key=signed):
        if len(bins[signed(p) >> (64 - bits)]) < take:
            bins[signed(p) >> (64 - bits)].append(p)
    out = []
    for b in range(-(1 << bits - 1), 1 << bits - 1):
        h = 42
        for y in sorted((p & (1 << 23) - 1) << 40 | p >> 24 for p in bins.get(b, [])):
            h = xxhash.xxh64_intdigest((y & (1 << 40) - 1).to_bytes(8, "little"), h)
        out.append(h if b in bins else None)
    return out


def test_order_minhash_equals_plain_version(spark, docs):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()] + [(100 + k, "repeat me now please " * 9 + f"tail {k}") for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = Counter()
    like = lambda a, b: sum(x is not None and x == y for x, y in zip(a, b)) / sum(x is not None or y is not None for x, y in zip(a, b))
    hexed = lambda p: "".join("-" * 8 if x is None else f"{x:016x}"[8:] for x in p)
    for k, (d, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = map(plain_prints, (t, edited, after))
        want[d, len(t), sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), like(a, b), like(a, c)] += 1
    got = Counter(tuple(r) for r in order_minhash.edited_likeness(frame).collect())
    assert got == want
    assert order_minhash.edited_likeness(docs.limit(0)).count() == 0
    assert order_minhash.edited_likeness(docs.where("doc_id = 3")).first().near_next == 1.0


def test_order_minhash_sees_order(spark):
    words = [f"w{k}" for k in range(600)]
    halves = words[300:] + words[:300]
    rows = spark.createDataFrame([(1, " ".join(words), " ".join(halves))], "id long, a string, b string")
    r = order_minhash.fingerprints(rows, {"x": "a", "y": "b"}).select(order_minhash.likeness(F.col("x"), F.col("y"))).first()[0]
    plain = order_minhash.fingerprints(rows, {"x": "a", "y": "b"}, take=1).select(order_minhash.likeness(F.col("x"), F.col("y"))).first()[0]
    assert plain > 0.95 and r < 0.8


@pytest.mark.parametrize("source", ["docs", "/root/testdata/sf0.01", "hot"])
def test_shards(spark, docs, source):
    if source == "docs":
        frame, shards = docs, 4
    elif source == "hot":
        frame, shards = spark.range(9_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "the same text").otherwise(F.concat(F.lit("text "), "id")).alias("text"), F.lit(1).alias("slot")), 16
    else:
        frame, shards = spark.read.parquet(f"{source}/documents.parquet"), 16
    rows = sharding.shard(frame, shards).collect()
    given = frame.collect()
    assert len(rows) == len(given)
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in given)
    assert all(r.size == len((r.text or "").encode()) + 1 for r in rows)
    by, slots, places = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        by[r.shard] += r.size
        slots[r.shard].append(r.slot)
        places[r.text].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if source != "docs":
        largest = 0 if source == "hot" else max(r.size for r in rows)
        share = sum(by.values()) / shards
        assert set(by) == set(range(shards)) and max(by.values()) <= share * 1.04 + largest and min(by.values()) >= share * 0.96 - largest
        weight = Counter(r.text for r in rows)
        cut = {t for t, p in places.items() if len(p) > 1}
        assert all(weight[t] * (len(t.encode()) + 1) > 0.04 * share for t in cut) and len(cut) < shards
    assert sharding.shard(frame.limit(0), 4).count() == 0


def test_native_plans_have_no_python(spark, small):
    for name in ("op2_mixing", "op3_order_minhash", "op7_sharding"):
        plan = queries.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas")), name
    assert os.path.isdir(small)

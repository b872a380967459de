"""Near-duplicate texts and vectors, components, the quality classifier and the pipeline."""

import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tideframe.llm import collisions, graphs, queries, simhash, weak_labels


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(1)
    chain = [(k, k + 1) for k in range(300)]
    star = [(1_000, 1_000 + k) for k in range(1, 400)]
    noise = [(rnd.randrange(2_000, 2_400), rnd.randrange(2_000, 2_400)) for _ in range(180)]
    links = chain + star + noise + [(5, 5)]
    want = groups({n for e in links for n in e}, links)
    got = {r.node: r.root for r in graphs.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: r for n, r in want.items() if n != r}
    a, b = (np.array(c) for c in zip(*links))
    nodes, roots = graphs.forest(a, b)
    assert dict(zip(nodes.tolist(), roots.tolist())) == got
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    words = ("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")).encode().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(len(words) - 2, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_near(rows, bits=3):
    prints = {k: plain_fingerprint(t) for k, (_, t) in enumerate(rows)}
    distinct = sorted(set(prints.values()))
    roots = groups(distinct, [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= bits])
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[roots[prints[k]]] = min(d, least.get(roots[prints[k]], d))
    return Counter((d, f"{prints[k]:016x}", least.get(roots[prints[k]])) for k, (d, _) in enumerate(rows))


def test_near_texts(spark, docs):
    rnd = random.Random(4)
    base = [f"word{rnd.randrange(400)}" for _ in range(700)]
    near = [(100 + k, " ".join(w if rnd.random() > 0.004 else "other" for w in base)) for k in range(120)]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    rows = [tuple(r) for r in frame.collect()]
    want = plain_near(rows)
    assert Counter(tuple(r) for r in simhash.near_duplicates(frame).collect()) == want
    assert len({c for _, _, c in want}) < len(rows) - 20
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = {plain_fingerprint(t) for _, t in rows}
    roots = groups(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3])
    assert sorted(roots[plain_fingerprint(r.text)] for r in kept) == sorted(set(roots.values()))
    for r in kept:
        ids = [d for d, t in rows if roots[plain_fingerprint(t)] == roots[plain_fingerprint(r.text)] and d is not None]
        assert r.doc_id == min(ids, default=None)
    assert all(len(r) == len(docs.columns) for r in kept)


def test_rows_without_or_with_the_same_id_are_decided_alone(spark):
    texts = [" ".join(f"{c}{k}" for k in range(30)) for c in "abcd"]
    rows = [(1, texts[0], "x"), (None, texts[0], "x"), (None, texts[1], "y"), (None, texts[1], "x"), (5, texts[2], "x"), (3, texts[2], "x"), (5, texts[3], "x"), (5, texts[3], "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    kept = Counter(tuple(r) for r in simhash.keep_one(frame).collect())
    assert kept == Counter([rows[0], rows[3], rows[5], rows[6]])


def test_near_links_of_crowded_values(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT", 8)
    rnd = np.random.default_rng(2)
    prints = set()
    for centre in rnd.integers(0, 2**62, 4).tolist():
        for n in rnd.integers(0, 5, 60).tolist():
            value = centre
            for bit in rnd.integers(0, 63, n).tolist():
                value ^= 1 << bit
            prints.add(value)
    links = simhash.near_links(spark.createDataFrame([(int(p),) for p in prints], "print long")).collect()
    values = [int(p) for p in prints]
    assert groups(values, [(r.a, r.b) for r in links]) == groups(values, [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 3])


def test_op6(spark, small):
    rows = duckdb.sql(f"select doc_id, text from '{small}/documents.parquet'").fetchall()
    assert Counter(tuple(r) for r in queries.op6_simhash(spark, small).collect()) == plain_near(rows)


def plain_vectors(rows, threshold=0.9):
    good = {k: np.array(v, dtype=np.float64) for k, v in rows if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= threshold]
    n = Counter(x for e in links for x in e)
    roots = groups([k for k, _ in rows if k is not None], links)
    return {k: (n[k], roots[k], roots[k] == k) for k, _ in rows if k is not None}


@pytest.mark.parametrize("options", [{}, {"block": 32}, {"end_size": 40}])
def test_near_vectors(spark, options):
    rnd = np.random.default_rng(3)
    x = rnd.standard_normal((400, 24))
    near = x[rnd.integers(0, 40, 300)] + 0.22 * rnd.standard_normal((300, 24))
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(np.concatenate([x, near]))]
    rows += [(900 + k, rows[7][1]) for k in range(60)] + [(990, [2 * v for v in rows[7][1]])]
    rows += [(1_000, None), (1_001, []), (1_002, [0.0] * 24), (1_003, [float("nan")] * 24), (1_004, [None] + [1.0] * 23), (1_005, [float("inf")] + [1.0] * 23), (None, rows[7][1]), (1_006, [1.0, 2.0]), (1_007, [1.0, 2.1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("links", F.lit(1)).withColumn("size", F.lit("x"))
    got = {r.vec_id: tuple(r)[1:] for r in collisions.near_vectors(frame, **options).collect()}
    assert got == plain_vectors(rows)
    assert collisions.near_vectors(frame.limit(0)).count() == 0


def test_vectors_of_any_size_link(spark):
    rows = [(1, [3e200, 4e200]), (2, [3e-200, 4e-200]), (3, [3.0, 4.0]), (4, [-3e300, -4e300]), (5, [5e-324, 0.0]), (6, [1e308, 0.0]), (7, [0.0, 0.0])]
    got = {r.vec_id: tuple(r)[1:] for r in collisions.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (0, 4, True), 5: (1, 5, True), 6: (1, 5, False), 7: (0, 7, True)}


def test_op4_equals_sql(spark, tmp_path):
    rnd = np.random.default_rng(9)
    x = rnd.standard_normal((120, 16))
    near = x[rnd.integers(0, 12, 150)] + 0.2 * rnd.standard_normal((150, 16))
    rows = [(k, v.astype(np.float32).tolist(), 0) for k, v in enumerate(np.concatenate([x, near]))] + [(500, [0.0] * 16, 1), (501, None, 1), (502, [float("nan")] * 16, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["op4_near_vectors"]).fetchall()
    got = sorted(tuple(r) for r in queries.op4_near_vectors(spark, str(tmp_path)).collect())
    assert got == sorted(want) and any(r[1] for r in got)


def test_plan_is_calibrated():
    rnd = np.random.default_rng(5)
    plan = collisions.Plan(20_000, 0.9)
    a = rnd.standard_normal((2_000, 48))
    a /= np.linalg.norm(a, axis=1)[:, None]
    r = rnd.standard_normal((2_000, 48))
    r -= (r * a).sum(axis=1)[:, None] * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * r / np.linalg.norm(r, axis=1)[:, None]
    shared = ((a @ plan.directions(48, 0) >= plan.cut) & (b @ plan.directions(48, 0) >= plan.cut)).any(axis=1)
    counts = (np.abs(a @ plan.directions(48, 1) - b @ plan.directions(48, 1)) <= plan.width).sum(axis=1)
    assert shared.mean() > 0.998 and (counts >= plan.least).mean() > 0.998


def test_op4(spark, small):
    rows = duckdb.sql(f"select vec_id, embedding from '{small}/embeddings.parquet'").fetchall()
    assert {r.vec_id: tuple(r)[1:] for r in queries.op4_near_vectors(spark, small).collect()} == plain_vectors(rows)


def test_classifier(spark, docs):
    at = "/root/testdata/sf0.01"
    got = {r.doc_id: r.kept for r in queries.op8_quality(spark, at).collect()}
    labels = duckdb.sql(f"select doc_id, quality from '{at}/labels.parquet'").fetchall()
    wrong = Counter(q for d, q in labels if got[d] != bool(q))
    assert wrong[1] <= 2 and wrong[0] <= 3 and sum(q == 0 for _, q in labels) > 40  # held-out labels: none is used in training
    scored, score = weak_labels.judged(docs.withColumn("junk_score", F.lit("x")))
    assert scored.where(score.isNull()).count() == 0 and scored.count() == docs.count()
    assert weak_labels.judged(docs.limit(0))[0].count() == 0


def votes(texts):
    patterns = weak_labels.Read(texts, weak_labels.Facts()).patterns
    return {name: (patterns // 3**k % 3).tolist() for k, name in enumerate(weak_labels.LABELLERS)}


def plain_read(text):
    """(votes by labeller, features) of one text, word by word."""
    words = text.split()
    n, chars = len(words), max(len(text), 1)
    facts = [weak_labels.word_facts(w) for w in words]
    symbols, capitals, ends, marks = (sum(f[k] for f in facts) for k in range(1, 5))
    same = sum(a == b for a, b in zip(words, words[1:]))
    varied = weak_labels.variety(words, Counter(words))
    enough, readable = n >= weak_labels.FEW, n > 0 and chars >= weak_labels.FEW
    some = max(n, 1)
    bounds = {  # value, good within, junk outside
        "symbols": ((symbols - (0 if enough else ends)) / chars, 0, 0.045, 0, 0.075), "capitals": (capitals / chars, 0, 0.06, 0, 0.2), "variety": (varied, 0.55, 1, 0.4, 1),
        "repeats": (same / some, 0, 0.02, 0, 0.1), "marks": (marks / some, 0, 0.03, 0, 0.15), "sentences": (ends / some, 0.06, 0.25, 0.03, 0.4), "word_length": (chars / some, 5, 7, 4.2, 8),
    }
    said = {}
    for name, (v, a, b, c, d) in bounds.items():
        votes_at = enough or (readable and name in weak_labels.PER_CHARACTER)
        said[name] = 2 if not votes_at else 0 if a <= v <= b else 1 if v < c or v > d else 2
    features = defaultdict(float, {0: 1.0, 1: 1 - varied if enough else 0.0, 2: (same / some) ** 0.5})
    for shape, times in Counter(f[0] for f in facts).items():
        features[shape] = (times / some) ** 0.5
    return tuple(said[name] for name in weak_labels.LABELLERS), features


def plain_posteriors(patterns, counts, rounds=50):
    """P(junk) of each pattern by expectation-maximisation in loops."""
    flagged = [frozenset(k for k, v in enumerate(p) if v == 1) for p in patterns]
    total = sum(c for f, c in zip(flagged, counts) if f)
    kinds = sorted((f for f in set(flagged) if f and sum(c for g, c in zip(flagged, counts) if g == f) >= 0.01 * total), key=lambda f: sum(1 << k for k in f))
    states = []
    for f in flagged:
        if not f:
            row = [1.0] + [0.0] * len(kinds)
        elif f in kinds:
            row = [0.0] + [float(f == k) for k in kinds]
        else:
            row = [0.0] + [len(f & k) / max(len(f), len(k)) for k in kinds]
        states.append([x / sum(row) for x in row] if sum(row) else [1.0] + [0.0] * len(kinds))
    for _ in range(rounds):
        weight = [[s * c for s in row] for row, c in zip(states, counts)]
        size = len(kinds) + 1
        logs = [[np.log(sum(w[k] for w in weight) + weak_labels.FLOOR) for k in range(size)] for _ in patterns]
        for j in range(len(patterns[0])):
            voted = [sum(w[k] for w, p in zip(weight, patterns) if p[j] != 2) for k in range(size)]
            for v in (0, 1):
                same = [sum(w[k] for w, p in zip(weight, patterns) if p[j] == v) for k in range(size)]
                for row, p in zip(logs, patterns):
                    if p[j] == v:
                        for k in range(size):
                            row[k] += np.log((same[k] + weak_labels.FLOOR) / (voted[k] + 2 * weak_labels.FLOOR))
        states = [(lambda e: [x / sum(e) for x in e])([np.exp(x - max(row)) for x in row]) for row in logs]
    return [1 - row[0] for row in states]


def test_votes_features_and_posteriors_equal_a_plain_version():
    texts = [r[0] for r in duckdb.sql("select coalesce(text, '') from '/root/testdata/sf0.01/documents.parquet' order by doc_id").fetchall()]
    texts += ["", " ", "a a a a", "word " * 400, "one. two, three " * 90, texts[3], texts[3], "$$$ !!! %%%", "x" * 50_000]
    read = weak_labels.Read(texts, weak_labels.Facts())
    rows = [plain_read(t) for t in texts]
    assert [tuple(p // 3**k % 3 for k in range(7)) for p in read.patterns.tolist()] == [v for v, _ in rows]
    got = [defaultdict(float) for _ in texts]
    for t, f, v in zip(read.text.tolist(), read.feature.tolist(), read.value.tolist()):
        got[t][f] += v
    for mine, (_, want) in zip(got, rows):
        assert {k: v for k, v in mine.items() if v} == pytest.approx({k: v for k, v in want.items() if v})
    counts = Counter(v for v, _ in rows)
    patterns = sorted(counts)
    mine = weak_labels.estimate(np.array(patterns), np.array([counts[p] for p in patterns], dtype=float))
    assert mine.tolist() == pytest.approx(plain_posteriors(patterns, [counts[p] for p in patterns]), abs=1e-4)


def test_scores_are_those_of_the_features(spark):
    """Same rows, scored from staged features and from the text alone; ties and repeated rows get one score."""
    rows = [(k % 7, t) for k, t in enumerate(["fine words of a text, and more of them." * 4, "$$$ !!! %%%", "", None, "a a a a a a a a"] * 8)]
    scored, score = weak_labels.judged(spark.createDataFrame(rows, "doc_id long, text string"), keep=["text"])
    assert scored.columns == ["text", "junk_score"]
    by = defaultdict(set)
    for r in scored.collect():
        by[r.text or ""].add(r.junk_score)
    assert all(len(v) == 1 for v in by.values()) and len(by) == 4
    weights = np.linspace(-1, 1, weak_labels.SIZE)
    f = spark.createDataFrame([(t,) for t in by], "text string").withColumn("f", weak_labels.features(spark)("text"))
    for r in f.select("text", weak_labels.scorer(spark, weights)(F.col("f.at"), F.col("f.value")).alias("p")).collect():
        z = sum(weights[k] * v for k, v in plain_read(r.text)[1].items())
        assert r.p == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def joined(lang, words, quality=1):
    """Labelled texts of one language end to end until they have ``words`` words."""
    rows = duckdb.sql(f"select text from '/root/testdata/sf0.1/documents.parquet' join '/root/testdata/sf0.1/labels.parquet' using (doc_id) where quality = {quality} and lang = '{lang}' order by doc_id").fetchall()
    out, n = [], 0
    for (text,) in rows:
        if n < words:
            out.append(text)
            n += len(text.split())
    assert n >= words
    return "\n".join(out)


def test_variety_does_not_fall_with_length():
    for lang in ("en", "de", "fr", "es"):
        texts = [joined(lang, n) for n in (1_000, 20_000, 50_000, 100_000)]
        assert votes(texts)["variety"] == [0, 0, 0, 0], lang
        read = weak_labels.Read(texts, weak_labels.Facts())
        feature = read.value[read.feature == 1]
        assert feature.max() < 0.35  # the tables hold copies of texts
    base = joined("en", 1_000).split()
    assert votes([" ".join(base[:50] * 400), " ".join(base[:1_000] * 20)])["variety"] == [1, 1]  # copies closer and further apart than a run


def test_rules_per_character_vote_on_short_texts(spark):
    junk = ["È$$$ onai*** des&&& outionoi&&& la.&&& Aiè.***", "ndtion. | Erndnd | thndonea. |", "Schlich | erzuen | erzuach | heitbe |"]
    clean = ["Thblent ersh th. Anreti eawhou ly edth and.", "The for, of it. Ha, edble.", "Le rein. An ed, for."]
    seen = votes(junk + clean + ["This.", "!!!", " " * 40, ""])
    assert seen["symbols"] == [1] * 3 + [0] * 3 + [2] * 4
    assert {v for name in weak_labels.LABELLERS[2:] for v in seen[name]} == {2}
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    long = [joined(lang, n) for lang, n in (("en", 20_000), ("de", 50_000), ("fr", 100_000))]
    odd = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(junk + clean + long)], "doc_id long, text string")
    scored, score = weak_labels.judged(frame.union(odd))
    kept = {-1 - r.doc_id: r.kept for r in scored.select("doc_id", (score < weak_labels.JUNK_FROM).alias("kept")).where("doc_id < 0").collect()}
    assert [kept[k] for k in range(9)] == [False] * 3 + [True] * 6


def test_estimation_from_incomplete_labellers():
    """Labellers that miss a tenth of the junk, abstain on a fifth, and rarely call good texts junk."""
    rnd = np.random.default_rng(1)
    junk = rnd.random(20_000) < 0.2
    said = [np.where(junk, rnd.random(20_000) < hit, rnd.random(20_000) < false) for hit, false in ((0.9, 0.0005), (0.85, 0.001), (0.9, 0.001), (0.8, 0.0005))]
    votes = np.stack([np.where(rnd.random(20_000) < 0.2, 2, s) for s in said], axis=1).astype(int)
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    assert ((weak_labels.estimate(patterns, counts.astype(float))[at.ravel()] > 0.5) == junk).mean() > 0.99


def test_pipeline(spark, docs, tmp_path):
    at = "/root/testdata/sf0.01"
    stages = dict(corpus_pipeline.STAGES)
    table = spark.read.parquet(f"{at}/documents.parquet")
    good = stages["quality"](spark, table, at)
    kept = {r.doc_id: r.kept for r in queries.op8_quality(spark, at).collect()}
    assert {r.doc_id for r in good.collect()} == {d for d, k in kept.items() if k}
    single = stages["near_duplicates"](spark, good, at)
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert {r.doc_id for r in single.collect()} == {c for _, _, c in plain_near(rows)}
    mixed = stages["mixture"](spark, single, at)
    assert good.columns == single.columns == mixed.columns == table.columns
    taken = Counter(r.doc_id for r in mixed.collect())
    want = Counter()
    con = duckdb.connect()
    single.toPandas().to_parquet(tmp_path / "single.parquet")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/single.parquet'")
    for r in con.execute(queries.ORACLES["op2_mixing"]).fetchall():
        want[r[0]] += 1
    assert taken == want
    out = corpus_pipeline.run(spark, at)
    texts = {r.doc_id: r.text for r in table.collect()}
    from hashlib import sha256
    final = defaultdict(int)
    for r in out.collect():
        final[r.doc_id] += 1
        assert r.decoded_sha256 == sha256((texts[r.doc_id] or "").encode()).hexdigest() and r.n_tokens == len(r.ids)
    assert final == taken
    frame = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, at)
    assert frame.count() >= 1
    frame = docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, at)
    assert frame.count() == 0

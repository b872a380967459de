"""Word pieces, byte-level BPE, chat formatting and token files against plain versions."""

import random
import re
import zlib
from hashlib import sha256

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tideframe.llm import bpe, chat, pieces, queries, tokenfile

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def odd_texts(n=3_000):
    rnd = random.Random(5)
    return ["".join(rnd.choice(" \n\t\x1c　\xa0ab'sé1!=") for _ in range(rnd.randrange(40))) for _ in range(n)]


def punctuated(n=3_000):
    rnd = random.Random(6)
    return ["".join(rnd.choice(" ,.!_'aAsé3É\n\u0301") for _ in range(rnd.randrange(40))) for _ in range(n)]


def greedy(word, starts, inner):
    at = count = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in (inner if at else starts)), None)
        if end is None:
            return 1
        at, count = end, count + 1
    return count


def test_automaton_equals_greedy():
    rnd = random.Random(3)
    for _ in range(300):
        starts = {bytes(rnd.choices(b"abc", k=rnd.randint(1, 4))) for _ in range(6)}
        inner = {bytes(rnd.choices(b"abc", k=rnd.randint(1, 5))) for _ in range(8)}
        a = pieces.Automaton(starts, inner)
        for _ in range(40):
            w = bytes(rnd.choices(b"abcd", k=rnd.randint(0, 12)))
            assert a.count(w) == greedy(w, starts, inner), (w, starts, inner)


def test_token_counts(spark, docs, small):
    count = pieces.token_counter(spark, RANKS)
    starts, inner = pieces.split_vocabulary(bpe.read_ranks(RANKS))
    want = lambda t: None if t is None else sum(greedy(w, starts, inner) for w in re.findall(rb"[^\x20\x09-\x0d]+", t.encode()))
    for r in docs.withColumn("got", count("text")).collect():
        assert r.got == want(r.text)
    texts = dict(duckdb.sql(f"select doc_id, text from '{small}/documents.parquet'").fetchall())
    got = {r.doc_id: r.n_tokens for r in queries.op1_token_counts(spark, small).collect()}
    assert got == {k: want(t) for k, t in texts.items()}
    assert docs.limit(0).select(count("text")).count() == 0


def spaced(word, starts, inner):
    """``greedy``, but a word without a fitting start piece is a space and continuation pieces."""
    if not word or any(word[:e] in starts for e in range(1, len(word) + 1)):
        return greedy(word, starts, inner)
    rest = greedy(b" " + word, {b" "}, inner)
    return rest if any(word[:e] in inner for e in range(1, len(word) + 1)) else 1


def test_words_without_a_start_piece_go_on_after_the_space(spark):
    rnd = random.Random(4)
    for _ in range(300):
        starts = {bytes(rnd.choices(b"ab", k=rnd.randint(1, 4))) for _ in range(4)} | {b""}
        inner = {bytes(rnd.choices(b"abc", k=rnd.randint(1, 5))) for _ in range(8)}
        a = pieces.Automaton(starts, inner)
        for _ in range(40):
            w = bytes(rnd.choices(b"abcd", k=rnd.randint(0, 12)))
            assert a.count(w) == spaced(w, starts, inner), (w, starts, inner)
    ranks = bpe.read_ranks(RANKS)
    texts = ["中文文本没有空格", "中文文本没有空格" * 500, "한국어", "россия", "работа россия", "ok 한국어 fine", "\x1c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").withColumn("got", pieces.token_counter(spark, RANKS)("text")).collect()
    for r in rows:
        assert r.got == sum(spaced(w, *pieces.split_vocabulary(ranks)) for w in r.text.encode().split())
    got = {r.text: r.got for r in rows}
    assert got[texts[1]] > 500 and min(got[t] for t in texts[:5]) > 1


def test_merge_replay_equals_library(tik):
    texts = [*odd_texts(), "aaaaaaaaaaaaaaaa", "", "x" * 3_000, "thththththth hahahaha"]
    got = [np.frombuffer(p, "<i4").tolist() for p in bpe.Encoder(bpe.read_ranks(RANKS), P.PATTERN).encode(texts)]
    assert got == [tik.encode_ordinary(t) for t in texts]


def test_replay_of_early_pairs_keeps_the_lowest_rank_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"ab": 310, b"abd": 305, b"dd": 320}
    table = bpe.MergeTable(ranks)
    words = [b"abd", b"abddabd", b"abcabd", b"ddd", b""]
    ids, at = table.replay(words)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [table.merge_one(w) for w in words]
    assert table.merge_one(b"abd") == [305]


def test_encode_decode_frame(spark, docs, tik):
    encode, decode = bpe.encoder(spark, RANKS, P.PATTERN), bpe.decoder(spark, RANKS)
    for r in docs.withColumn("ids", encode("text")).withColumn("back", decode("ids")).collect():
        assert (None if r.ids is None else list(r.ids)) == (None if r.text is None else tik.encode_ordinary(r.text))
        assert (None if r.back is None else bytes(r.back).decode()) == r.text
    assert docs.limit(0).select(decode(encode("text"))).count() == 0


def test_op9(spark, small, tik):
    texts = dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{small}/documents.parquet'").fetchall())
    rows = queries.op9_byte_bpe(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = tik.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(texts[r.doc_id].encode()).hexdigest())


def test_elias_fano():
    rnd = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (1, 9_000), (700, 1), (5_000, 20_000), (5_000, 2**40), (3_000, 3_000_000)):
        values = np.sort(rnd.integers(0, top, n)).astype(np.uint64)
        packed = tokenfile.EliasFano.of(values).pack()
        back, end = tokenfile.EliasFano.unpack(memoryview(packed), 0)
        assert end == len(packed) and [v for k in range(0, n, tokenfile.STEP) for v in back.stretch(k).tolist()] == values.tolist()
        assert [back.select(k) for k in range(0, n, 37)] == values[::37].tolist()


def test_token_files(spark, docs, tmp_path):
    definition = open(P.path("word_bpe_49k.json")).read()
    library = Tokenizer.from_str(definition)
    want, at = [], 0
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, (r.text or "").encode())
    for r in sorted(docs.collect(), key=key):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    tokenfile.write_token_files(docs, str(tmp_path / "a"), definition, 1, tokens_per_segment=1_000)
    got = sorted((tuple(r) for r in tokenfile.read_token_files(spark, str(tmp_path / "a")).collect()), key=lambda r: r[1])
    assert got == want
    files = [r.content for r in tokenfile.read_files(spark, str(tmp_path / "a")).collect()]
    picked = [s.ids(k).tolist() for f in files for s in tokenfile.segments(bytes(f)) for k in range(s.n)]
    assert sorted(picked) == sorted(w[4] for w in want)
    tokenfile.write_token_files(docs.limit(0), str(tmp_path / "b"), definition, 1)
    assert tokenfile.read_token_files(spark, str(tmp_path / "b")).count() == 0


def test_library_words_equal_library_texts():
    definition = open(P.path("word_bpe_49k.json")).read()
    library, texts = Tokenizer.from_str(definition), [*odd_texts(), *punctuated(), "one, two. three,, four., five,. ,six .seven 8, é, ǅ. ª,", "A<|endoftext|>b <|endoftext|> É é ΣΑΣ İ"]
    got = [np.frombuffer(p, "<u2").tolist() for p in tokenfile.LibraryEncoder(definition, 2).encode(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_word_is_encoded_once_whatever_marks_follow():
    definition = open(P.path("word_bpe_49k.json")).read()
    library, encoder, made = Tokenizer.from_str(definition), tokenfile.LibraryEncoder(definition, 2), []
    encode_words = encoder.encode_words
    encoder.memo.make = lambda words: (made.extend(words), encode_words(words))[1]
    encoder.memo.limit = 12
    texts = ["thorn thorn. Thorn### thorn2019", "thorn|\nthorn,' thorn", "", " ", "***"]
    got = [np.frombuffer(p, "<u2").tolist() for p in encoder.encode(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [w for w in made if "thorn" in w] == ["thorn"]
    # letters by Python's or the library's tables only, letters that become two, control strings, quotes, combining marks
    rnd = random.Random(7)
    parts = ["a", "thorn", "\U0001e030", "\U00031350", "İ", "ª", "²", "e\u0301", "가", "\u1100\u1161", "Σ", "'s", "'", "<|endoftext|>", "<|", "|>", ".", "9", "###", "\u0301", "\x00", "\t", "\u2028", " ", " ", "\n"]
    odd = ["".join(rnd.choices(parts, k=rnd.randrange(12))) for _ in range(2_000)]
    got = [np.frombuffer(p, "<u2").tolist() for p in encoder.encode(odd)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in odd]


def plain_chat(turns):
    out = {}
    for conv, turn, role, text in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or 0)):
        out.setdefault(conv, []).append((role or "", text or ""))
    return {c: (len(ts), sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest(), len(a := "".join(t for r, t in ts if r == "assistant")), sha256(a.encode()).hexdigest(), sum(len(f"<|im_start|>{chat.escape_role(r)}\n{chat.escape(t)}<|im_end|>\n") for r, t in ts)) for c, ts in out.items()}


def test_escapes_are_reversible():
    rnd = random.Random(2)
    for _ in range(3_000):
        t = "".join(rnd.choice("<|\\>n\na") for _ in range(rnd.randrange(12)))
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        assert chat.unescape_role(chat.escape_role(t)) == t and "\n" not in chat.escape_role(t)


def test_chat(spark):
    rows = [(1, 0, "user", "hi <|im_end|> <\\| <\\\\| ok"), (1, 1, "assistant", None), (1, 2, "assistant", "é" * 40_000), (2, None, None, "x"), (2, 3, "assi\nstant\\", "\n\ny\n"), (None, 0, "assistant", ""), (3, 5, "assistant", "<|im_start|>assistant ok")]
    rows += [(7, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(3_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1)).withColumn("at", F.lit("a"))
    formatted = chat.format_chat(frame, RANKS, P.PATTERN, block=100)
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_chat(formatted, RANKS).collect()}
    assert got == plain_chat(rows)
    hot = formatted.where("conv_id = 7").orderBy("place").collect()
    assert [r.place for r in hot] == list(range(3_000))
    assert all(a.at + len(a.ids) == b.at for a, b in zip(hot, hot[1:]))
    assert chat.read_chat(chat.format_chat(frame.limit(0), RANKS, P.PATTERN), RANKS).count() == 0


def test_op5(spark, small):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{small}/conversations.parquet'").fetchall()
    got = {r.conv_id: tuple(r)[1:] for r in queries.op5_chat_format(spark, small).collect()}
    assert got == plain_chat([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)])


def test_op5_equals_sql(spark, tmp_path):
    rows = [(1, 0, "user", "hi <|im_end|> <\\| <\\\\| ok"), (1, 1, "assistant", None), (1, 2, "assistant", "é<|x"), (2, 0, None, "x"), (2, 3, "assi\nstant\\", "\n\ny\n"), (3, 5, "assistant", "<|im_start|>assistant ok")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["op5_chat_format"]).fetchall()
    assert sorted(tuple(r) for r in queries.op5_chat_format(spark, str(tmp_path)).collect()) == sorted(want)


def test_op10(spark, small):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want, at = [], 0
    for doc, text in duckdb.sql(f"select doc_id, coalesce(text, '') from '{small}/documents.parquet' order by 1").fetchall():
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in queries.op10_token_files(spark, small).collect()) == want

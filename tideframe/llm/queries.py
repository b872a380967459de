"""Registered queries of the text operators over the whole tables, and their SQL where it exists."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tideframe.llm import alignment, bpe, chat, collisions, interpolation, mixing, order_minhash, phrases, pieces, sharding, simhash, tokenfile, weak_labels
from tideframe.session import STAGED, checkpoint_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(column: str = "text"):
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-piece count of every document by the public byte vocabulary."""
    count = pieces.token_counter(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return table(spark, sf_dir, "documents").select("doc_id", count(whole()).alias("n_tokens"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 16)
    return placed.select("doc_id", "size", F.crc32(whole().cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, score = weak_labels.judged(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return scored.select("doc_id", score.alias("junk_score"), (score < weak_labels.JUNK_FROM).alias("kept"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encode, decode = bpe.encoder(spark, path, public_tokenizers.PATTERN), bpe.decoder(spark, path)
    encoded = table(spark, sf_dir, "documents").select("doc_id", encode(whole()).alias("ids"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2(decode("ids"), 256).alias("decoded_sha256"))


#: Production target weights of the mix by domain, language and source; nodes not named have weight 1.
MIX_WEIGHTS = {
    ("web",): 6, ("books",): 4,
    ("web", "en"): 6, ("web", "de"): 2, ("web", "fr"): 2, ("web", "es"): 2,
    ("books", "en"): 8, ("books", "de"): 1, ("books", "fr"): 1, ("books", "es"): 1,
    ("web", "en", "src0"): 3,
}
MIX_EPOCHS = 2


def domain():
    """Sources numbered below 10 are the web, the others (without a number or with one beyond int, too) books."""
    return F.when(F.regexp_extract("source", r"([0-9]+)\z", 1).try_cast("int") < 10, "web").when(F.col("source").isNotNull(), "books")


def mixed(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs.withColumn("mix_domain", domain()), ["mix_domain", "lang", "source"], MIX_WEIGHTS, mixing.word_tokens(F.col("text")), epochs=MIX_EPOCHS)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).select("doc_id", "mix_domain", "lang", "source", "mix_tokens", F.col("mix_epoch").cast("long").alias("mix_epoch"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_likeness(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return chat.read_chat(chat.format_chat(turns, path, public_tokenizers.PATTERN), path)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_root(spark)}/tokens-{uuid.uuid4().hex}"
    with open(public_tokenizers.path("word_bpe_49k.json")) as file:
        definition = file.read()
    tokenfile.write_token_files(table(spark, sf_dir, "documents"), path, definition, end_id=1)
    STAGED.append((spark, path))
    return tokenfile.read_token_files(spark, path).drop("ids")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.scored(table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json")) as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return alignment.align(table(spark, sf_dir, "documents"), a.read(), b.read())


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_mixing, op3_order_minhash, op4_near_vectors, op5_chat_format, op6_simhash, op7_sharding, op8_quality, op9_byte_bpe, op10_token_files, op11_collocations, op12_lm_scores, op13_tokenizer_alignment)}


def mix_oracle() -> str:
    """The mix as SQL: levels dealt from the root down, then the prefix of one more epoch per leaf."""
    paths = [["mix_domain"], ["mix_domain", "lang"], ["mix_domain", "lang", "source"]]
    parts = ["""sized AS (SELECT doc_id, lang, source, CASE WHEN TRY_CAST(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS INT) < 10 THEN 'web' WHEN source IS NOT NULL THEN 'books' END AS mix_domain,
        coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS mix_tokens FROM documents)"""]
    budget = "(SELECT CAST(coalesce(sum(mix_tokens), 0) AS BIGINT) FROM sized)"
    for depth, path in enumerate(paths):
        names, parent = ", ".join(path), path[:-1]
        cases = " ".join("WHEN " + " AND ".join(f"{c} = '{v}'" for c, v in zip(path, key)) + f" THEN {w}" for key, w in MIX_WEIGHTS.items() if len(key) == len(path))
        above = budget if not depth else f"(SELECT n.budget FROM n{depth - 1} n WHERE " + " AND ".join(f"n.{c} IS NOT DISTINCT FROM r.{c}" for c in parent) + ")"
        over = f"PARTITION BY {', '.join(parent)}" if parent else ""
        order = f"{over} ORDER BY full_at, {path[-1]} NULLS FIRST"
        parts += [
            f"r{depth} AS (SELECT {names}, CAST(sum(mix_tokens) * {MIX_EPOCHS} AS BIGINT) AS room, CASE {cases} ELSE 1 END AS weight FROM sized GROUP BY {names})",
            f"b{depth} AS (SELECT *, CAST(room AS HUGEINT) * 1000000 // weight AS full_at, least({above}, sum(room) OVER ({over})) AS budget FROM r{depth} r)",
            f"s{depth} AS (SELECT *, budget - coalesce(sum(room) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over, sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM b{depth})",
            f"f{depth} AS (SELECT *, min(CASE WHEN CAST(room AS HUGEINT) * weights <= CAST(left_over AS HUGEINT) * weight THEN 1 ELSE 0 END) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS is_full FROM s{depth})",
            f"h{depth} AS (SELECT *, CASE WHEN is_full = 1 THEN room ELSE least(room, CAST(budget - coalesce(sum(CASE WHEN is_full = 1 THEN room END) OVER ({over}), 0) AS HUGEINT) * weight // sum(CASE WHEN is_full = 0 THEN weight END) OVER ({over})) END AS given FROM f{depth})",
            f"n{depth} AS (SELECT {names}, room, CASE WHEN is_full = 0 AND row_number() OVER ({over} ORDER BY is_full, full_at, {path[-1]} NULLS FIRST) <= budget - sum(given) OVER ({over}) THEN least(given + 1, room) ELSE given END AS budget FROM h{depth})",
        ]
    leaf = ", ".join(paths[-1])
    return f"""WITH {", ".join(parts)},
    plan AS (SELECT {leaf}, CASE WHEN room > 0 THEN budget // (room // {MIX_EPOCHS}) ELSE 0 END AS whole, CASE WHEN room > 0 THEN budget % (room // {MIX_EPOCHS}) ELSE 0 END AS more FROM n2),
    dealt AS (SELECT s.*, p.whole, p.more, md5('1|' || CAST(CAST(p.whole AS BIGINT) AS VARCHAR) || '|' || CAST(s.doc_id AS VARCHAR)) AS place FROM sized s JOIN plan p ON {" AND ".join(f"s.{c} IS NOT DISTINCT FROM p.{c}" for c in paths[-1])}),
    placed AS (SELECT *, whole + CASE WHEN coalesce(sum(mix_tokens) OVER (PARTITION BY {leaf} ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < more THEN 1 ELSE 0 END AS times FROM dealt)
    SELECT doc_id, mix_domain, lang, source, mix_tokens, unnest(range(CAST(times AS BIGINT))) AS mix_epoch FROM placed"""


def collocation_oracle(longest: int = 5, least: int = 100, first: int = 2000) -> str:
    """Phrases counted word by word, each cut scored in 128-bit integers."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    grams = " UNION ALL ".join(f"SELECT lang, {n} AS words, array_to_string(w[i:i + {n - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM pieces)" for n in range(1, longest + 1))
    spans = " UNION ALL ".join(f"SELECT lang, array_to_string(w[i:i + {n - 1}], ' ') AS phrase, a FROM (SELECT lang, w, a, unnest(range(1, len(w) - {n} + 2)) AS i FROM candidates WHERE len(w) > {n})" for n in range(2, longest))
    return f"""WITH cut AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM cut),
    totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
    counts AS (SELECT lang, words, phrase, count(*) AS f FROM ({grams}) GROUP BY ALL HAVING count(*) >= {least}),
    candidates AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE words > 1),
    cuts AS (SELECT lang, phrase, a, k, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, len(w))) AS k FROM candidates)),
    scored AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n, CAST(CAST(1000 AS HUGEINT) * c.a * t.n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
        FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.head JOIN counts y ON y.lang = c.lang AND y.phrase = c.tail JOIN totals t ON t.lang = c.lang),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inside AS (SELECT lang, phrase, max(a) AS longer FROM ({spans}) GROUP BY ALL),
    ranked AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR 100 * i.longer < 100 * b.a)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {first}"""


#: Every pair of vectors compared, links followed to the end.
VECTOR_ORACLE = """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    fine AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE len(e) = len(list_filter(e, lambda x: isfinite(x))) AND list_dot_product(e, e) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
    reach AS (SELECT vec_id AS node, vec_id AS other FROM v UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
    component AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node), degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN component ON node = v.vec_id LEFT JOIN degree ON a = v.vec_id"""

#: Digests of the turns themselves: what formatting and reading back must give.
CHAT_ORACLE = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok'),
    e AS (SELECT *, replace(replace(role, '\', '\\'), chr(10), '\n') AS r FROM (SELECT conv_id, turn, text, role FROM t))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(sum(length('<|im_start|>' || regexp_replace(r, '<(\\*)\|', '<\1\\|', 'g') || chr(10) || regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id"""

ORACLES: dict[str, str] = {"op2_mixing": mix_oracle(), "op4_near_vectors": VECTOR_ORACLE, "op5_chat_format": CHAT_ORACLE, "op11_collocations": collocation_oracle()}

"""Chat formatting at token level.

Each turn becomes: start id, ids of the role, ids of a newline, ids of the text, end id, ids of a
newline.  The segments are encoded apart and the reserved ids spliced in, so no text can ever merge
into a control token.  Control strings inside a role or text are escaped before encoding: ``<``,
any number of backslashes and ``|`` get one backslash more, which the reader takes away again.  In
roles, backslash and newline are escaped as well, so that the first newline ends the role.

Positions come from prefix sums of segment lengths: over the turns of a conversation in order, with
the turns of a hot conversation summed in blocks first.  The loss mask of a turn is the half-open
range of the conversation's tokens that hold the text of an assistant turn.

Defined results: null role and null text are empty; a null turn comes first; equal turns are in
order of role, then text; a null conversation id is a conversation of its own; a table without rows
gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tideframe.llm.bpe import Encoder, id_arrays, read_ranks
from tideframe.llm.words import bounded_batches, kept
from tideframe.session import staged

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_chat(turns: DataFrame, path: str, pattern: str, block: int = 1024) -> DataFrame:
    """One row per turn: conv_id, turn, place (number of the turn in its conversation, from 0), ids,
    at (position of its first id in the conversation), loss_from and loss_to (positions under the
    loss mask; equal where there is none).  Reserved ids: the two after the last id of the vocabulary."""
    shared = bounded_batches(turns.sparkSession).sparkContext.broadcast({"ranks": read_ranks(path)})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(shared, lambda value: Encoder(value["ranks"], pattern))
        reserved = encoder.table.size - 1
        start, end = (int(reserved + k).to_bytes(4, "little") for k in (0, 1))
        newline = next(encoder.encode(["\n"]))
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            heads = list(encoder.encode([escape_role(r) for r in roles]))
            bodies = list(encoder.encode([escape(t) for t in texts]))
            packed = [start + h + newline + b + end + newline for h, b in zip(heads, bodies)]
            lead = [(len(start) + len(h) + len(newline)) // 4 for h in heads]
            taught = [len(b) // 4 if r == "assistant" else 0 for r, b in zip(roles, bodies)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), batch.column("tie"), id_arrays(packed), pa.array(lead, type=pa.int64()), pa.array(taught, type=pa.int64())], ["conv_id", "turn", "tie", "ids", "lead", "taught"])

    clean = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = clean.withColumn("tie", F.concat("role", F.lit("\n"), "text").cast("binary")).withColumn("tie", F.sha2("tie", 256))
    encoded = staged(rows.mapInArrow(encode, "conv_id long, turn long, tie string, ids array<int>, lead long, taught long"))
    # a block is a range of turn numbers, so a conversation of any length is numbered in parts
    blocked = encoded.withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / block))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "tie").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocked.groupBy("conv_id", "block").agg(F.sum(F.size("ids")).alias("tokens"), F.count("*").alias("turns"))
    past = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("tokens").over(past), F.lit(0)).alias("base"), F.coalesce(F.sum("turns").over(past), F.lit(0)).alias("first"))
    placed = blocked.withColumn("before", F.coalesce(F.sum(F.size("ids")).over(inside), F.lit(0))).withColumn("number", F.coalesce(F.count("*").over(inside), F.lit(0)))
    joined = placed.join(bases, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    at = F.col("base") + F.col("before")
    return joined.select("conv_id", "turn", (F.col("first") + F.col("number")).alias("place"), "ids", at.alias("at"), (at + F.col("lead")).alias("loss_from"), (at + F.col("lead") + F.col("taught")).alias("loss_to"))


def read_chat(formatted: DataFrame, path: str) -> DataFrame:
    """Read conversations back from ids and masks: one row per conversation with n_turns,
    turns_sha256, loss_chars, loss_sha256 and formatted_chars.

    Turns are sorted within the tasks; a conversation runs through as a stream of turns with running
    digests, so its length is not bounded by memory."""
    ranks = formatted.sparkSession.sparkContext.broadcast(read_ranks(path))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: text for text, rank in ranks.value.items()}
        reserved = max(token) + 1
        token |= {reserved: START.encode(), reserved + 1: END.encode()}
        key, state, done = None, None, []

        def close() -> None:
            if state is not None:
                n, turns, chars, loss, size = state
                done.append({"conv_id": key, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": size})

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(done, schema=pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

        for batch in batches:
            for conv, ids, at, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "at", "loss_from", "loss_to"))):
                if state is None or conv != key:
                    close()
                    key, state = conv, [0, sha256(), 0, sha256(), 0]
                if ids[0] != reserved or ids.count(reserved) != 1 or ids.count(reserved + 1) != 1:
                    raise ValueError("a turn has one start and one end id")
                inner = b"".join(token[i] for i in ids[1 : ids.index(reserved + 1)]).decode()
                role, _, text = inner.partition("\n")
                state[0] += 1
                state[1].update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
                taught = unescape(b"".join(token[i] for i in ids[lo - at : hi - at]).decode())
                state[2] += len(taught)
                state[3].update(taught.encode())
                state[4] += len(b"".join(token[i] for i in ids).decode())
            if len(done) >= 1_000:
                yield out()
                done.clear()
        close()
        yield out()

    rows = formatted.select("conv_id", "place", "ids", "at", "loss_from", "loss_to")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return dealt.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

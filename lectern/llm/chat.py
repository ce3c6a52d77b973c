"""Chat formatting by event-sourced reconstruction (dealt operator 7).

A log has events of messages: message starts one with a role and a text, delta adds to its text, edit replaces the text, and
regenerate empties it for the deltas that follow. Events are dealt by ranges of conversation and turn and sorted by sequence,
so tasks fold them as a stream with one message in memory, and a long conversation is spread over tasks. Each message
is rendered to one row of the output: the formatted piece and the spans that the loss mask covers in it.

The template is ``### role: text</turn>`` and a line feed. In texts a backslash is put before each backslash and before
each character at which a control string (### or </turn>) starts; in roles also before a colon. Taking these backslashes
away gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.shared import stored, text_batches

_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_ROLE = re.compile(r"\\|#(?=##)|<(?=/turn>)|:")
#: Repeats are possessive: nothing that was read is held for another try, however long a text is.
_PIECE = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
#: Characters of a delta in as_events().
DELTA = 200
_ESCAPED = re.compile(r"\\(.)", re.S)
#: The conversation that the contract adds, with control strings in its texts.
PROBE = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def escape(text: str, pattern: re.Pattern = _CONTROL) -> str:
    return pattern.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The formatted piece of a message, and where its loss span starts and ends (both 0 if it has none)."""
    head, body = f"### {escape(role, _ROLE)}: ", escape(text)
    return f"{head}{body}</turn>\n", *((len(head), len(head) + len(body)) if role == "assistant" else (0, 0))


def parse(piece: str) -> tuple[str, str]:
    """Role and text of a formatted piece."""
    m = _PIECE.fullmatch(piece)
    if not m:
        raise ValueError("not a formatted message")
    return unescape(m[1]), unescape(m[2])


def as_events(rows: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as a log of events, as if assistants' texts had been streamed, edited and regenerated.

    By a hash of the row an assistant's text is one message, or an empty message and deltas, or another text, an edit and deltas, or
    another text, a regeneration and deltas. A turn with several rows has whole messages, since its events would mix.
    """
    keys = ["conv_id", "turn"]
    several = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*[F.col(k).alias(f"_{k}") for k in keys], F.lit(True).alias("_several"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & F.col("turn").eqNullSafe(F.col("_turn"))
    text = F.coalesce("text", F.lit(""))
    way = F.when((F.col("role") == "assistant") & F.col("_several").isNull(), F.pmod(F.xxhash64("conv_id", "turn", text), F.lit(4))).otherwise(0)
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(text) / DELTA).cast("int") - 1)), lambda i: F.substr(text, i * DELTA + 1, F.lit(DELTA)))
    event = lambda kind, said: F.struct(F.lit(kind).alias("kind"), said.alias("text"))
    deltas = lambda said: F.transform(said, lambda x: event("delta", x))
    draft = event("message", F.lit("a draft that goes"))
    events = (
        F.when(way == 1, F.concat(F.array(event("message", F.lit(""))), deltas(pieces)))
        .when(way == 2, F.concat(F.array(draft, event("edit", F.get(pieces, 0))), deltas(F.slice(pieces, F.lit(2), F.greatest(F.lit(0), F.size(pieces) - 1)))))
        .when(way == 3, F.concat(F.array(draft, event("delta", F.lit(", too")), event("regenerate", F.lit(""))), deltas(pieces)))
        .otherwise(F.array(event("message", text)))
    )
    met = rows.select(*keys, "role", "text").join(several, same, "left")
    out = met.select(*keys, "role", F.posexplode(events).alias("seq", "e"))
    return out.select(*keys, F.col("seq").cast("long").alias("seq"), "e.kind", "role", "e.text")


def format_chats(events: DataFrame) -> DataFrame:
    """conv_id, turn, part, formatted, loss_start, loss_end: a row for each message of a log (conv_id, turn, seq, kind, role, text).

    Messages of a conversation follow each other by turn, and within a turn by sequence (part counts them). Null roles and
    texts count as empty. Every message event is a message of its own, so repeated rows stay, and ties are ordered by kind,
    role and text; a null conversation or turn is a value of its own, before the others. A delta, edit or regenerate that
    no message precedes in its turn starts one. Other columns are ignored; an empty log gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, part, role, parts = None, 0, "", None
        for batch in batches:
            out = []
            for at, kind, r, text in zip(batch["key"], batch["kind"], batch["role"], batch["text"], strict=True):
                if parts is not None and (at != key or kind == "message"):
                    out.append((key, part, *render(role, "".join(parts))))
                    part, parts = part + 1, None
                if at != key:
                    key, part = at, 0
                if parts is None:
                    role, parts = r, []
                if kind in ("edit", "regenerate"):
                    parts = []
                if kind != "regenerate":
                    parts.append(text)
            yield pd.DataFrame(out, columns=names)
        if parts is not None:
            yield pd.DataFrame([(key, part, *render(role, "".join(parts)))], columns=names)

    names = ["key", "part", "formatted", "loss_start", "loss_end"]
    order = F.when(F.col("kind") == "message", 0).otherwise(1)
    log = text_batches(events).select("conv_id", "turn", "seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    log = log.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "seq", order, "kind", "role", "text")
    made = log.select(F.to_json(F.struct("conv_id", "turn")).alias("key"), "kind", "role", "text").mapInPandas(run, "key string, part int, formatted string, loss_start int, loss_end int")
    ids = F.from_json("key", "conv_id long, turn long")
    return made.select(ids["conv_id"].alias("conv_id"), ids["turn"].alias("turn"), "part", "formatted", "loss_start", "loss_end")


def digests(output: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the formatted output.

    Digests of a conversation are taken in one pass over its pieces in order; only their state is held. Pieces without a
    conversation are one; equal pieces each count; columns beside those of format_chats() are ignored; no pieces give no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, None
        for batch in batches:
            out = []
            for at, piece, start, end in zip(batch["key"], batch["formatted"], batch["loss_start"], batch["loss_end"], strict=True):
                if held is None or at != key:
                    if held is not None:
                        out.append(_told(key, held))
                    key, held = at, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse(piece)
                held[1].update(f"{role}\n{text}\n".encode())
                learnt = unescape(piece[start:end])
                held[3].update(learnt.encode())
                held[0], held[2], held[4] = held[0] + 1, held[2] + len(learnt), held[4] + len(piece)
            yield pd.DataFrame(out, columns=names)
        if held is not None:
            yield pd.DataFrame([_told(key, held)], columns=names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    rows = output.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part").select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), "formatted", "loss_start", "loss_end")
    return rows.mapInPandas(run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumn("conv_id", F.nullif(F.col("conv_id"), F.lit("")).cast("long"))


def _told(key: str, held: list) -> tuple:
    return key, held[0], held[1].hexdigest(), held[2], held[3].hexdigest(), held[4]


def formatted_digests(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Formats conversations and the probe, writes the output and returns what digests() reads from it."""
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    log = as_events(conversations.select("conv_id", "turn", "role", "text").unionByName(probe))
    return digests(stored(format_chats(log), "chats"))

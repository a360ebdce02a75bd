"""Chat formatting by columnar byte assembly.

The turns of whole conversations are laid out in numpy: every turn is a header,
its text and a footer; the lengths of all those segments give offsets by a
running sum, and headers and texts are copied by scatter indices into one
preallocated buffer that becomes the Arrow column.

Template, for every turn: ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles
and texts, ``<`` with k backslashes and ``|`` is written with k + 1 backslashes,
so that no ``<|`` is left and reading takes one off again; a role's line breaks
and backslashes are written as ``\\n`` and ``\\\\`` before that. The loss mask
lists the spans of the assistant's texts.

Edge cases: null texts and roles count as empty; equal (conversation, turn) rows
are all kept, in order of role and text; rows with a null conversation id form
one conversation; an empty table gives no rows. One conversation is one value,
so memory follows the longest conversation.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, read

START, END = "<|im_start|>", "<|im_end|>"
GUARD, GUARDED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
LEARNED = "assistant"
#: Turns and bytes of text that are assembled together.
BATCH_BYTES = 4_000_000


def guard(text: str) -> str:
    return GUARD.sub(r"<\\\1|", text) if "<" in text else text


def unguard(text: str) -> str:
    return GUARDED.sub(r"<\1|", text) if "<\\" in text else text


def role_line(role: str) -> str:
    return guard(role.replace("\\", "\\\\").replace("\n", "\\n"))


def role_of(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unguard(line))


def assemble(roles: list[str], texts: list[str], conversation: np.ndarray, count: int) -> tuple[pa.Array, list[list[tuple[int, int]]]]:
    """The formatted conversations as one Arrow column, and their loss spans in code points.

    ``conversation``: for each turn, in order, the index of its conversation.
    """
    heads = [f"{START}{role_line(r)}\n" for r in roles]
    bodies = list(map(guard, texts))
    foot = f"{END}\n"
    parts = [[h.encode() for h in heads], [b.encode() for b in bodies]]
    lengths = np.array([[len(x) for x in parts[0]], [len(x) for x in parts[1]], [len(foot)] * len(roles)], np.int64).T.reshape(-1, 3)
    ends = np.cumsum(lengths.ravel()).reshape(-1, 3) if len(roles) else np.zeros((0, 3), np.int64)
    starts = ends - lengths
    size = int(ends[-1, -1]) if len(roles) else 0
    out = np.empty(size, np.uint8)
    for k, segments in enumerate([*parts, [foot.encode()] * len(roles)]):
        source = np.frombuffer(b"".join(segments), np.uint8)
        n = lengths[:, k]
        shift = starts[:, k] - (np.cumsum(n) - n)  # from the joined segments to the buffer
        out[np.repeat(shift, n) + np.arange(len(source))] = source
    turn_bytes = lengths.sum(1) if len(roles) else np.zeros(0, np.int64)
    offsets = np.r_[0, np.cumsum(np.bincount(conversation, turn_bytes, count))].astype(np.int64)
    column = pa.Array.from_buffers(pa.large_string(), count, [None, pa.py_buffer(offsets), pa.py_buffer(out)])
    spans: list[list[tuple[int, int]]] = [[] for _ in range(count)]
    at, now = 0, -1
    for i, c in enumerate(conversation.tolist()):
        if c != now:
            at, now = 0, c
        at += len(heads[i])
        if roles[i] == LEARNED:
            spans[c].append((at, at + len(bodies[i])))
        at += len(bodies[i]) + len(foot)
    return column, spans


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its id, ``n_turns``, ``formatted`` and ``loss_spans``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows = turns.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    schema = StructType([turns.schema[conv], *StructType.fromDDL("n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>").fields])

    def run(batches):
        arrow = to_arrow_schema(schema)
        held: list[list] = [[], [], []]  # ids, roles, texts of turns not yet written
        size = 0

        def write(n: int):
            ids, roles, texts = (h[:n] for h in held)
            for h in held:
                del h[:n]
            new = np.array([i == 0 or ids[i] != ids[i - 1] for i in range(n)], bool)
            index = np.cumsum(new) - 1
            count = int(new.sum())
            column, spans = assemble(roles, texts, index, count)
            names = [ids[i] for i in np.flatnonzero(new)]
            pairs = [[{"start": a, "end": b} for a, b in s] for s in spans]
            return pa.RecordBatch.from_arrays(
                [pa.array(names, arrow.field(0).type), pa.array(np.bincount(index, minlength=count).astype(np.int64)),
                 column.cast(arrow.field(2).type), pa.array(pairs, arrow.field(3).type)], schema=arrow)

        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                if size > BATCH_BYTES and values[0] != held[0][-1]:
                    yield write(len(held[0]))
                    size = 0
                for h, v in zip(held, values):
                    h.append(v)
                size += len(values[2]) + 50
        if held[0]:
            yield write(len(held[0]))

    return rows.mapInArrow(run, schema)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The roles and texts of a formatted conversation."""
    return [(role_of(m[1]), unguard(m[2])) for m in TURN.finditer(formatted)]


def chat_digests(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the formatted conversations and their loss spans give when read back."""

    def make():
        def work(values):
            out = {n: [] for n in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for v in values:
                spans, text = v.split("\n", 1)
                turns = read_back(text)
                learned = "".join(unguard(text[int(a) : int(b)]) for a, b in (s.split("-") for s in spans.split(",") if s))
                out["n_turns"].append(len(turns))
                out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                out["loss_chars"].append(len(learned))
                out["loss_sha256"].append(hashlib.sha256(learned.encode()).hexdigest())
                out["formatted_chars"].append(len(text))
            return out

        return work

    spans = F.array_join(F.transform("loss_spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    both = chats.select(F.col(f"`{conv}`"), F.concat(spans, F.lit("\n"), F.col("formatted")).alias("both"))
    return map_texts(both, "both", [conv], "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", make)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(LEARNED).alias("role"), F.lit(said).alias("text"))
    return chat_digests(format_chats(turns.unionByName(probe)))


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS body,
         regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') AS line FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(line) + 1 + length(body) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

"""Chat formatting with typed content parts.

A turn holds parts of type text, image, audio or document. A visitor flattens them in order: text is escaped,
every attachment becomes a placeholder, and its reference, its place and the tokens it expands to are recorded.
The template is one segment a turn,

    <|turn|>ROLE\\nCONTENT<|end|>\\n

and a conversation is the concatenation of its segments, so no conversation has to fit one row or one task's
memory. Control strings inside texts and roles are escaped by a backslash after their first character, and
backslashes are doubled; `unescape` takes that back exactly.

Defined results: null texts, roles and part lists are empty; a part of unknown type is rendered as its text; rows
are ordered by turn (null first), ties and repeated rows by role and content, each a turn of its own;
rows of a null conv_id form one conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_STARTS = re.compile(f"(?={'|'.join(map(re.escape, CONTROL))})(.)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_SEGMENT = re.compile(r"<\|turn\|>((?:[^\\\n]|\\.)*)\n(.*)<\|end\|>\n", re.DOTALL)
_PLACEHOLDER = re.compile(r"<\|(image|audio|document)\|>")
LOSS_ROLE = "assistant"

PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
ATTACHMENTS = "array<struct<kind:string,ref:string,position:bigint,tokens:bigint>>"
SEGMENTS = f"conv_id bigint, turn bigint, role string, segment string, loss_start bigint, loss_end bigint, attachments {ATTACHMENTS}, expanded_tokens bigint"
DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_attachments bigint"


def escape(text: str) -> str:
    """Backslashes doubled, then one put after the first character of each control string, overlapping ones too."""
    return _STARTS.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class PartVisitor:
    """Renders parts in order. Token counts of attachments are parameters of the model that reads them."""

    def __init__(self, tile: int = 336, tokens_per_tile: int = 144, tokens_per_second: float = 12.5, tokens_per_page: int = 600):
        self.tile, self.tokens_per_tile, self.tokens_per_second, self.tokens_per_page = tile, tokens_per_tile, tokens_per_second, tokens_per_page

    def flatten(self, parts) -> tuple[str, list[dict]]:
        out, found, length = [], [], 0
        for part in [] if parts is None else parts:
            if part is None:
                continue
            kind = part["type"]
            text, tokens = getattr(self, f"visit_{kind}", self.visit_text)(part) if kind in ("text", "image", "audio", "document") else self.visit_text(part)
            if tokens is not None:
                found.append({"kind": kind, "ref": part["ref"], "position": length, "tokens": tokens})
            out.append(text)
            length += len(text)
        return "".join(out), found

    def visit_text(self, part) -> tuple[str, None]:
        return escape(part["text"] or ""), None

    def visit_image(self, part) -> tuple[str, int]:
        across, down = (max(1, math.ceil(_number(part[k]) / self.tile)) for k in ("width", "height"))
        return "<|image|>", across * down * self.tokens_per_tile

    def visit_audio(self, part) -> tuple[str, int]:
        return "<|audio|>", math.ceil(_number(part["seconds"]) * self.tokens_per_second)

    def visit_document(self, part) -> tuple[str, int]:
        return "<|document|>", max(1, int(_number(part["pages"]))) * self.tokens_per_page


def _number(x) -> float:
    return float(x) if x is not None and x == x and x > 0 else 0.0


def format_turns(turns: DataFrame, visitor: PartVisitor | None = None) -> DataFrame:
    """A segment a turn. turns: conv_id, turn, role and either text or parts (an array as in PARTS)."""
    visitor = visitor or PartVisitor()
    if "parts" in turns.columns:
        parts = F.col("parts").cast(PARTS)
    else:
        parts = F.array(F.struct(F.lit("text").alias("type"), F.col("text"))).cast("array<struct<type:string,text:string>>")
        parts = F.transform(parts, lambda p: F.struct(p["type"].alias("type"), p["text"].alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for role, listed in zip(pdf["role"], pdf["parts"]):
                content, found = visitor.flatten(listed)
                head = f"<|turn|>{escape(role).replace(chr(10), chr(92) + chr(10))}\n"
                loss = (len(head), len(head) + len(content)) if role == LOSS_ROLE else (0, 0)
                for x in found:
                    x["position"] += len(head)
                out.append((f"{head}{content}<|end|>\n", *loss, found, sum(x["tokens"] for x in found)))
            made = pd.DataFrame(out, columns=["segment", "loss_start", "loss_end", "attachments", "expanded_tokens"], index=pdf.index)
            yield pd.concat([pdf[["conv_id", "turn", "role"]], made], axis=1)

    return rows.mapInPandas(run, SEGMENTS)


def read_back(segments: DataFrame) -> DataFrame:
    """One row a conversation, from its segments alone: digests of turns and of the text under the loss mask.

    A digest is sequential by nature; a task streams its sorted conversations and keeps two hash states.
    """
    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = segments.select("conv_id", "turn", "role", "segment", "loss_start", "loss_end").repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", F.regexp_replace("segment", r"\\(?s:(.))", "$1"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        done: list[tuple] = []

        def close():
            if state:
                done.append((None if now is None else now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))

        for pdf in frames:
            ids = pdf["conv_id"].astype("object").where(pdf["conv_id"].notna(), None)
            for conv, segment, low, high in zip(ids, pdf["segment"], pdf["loss_start"], pdf["loss_end"]):
                conv = None if conv is None else int(conv)
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                role, content = _SEGMENT.fullmatch(segment).groups()
                state[0] += 1
                state[1].update(f"{unescape(role)}\n{unescape(content)}\n".encode())
                under = unescape(segment[low:high])
                state[2] += len(under)
                state[3].update(under.encode())
                state[4] += len(segment)
                state[5] += len(_PLACEHOLDER.findall(content))
            if done:
                yield _frame(done)
                done.clear()
        close()
        yield _frame(done)

    return ordered.mapInPandas(run, DIGEST)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments"])
    pdf["conv_id"] = pdf["conv_id"].astype("Int64")
    return pdf


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return read_back(format_turns(turns.unionByName(probe)))


_ESCAPES = " + ".join(f"(length(text) - length(replace(text, '{c}', ''))) // {len(c)}" for c in CONTROL)
OP2_SQL = f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, length(replace(role, chr(92), 'xx')) as role_chars, length(replace(text, chr(92), 'xx')) + {_ESCAPES} as text_chars from t)
select conv_id, count(*)::bigint as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    sum(length('<|turn|>' || chr(10) || '<|end|>' || chr(10)) + role_chars + text_chars)::bigint as formatted_chars, 0::bigint as n_attachments
from e group by conv_id
"""

"""Chat formatting on token level.

Every segment (role, text) is encoded by itself and reserved ids are spliced between the segments::

    <s> [INST] role [/INST] text </s> [INST] role [/INST] text </s> ...

so no text can produce a reserved id.  In segments the control strings are also escaped, reversibly, so that
the written-out form is as unambiguous as the ids.  Loss masks come from prefix sums of segment lengths.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import codec, default_vocabulary

# Control strings, in the order of their reserved ids
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
BEGIN, END, OPEN, CLOSE = range(4)
ESCAPE = "\\"
LEARNED_ROLE = "assistant"


def escape(text: str) -> str:
    """Doubles the escape character and puts one after the first character of each control string."""
    text = text.replace(ESCAPE, ESCAPE * 2)
    for control in CONTROLS:
        text = text.replace(control, control[0] + ESCAPE + control[1:])
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def assemble(roles: list[str], texts: list[str], encode, reserved: int) -> list[tuple]:
    """(ids, loss mask, characters of the written-out form) per turn, without the opening <s>."""
    out = []
    controls = sum(len(CONTROLS[k]) for k in (OPEN, CLOSE, END))
    for role, text in zip(roles, texts):
        parts = [escape(role), escape(text)]
        encoded = [np.array(encode(p), np.int32) for p in parts]
        segments = [[reserved + OPEN], encoded[0], [reserved + CLOSE], encoded[1], [reserved + END]]
        ids = np.concatenate([np.asarray(s, np.int32) for s in segments])
        ends = np.cumsum([len(s) for s in segments])
        edges = np.zeros(len(ids) + 1, np.int32)
        if role == LEARNED_ROLE:
            edges[ends[-3]] += 1
            edges[ends[-2]] -= 1
        mask = np.cumsum(edges[:-1]) > 0
        out.append((ids, mask, controls + sum(map(len, parts))))
    return out


def format_turns(turns: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per turn of (conv_id, turn, role, text): conv_id, turn_no, ids, loss, n_chars.

    The rows of a conversation, by ``turn_no`` from 0, are its sequence.  Turns are ordered by turn (nulls
    first), then role and text; null roles and texts are empty; rows without conv_id are one conversation.
    Encoding needs no neighbours and runs before the turns meet; numbering is a running count over the
    sorted turns, so a long conversation is never held as a whole.  Other columns are not read.
    """
    path = vocabulary or default_vocabulary()
    rows = turns.selectExpr("cast(conv_id AS long) AS conv_id", "cast(turn AS long) AS turn", "coalesce(role, '') AS role",
                            "coalesce(text, '') AS text")
    kind = "conv_id long, turn long, role string, text string, ids array<int>, loss array<boolean>, n_chars long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, _, reserved = codec(path)
        for batch in batches:
            made = assemble(batch["role"].tolist(), batch["text"].tolist(), encode, reserved)
            frame = pd.DataFrame(made, columns=["ids", "loss", "n_chars"], index=batch.index)
            yield pd.concat([batch.astype({"conv_id": "Int64", "turn": "Int64"}), frame], axis=1)

    begin = codec(path)[2] + BEGIN
    return rows.mapInPandas(run, kind).withColumn("turn_no", F.expr(
        "cast(row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS long)")).selectExpr(
        "conv_id", "turn_no", f"IF(turn_no = 0, concat(array({begin}), ids), ids) AS ids",
        "IF(turn_no = 0, concat(array(false), loss), loss) AS loss",
        f"n_chars + IF(turn_no = 0, {len(CONTROLS[BEGIN])}, 0) AS n_chars")


def read_turns(formatted: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(conv_id, turn_no, role, text, loss_text, n_chars) decoded from ids and masks alone.

    ``loss_text`` is the text under the mask, unescaped.
    """
    path = vocabulary or default_vocabulary()
    kind = "conv_id long, turn_no long, role string, text string, loss_text string, n_chars long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, decode, reserved = codec(path)
        for batch in batches:
            out = []
            for key, turn, ids, loss, n_chars in zip(
                    batch["conv_id"], batch["turn_no"], batch["ids"], batch["loss"], batch["n_chars"]):
                ids = np.asarray(ids)
                at = {c: int(np.flatnonzero(ids == reserved + c)[0]) for c in (OPEN, CLOSE, END)}
                plain = [unescape(decode(part.tolist()).decode()) for part in (
                    ids[at[OPEN] + 1:at[CLOSE]], ids[at[CLOSE] + 1:at[END]], ids[np.asarray(loss, bool)])]
                out.append((key, turn, *plain, n_chars))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in kind.split(", ")])
            yield frame.astype({"conv_id": "Int64"})

    return formatted.mapInPandas(run, kind)


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest over a conversation has to see its turns one after the other: rows are dealt by conv_id,
    sorted, and streamed through a running digest; only one turn and the state of one conversation are held.
    """
    kind = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
            "formatted_chars long")
    columns = [c.split()[0] for c in kind.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for batch in batches:
            done = []
            for key, role, text, loss, n_chars in zip(
                    batch["conv_id"].astype("Int64"), batch["role"], batch["text"], batch["loss_text"], batch["n_chars"]):
                key = None if key is pd.NA else int(key)
                if state is None or state[0] != key:
                    if state is not None:
                        done.append(_closed(state))
                    state = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state[3] += len(loss)
                state[4].update(loss.encode("utf-8", "surrogatepass"))
                state[5] += n_chars
            yield pd.DataFrame(done, columns=columns).astype({"conv_id": "Int64"})
        if state is not None:
            yield pd.DataFrame([_closed(state)], columns=columns).astype({"conv_id": "Int64"})

    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no")
    return dealt.select("conv_id", "role", "text", "loss_text", "n_chars").mapInPandas(run, kind)


def _closed(state: list) -> tuple:
    return state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]


def oracle(extra: str) -> str:
    """DuckDB SQL for the digests of ``conversations`` and the rows of the SELECT ``extra``."""
    escaped = f"replace({{}}, '{ESCAPE}', '{ESCAPE * 2}')"
    for control in CONTROLS:
        escaped = f"replace({escaped}, '{control}', '{control[0] + ESCAPE + control[1:]}')"
    per_turn = sum(len(CONTROLS[k]) for k in (OPEN, CLOSE, END))
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL {extra}),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{LEARNED_ROLE}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = '{LEARNED_ROLE}'), '')) AS loss_sha256,
  CAST({len(CONTROLS[BEGIN])} + sum({per_turn} + length({escaped.format('role')}) + length({escaped.format('text')})) AS BIGINT)
    AS formatted_chars
FROM o GROUP BY conv_id"""

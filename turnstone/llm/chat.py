"""Chat formatting with offset-aligned masks.

A turn is rendered as `<turn:` role `<text>` text `</turn>`. Inside roles and texts a backslash becomes two, and a backslash goes
after the first character of each control string, so no control string stands there and unescaping gives back what was. The three
control strings are added tokens, so a token never reaches over the edge of a text.

Conversations are rendered whole, encoded once with offsets, and the sorted spans of the assistant's texts are intersected with
the sorted token spans by binary search. A conversation of more than `segment_chars` is cut between turns, where tokens end
anyway, into several rows, so that one with very many turns needs no more memory.

Defined results: null roles and texts are empty; turns are ordered by turn, then role, then text, nulls first; repeated rows
are repeated turns; rows with a null conv_id are one conversation.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TURN, TEXT, END = "<turn:", "<text>", "</turn>"
CONTROL = (TURN, TEXT, END)
LOSS_ROLE = "assistant"
SEGMENT_CHARS = 400_000
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.DOTALL)

FORMATTED = "conv_id bigint, segment int, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"
_ARROW = pa.schema([("conv_id", pa.int64()), ("segment", pa.int32()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_()))])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for c in CONTROL:
        text = text.replace(c, f"{c[0]}\\{c[1:]}")
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str | None, str | None]], loss_role: str = LOSS_ROLE) -> tuple[str, list[tuple[int, int]]]:
    """The rendered turns, and the spans of the texts that are trained on."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role or "") + TEXT, escape(text or "")
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts.append(head + body + END)
        at += len(parts[-1])
    return "".join(parts), spans


def token_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens meet the spans. Both are sorted; the first and last token of each span are found by binary search."""
    mask = np.zeros(len(starts) + 1, np.int32)
    if spans:
        s = np.array([x for x in spans if x[1] > x[0]], np.int64).reshape(-1, 2)
        np.add.at(mask, np.searchsorted(ends, s[:, 0], "right"), 1)
        np.add.at(mask, np.searchsorted(starts, s[:, 1], "left"), -1)
    return np.cumsum(mask)[:-1] > 0


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The text under the mask, unescaped; one part for each run of tokens that touch. Tokens inside one character share its span."""
    s, e = starts[mask], ends[mask]
    if not len(s):
        return []
    first = np.flatnonzero(np.append(True, s[1:] > np.maximum.accumulate(e)[:-1]))
    return [unescape(formatted[a:b]) for a, b in zip(s[first].tolist(), np.append(e[first[1:] - 1], e[-1]).tolist())]


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn, read back from rendered text."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def format_conversations(conversations: DataFrame, tokenizer: str | None = None, loss_role: str = LOSS_ROLE, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Rendered text, token ids, token spans and loss mask of every conversation; segments of one stand in order, one after another."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        own = Tokenizer.from_file(path)
        # Special-token strings of the tokenizer's file inside texts are ordinary text; the control strings alone are marks.
        own.encode_special_tokens = True
        own.add_tokens([AddedToken(c, normalized=False) for c in CONTROL])

        def encoded(rows: list[tuple]) -> pa.RecordBatch:
            drawn = [render(turns, loss_role) for _, _, turns in rows]
            columns: list[list] = [[] for _ in range(7)]
            for (conv, segment, _), (text, spans), enc in zip(rows, drawn, own.encode_batch([t for t, _ in drawn], add_special_tokens=False)):
                offsets = np.array(enc.offsets, np.int32).reshape(-1, 2)
                for c, v in zip(columns, (conv, segment, text, np.array(enc.ids, np.int32), offsets[:, 0], offsets[:, 1], token_mask(offsets[:, 0], offsets[:, 1], spans))):
                    c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

        ready: list[tuple] = []
        ready_chars, turns, chars, segment, now, begun = 0, [], 0, 0, None, False
        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                new = begun and conv != now
                if new or chars > segment_chars:
                    ready.append((now, segment, turns))
                    ready_chars += chars
                    segment, turns, chars = 0 if new else segment + 1, [], 0
                    if ready_chars > segment_chars:
                        yield encoded(ready)
                        ready, ready_chars = [], 0
                now, begun = conv, True
                turns.append((role, text))
                chars += len(text or "") + 20
        if begun:
            ready.append((now, segment, turns))
        if ready:
            yield encoded(ready)

    dealt = conversations.select(F.col("conv_id").cast("bigint"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


def report(formatted: DataFrame) -> DataFrame:
    """The digest of each conversation, read back from the rendered text and the mask. formatted: as format_conversations returns it."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict | None = None

        def closed(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r["conv"] for r in rows], pa.int64()), pa.array([r["n"] for r in rows], pa.int64()), pa.array([r["turns"].hexdigest() for r in rows]), pa.array([r["chars"] for r in rows], pa.int64()), pa.array([r["loss"].hexdigest() for r in rows]), pa.array([r["size"] for r in rows], pa.int64())], names)

        for batch in batches:
            done: list[dict] = []
            for i in range(batch.num_rows):
                conv, segment, text = (batch.column(k)[i].as_py() for k in range(3))
                starts, ends, mask = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (3, 4, 5))
                if not segment:
                    if state:
                        done.append(state)
                    state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0}
                state["size"] += len(text)
                for role, body in parse(text):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{body}\n".encode())
                for part in masked_text(text, starts, ends, mask):
                    state["chars"] += len(part)
                    state["loss"].update(part.encode())
            if done:
                yield closed(done)
        if state:
            yield closed([state])

    return formatted.select("conv_id", "segment", "formatted", "starts", "ends", "loss").mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


#: Formatting must give back any text, its own control strings included; this conversation is formatted along with the table.
PROBE_ID, PROBE_TEXT = -7, r"\### Assistant: </turn> ok"


def with_probe(conversations: DataFrame) -> DataFrame:
    probe = conversations.sparkSession.createDataFrame([(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, LOSS_ROLE, PROBE_TEXT)], "conv_id bigint, turn bigint, role string, text string")
    return conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text").unionByName(probe)


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), e AS (
  SELECT *, length(replace(replace(replace(replace(text, '\', '\\'), '<turn:', '<\turn:'), '<text>', '<\text>'), '</turn>', '<\/turn>')) + length(replace(role, '\', '\\')) + 19 AS n FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

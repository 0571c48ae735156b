"""Chat formatting with offset-aligned loss masks.

Conversations are rendered in segments of whole turns, each segment is encoded once with offsets, and the sorted spans of
the assistant's texts are met with the sorted token spans by binary search. Markers are single tokens on both sides of
every text, so no token crosses the border of a text and a segment's tokens are those the whole conversation would have
there. Rows are dealt by ranges of (conversation, turn), so a very long conversation is rendered and encoded by many tasks;
only a digest over it, which is sequential by nature, is streamed in order by one task, a segment at a time.

Control strings inside texts and roles get a backslash behind their first character (one more if they have some already),
and lose one when they are read back.

Defined results: null texts and roles are empty; null conversation or turn numbers sort first, rows with a null
conversation form one. Equal turn numbers are ordered by role, then text; repeated rows are turns like others. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

# The template's markers, and control strings of widespread templates that texts must not carry bare.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_CONTROL = r"<(?=\\*(?:\||/?s>|</?SYS>>|/?bos>|/?eos>|/?unk>|/?pad>|start_of_turn>|end_of_turn>))|\[(?=\\*(?:/?INST\]|/?SYSTEM_PROMPT\]|/?AVAILABLE_TOOLS\]|/?TOOL_CALLS\]|/?TOOL_RESULTS\]))"
_ESCAPE = re.compile(_CONTROL)
_UNESCAPE = re.compile(rf"({_CONTROL})\\")
_READ = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)
#: Characters after which a segment ends with its turn.
SEGMENT = 1 << 16
ROLE = "assistant"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str, str]], role: str = ROLE) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the sorted spans of the role's texts in it."""
    out, spans, at = [], [], 0
    for who, text in turns:
        head, body = f"{TURN}{escape(who)}{TEXT}", escape(text)
        if who == role:
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}{END}")
        at += len(out[-1])
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(a), unescape(b)) for a, b in _READ.findall(formatted)]


def token_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """For each token whether it meets a span. offsets: (n, 2), starts and ends both ascending."""
    mask = np.zeros(len(offsets), dtype=bool)
    if len(offsets) and spans:
        s = np.array(spans)
        first, last = np.searchsorted(offsets[:, 1], s[:, 0], "right"), np.searchsorted(offsets[:, 0], s[:, 1], "left")
        for a, b, empty in zip(first, last, s[:, 0] == s[:, 1], strict=True):
            if not empty:
                mask[a:b] = True
    return mask


def spans_of(offsets: np.ndarray, mask: np.ndarray) -> list[tuple[int, int]]:
    """Characters under the mask, as sorted spans that neither meet nor overlap."""
    out: list[tuple[int, int]] = []
    for a, b in offsets[mask].tolist():
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@functools.lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (TURN, TEXT, END)])
    return t


SEGMENTS = "segment long, n_turns long, formatted string, ids array<int>, loss_mask array<boolean>, loss_spans array<struct<start:int,end:int>>"


def format_conversations(convs: DataFrame, path: str, role: str = ROLE) -> DataFrame:
    """conv_id with the columns of SEGMENTS; segments of a conversation ascend with its turns. path: the tokenizer's file."""
    ship(convs.sparkSession)
    order = ["conv_id", "turn", "role", "text"]
    rows = convs.select("conv_id", "turn", *(F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in order[2:]))
    n = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    schema = T.StructType([convs.schema["conv_id"], *T._parse_datatype_string(SEGMENTS).fields])
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(span)]

    def run(batches):
        t = _tokenizer(path)
        number = TaskContext.get().partitionId() << 32
        key, turns, size = None, [], 0
        key_type = None

        def segment():
            nonlocal turns, size, number
            text, spans = render(turns, role)
            e = t.encode(text, add_special_tokens=False)
            offsets = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
            mask = token_mask(offsets, spans)
            row = [key], [number], [len(turns)], [text], [e.ids], [mask.tolist()], [[{"start": a, "end": b} for a, b in spans_of(offsets, mask)]]
            turns, size, number = [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, [key_type, *types], strict=True)], names=schema.names)

        for batch in batches:
            key_type = batch.schema.field(0).type
            for c, who, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if turns and (c != key or size >= SEGMENT):
                    yield segment()
                key = c
                turns.append((who, text))
                size += len(text)
        if turns:
            yield segment()

    return rows.mapInArrow(run, schema)


DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"


def digests(segments: DataFrame) -> DataFrame:
    """One row per conversation: conv_id and the columns of DIGESTS, read back from the formatted text and the loss spans."""
    slim = segments.select(
        "conv_id", "segment", "formatted", "loss_spans", F.size("ids").cast("long").alias("tokens"), F.size(F.filter("loss_mask", lambda x: x)).cast("long").alias("under")
    )
    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = slim.repartition(n, "conv_id").sortWithinPartitions("conv_id", "segment")
    schema = T.StructType([segments.schema["conv_id"], *T._parse_datatype_string(DIGESTS).fields])

    def run(batches):
        state = None

        def finished():
            return [state["key"], state["turns"], state["sha"].hexdigest(), state["loss"], state["loss_sha"].hexdigest(), state["chars"], state["tokens"], state["under"]]

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            done = []
            for x in batch.to_pylist():
                if state is None or state["key"] != x["conv_id"]:
                    if state:
                        done.append(finished())
                    state = {"key": x["conv_id"], "turns": 0, "sha": hashlib.sha256(), "loss": 0, "loss_sha": hashlib.sha256(), "chars": 0, "tokens": 0, "under": 0}
                turns = read_back(x["formatted"])
                state["turns"] += len(turns)
                state["sha"].update("".join(f"{a}\n{b}\n" for a, b in turns).encode())
                for s in x["loss_spans"]:
                    text = unescape(x["formatted"][s["start"] : s["end"]])
                    state["loss"] += len(text)
                    state["loss_sha"].update(text.encode())
                state["chars"] += len(x["formatted"])
                state["tokens"] += x["tokens"]
                state["under"] += x["under"]
            if done:
                yield _batch(done, kind)
        if state:
            yield _batch([finished()], kind)

    def _batch(rows, kind):
        types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=schema.names)

    return slim.mapInArrow(run, schema)

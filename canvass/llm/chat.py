r"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as one string: each turn is OPEN role MIDDLE text CLOSE. The three marks are
added tokens, so that a token never crosses from a mark into a text. Roles and texts are escaped: a backslash becomes two,
and a backslash is put into each ``<|``, so that no mark nor special token of the vocabulary can stand in them; reading drops the added
backslashes. The string is encoded once with offsets, and the sorted spans of the learned turns are met with the sorted
token spans by binary search.

Cases: null texts and roles are empty; turns are ordered by turn, null first, then role and text; repeated turns all stay; each row
with a null conv_id is a conversation of its own; an empty table gives an empty result; further columns are ignored. A conversation is one row of
the result, and memory is bounded by the longest conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|turn|>", "<|text|>", "<|close|>"
_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(MIDDLE) + "(.*?)" + re.escape(CLOSE), re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], learned: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted string and the spans of the learned texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role) + MIDDLE, escape(text)
        parts += [head, body, CLOSE]
        if role == learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def mask_tokens(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Marks of the tokens that lie in any span. offsets: (start, end) of the tokens, ascending; spans are sorted."""
    mask = np.zeros(len(offsets), bool)
    if len(offsets) and spans:
        bounds = np.array(spans)
        first = np.searchsorted(offsets[:, 1], bounds[:, 0], "right")
        stop = np.searchsorted(offsets[:, 0], bounds[:, 1], "left")
        for a, b in zip(first.tolist(), stop.tolist(), strict=True):
            mask[a:b] = True
    return mask


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> str:
    """What stands under the mask, unescaped, each stretch of tokens once."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    cut = [formatted[offsets[a, 0] : offsets[b - 1, 1]] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
    return "".join(map(unescape, cut))


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(a), unescape(b)) for a, b in _TURN.findall(formatted)]


def load_tokenizer(definition: str):
    from tokenizers import AddedToken, Tokenizer
    from tokenizers.processors import ByteLevel

    found = Tokenizer.from_str(definition)
    found.post_processor = ByteLevel(trim_offsets=False)
    found.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (OPEN, MIDDLE, CLOSE)])
    return found


def _lists(*columns: list[np.ndarray]) -> list[pa.Array]:
    """List arrays from the flat values of each."""
    return [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x))) for x in columns]


def format_conversations(rows: DataFrame, definition: str, learned: str = "assistant") -> DataFrame:
    """rows (conv_id, turn, role, text) -> (conv_id, formatted, ids, starts, ends, mask): starts and ends are token offsets in code points."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turn = F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("turn"), empty("role"), empty("text"))
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    known = own.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    grouped = known.unionByName(own.where("conv_id is null").select("conv_id", F.array("t").alias("turns")))
    shared = rows.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = load_tokenizer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [render([(t["role"], t["text"]) for t in turns], learned) for turns in part.column(1).to_pylist()]
                found = library.encode_batch([x for x, _ in made], add_special_tokens=False)
                offsets = [np.array(x.offsets, np.int64).reshape(-1, 2) for x in found]
                masks = [mask_tokens(o, spans) for o, (_, spans) in zip(offsets, made, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x for x, _ in made], pa.string()), pa.array([x.ids for x in found], pa.list_(pa.int32())), *_lists([o[:, 0].astype(np.int32) for o in offsets], [o[:, 1].astype(np.int32) for o in offsets], masks)],
                    names=["conv_id", "formatted", "ids", "starts", "ends", "mask"],
                )

    return grouped.mapInArrow(run, "conv_id long, formatted string, ids array<int>, starts array<int>, ends array<int>, mask array<boolean>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, from the output alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(6)]
            numbers = [batch.column(i) for i in (2, 3, 4)]
            for i, (conv_id, formatted) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True)):
                turns = read_turns(formatted)
                starts, ends, mask = (x[i].values.to_numpy(zero_copy_only=False) for x in numbers)
                loss = masked_text(formatted, np.column_stack([starts, ends]).astype(np.int64).reshape(-1, 2), mask)
                whole = "".join(f"{role}\n{text}\n" for role, text in turns)
                row = (conv_id, len(turns), hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(formatted))
                for values, value in zip(out, row, strict=True):
                    values.append(value)
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "starts", "ends", "mask").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

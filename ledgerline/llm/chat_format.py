r"""Chat formatting by columnar byte assembly.

Rows of a conversation are brought together and ordered by turn; a batch is then written at once: every turn is a
header, a content and a footer whose lengths give cumulative offsets, whose offsets give scatter indices, and one
gather fills a preallocated buffer that becomes the Arrow string column. A turn reads

    <s>[INST]role\ncontent[/INST]</s>\n

Control strings (``<s> </s> [INST] [/INST]``) inside roles and contents get a backslash after their first character,
and those that already have backslashes there get one more, so removing one restores them; a role's backslashes and
line feeds are escaped too.

Results: null roles and texts are empty; turns with the same number are ordered by role, then text; repeated rows are
separate turns; the null conversation is one like any other; an empty table gives an empty result. The loss mask is a
list of code point spans of the formatted text: the contents of assistant turns. A conversation is one string by its
nature, so its turns meet in one task; nothing else does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import slices, text_bytes, tidily

OPEN, CLOSE = "<s>[INST]", "[/INST]</s>\n"
SLICE_BYTES = 2_000_000
SCHEMA = "conv_id long, n_turns long, formatted string, loss_starts array<long>, loss_ends array<long>"
_TURN = re.compile(r"<s>\[INST\](.*?)\n(.*?)\[/INST\]</s>\n", re.DOTALL)
_ESCAPED = re.compile(r"([<\[])\\(\\*/?(?:s>|INST\]))")


def escaped(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, r"([<\[])(\\*/?(?:s>|INST\]))", r"\1\\\2")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def _role_out(role: str) -> str:
    return escaped(pa.array([role]))[0].as_py().replace("\\", "\\\\").replace("\n", "\\n")


def _role_in(role: str) -> str:
    return unescaped(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def _assemble(ids: pa.Array, roles: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """One row for each run of equal ids, in order."""
    n = len(ids)
    known = roles.fill_null("").dictionary_encode()
    names = known.dictionary.to_pylist()
    which = known.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    heads = [f"{OPEN}{_role_out(r)}\n" for r in names]
    parts = [np.frombuffer(x.encode(), np.uint8) for x in [*heads, CLOSE]]
    content = escaped(texts.fill_null(""))
    body, body_at = text_bytes(content)
    fixed_len = np.array([len(x) for x in parts], np.int64)
    fixed_at = len(body) + np.cumsum(fixed_len) - fixed_len
    source = np.concatenate([body, *parts])
    lengths = np.empty((n, 3), np.int64)
    lengths[:, 0], lengths[:, 1], lengths[:, 2] = fixed_len[which], np.diff(body_at), fixed_len[-1]
    starts = np.empty((n, 3), np.int64)
    starts[:, 0], starts[:, 1], starts[:, 2] = fixed_at[which], body_at[:-1], fixed_at[-1]
    ends = np.cumsum(lengths.ravel())
    total = int(ends[-1]) if n else 0
    buffer = np.empty(total, np.uint8)
    row_end = ends[2::3]
    for a, b in slices(lengths.sum(axis=1), SLICE_BYTES):  # the indices take eight times the bytes
        lo, hi = (int(row_end[a - 1]) if a else 0), int(row_end[b - 1])
        size = lengths[a:b].ravel()
        place = np.cumsum(size) - size
        np.take(source, np.arange(hi - lo) + np.repeat(starts[a:b].ravel() - place, size), out=buffer[lo:hi])
    value, valid = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)
    new = np.ones(n, bool)
    new[1:] = (value[1:] != value[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n)
    offsets = np.concatenate([[0], row_end[last - 1]])
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(buffer)).cast(pa.string())
    chars = np.empty((n, 3), np.int64)
    chars[:, 0] = np.array([len(x) for x in heads], np.int64)[which] if n else 0
    chars[:, 1], chars[:, 2] = pc.utf8_length(content).to_numpy(zero_copy_only=False), len(CLOSE)
    at = np.cumsum(chars.ravel()).reshape(n, 3)
    base = np.repeat(np.concatenate([[0], at[last[:-1] - 1, 2]]), last - first)
    taught = which == names.index("assistant") if "assistant" in names else np.zeros(n, bool)
    counts = np.concatenate([[0], np.cumsum(taught)])
    cuts = pa.array(np.concatenate([counts[first], counts[-1:]]).astype(np.int32))
    spans = [pa.ListArray.from_arrays(cuts, pa.array((at[:, k] - base)[taught])) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array(last - first), formatted, *spans],
                                      ["conv_id", "n_turns", "formatted", "loss_starts", "loss_ends"])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # the last conversation may go on in the next batch
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = (pa.concat_tables([held, rows]) if held is not None else rows).combine_chunks()
        if rows.num_rows == 0:
            continue
        ids = rows.column("conv_id").combine_chunks()
        last = ids[-1].as_py()
        same = ids.is_null() if last is None else pc.fill_null(pc.equal(ids, last), False)
        keep = rows.num_rows - pc.sum(same.cast(pa.int64())).as_py()
        held = rows.slice(keep)
        if keep:
            yield _assemble(*(_one(rows.slice(0, keep), c) for c in ("conv_id", "role", "text")))
    if held is not None:
        yield _assemble(*(_one(held, c) for c in ("conv_id", "role", "text")))


def _one(rows: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(rows.column(name).chunks)


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_starts, loss_ends) of a frame with conv_id, turn, role and text."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn").mapInArrow(tidily(_run), SCHEMA)


def read_chats(formatted: DataFrame) -> DataFrame:
    """Read formatted conversations back: conv_id, formatted, turns (role, text) and loss_text, all unescaped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            texts = batch.column("formatted").to_pylist()
            starts, ends = batch.column("loss_starts").to_pylist(), batch.column("loss_ends").to_pylist()
            turns = [[{"role": _role_in(m[1]), "text": unescaped(m[2])} for m in _TURN.finditer(x)] for x in texts]
            loss = ["".join(unescaped(x[a:b]) for a, b in zip(s, e, strict=True)) for x, s, e in zip(texts, starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("formatted"), pa.array(turns, kind), pa.array(loss, pa.string())],
                                             ["conv_id", "formatted", "turns", "loss_text"])

    return formatted.select("conv_id", "formatted", "loss_starts", "loss_ends").mapInArrow(tidily(run), "conv_id long, formatted string, turns array<struct<role:string,text:string>>, loss_text string")

"""Chat formatting by columnar byte assembly.

The turns of a conversation become one string: for each turn a header with its role, its text and a footer. All is done
on Arrow buffers: the lengths of the segments give cumulative offsets, these give scatter indices, and headers, texts
and footers are copied into one preallocated buffer, the result column's data.

Defined results: turns are ordered by turn, role and text, nulls first; repeated rows are repeated turns; a null role
is written as "unknown", a null or empty text as nothing between header and footer; rows with a null conversation id are
one conversation with a null id; an empty table gives an empty result; other columns are passed over. Texts that hold
the markers are copied as they are. `spans` are the byte ranges of the assistant's texts in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._hashing import string_buffers

HEADER, AFTER_ROLE, FOOTER = "<|im_start|>", "\n", "<|im_end|>\n"
UNKNOWN = "unknown"
TARGET_ROLE = "assistant"
_SLICE_BYTES = 4 << 20


def _copy(out: np.ndarray, at: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
    """out[at[i] : at[i] + size[i]] = data[start[i] : start[i] + size[i]] for all i by one scatter."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    if total:
        inner = np.arange(total) - np.repeat(ends - size, size)
        out[np.repeat(at, size) + inner] = data[np.repeat(start, size) + inner]


def assemble(turn_offsets: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets by conversation, start and size of each turn's text in its conversation).

    `turn_offsets`: where each conversation's turns begin in `roles` and `texts`, and the end.
    """
    names = roles.fill_null(UNKNOWN).dictionary_encode()
    known = names.dictionary.to_pylist()
    heads = [(HEADER + r + AFTER_ROLE).encode() for r in known]
    head_data = np.frombuffer(b"".join(heads) + FOOTER.encode(), np.uint8)
    head_size = np.array([len(h) for h in heads], np.int64)
    head_start = np.cumsum(head_size) - head_size
    which = names.indices.to_numpy(zero_copy_only=False)
    data, text_offs = string_buffers(texts)
    text_size = np.diff(text_offs)
    foot = len(FOOTER.encode())
    sizes = np.stack([head_size[which] if len(which) else np.zeros(0, np.int64), text_size, np.full(len(text_size), foot, np.int64)], axis=1)
    at = np.concatenate([[0], np.cumsum(sizes.ravel())])
    out = np.empty(int(at[-1]), np.uint8)
    places = at[:-1].reshape(-1, 3)
    _copy(out, places[:, 0], head_data, head_start[which] if len(which) else np.zeros(0, np.int64), sizes[:, 0])
    _copy(out, places[:, 1], data, text_offs[:-1], text_size)
    _copy(out, places[:, 2], head_data, np.full(len(text_size), len(head_data) - foot), sizes[:, 2])
    ends = at[turn_offsets * 3]
    begin = np.repeat(ends[:-1], np.diff(turn_offsets))
    return out, ends, places[:, 1] - begin, text_size


def format_chats(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, n_turns, chat (the string) and spans of the target role's texts for each conversation."""
    id_type = turns.schema[id_col].dataType.simpleString()
    span = pa.struct([("start", pa.int32()), ("size", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lists = whole.column(1)
            size = np.cumsum(_list_bytes(lists))
            a = 0
            while a < whole.num_rows:
                before = size[a - 1] if a else 0
                b = min(max(int(np.searchsorted(size, before + _SLICE_BYTES, "right")), a + 1), whole.num_rows)
                part = lists.slice(a, b - a)
                flat = part.flatten()
                counts = part.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                offs = np.concatenate([[0], np.cumsum(counts)])
                roles = flat.field(1) if flat.offset == 0 else flat.flatten()[1]
                texts = flat.field(2) if flat.offset == 0 else flat.flatten()[2]
                roles, texts = roles.slice(0, len(flat)), texts.slice(0, len(flat))
                out, ends, start, length = assemble(offs, roles, texts)
                chat = pa.Array.from_buffers(pa.string(), b - a, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(out)])
                mine = np.asarray(pa.compute.equal(roles.fill_null(UNKNOWN), TARGET_ROLE))
                spans = pa.StructArray.from_arrays([pa.array(start[mine].astype(np.int32)), pa.array(length[mine].astype(np.int32))], fields=list(span))
                span_offs = np.concatenate([[0], np.cumsum(mine)])[offs].astype(np.int32)
                yield pa.RecordBatch.from_arrays([whole.column(0).slice(a, b - a), pa.array(counts.astype(np.int32)), chat, pa.ListArray.from_arrays(pa.array(span_offs), spans)], ["conv_id", "n_turns", "chat", "spans"])
                a = b

    turn = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    gathered = turns.select(F.col(id_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return gathered.mapInArrow(run, f"conv_id {id_type}, n_turns int, chat string, spans array<struct<start: int, size: int>>")


def _list_bytes(lists: pa.ListArray) -> np.ndarray:
    """Bytes of text in each list of turns."""
    flat = lists.flatten()
    texts = flat.flatten()[2]
    _, offs = string_buffers(texts)
    counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.diff(offs[np.concatenate([[0], np.cumsum(counts)])])


def query(spark, sf_dir: str) -> DataFrame:
    out = format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.select("conv_id", "n_turns", "chat", F.size("spans").alias("n_spans"))


ORACLE = """SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns,
  string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS chat,
  CAST(count(*) FILTER (WHERE role = 'assistant') AS INTEGER) AS n_spans
FROM conversations GROUP BY conv_id"""
QUERY = ("op6_chat_format", query)

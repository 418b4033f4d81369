"""Op 5, chat formatting by columnar byte assembly.

A turn is written as `### <role>: <text></turn>` and a line feed. Inside texts and roles a backslash becomes
two, `###` becomes backslash h, `</turn>` backslash e; in roles a colon also becomes backslash c and a line
feed backslash n. So no text can forge a header or an end, and reading back undoes it exactly. The loss mask
covers the (escaped) texts of assistant turns, without header and end.

For each slice of about `piece_bytes` of text the lengths of all segments, their running sum and the place of every byte are computed in
numpy, and headers and texts are copied into one preallocated buffer, which becomes the Arrow column: short segments by scatter
indices, long ones as they are, so that indices stay few. A slice holds one turn at least.

Turns are dealt by ranges of (conversation, turn), so a conversation that holds many of all turns is spread over tasks, and sorted by
(turn, role, text), nulls first. A piece is what a conversation has in one slice; pieces are numbered in their order (with gaps), so its formatted text is that
of its pieces put together, however they are stored. Null texts and roles count as empty; a null
conversation id is one conversation. Repeated rows are turns like others. Empty table: no rows. Other columns
are ignored. read_back() follows a conversation's pieces in order: a digest of the whole is one task's, but never holds more than a piece.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, table

ESCAPES = (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\e"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"), ("\n", "\\n"))
BACK = {"\\": "\\", "h": "###", "e": "</turn>", "c": ":", "n": "\n"}
HEAD, MIDDLE, END = b"### ", b": ", b"</turn>\n"
TURN = re.compile(r"### (.*?): (.*?)</turn>\n", re.S)
PIECE = "conv_id long, piece long, n_turns long, formatted string, mask array<struct<start: long, length: long>>"


def escape(column: pa.Array, pairs=ESCAPES) -> pa.Array:
    column = pc.fill_null(column, "")
    for old, new in pairs:
        column = pc.replace_substring(column, old, new)
    return column


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: BACK[m[1]], text, flags=re.S) if "\\" in text else text


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(column.buffers()[2], np.uint8) if at[-1] else np.zeros(0, np.uint8)), at


#: Longer segments are copied as they are.
LONG = 1 << 14


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buffer of all turns; where each of a turn's five segments starts in it, and how many code points come before each of them, in all (one more at the end)."""
    roles, texts = utf8(escape(roles, ROLE_ESCAPES)), utf8(escape(texts))
    n = len(roles[1]) - 1
    lengths = np.empty((n, 5), np.int64)
    lengths[:] = len(HEAD), 0, len(MIDDLE), 0, len(END)
    lengths[:, 1], lengths[:, 3] = np.diff(roles[1]), np.diff(texts[1])
    to = np.concatenate(([0], np.cumsum(lengths)))  # of every segment, and the end
    out = np.empty(to[-1], np.uint8)
    starts = to[:-1].reshape(n, 5)
    for k, fixed in ((0, HEAD), (2, MIDDLE), (4, END)):
        out[starts[:, k, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    for k, (data, at) in ((1, roles), (3, texts)):
        size, begin = lengths[:, k], at[:-1]
        for i in np.flatnonzero(size > LONG).tolist():
            out[starts[i, k] : starts[i, k] + size[i]] = data[begin[i] : begin[i] + size[i]]
        size = np.where(size > LONG, 0, size)
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(starts[:, k], size) + inside] = data[np.repeat(begin, size) + inside]
    # code points of each segment: its bytes that don't go on one
    points = np.add.reduceat(np.append((out & 0xC0) != 0x80, False).astype(np.int8), to[:-1], dtype=np.int64) * (lengths.ravel() > 0) if n else np.zeros(0, np.int64)
    return out, to, np.concatenate(([0], np.cumsum(points)))


def format_chat(turns: DataFrame, piece_bytes: int = 1 << 20, parts: int | None = None) -> DataFrame:
    """Rows (conv_id, piece, n_turns, formatted, mask) from turns(conv_id, turn, role, text); mask: spans of code points in the piece. parts: ranges of turns."""

    def run(batches):
        piece = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in pieces(iter([whole]), most=piece_bytes):
                conv = batch.column("conv_id").to_pylist()
                out, to, points = assemble(batch.column("role"), batch.column("text"))
                trained = pc.fill_null(pc.equal(batch.column("role"), "assistant"), False).to_numpy(zero_copy_only=False)
                cuts = np.array([0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1]), len(conv)])
                own = np.flatnonzero(trained)
                first = cuts[np.searchsorted(cuts, own, "right") - 1]  # of the piece that each trained turn is in
                spans = pa.StructArray.from_arrays([pa.array(points[own * 5 + 3] - points[first * 5]), pa.array(points[own * 5 + 4] - points[own * 5 + 3])], ["start", "length"])
                masks = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, cuts).astype(np.int32)), spans)
                formatted = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(to[cuts * 5]), pa.py_buffer(out)).cast(pa.string())
                numbers = piece + np.arange(len(cuts) - 1)
                piece += len(cuts) - 1
                yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(pa.array(cuts[:-1])), pa.array(numbers), pa.array(np.diff(cuts)), formatted, masks], ["conv_id", "piece", "n_turns", "formatted", "mask"])

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    parts = parts or int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, "conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, PIECE)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from the pieces that format_chat wrote, wherever they are."""

    def run(batches):
        conv, held = None, None

        def row():
            return [conv, held[0], held[1].hexdigest(), held[2], held[3].hexdigest(), held[4]]

        for batch in batches:
            done = []
            for i in range(batch.num_rows):
                own, text = batch.column("conv_id")[i].as_py(), batch.column("formatted")[i].as_py()
                if held is None or own != conv:
                    if held:
                        done.append(row())
                    conv, held = own, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for m in TURN.finditer(text):
                    held[0] += 1
                    held[1].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                for span in batch.column("mask")[i].as_py():
                    said = unescape(text[span["start"] : span["start"] + span["length"]])
                    held[2] += len(said)
                    held[3].update(said.encode())
                held[4] += len(text)
            yield as_batch(done)
        yield as_batch([row()] if held else [])

    def as_batch(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "piece").select("conv_id", "formatted", "mask").mapInArrow(run, DIGEST)


def query(spark, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return read_back(format_chat(turns))

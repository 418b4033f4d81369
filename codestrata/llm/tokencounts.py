"""Op 4, token counts: documents are encoded whole, once; tokens are attributed to sections by their spans.

Sections of a text are its lines (with the line feed that ends them), given by byte and by character. Token spans come from the
running sum of the tokens' bytes, so no text is encoded twice; a token may begin or end inside a character, which lies in one section whole. A token that crosses from one section to the next is
allocated by `rule`: 'first' (default) gives it to the section of its first byte, 'last' to that of its last
byte, 'most' to the section with most of its bytes (ties to the earlier).

Null or empty text: one empty section without tokens. Empty table: no rows. Repeated rows: each row gives its
own sections. A null id stays null. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import pieces, table

SCHEMA = "doc_id long, section int, start_byte long, end_byte long, start_char long, end_char long, n_tokens long, n_crossing long, doc_tokens long"


class Encoder:
    """A byte-level tokenizer from a file of ranks, with each token's length in bytes."""

    _held: dict = {}

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.length[i] = len(token)

    @classmethod
    def of(cls, path: str, pattern: str) -> Encoder:
        if (path, pattern) not in cls._held:
            cls._held[path, pattern] = cls(path, pattern)
        return cls._held[path, pattern]

    def ends(self, text: str) -> np.ndarray:
        """The byte at which each token of text ends."""
        return np.cumsum(self.length[np.asarray(self.encoding.encode_ordinary(text), np.int64)]) if text else np.zeros(0, np.int64)


def section_ends(data: bytes) -> np.ndarray:
    cuts = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return cuts if len(cuts) and cuts[-1] == len(data) else np.append(cuts, len(data))


def characters(data: bytes, cuts: np.ndarray) -> np.ndarray:
    """How many characters end by each cut."""
    first = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    return np.concatenate(([0], np.cumsum(first, dtype=np.int64)))[cuts]


def attribute(token_ends: np.ndarray, cuts: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them reach beyond one section."""
    starts = np.concatenate(([0], token_ends[:-1])) if len(token_ends) else token_ends
    first, last = np.searchsorted(cuts, starts, "right"), np.searchsorted(cuts, token_ends - 1, "right")
    crossing = np.flatnonzero(first != last)
    if rule == "last":
        to = last
    elif rule == "most":
        to = first.copy()
        for i in crossing:
            edges = np.clip(np.concatenate(([starts[i]], cuts[first[i] : last[i]], [token_ends[i]])), starts[i], token_ends[i])
            to[i] = first[i] + int(np.argmax(np.diff(edges)))
    else:
        to = first
    return np.bincount(to, minlength=len(cuts)), np.bincount(to[crossing], minlength=len(cuts))


def count_tokens(docs: DataFrame, path: str, pattern: str, rule: str = "first") -> DataFrame:
    """A row for each section of each row of docs(doc_id, text)."""

    def run(batches):
        encoder = Encoder.of(path, pattern)
        for batch in pieces(batches):
            ids, parts = batch.column("doc_id").to_pylist(), []
            for i, text in zip(ids, batch.column("text").to_pylist(), strict=True):
                text = text or ""
                data = text.encode()
                cuts = section_ends(data)
                ends = encoder.ends(text)
                parts.append((i, cuts, *attribute(ends, cuts, rule), len(ends), characters(data, cuts)))
            each = [len(p[1]) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), each))),
                    pa.array(np.concatenate([np.arange(n) for n in each]), pa.int32()),
                    pa.array(np.concatenate([np.concatenate(([0], p[1][:-1])) for p in parts]), pa.int64()),
                    pa.array(np.concatenate([p[1] for p in parts]), pa.int64()),
                    pa.array(np.concatenate([np.concatenate(([0], p[5][:-1])) for p in parts]), pa.int64()),
                    pa.array(np.concatenate([p[5] for p in parts]), pa.int64()),
                    pa.array(np.concatenate([p[2] for p in parts]), pa.int64()),
                    pa.array(np.concatenate([p[3] for p in parts]), pa.int64()),
                    pa.array(np.repeat([p[4] for p in parts], each), pa.int64()),
                ],
                ["doc_id", "section", "start_byte", "end_byte", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

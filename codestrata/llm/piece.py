"""Op 6, SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

Merging the best pair again and again gives the only sequence of pieces in which every two neighbours are
compatible: merging the characters of both together gives back just these two. So a text is read from left
to right: the longest piece at each place (found by Aho-Corasick, which goes on from place to place while the longest
ones fit) is tried, then shorter ones, as long as it fits its left neighbour; if none fits, the neighbour is taken back
and its place noted in a bitfield as failed. Compatibility is found by merging the two pieces' characters once, and
remembered.

A blank becomes U+2581 and one is put in front. No piece of the model has U+2581 after another character, so
merges never cross from a word to the next blank; nor do they cross between two characters that stand side by side
in no piece. Characters are sorted into kinds (letters of a script, marks, ...) such that no piece has two kinds; each
stretch of blanks and characters of one kind is encoded once and remembered (bounded store). Characters outside the
vocabulary become their UTF-8 bytes.

Null and empty texts give no ids and decode to the empty text. Texts are encoded whole, whatever their length.
Empty table: no rows; repeated rows: one result each. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterable
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces, table

BLANK = "▁"
KEEP = 100_000
KINDS = 8
WINDOW = 1 << 18


class PieceModel:
    _held: dict[str, PieceModel] = {}

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.id_of, self.score, self.byte_id, self.bytes_of = {}, {}, [0] * 256, []
        kinds = proto.ModelProto.SentencePiece
        for i, p in enumerate(model.pieces):
            out = p.piece.replace(BLANK, " ").encode()
            if p.type == kinds.BYTE:
                self.byte_id[(b := int(p.piece[3:5], 16))] = i
                out = bytes([b])
            elif p.type == kinds.NORMAL:
                self.id_of[p.piece], self.score[p.piece] = i, p.score
            elif p.type == kinds.UNKNOWN:
                out = " ⁇ ".encode()
            elif p.type == kinds.CONTROL:
                out = b""
            self.bytes_of.append(out)
        if any(BLANK in p.lstrip(BLANK) for p in self.id_of):
            raise ValueError("a piece has a blank after another character: words can't be encoded on their own")
        if model.normalizer_spec.name not in ("", "identity") or model.normalizer_spec.remove_extra_whitespaces or not model.normalizer_spec.add_dummy_prefix:
            raise ValueError("only models without text normalisation and with a blank in front are supported")
        self.stretches = re.compile(stretches(self.id_of))
        self.fits: dict[int, int] = {}
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.pieces: set[str] = set()
        self.spine: dict[str, tuple[list, list]] = {}
        for p in sorted(self.id_of, key=len):
            self.add(p)
        self.chars = {p for p in self.pieces if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p in self.pieces:
            self.automaton.add_word(p, self.id_of[p])
        self.automaton.make_automaton()
        self.most = max(map(len, self.pieces))
        self.span = 4 * self.most
        self.text_of = {self.id_of[p]: p for p in self.pieces}
        self.length = [len(self.text_of.get(i, "")) for i in range(len(model.pieces))]
        self.shorter = [-1] * len(model.pieces)  # the longest piece that a piece begins with, itself apart
        for p in self.pieces:
            self.shorter[self.id_of[p]] = next((self.id_of[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.pieces), -1)

    @classmethod
    def of(cls, path: str) -> PieceModel:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def add(self, p: str) -> None:
        """Takes p among the pieces if merging makes it whole, with its merges along either edge, the last first: (part at that edge, score at which it goes into a larger one)."""
        if len(p) == 1:
            self.pieces.add(p)
            self.spine[p] = [(p, None)], [(p, None)]
            return
        if self.merge(p) != [p]:
            return
        a, b = self.merge_but_last(p)
        if any(len(x) > 1 and self.score[x] <= self.score[p] for x in (a, b)) and p.strip(BLANK):
            raise ValueError("a piece is merged before its parts: scores aren't in the order of merges")
        self.pieces.add(p)
        own = self.score[p]
        self.spine[p] = tuple([(p, None), *((x, own if s is None else s) for x, s in self.spine[part][k])] for k, part in enumerate((a, b)))

    def merge_but_last(self, p: str) -> tuple[str, str]:
        parts: list[str] = []
        self.merge(p, parts)
        return parts[-2], parts[-1]

    def merge(self, text: str, parts: list | None = None) -> list[str]:
        """Merges the neighbours whose joint piece scores best, the leftmost of equals, until none are left."""
        part, left, right = list(text), list(range(-1, len(text) - 1)), [*range(1, len(text)), -1]
        heap: list = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (joint := part[a] + part[b]) in self.score:
                heapq.heappush(heap, (-self.score[joint], a, b, joint))

        for i in range(len(text) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, joint = heapq.heappop(heap)
            if part[a] and part[b] and right[a] == b and part[a] + part[b] == joint:
                if parts is not None:
                    parts += part[a], part[b]
                part[a], part[b], right[a] = joint, "", right[b]
                if right[b] >= 0:
                    left[right[b]] = a
                offer(left[a], a)
                offer(a, right[a])
        return [p for p in part if p]

    def fitting(self, a: int, b: int) -> int:
        """The longest of b and the pieces it begins with that can stand right of a (-1: the text's beginning): merging the characters of both together gives them back. -1 if none can."""
        if a < 0 or b < 0:
            return b
        if (found := self.fits.get(a << 20 | b)) is None:
            found = b if self.remerge(self.text_of[a], self.text_of[b]) else self.fitting(a, self.shorter[b])
            if len(self.fits) > 4 * KEEP:
                self.fits.clear()
            self.fits[a << 20 | b] = found
        return found

    def remerge(self, a: str, b: str) -> bool:
        """
        Merges both pieces again from their characters, with an eye on the seam only. What stands left of it is in
        turn each part along a's right edge, what stands right of it each part along b's left edge; a part stands
        until its own merge comes (scores fall from merge to merge). Two parts that stand at the seam at once merge
        across it if their joint piece scores better than both merges that would end them; of equal scores the
        leftmost goes first, which is a's before the seam's before b's.
        """
        left, right = self.spine[a][1], self.spine[b][0]
        i, j = len(left) - 1, len(right) - 1
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            joint = self.score.get(x + y)
            if joint is not None and (x_ends is None or joint > x_ends) and (y_ends is None or joint >= y_ends):
                return False
            if x_ends is None and y_ends is None:
                return True
            if y_ends is None or x_ends is not None and x_ends >= y_ends:
                i -= 1
            else:
                j -= 1

    def split(self, text: str) -> list[int]:
        """The pieces of a text whose characters are all in the vocabulary."""
        n = len(text)
        failed = bytearray(n // 8 + 1)
        length, shorter, known, matches, span, most = self.length, self.shorter, self.fits, self.automaton.iter_long, self.span, self.most
        done: list[int] = []
        at, last, sure, ahead = 0, -1, -1, -1  # up to `sure` matches are whole; the next one is that at `ahead`
        new = True
        while at < n:
            if new:
                if at != ahead or at > sure:
                    longest, base, ahead = matches(text[at : at + span]), at, at
                    sure = at + span - most if at + span < n else n
                end, trial = next(longest)
                ahead = base + end + 1
            if (fit := known.get(last << 20 | trial)) is None:
                fit = self.fitting(last, trial)
            if fit < 0:  # nothing fits here: the piece before goes, and must be a shorter one
                failed[at >> 3] |= 1 << (at & 7)
                at -= length[last]
                trial = shorter[last]
                last = done.pop()
                new = False
                continue
            end = at + length[fit]
            if new := not failed[end >> 3] >> (end & 7) & 1:
                done.append(last)
                at, last = end, fit
            else:
                trial = shorter[fit]
        return [*done[1:], last] if n else done

    def stretch(self, text: str) -> bytes:
        """Ids (as int32 bytes) of blanks and the characters of one kind that follow them."""
        if (found := self.known.get(text)) is not None:
            return found
        if (found := self.before.get(text)) is None:
            if text[1:2] == BLANK:  # runs of blanks have pieces of equal score: merged as they stand
                ids = [i for p in self.merge(text) for i in ([self.id_of[p]] if p in self.id_of else self.spelled(p))]
            elif self.chars.issuperset(text):
                ids = self.split(text)
            else:
                ids, start = [], 0
                for i, c in enumerate(text):
                    if c not in self.chars:
                        ids += self.split(text[start:i]) + self.spelled(c)
                        start = i + 1
                ids += self.split(text[start:])
            found = array("i", ids).tobytes()
        if len(text) <= 64:
            if len(self.known) > KEEP:  # what was used lately stays
                self.before, self.known = self.known, {}
            self.known[text] = found
        return found

    def spelled(self, c: str) -> list[int]:
        return [self.byte_id[b] for b in c.encode()]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        text = BLANK + text.replace(" ", BLANK)
        at, window, out = 0, WINDOW, []
        while at < len(text):
            parts = self.stretches.findall(text, at, at + window)
            if at + window >= len(text):
                at = len(text)
            elif len(parts) > 1:  # the last one may go on beyond the window
                at += window - len(parts.pop())
            else:
                window *= 2
                continue
            ids = list(map(self.known.get, parts))
            i = -1
            for _ in range(ids.count(None)):
                i = ids.index(None, i + 1)
                ids[i] = self.stretch(parts[i])
            out.append(b"".join(ids))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids) -> str:
        out = b"".join(map(self.bytes_of.__getitem__, ids))
        return (out[1:] if out[:1] == b" " and len(ids) and self.bytes_of[ids[0]][:1] == b" " else out).decode("utf-8", "replace")


def stretches(of: Iterable[str]) -> str:
    """
    A pattern for blanks with the characters of one kind behind them. Two characters that stand side by side in a piece
    are of one kind, blanks apart; a character that never does is a kind of its own. Beyond the largest kinds the others count as one.
    """
    kind: dict[str, str] = {}

    def first(c: str) -> str:
        while kind.setdefault(c, c) != c:
            kind[c] = c = kind[kind[c]]
        return c

    for p in of:
        p = p.lstrip(BLANK)
        for a, b in pairwise(p):
            kind[first(a)] = first(b)
    kinds: dict[str, list[str]] = {}
    for c in sorted(kind):
        kinds.setdefault(first(c), []).append(c)
    sets = sorted(kinds.values(), key=lambda x: (-len(x), x))
    sets = [*sets[:KINDS], *([sum(sets[KINDS:], [])] if sets[KINDS:] else [])]
    return f"{BLANK}*(?:{''.join(f'[{re.escape("".join(x))}]+|' for x in sets)}[^{BLANK}])|{BLANK}+"


ENCODED, DECODED = "doc_id long, ids array<int>", "doc_id long, ids array<int>, text string"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
CODEC = "doc_id long, ids array<int>, n_tokens long, round_trip boolean"


def lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def rows_of(column: pa.Array) -> list[list[int]]:
    values, at = column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))))
    return [values[a:b].tolist() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


# Each of these turns batches into batches, so that a chain of them runs in one Python worker with one model.


def encoding(path: str):
    def run(batches):
        model = PieceModel.of(path)
        for batch in pieces(batches):
            ids = [model.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists(ids)], ["doc_id", "ids"])

    return run


def decoding(path: str):
    def run(batches):
        model = PieceModel.of(path)
        for whole in batches:
            for batch in (whole.slice(a, 256) for a in range(0, whole.num_rows, 256)):
                texts = [model.decode(x) for x in rows_of(batch.column("ids"))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return run


def digesting(path: str):
    def run(batches):
        decimal = [str(i).encode() for i in range(len(PieceModel.of(path).bytes_of))]
        for batch in batches:
            rows = rows_of(batch.column("ids"))
            ids = [hashlib.sha256(b",".join(map(decimal.__getitem__, x))).hexdigest() for x in rows]
            texts = [hashlib.sha256(t.encode()).hexdigest() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in rows], pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) for each row of docs(doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(encoding(path), ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text) for each row of encoded(doc_id, ids)."""
    return encoded.select("doc_id", "ids").mapInArrow(decoding(path), DECODED)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Encodes, decodes what was encoded, and gives digests of both."""
    return docs.select("doc_id", "text").mapInArrow(lambda b: digesting(path)(decoding(path)(encoding(path)(b))), DIGEST)


def codec(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) for each row of docs(doc_id, text); round_trip: decoding gives the text back."""

    def run(batches):
        model = PieceModel.of(path)
        for batch in pieces(batches):
            texts = batch.column("text").to_pylist()
            ids = [model.encode(t or "") for t in texts]
            same = [model.decode(x.tolist()) == (t or "") for x, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists(ids), pa.array([len(x) for x in ids], pa.int64()), pa.array(same)], ["doc_id", "ids", "n_tokens", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, CODEC)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

"""Operator 8: SentencePiece encoding and decoding by streaming Viterbi.

Spaces become U+2581, one is put before the text, and the pieces of a model
file are chosen so that the sum of their scores is largest (ties: the longer
last piece). The decoder keeps a window bounded by the longest piece: once all
paths that can still survive pass through one boundary, the ids up to there
are committed and forgotten. Characters without a piece become byte pieces.

Between two characters that no piece of the model holds side by side (a letter
and the U+2581 after it, say) every path has a boundary; the segments between
such places go through the decoder one by one, and what it gives for a short
one is remembered while it keeps coming. Decoding gives back every text (U+2581 itself comes back as
a space).

Scores are those of the file. Of a file trained by merges, they are ranks, and
the ids differ from those of the merge procedure, which isn't a shortest path.
The space put before the text and the lack of any other normalisation are
fixed here, not read from the file. Null and empty texts have no ids; very
long ones are encoded whole, in a window that doesn't grow; repeated rows are
encoded alike; an empty table gives an empty result; columns that are named
like the results are replaced, others stay.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import chunks, flat
from .tokenfiles import gather

SPACE = "▁"
#: Segments that a Python worker remembers in each of two generations.
REMEMBERED = 200_000
#: Text bytes encoded at once; the ids of a text take several times its bytes.
PASS_BYTES = 1 << 20
_models: dict[str, Pieces] = {}


class Pieces:
    """The pieces of a model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.scores: dict[str, tuple[float, int]] = {}
        self.bytes: dict[int, int] = {}
        #: What each id stands for.
        self.text = [b""] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.text[i] = bytes([int(piece[1:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.scores[piece] = (sp.get_score(i), i)
                self.text[i] = piece.replace(SPACE, " ").encode()
        self.unknown = sp.unk_id()
        self.longest = max(map(len, self.scores))
        #: The ends of all pieces; those that are no pieces themselves are never the best choice.
        self.ends = {p[k:]: (-math.inf, -1) for p in self.scores for k in range(1, len(p))} | self.scores
        #: An unknown character costs more than any piece.
        self.penalty = min(s for s, _ in self.scores.values()) - 10.0
        # byte pairs that no piece holds: every path has a boundary between them
        self.cuts = np.ones((256, 256), bool)
        self.cuts[128:, :] = self.cuts[:, 128:] = False
        for piece in self.scores:
            for a, b in zip(piece, piece[1:]):
                a, b = ord(a.replace(SPACE, " ")), ord(b.replace(SPACE, " "))
                if a < 128 and b < 128:
                    self.cuts[a, b] = False
        # a space before or after a character beyond ASCII
        wide = [(a, b) for p in self.scores for a, b in zip(p, p[1:]) if ord(a) > 127 or ord(b) > 127]
        if not any(b == SPACE and a != SPACE for a, b in wide):
            self.cuts[128:, 0x20] = True
        #: Ids of segments: those met lately, and the generation before.
        self.known: tuple[dict[bytes, bytes], dict[bytes, bytes]] = ({}, {})
        self.decoder = StreamingViterbi(self)

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in _models:
            _models[path] = cls(path)
        return _models[path]

    def spelled(self, char: str) -> list[int]:
        return [self.bytes.get(b, self.unknown) for b in char.encode()] if self.bytes else [self.unknown]


class StreamingViterbi:
    """feed() characters, get committed ids; finish() gives the rest.

    The window holds the characters since the last commit. At each of its
    boundaries it keeps the best score, and the length and id of the best
    path's last piece (-1: a character spelled in bytes). Once the paths of all
    boundaries where a later piece can still begin share a boundary, what lies
    before it is committed.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.base = 0  # characters committed
        self.peak = 0  # the longest window so far
        self._start(0.0)

    def _start(self, score: float) -> None:
        self.chars = ""
        self.score, self.size, self.ident = [score], [0], [0]

    def feed(self, chars: str) -> list[int]:
        longest, out = self.pieces.longest, []
        for at in range(0, len(chars), longest):
            self._extend(chars[at : at + longest])
            if len(self.chars) > longest:
                out += self._settled()
        return out

    def _extend(self, chars: str) -> None:
        get, penalty, longest = self.pieces.ends.get, self.pieces.penalty, self.pieces.longest
        score, size, ident = self.score, self.size, self.ident
        t, text = len(self.chars), self.chars + chars
        for t in range(t + 1, len(text) + 1):
            top, length, best = score[t - 1] + penalty, 1, -1
            for i in range(t - 1, t - longest - 1 if t > longest else -1, -1):
                hit = get(text[i:t])
                if hit is None:  # nothing longer ends a piece either
                    break
                s = score[i] + hit[0]
                if s >= top:
                    top, length, best = s, t - i, hit[1]
            score.append(top)
            size.append(length)
            ident.append(best)
        self.chars = text
        self.peak = max(self.peak, len(text))

    def _settled(self) -> list[int]:
        """Commits up to the boundary where all paths that can still go on have met."""
        n, size = len(self.chars), self.size
        low = n + 1 - self.pieces.longest
        live = set(range(max(0, low), n + 1))
        p = n
        while len(live) > 1:
            if p in live:
                live.remove(p)
                live.add(p - size[p])
            p -= 1
        met = live.pop()
        if not met:
            return []
        ids = self._path(met)
        self.chars = self.chars[met:]
        self.score, self.size, self.ident = self.score[met:], size[met:], self.ident[met:]
        self.base += met
        return ids

    def _path(self, p: int) -> list[int]:
        """Ids from the window's start to boundary p."""
        out: list[int] = []
        while p > 0:
            if self.ident[p] >= 0:
                out.append(self.ident[p])
            else:
                out += reversed(self.pieces.spelled(self.chars[p - 1]))
            p -= self.size[p]
        out.reverse()
        return out

    def finish(self) -> list[int]:
        ids = self._path(len(self.chars))
        self.base += len(self.chars)
        self._start(0.0)
        return ids


def whole_viterbi(pieces: Pieces, text: str) -> list[int]:
    """The same choice with the whole lattice in memory; for tests."""
    best = [(0.0, 0, 0)]
    for t in range(1, len(text) + 1):
        top, size, ident = best[t - 1][0] + pieces.penalty, 1, -1
        for k in range(1, min(pieces.longest, t) + 1):
            hit = pieces.scores.get(text[t - k : t])
            if hit is not None and best[t - k][0] + hit[0] >= top:
                top, size, ident = best[t - k][0] + hit[0], k, hit[1]
        best.append((top, size, ident))
    out: list[list[int]] = []
    p = len(text)
    while p:
        _, size, ident = best[p]
        out.append([ident] if ident >= 0 else pieces.spelled(text[p - size : p]))
        p -= size
    return [i for part in reversed(out) for i in part]


def prepared(text: str) -> str:
    return (" " + text).replace(" ", SPACE) if text else ""


def encode_text(pieces: Pieces, text: str) -> list[int]:
    decoder = StreamingViterbi(pieces)
    return decoder.feed(prepared(text)) + decoder.finish()


def decode_ids(pieces: Pieces, ids: list[int]) -> str:
    return b"".join(pieces.text[i] for i in ids).decode(errors="replace").removeprefix(" ")


def _segments(pieces: Pieces, column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The prepared bytes (with spaces), the segments that are encoded alone, and their number in each document."""
    column = pc.replace_substring(column.cast(pa.large_string()).fill_null(""), SPACE, " ")
    column = pc.if_else(pc.equal(pc.binary_length(column), 0), column, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())))
    data, offs = flat(column)
    first = np.zeros(len(data), bool)
    if len(data):
        first[1:] = pieces.cuts[data[:-1], data[1:]]
    first[offs[:-1][offs[:-1] < len(data)]] = True
    start = np.flatnonzero(first)
    values = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return data, values, np.diff(np.searchsorted(start, offs))


def encode_column(pieces: Pieces, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all documents, the number of each, and the prepared bytes."""
    data, values, counts = _segments(pieces, column)
    coded = values.dictionary_encode()
    if len(pieces.known[0]) > REMEMBERED:
        pieces.known = ({}, pieces.known[0])
    (known, older), decoder = pieces.known, pieces.decoder
    blobs = []
    for v in coded.dictionary.to_pylist():
        blob = known.get(v)
        if blob is None:
            blob = older.get(v)
            if blob is None:
                blob = array("i", decoder.feed(v.decode().replace(" ", SPACE)) + decoder.finish()).tobytes()
            if len(v) < 200:
                known[v] = blob
        blobs.append(blob)
    ids, sizes = gather(blobs, np.dtype("<i4"), coded.indices.to_numpy(zero_copy_only=False), counts, None)
    return ids, sizes, data


def decode_column(pieces: Pieces, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The texts of documents of `sizes` ids."""
    body = np.frombuffer(b"".join(pieces.text), np.uint8)
    length = np.array([len(t) for t in pieces.text], np.int64)
    start = np.cumsum(length) - length
    runs = length[ids]
    before = np.concatenate([[0], np.cumsum(runs)])
    data = body[np.repeat(start[ids] - before[:-1], runs) + np.arange(before[-1])]
    edges = before[np.concatenate([[0], np.cumsum(sizes)])]
    texts = [data[a:b].tobytes().decode(errors="replace").removeprefix(" ") for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    return pa.array(texts, pa.string())


def encoded(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """The rows of docs with their ids (array of int); null texts have none.

    With decoded_col also the text that the ids decode to, in the same pass.
    Columns of docs with these names are replaced.
    """
    docs = docs.drop(*[c for c in (ids_col, decoded_col) if c and c != text_col])
    place = docs.columns.index(text_col)
    more = [F.array().cast("array<int>").alias(ids_col)] + ([F.lit("").alias(decoded_col)] if decoded_col else [])
    kind = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *more).schema

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model)
        for batch in batches:
            _, offs = flat(batch.column(place))
            for i, j in chunks(offs, PASS_BYTES):
                part = batch.slice(i, j - i)
                ids, sizes, _ = encode_column(pieces, part.column(place))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids, pa.int32()))
                columns, names = [*part.columns, lists], [*batch.schema.names, ids_col]
                if decoded_col:
                    columns, names = [*columns, decode_column(pieces, ids, sizes)], [*names, decoded_col]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(encode, kind)


def decoded(df: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The rows of df with the text of their ids; a column of that name is replaced."""
    df = df.drop(text_col)
    place = df.columns.index(ids_col)
    kind = df.select(*[F.col(f"`{c}`") for c in df.columns], F.lit("").alias(text_col)).schema

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model)
        for batch in batches:
            if batch.num_rows:
                lists = batch.column(place).fill_null([])
                sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, decode_column(pieces, lists.flatten().to_numpy(zero_copy_only=False), sizes)], names=[*batch.schema.names, text_col])

    return df.mapInArrow(decode, kind)


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())

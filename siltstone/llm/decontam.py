"""Operator 1: benchmark decontamination with an FM-index per training shard.

Each task cuts its documents into shards of a few million words. Over a
shard's word ids it builds a suffix array, the Burrows-Wheeler transform, a
wavelet matrix that answers rank queries on it, and a sample of the suffix
positions. All test phrases are searched at once, backwards, one word a step;
what is found is located by walking to the next sampled position, and the
occurrences merge into removal spans.

Phrases come from the benchmark in blocks of a bounded size. A benchmark of one
block is one pass over the documents. With more, each block is a job of its own
that writes the spans of the texts it hits, and a last pass unites the spans of
all blocks, always on the uncut texts; so what is sent to the tasks and what a
worker holds never grow with the benchmark, and the answer doesn't depend on
the size of a block.

Null and empty texts have no words and are never contaminated; repeated rows
are judged alike; an empty benchmark leaves everything clean; a document longer
than a shard is a shard of its own. Items without an id are searched like
others (their words are hit), but are listed nowhere; items without words find
nothing. Only the named columns are read; further ones stay as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fresh_names, text_columns, written
from .text import ALNUM_WORD, ASCII_LOWER, ASCII_UPPER, IS_ALNUM, Words, chunks, flat

#: Text bytes of a shard, and of benchmark text searched in one pass.
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 4 << 20
#: Every so many text positions keep their place in the suffix array.
SAMPLE = 8

_LOWER = str.maketrans(ASCII_UPPER, ASCII_LOWER)
_WORD = re.compile(ALNUM_WORD)


def item_windows(text: str | None, size: int) -> set[tuple[str, ...]]:
    """The windows of one benchmark item; a shorter item is one window."""
    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


class Phrases:
    """Distinct windows as rows of word numbers, and the items of each."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int):
        owners: dict[tuple[str, ...], set[str]] = defaultdict(set)
        for item, text in items:
            for window in item_windows(text, size):
                owners[window].update([] if item is None else [item])
        keys = sorted(owners)
        vocabulary = sorted({w for k in keys for w in k})
        number = {w: i for i, w in enumerate(vocabulary)}
        self.vocabulary = pa.array([w.encode() for w in vocabulary], pa.large_binary())
        self.length = np.array([len(k) for k in keys], np.int64)
        self.rows = np.full((len(keys), size), -1, np.int32)
        for i, k in enumerate(keys):
            self.rows[i, : len(k)] = [number[w] for w in k]
        self.items = [sorted(owners[k]) for k in keys]


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of the suffixes of t, whose last symbol is its unique least one (prefix doubling).

    The first key packs as many symbols as fit 62 bits; later rounds sort only
    suffixes that are still tied.
    """
    n = len(t)
    bits = max(1, int(t.max()).bit_length())
    width = max(1, min(62 // bits, 8))
    key = t.astype(np.int64)
    width = min(width, n)
    for j in range(1, width):
        key = key << bits
        key[: n - j] |= t[j:]
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:])
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = head
    tied = ~fresh
    tied[:-1] |= ~fresh[1:]
    at = np.flatnonzero(tied)
    step = width
    while len(at):
        sub = sa[at]
        nxt = sub + step
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)], -1) + 1
        both = rank[sub] * (n + 1) + second
        order = np.argsort(both, kind="stable")
        both, sub = both[order], sub[order]
        sa[at] = sub
        fresh = np.empty(len(at), bool)
        fresh[0] = True
        np.not_equal(both[1:], both[:-1], out=fresh[1:])
        rank[sub] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        at = at[tied]
        step *= 2
    return sa


class BitVector:
    """Bits in 64-bit words with counts before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletMatrix:
    """Rank and access over an integer sequence, one bit vector a level."""

    def __init__(self, sequence: np.ndarray):
        self.levels: list[tuple[int, BitVector, int]] = []
        seq = sequence.astype(np.uint32)
        for shift in range(max(1, int(seq.max()).bit_length()) - 1, -1, -1):
            bit = (seq >> np.uint32(shift)) & np.uint32(1) != 0
            zeros = int(len(bit) - np.count_nonzero(bit))
            self.levels.append((shift, BitVector(bit), zeros))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position i."""
        low = np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = (symbol >> shift) & 1 != 0
            a, b = bits.rank(low), bits.rank(i)
            low = np.where(one, zeros + a, low - a)
            i = np.where(one, zeros + b, i - b)
        return i - low

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i and its rank before i."""
        symbol, low = np.zeros_like(i), np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = bits.get(i)
            symbol |= one.astype(np.int64) << shift
            a, b = bits.rank(low), bits.rank(i)
            low = np.where(one, zeros + a, low - a)
            i = np.where(one, zeros + b, i - b)
        return symbol, i - low


class FMIndex:
    """Backward search over t, whose last symbol is its unique least one."""

    def __init__(self, t: np.ndarray):
        self.n = len(t)
        sa = suffix_array(t)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(t))])
        self.wavelet = WaveletMatrix(t[sa - 1])
        marked = sa % SAMPLE == 0
        self.marked = BitVector(marked)
        self.sample = sa[marked]

    def search(self, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of the patterns; rows hold symbols, left-aligned, or -1 for one that doesn't occur."""
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), self.n, np.int64)
        for back in range(1, rows.shape[1] + 1 if len(rows) else 1):
            at = length - back
            live = np.flatnonzero((at >= 0) & (lo < hi))
            if not len(live):
                break
            c = rows[live, at[live]]
            known = c >= 0
            hi[live[~known]] = lo[live[~known]]
            live, c = live[known], c[known]
            base = self.before[c]
            lo[live], hi[live] = base + self.wavelet.rank(c, lo[live]), base + self.wavelet.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows."""
        out = np.zeros(len(rows), np.int64)
        at, left, steps = rows.copy(), np.arange(len(rows)), 0
        while len(left):
            done = self.marked.get(at)
            out[left[done]] = self.sample[self.marked.rank(at[done])] + steps
            left, at = left[~done], at[~done]
            if len(left):
                symbol, rank = self.wavelet.access(at)
                at = self.before[symbol] + rank
                steps += 1
        return out


class Scan:
    """What a shard of documents holds of the phrases."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, phrases: Phrases):
        self.words = words = Words(data, offs, IS_ALNUM, lower=True)
        n, docs = len(words), len(offs) - 1
        self.hit = np.zeros(n, bool)
        self.items: dict[int, set[str]] = {}
        if not n or not len(phrases.length):
            return
        coded = words.values().dictionary_encode()
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # 0 ends the shard and 1 each document, so no phrase runs from one into the next
        t = np.ones(n + docs + 1, np.int64)
        place = np.arange(n) + words.doc()
        t[place] = ids + 2
        t[-1] = 0
        number = pc.index_in(phrases.vocabulary, value_set=coded.dictionary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        symbols = np.append(np.where(number >= 0, number + 2, -1), -1)  # row padding -1 picks the last
        rows = symbols[phrases.rows]
        possible = np.flatnonzero((rows >= 0).sum(axis=1) == phrases.length)
        if not len(possible):
            return
        index = FMIndex(t)
        lo, hi = index.search(rows[possible], phrases.length[possible])
        count = hi - lo
        if not count.sum():
            return
        which = np.repeat(np.arange(len(possible)), count)
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        found = np.searchsorted(place, index.locate(at))
        size = phrases.length[possible[which]]
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, found, 1)
        np.add.at(cover, found + size, -1)
        self.hit = np.cumsum(cover[:-1]) > 0
        owner = np.searchsorted(words.first, found, side="right") - 1
        pairs = np.unique(owner * len(phrases.length) + possible[which])
        for pair in pairs.tolist():
            self.items.setdefault(pair // len(phrases.length), set()).update(phrases.items[pair % len(phrases.length)])

    def spans(self, doc: int) -> list[tuple[int, int]]:
        """Merged hit intervals [start, end) of a document, in its words."""
        a, b = self.words.first[doc], self.words.first[doc + 1]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], self.hit[a:b], [False]]).astype(np.int8)))
        return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = "spans array<struct<start:long,end:long>>, items array<string>"


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in blocks of about block_bytes of text, dealt by a hash of it; at least one block."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where(F.length("text") > 0)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-int(size) // block_bytes) or 1
    for k in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("text", "item"), F.lit(n)) == k).collect()]


def _scanned(batch: pa.RecordBatch, place: int, phrases: Phrases) -> Iterator[tuple[int, int, Scan]]:
    """The shards of a batch: first row, end, and what each holds."""
    data, offs = flat(batch.column(place))
    for i, j in chunks(offs, SHARD_BYTES):
        yield i, j, Scan(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], phrases)


def _text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def _hits(texts: DataFrame, phrases: Phrases) -> DataFrame:
    """k0, k1 (the key of a text), spans and items of each distinct text that the phrases hit."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, shard in _scanned(batch, 2, phrases):
                hit = sorted(shard.items)
                part = batch.slice(i, j - i).take(pa.array(hit, pa.int64()))
                spans = pa.array([[{"start": a, "end": b} for a, b in shard.spans(k)] for k in hit], _SPANS)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), spans, pa.array([sorted(shard.items[k]) for k in hit], pa.list_(pa.string()))], names=["k0", "k1", "spans", "items"])

    keyed = texts.select(*[k.alias(f"k{i}") for i, k in enumerate(_text_key(F.col("text")))], "text")
    return keyed.mapInArrow(scan, f"k0 long, k1 long, {_FOUND}").dropDuplicates(["k0", "k1"])


def _with_hits(docs: DataFrame, text_col: str, blocks: Iterator[list], window: int) -> tuple[DataFrame, Phrases, bool]:
    """docs with one more column, the spans and items of all blocks but one; the phrases of that one; whether there are others.

    The last pass searches that block itself, so a benchmark of one block needs no table and no join.
    """
    block, tables = next(blocks), []
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    for other in blocks:
        tables.append(written(_hits(texts, Phrases(other, window)), "hits"))
    phrases = Phrases(block, window)
    if not tables:
        return docs, phrases, False
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    k0, k1, found = fresh_names(docs, "k0", "k1", "found")
    united = every.groupBy("k0", "k1").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items")).select(F.col("k0").alias(k0), F.col("k1").alias(k1), F.struct("spans", "items").alias(found))
    mine = _text_key(docs[text_col].cast("string"))
    joined = docs.join(united, (mine[0] == united[k0]) & (mine[1] == united[k1]), "left")
    return joined.select(*[docs[f"`{c}`"] for c in docs.columns], found), phrases, True


def _united(batch: pa.RecordBatch, i: int, shard: Scan) -> None:
    """Adds what other blocks found (the last column) to a shard that begins at row i."""
    for k, found in enumerate(batch.column(batch.num_columns - 1).slice(i, len(shard.words.counts)).to_pylist()):
        if found is not None:
            shard.items.setdefault(k, set()).update(found["items"])
            for x in found["spans"]:
                shard.hit[shard.words.first[k] + x["start"] : shard.words.first[k] + x["end"]] = True


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (merged word intervals) and items (ids as strings, sorted) of every row."""
    rows, phrases, more = _with_hits(text_columns(docs, id_col, text_col), "text", _blocks(benchmark, item_col, item_text_col, block_bytes), window)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, shard in _scanned(batch, 1, phrases):
                if more:
                    _united(batch, i, shard)
                spans = [[{"start": a, "end": b} for a, b in shard.spans(k)] if k in shard.items else [] for k in range(j - i)]
                items = [sorted(shard.items.get(k, ())) for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(shard.words.counts, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "spans", "items"])

    return rows.mapInArrow(scan, f"doc_id long, n_words long, {_FOUND}")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs with every hit span cut out of the text (first to last character of its words).

    Texts without hits stay as they are. Spans of all blocks of the benchmark are found on the uncut texts and cut once.
    """
    place, width, schema = docs.columns.index(text_col), len(docs.columns), docs.schema
    rows, phrases, more = _with_hits(docs, text_col, _blocks(benchmark, item_col, item_text_col, block_bytes), window)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for i, _, shard in _scanned(batch, place, phrases):
                if more:
                    _united(batch, i, shard)
                words = shard.words
                for k in shard.items:
                    raw, base, origin = texts[i + k].encode(), words.first[k], words.offs[k]
                    kept, at = [], 0
                    for a, b in shard.spans(k):
                        kept.append(raw[at : words.start[base + a] - origin])
                        at = words.end[base + b - 1] - origin
                    texts[i + k] = b"".join([*kept, raw[at:]]).decode()
            out = list(batch.columns)[:width]
            out[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(out, names=batch.schema.names[:width])

    return rows.mapInArrow(scan, StructType(schema.fields))


def brute_force(documents: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = 10) -> dict[int, tuple[int, int, list[str]]]:
    """doc_id -> (words, hit words, items), by looking everywhere; items without an id hit but aren't listed; for tests."""
    out = {}
    listed = [(i, item_windows(t, window)) for i, t in items]
    for doc, text in documents:
        words = _WORD.findall((text or "").translate(_LOWER))
        hit, owners = [False] * len(words), []
        for item, wins in listed:
            places = [(k, len(w)) for w in wins for k in range(len(words) - len(w) + 1) if tuple(words[k : k + len(w)]) == w]
            if places and item is not None:
                owners.append(str(item))
            for k, n in places:
                hit[k : k + n] = [True] * n
        out[doc] = (len(words), sum(hit), sorted(owners))
    return out


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()

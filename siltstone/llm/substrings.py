"""Operator 6: substring dedup by Rabin-Karp hashes of every window of 35 words.

One pass hashes every window of every document, twice: one hash deals the
windows out to buckets, the other tells them apart in their bucket, with eight
bits of the first (together 72 + log2(buckets) bits). The number of buckets
follows from the bytes of the texts, about BUCKET_BYTES to each, so what one
task holds doesn't grow. A batch sends each bucket one row of packed hashes
and positions, a hash at most once, so a passage that a third of all documents
hold costs one entry a batch, not one a document. The buckets are shuffled and
counted; what repeats goes back to its batch, and there repeated windows merge
into maximal removal intervals by document. The text itself moves once, to
meet its intervals.

Rows are told apart by doc_id and a hash of the text; equal rows repeat each
other and get the same intervals. Null and empty texts have no words. Texts
shorter than a window keep all their words. The result doesn't depend on how
rows are dealt out. A batch is known by its partition, its number and the hash
of its rows; if a retried task should deal rows out differently, the counts no
longer add up and the job fails instead of losing a window.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_columns
from .text import IS_SPACE_WORD, Words, chunks, flat, mix, windows

_SPAN = "array<struct<start:long,end:long>>"
#: Odd multipliers of the two window hashes.
_DEAL, _TELL = 0xD1342543DE82EF95, 0xA0761D6478BD642F
#: A batch of windows; positions in it fit the packing.
BATCH_BYTES = 8 << 20
#: Text bytes whose windows make up a bucket; no more buckets than leave some windows in each row of a batch.
BUCKET_BYTES, MOST_BUCKETS = 16 << 20, 1 << 14


def _pack(at: np.ndarray) -> bytes:
    """Rising positions as one-byte steps; 255 is followed by four bytes."""
    step = np.diff(at, prepend=0)
    wide = step >= 255
    if not wide.any():
        return step.astype(np.uint8).tobytes()
    place = np.arange(len(step)) + 4 * (np.cumsum(wide) - wide)
    out = np.zeros(len(step) + 4 * int(wide.sum()), np.uint8)
    out[place] = np.where(wide, 255, step)
    tail = step[wide].astype("<u4").view(np.uint8).reshape(-1, 4)
    out[place[wide][:, None] + np.arange(1, 5)] = tail
    return out.tobytes()


def _unpack(blob: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8)
    if len(raw) == n:
        return np.cumsum(raw.astype(np.int64))
    step, i, k = np.empty(n, np.int64), 0, 0
    while k < n:
        stop = np.flatnonzero(raw[i : i + n - k] == 255)
        run = int(stop[0]) if len(stop) else n - k
        step[k : k + run] = raw[i : i + run]
        i, k = i + run, k + run
        if len(stop):
            step[k] = int.from_bytes(raw[i + 1 : i + 5].tobytes(), "little")
            i, k = i + 5, k + 1
    return np.cumsum(step)


class _Batch:
    """Window hashes of a run of documents."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, size: int):
        self.size = size
        tell, deal, at, counts, base = [], [], [], [], 0
        for i, j in chunks(offs):
            words = Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], IS_SPACE_WORD)
            h = words.hashes()
            # windows that don't run over a document's end
            left = np.repeat(words.first[1:], words.counts) - np.arange(len(words))
            whole = np.flatnonzero(left >= size)
            tell.append(windows(h, size, _TELL)[whole] if len(whole) else np.zeros(0, np.uint64))
            deal.append(windows(mix(h), size, _DEAL)[whole] if len(whole) else np.zeros(0, np.uint64))
            at.append(base + whole)
            counts.append(words.counts)
            base += len(words)
        self.tell, self.deal, self.at = np.concatenate(tell), np.concatenate(deal), np.concatenate(at)
        self.counts = np.concatenate(counts)


def _hash_pass(size: int, buckets: int):
    """Rows (kind 0: a bucket's windows of this batch; kind 1: the batch's documents and what repeats inside it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number = 0
        for batch in batches:
            data, offs = flat(batch.column(2))
            for i, j in chunks(offs, BATCH_BYTES):
                b = _Batch(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], size)
                keys = batch.column(0).slice(i, j - i).to_numpy(zero_copy_only=False).astype("<i8")
                texts = batch.column(1).slice(i, j - i).to_numpy(zero_copy_only=False).astype("<i8")
                name = f"{part}:{number}:" + hashlib.md5(keys.tobytes() + texts.tobytes()).hexdigest()
                number += 1
                # one entry for each hash of the batch, at its first place
                order = np.argsort(b.tell, kind="stable")
                t, d = b.tell[order], b.deal[order]
                fresh = np.ones(len(t), bool)
                fresh[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
                group = np.cumsum(fresh) - 1
                many = np.bincount(group, minlength=1) > 1 if len(t) else np.zeros(0, bool)
                inner = np.sort(b.at[order[many[group]]]) if len(t) else np.zeros(0, np.int64)
                first = order[fresh]
                first = first[np.argsort((b.deal[first] % np.uint64(buckets)).astype(np.int64) * (1 << 40) + first)]
                bucket = (b.deal[first] % np.uint64(buckets)).astype(np.int64)
                again = np.zeros(len(b.tell), bool)
                if len(t):
                    again[order] = many[group]
                edge = np.flatnonzero(np.diff(bucket, prepend=-1))
                kinds, where, blobs, places, flags = [], [], [], [], []
                for lo, hi in zip(edge.tolist(), np.append(edge[1:], len(bucket)).tolist()[: len(edge)], strict=True):
                    mine = first[lo:hi]
                    kinds.append(0)
                    where.append(int(bucket[lo]))
                    blobs.append(b.tell[mine].astype("<u8").tobytes() + (b.deal[mine] >> np.uint64(56)).astype(np.uint8).tobytes())
                    places.append(_pack(b.at[mine]))
                    flags.append(np.packbits(again[mine]).tobytes())
                # the documents: keys, text hashes, word counts; the number of buckets that will answer
                kinds.append(1)
                where.append(int(name[-15:], 16) % buckets)
                blobs.append(b"".join([keys.tobytes(), texts.tobytes(), b.counts.astype("<i8").tobytes()]))
                places.append(inner.astype("<u4").tobytes())
                flags.append(len(edge).to_bytes(4, "little"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kinds, pa.int32()), pa.array(where, pa.int64()), pa.array([name] * len(kinds)), pa.array(blobs, pa.binary()), pa.array(places, pa.binary()), pa.array(flags, pa.binary())],
                    names=["kind", "bucket", "batch", "hashes", "places", "flags"],
                )

    return run


def _count_bucket(rows: list[tuple[str, bytes, bytes, bytes]]) -> list[tuple[str, bytes]]:
    """For each batch, the places of its windows that other batches hold too."""
    hashes = [np.frombuffer(h, "<u8", count=len(h) // 9) for _, h, _, _ in rows]
    every = np.concatenate(hashes)
    more = np.concatenate([np.frombuffer(h, np.uint8, offset=len(h) // 9 * 8) for _, h, _, _ in rows])
    again = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=len(h)) for h, (_, _, _, f) in zip(hashes, rows, strict=True)])
    order = np.argsort(every, kind="stable")
    s, x = every[order], more[order]
    same = s[1:] == s[:-1]
    if (x[1:] != x[:-1])[same].any():  # the eight bits tell apart what 64 don't
        order = np.lexsort((more, every))
        s, x = every[order], more[order]
        same = s[1:] == s[:-1]
    fresh = np.ones(len(s), bool)
    fresh[1:] = ~same | (x[1:] != x[:-1])
    group = np.cumsum(fresh) - 1
    many = np.bincount(group) > 1
    repeated = np.zeros(len(every), bool)
    repeated[order] = many[group]
    repeated &= again == 0  # the others their batch knows already
    out, at = [], 0
    for (name, _, places, _), h in zip(rows, hashes, strict=True):
        mine = repeated[at : at + len(h)]
        at += len(h)
        out.append((name, _unpack(places, len(h))[mine].astype("<u4").tobytes() if mine.any() else b""))
    return out


def _sorted_groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[object, list[tuple]]]:
    """Groups of a partition that is sorted by a column."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[key] != now:
                yield now, rows
                rows = []
            now = row[key]
            rows.append(row)
    if rows:
        yield now, rows


def _count_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in _sorted_groups(batches, 1):
        out = [(0, name, places, None, None) for name, places in _count_bucket([(r[2], r[3], r[4], r[5]) for r in rows if r[0] == 0])] if any(r[0] == 0 for r in rows) else []
        out += [(1, r[2], r[4], r[3], r[5]) for r in rows if r[0] == 1]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["kind", "batch", "places", "docs", "answers"])


def _merge_pass(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in _sorted_groups(batches, 1):
            own = [r for r in rows if r[0] == 1]
            if len(own) != 1 or len(rows) - 1 != int.from_bytes(own[0][4], "little"):
                raise RuntimeError(f"batch {name} was dealt out differently by a retried task; write its input to a table first")
            keys, texts, counts = np.frombuffer(own[0][3], "<i8").reshape(3, -1)
            total = int(counts.sum())
            cover = np.zeros(total + 1, np.int64)
            for r in rows:
                at = np.frombuffer(r[2], "<u4").astype(np.int64)
                cover[at] += 1
                cover[at + size] -= 1  # places are distinct within a row
            hit = np.cumsum(cover[:-1]) > 0
            first = np.concatenate([[0], np.cumsum(counts)])
            # interval edges, cut at document borders
            change = np.ones(total, bool)
            change[1:] = hit[1:] != hit[:-1]
            change[first[:-1][first[:-1] < total]] = True
            start = np.flatnonzero(change)
            end = np.append(start[1:], total)
            keep = hit[start] if total else np.zeros(0, bool)
            start, end = start[keep], end[keep]
            owner = np.searchsorted(first, start, side="right") - 1
            edge = np.flatnonzero(np.diff(owner, prepend=-1))
            spans = [[{"start": int(s - first[o]), "end": int(e - first[o])} for s, e in zip(start[lo:hi], end[lo:hi], strict=True)] for lo, hi, o in zip(edge, np.append(edge[1:], len(owner))[: len(edge)], owner[edge], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[owner[edge]], pa.int64()), pa.array(texts[owner[edge]], pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "text_hash", "spans"],
            )

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """doc_id, text_hash, spans: the maximal intervals of words that repeated windows cover, where there are any."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = text_columns(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(-1).cast("long")).alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(partitions, min(MOST_BUCKETS, -(-size // BUCKET_BYTES)))
    hashed = rows.mapInArrow(_hash_pass(window, buckets), "kind int, bucket long, batch string, hashes binary, places binary, flags binary")
    counted = hashed.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(_count_pass, "kind int, batch string, places binary, docs binary, answers binary")
    return counted.repartition(partitions, "batch").sortWithinPartitions("batch").mapInArrow(_merge_pass(window), f"doc_id long, text_hash long, spans {_SPAN}").dropDuplicates(["doc_id", "text_hash"])


def _with_spans(docs: DataFrame, id_col: str, text_col: str, window: int) -> tuple[DataFrame, str]:
    """docs with their spans (null without repeats), and the name of that column, which docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    tail = next(k for k in range(len(taken) + 1) if not {f"__id{k}", f"__hash{k}", f"__spans{k}"} & taken)
    names = [f"__id{tail}", f"__hash{tail}", f"__spans{tail}"]
    spans = repeated_spans(docs, id_col, text_col, window).toDF(*names)
    key = (F.coalesce(docs[id_col].cast("long"), F.lit(-1)) == spans[names[0]]) & (F.xxhash64(docs[text_col].cast("string")) == spans[names[1]])
    return docs.join(spans, key, "left").drop(*names[:2]), names[2]


def _cutter(text_at: int, spans_at: int):
    """Kept word runs of each text: one list of (first byte, last byte) and the number of words."""

    def cut(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, Words, np.ndarray]]:
        data, offs = flat(batch.column(text_at))
        spans = batch.column(spans_at)
        for i, j in chunks(offs):
            words = Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], IS_SPACE_WORD)
            raw = words.data.tobytes()
            for k, got in enumerate(spans.slice(i, j - i).to_pylist()):
                a, b = words.first[k], words.first[k + 1]
                keep = np.ones(b - a, bool)
                for x in got or ():
                    keep[x["start"] : x["end"]] = False
                yield i + k, raw, words, a + np.flatnonzero(keep)

    return cut


def substring_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    rows, spans = _with_spans(text_columns(docs, id_col, text_col), "doc_id", "text", window)
    rows = rows.select("doc_id", "text", spans)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _cutter(1, 2)
        for batch in batches:
            kept, sums = [], []
            for _, raw, words, keep in cut(batch):
                start, end = words.start[keep].tolist(), words.end[keep].tolist()
                sums.append(hashlib.sha256(b" ".join([raw[s:e] for s, e in zip(start, end, strict=True)])).hexdigest())
                kept.append(len(keep))
            counts = _word_counts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(counts - np.array(kept, np.int64), pa.int64()), pa.array(sums, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _word_counts(column: pa.Array) -> np.ndarray:
    data, offs = flat(column)
    return np.concatenate([np.zeros(0, np.int64), *(Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], IS_SPACE_WORD).counts for i, j in chunks(offs))])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """The rows of docs with repeated windows cut out of the text.

    Kept runs of words keep their own white space and are joined by one
    space; texts without repeats stay as they are.
    """
    rows, spans_col = _with_spans(docs, id_col, text_col, window)
    place, spans_at = docs.columns.index(text_col), len(docs.columns)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _cutter(place, spans_at)
        for batch in batches:
            texts = batch.column(place).to_pylist()
            spans = batch.column(batch.num_columns - 1)
            touched = spans.is_valid().to_pylist()
            for k, raw, words, keep in cut(batch):
                if touched[k]:
                    edge = np.flatnonzero(np.diff(keep, prepend=-2) != 1)
                    last = np.append(edge[1:], len(keep)) - 1 if len(keep) else edge
                    texts[k] = b" ".join([raw[words.start[keep[a]] : words.end[keep[b]]] for a, b in zip(edge, last, strict=True)]).decode()
            columns = list(batch.columns)[:-1]
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    names = docs.columns
    return rows.select(*[F.col(f"`{c}`") for c in names], spans_col).mapInArrow(clean, docs.schema)


def brute_force(documents: list[tuple[int, str | None]], size: int = 35) -> list[tuple[int, int, int, str]]:
    """(doc_id, n_words, n_removed, kept_sha256) by counting every window; for tests."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in documents]
    count = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (doc, _), w in zip(documents, words, strict=True):
        hit = [False] * len(w)
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                hit[i : i + size] = [True] * size
        out.append((doc, len(w), sum(hit), hashlib.sha256(" ".join(x for x, h in zip(w, hit, strict=True) if not h).encode()).hexdigest()))
    return out

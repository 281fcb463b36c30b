"""Operator 3: quality by Bradley-Terry pairwise ranking.

Each preference pair is a document labelled 1 and one labelled 0; the chance
that the first is preferred is the logistic function of the difference of
their scores, a linear function of text features. All labelled rows are learnt
from: they are dealt into groups by a hash of their id, and in its group each
row is paired with some of the other label. The weights minimise the logistic
loss over pairs by Newton's method; each step is a job that sums gradient and
Hessian where the rows are, so that the driver sees sums only. The threshold is
the quantile of the training scores that leaves as large a part below it as the
labels do; the score is moved so that it lies at 0.3 there.

Features come from the whole text alone. Null and empty texts have the
features of no words and get a score too. Labels other than 0 and 1 are not
used, nor labels without a document. Without both kinds of labels every score
is 0.5. Rows with equal texts have equal scores. Very long texts are read
whole; an empty table gives an empty result; further columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, text_columns, written
from .text import IS_SPACE_WORD, Words, chunks, flat

#: Labelled rows of a group, on average, and the fewest of the rarer label that groups are made for.
GROUP_ROWS, GROUP_RARER = 4096, 64
#: Preference pairs: each row of the more frequent label is paired with so many of the other.
PAIRS_EACH = 16
#: Scores of which the driver may hold some while it looks for a quantile.
FEW = 10_000
CUT = 0.3

_UPPER, _DIGIT, _SYMBOL, _MARK, _WIDE = range(1, 6)
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = _UPPER
_CLASS[48:58] = _DIGIT
_CLASS[[ord(c) for c in "#$%&*@^~_=+<>{}[]|\\/"]] = _SYMBOL
_CLASS[[ord(c) for c in "!?"]] = _MARK
_CLASS[128:] = _WIDE
_STOP = np.isin(np.arange(256), [ord(c) for c in ".,;:"])


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of numbers for each document."""
    words = Words(data, offs, IS_SPACE_WORD)
    docs, n = len(offs) - 1, len(words)
    counts = words.counts
    total = np.maximum(counts, 1).astype(float)
    size = np.maximum(np.diff(offs), 1).astype(float)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        """Sums over each document's words."""
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[words.first[1:]] - sums[words.first[:-1]]

    def per_byte(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[offs[1:]] - sums[offs[:-1]]

    kind = _CLASS[words.data]
    parts = [per_byte(kind == k) / size for k in (_UPPER, _DIGIT, _SYMBOL, _MARK, _WIDE)]
    parts += [per_byte(_STOP[words.data]) / size, per_byte(words.data == 10) / total]
    h, owner = words.hashes(), words.doc()
    same = np.zeros(n, bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    parts.append(per_doc(same) / total)
    # the longest run of one word
    start = np.flatnonzero(~same)
    run = np.diff(np.append(start, n))
    longest = np.zeros(docs)
    np.maximum.at(longest, owner[start], run)
    parts.append(longest / total)
    order = np.lexsort((h, owner))
    fresh = np.ones(n, bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][fresh], minlength=docs) if n else np.zeros(docs)
    parts.append(distinct / total)
    # words by what they are made of
    upto = np.concatenate([[0], np.cumsum(kind == _UPPER)])
    upper = upto[words.end] - upto[words.start] if n else np.zeros(0)
    upto = np.concatenate([[0], np.cumsum((kind == _SYMBOL) | (kind == _MARK))])
    odd = upto[words.end] - upto[words.start] if n else np.zeros(0)
    length = words.end - words.start
    parts += [per_doc(upper >= 2) / total, per_doc(odd >= 1) / total, per_doc(odd >= 2) / total, per_doc(odd == length) / total, per_doc(length) / total]
    rates = np.stack(parts, axis=1)
    return np.concatenate([rates, np.log(rates + 1e-3), np.log1p(counts)[:, None]], axis=1)


@dataclass(frozen=True)
class Ranking:
    """A fitted model: score = sigmoid(weights . (x - mean) / spread - threshold + logit(CUT))."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(raw + np.log(CUT / (1 - CUT)), -30, 30)))


def _feature_rows(batch: pa.RecordBatch, column: int) -> np.ndarray:
    data, offs = flat(batch.column(column))
    return np.concatenate([features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in chunks(offs)])


def _matrix(blobs: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist())).reshape(len(blobs), -1)


def _packed(batch: pa.RecordBatch, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of each group of a batch, a group to a row."""
    for x, label in zip(batch.column("x"), batch.column("label"), strict=True):
        yield np.frombuffer(x.as_py()).reshape(-1, k), np.frombuffer(label.as_py(), np.int8)


def _summed(rows: DataFrame, sums: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """`sums` of the batches of rows, a sum of each task; None if there are no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = sums(batch)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    # one job (an iterator over the parts would make a job of each); ordered, so that the sum is the same in each run
    parts = sorted(bytes(r["s"]) for r in rows.mapInArrow(run, "s binary").collect())
    return np.sum([np.frombuffer(p) for p in parts], axis=0) if parts else None


def pair_sums(z: np.ndarray, label: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Number of pairs, loss, gradient and Hessian of a group's pairs: every row of both labels is in some, unless the group has one label only."""
    good, bad, k = np.flatnonzero(label == 1), np.flatnonzero(label == 0), len(w)
    out = np.zeros(2 + k + k * k)
    if not len(good) or not len(bad):
        return out
    at = np.arange(max(len(good), len(bad)))
    for j in range(PAIRS_EACH):
        # one of the two is shorter, so the shift always changes the partner where there is another
        diff = z[good[(at + (j if len(good) <= len(bad) else 0)) % len(good)]] - z[bad[(at + (j if len(bad) < len(good) else 0)) % len(bad)]]
        margin = diff @ w
        p = 1 / (1 + np.exp(np.clip(margin, -30, 30)))  # chance of the wrong order
        out[0] += len(diff)
        out[1] += np.logaddexp(0, -margin).sum()
        out[2 : 2 + k] -= diff.T @ p
        out[2 + k :] += ((diff * (p * (1 - p))[:, None]).T @ diff).ravel()
    return out


def exact_quantile(scores: DataFrame, q: float) -> float:
    """The linear quantile of column `raw`: the range that holds it is cut into bins until few values are left in it."""
    n, low, high = scores.agg(F.count("raw"), F.min("raw"), F.max("raw")).first()
    rank = q * (n - 1)
    want = int(np.floor(rank)), int(np.ceil(rank))

    def inside(lo: float, hi: float) -> DataFrame:
        return scores.where((F.col("raw") >= lo) & (F.col("raw") <= hi))

    # both ranks mostly lie in the same ranges, so each range is looked at once
    @cache
    def bins(lo: float, hi: float) -> list[tuple]:
        size = (hi - lo) / 1000
        place = F.least(F.floor((F.col("raw") - lo) / size), F.lit(999)) if size > 0 else F.lit(0)
        return sorted(tuple(r) for r in inside(lo, hi).groupBy(place.alias("b")).agg(F.count("raw"), F.min("raw"), F.max("raw")).collect())

    @cache
    def few(lo: float, hi: float) -> list[float]:
        return sorted(r[0] for r in inside(lo, hi).collect())

    def value(k: int) -> float:
        lo, hi, before = low, high, 0
        while True:
            if lo == hi:
                return lo
            for _, count, first, last in bins(lo, hi):
                if before + count > k:
                    break
                before += count
            if count <= FEW:
                return few(first, last)[k - before]
            lo, hi = first, last

    a = value(want[0])
    return a if want[0] == want[1] else a + (value(want[1]) - a) * (rank - want[0])


def fit_ranking(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", ridge: float = 1e-3) -> Ranking | None:
    """Fits on all labelled rows."""
    labelled = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).dropDuplicates()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _feature_rows(batch, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

    # features first, as they are smaller than the texts that the join would move
    featured = written(text_columns(docs, id_col, text_col).mapInArrow(gather, "doc_id long, x binary").join(labelled, "doc_id"), "features")
    sums = _summed(featured, lambda b: np.concatenate([np.bincount(b.column("label").to_numpy(), minlength=2), _matrix(b.column("x")).sum(axis=0)]))
    if sums is None or not sums[:2].all():
        dropped(featured)
        return None
    counts = [int(c) for c in sums[:2]]
    n, k = sum(counts), len(sums) - 2
    mean = sums[2:] / n
    groups = max(1, min(n // GROUP_ROWS, min(counts) // GROUP_RARER))

    def pack(part: pa.Table) -> pa.Table:
        part = part.sort_by([("doc_id", "ascending"), ("label", "ascending"), ("x", "ascending")])
        order = np.random.default_rng(7).permutation(part.num_rows)
        return pa.table({"x": pa.array([_matrix(part["x"])[order].tobytes()], pa.binary()), "label": pa.array([part["label"].to_numpy()[order].astype(np.int8).tobytes()], pa.binary())})

    # rows meet in their groups once, a row to a group, so that no step deals them out again
    dealt = featured.withColumn("g", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(groups)).cast("int"))
    packed = written(dealt.groupBy("g").applyInArrow(pack, "x binary, label binary"), "groups")
    spread = np.sqrt(_summed(packed, lambda b: sum(((x - mean) ** 2).sum(axis=0) for x, _ in _packed(b, k))) / n) + 1e-6
    scaled = lambda x: np.clip((x - mean) / spread, -8, 8)

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        s = _summed(packed, lambda b: sum(pair_sums(scaled(x), label, w) for x, label in _packed(b, k)))
        return s[1] / s[0] + ridge * (w @ w) / 2, s[2 : 2 + k] / s[0] + ridge * w, s[2 + k :].reshape(k, k) / s[0] + ridge * np.eye(k)

    w = np.zeros(k)
    now, grad, hess = at(w)
    for _ in range(40):
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-4:
            found = at(w - size * step)
            if found[0] <= now:
                break
            size /= 2
        else:
            break
        w, before = w - size * step, now
        now, grad, hess = found
        if before - now < 1e-9:
            break

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, _ in _packed(batch, k):
                yield pa.RecordBatch.from_arrays([pa.array(scaled(x) @ w, pa.float64())], names=["raw"])

    scores = written(packed.mapInArrow(score, "raw double"), "scores")
    threshold = exact_quantile(scores, counts[0] / n)
    dropped(featured, packed, scores)
    return Ranking(mean, spread, w, threshold)


def quality_scores(docs: DataFrame, model: Ranking | None, text_col: str = "text") -> DataFrame:
    """The rows of docs with a column quality_score (0 to 1); one of that name is replaced."""
    docs = docs.drop("quality_score")
    place = docs.columns.index(text_col)
    kind = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.lit(0.0).alias("quality_score")).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = model.scores(_feature_rows(batch, place)) if model else np.full(batch.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, "quality_score"])

    return docs.mapInArrow(score, kind)

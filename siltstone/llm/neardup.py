"""Operator 10: near-duplicate detection by MinHash.

Many universal hash minima make a signature, cut into bands. Documents with
equal shingle sets fall together first, as one node, so a group of exact
copies costs one row. Nodes that share a band are compared with the centre of
their bucket (a star, so a bucket of m makes at most m - 1 pairs), first by
signature, then on the full shingle sets. The centre is the member whose bands
are shared most, so the buckets of one cluster agree on it. Components of the
links come from alternating large-star and small-star.

Buckets that still hold several components are settled exactly: a bucket's
members go into packed rows of about BLOCK_BYTES, each row of members outside
the bucket's main component meets each row of members, and within such a cell
every pair of different components is compared by signature; the members that
pass are dealt out again with their full sets and compared on those. Nothing is
left out, however large the bucket; of the first pass only members leave a
cell, of the second only links.

With 40 bands of 6 rows a pair at a similarity of exactly 0.8 shares no band
with probability 5e-6; the signature test drops it with probability 1e-4 (it
lies four standard deviations below), at 0.85 with less than 1e-8.

Null and empty texts have no shingles, are linked with nothing and kept.
Texts shorter than a shingle are one shingle; very long texts are taken whole.
Repeated rows are copies of each other: they get the same component, and
`kept` holds for each of them if it holds for one. Rows that share an id but
not a text are nodes of their own. Rows without an id link like others, never
name a component that has another member with an id, and are kept. An empty
table gives an empty result; extra columns are not read. Full sets hold 48-bit
hashes of their shingles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, text_columns, written
from .text import ASCII_LOWER, ASCII_UPPER, IS_SPACE_WORD, Words, chunks, flat, mix, windows

BANDS, ROWS = 40, 6
#: Bytes of signatures and sets that a packed row of a bucket holds.
BLOCK_BYTES = 512 << 10
#: Ids that are broadcast to pick texts by; more are joined by a shuffle.
SENT = 1_000_000
#: Shared shingles that a cell counts at once.
COLUMNS = 4096
_SHINGLE = 0xE7037ED1A0B428DB
_rng = np.random.default_rng(20240607)
_A = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted, and where each document's begin (one more entry)."""
    words = Words(data, offs, IS_SPACE_WORD, lower)
    h, counts = words.hashes(), words.counts
    left = np.repeat(words.first[1:], counts) - np.arange(len(words))
    whole = np.flatnonzero(left >= size)
    values = [windows(h, size, _SHINGLE)[whole]] if len(whole) else []
    owners = [words.doc()[whole]]
    for n in range(1, size):  # documents of n words are one shingle
        short = np.flatnonzero(counts == n)
        if len(short):
            at = words.first[short][:, None] + np.arange(n)
            acc = np.full(len(short), n, np.uint64)
            with np.errstate(over="ignore"):
                for k in range(n):
                    acc = mix(acc * np.uint64(_SHINGLE) + h[at[:, k]])
            values.append(acc)
            owners.append(short)
    owner = np.concatenate(owners)
    value = np.concatenate(values) if values else np.zeros(0, np.uint64)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    owner, value = owner[fresh], value[fresh]
    return value, np.searchsorted(owner, np.arange(len(offs)))


def _names(value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, whatever the order of its shingles."""
    with np.errstate(over="ignore"):
        return np.add.reduceat(mix(value), at), np.bitwise_xor.reduceat(mix(value ^ np.uint64(_SHINGLE)), at)


def _node(doc_id: Column, low: Column) -> Column:
    """A set's name as 17 bytes: they sort by doc_id, without an id last, and tell sets of one id apart."""
    hexed = lambda x: F.lpad(F.hex(x), 16, "0")
    least = -(1 << 63)
    return F.unhex(F.concat(F.when(doc_id.isNull(), "01").otherwise("00"), hexed(F.coalesce(doc_id, F.lit(0).cast("long")).bitwiseXOR(F.lit(least))), hexed(low)))


def _doc_id(node: Column) -> Column:
    """The doc_id in a node's name."""
    digits = F.hex(F.substring(node, 2, 8))
    high = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long") - F.lit(1 << 31)
    return F.when(F.substring(node, 1, 1) == F.unhex(F.lit("00")), F.shiftleft(high, 32).bitwiseOR(F.conv(F.substring(digits, 9, 8), 16, 10).cast("long")))


def _features(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = flat(batch.column(1))
            for i, j in chunks(offs):
                value, first = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], size)
                n = np.diff(first)
                full = np.flatnonzero(n)
                at = first[:-1][full]
                low, high = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                bands = np.zeros((j - i, BANDS), np.uint64)
                sig = np.zeros((j - i, BANDS * ROWS), np.uint8)
                if len(full):
                    with np.errstate(over="ignore"):
                        low[full], high[full] = _names(value, at)
                        for b in range(BANDS):
                            key = np.full(len(full), b, np.uint64)
                            for r in range(b * ROWS, (b + 1) * ROWS):
                                least = np.minimum.reduceat(value * _A[r] + _B[r], at)
                                key = mix(key * np.uint64(_SHINGLE) + least)
                                sig[full, r] = (mix(least) & np.uint64(255)).astype(np.uint8)
                            bands[full, b] = key
                flat_bands = pa.array(bands[full].ravel().view(np.int64))
                band_lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]), pa.int32()), flat_bands)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), band_lists, pa.array([x.tobytes() for x in sig], pa.binary())],
                    names=["doc_id", "n_shingles", "low", "high", "bands", "sig"],
                )

    return run


def _full_sets(size: int):
    """node and packed full set of each text that has shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = flat(batch.column(1))
            for i, j in chunks(offs):
                value, first = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], size)
                full = np.flatnonzero(np.diff(first))
                if not len(full):
                    continue
                low, _ = _names(value, first[:-1][full])
                ids = batch.column(0).slice(i, j - i).take(pa.array(full))
                name = np.zeros((len(full), 17), np.uint8)
                name[:, 0] = ids.is_null().to_numpy(zero_copy_only=False)
                name[:, 1:9] = (ids.fill_null(0).to_numpy() ^ np.int64(-(1 << 63))).astype(">i8").view(np.uint8).reshape(-1, 8)
                name[:, 9:] = low.astype(">u8").view(np.uint8).reshape(-1, 8)
                packed = (value >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                blobs = [packed[a:b].tobytes() for a, b in zip(first[full].tolist(), first[full + 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in name], pa.binary()), pa.array(blobs, pa.binary())], names=["node", "members"])

    return run


def _unpacked(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _confirm(percent: int):
    """Pairs whose full sets meet 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_shares(_unpacked(x.as_py()), _unpacked(y.as_py()), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _alike(threshold: float):
    """Pairs whose signatures agree in at least that part of their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, BANDS * ROWS) for c in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= threshold * BANDS * ROWS))

    return run


def _shares(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets meet 100 * intersection >= percent * union."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(x) + len(y) - common)


class _Packed:
    """The members of one packed row; their sets come in the second pass only."""

    def __init__(self, rows: list[dict]):
        self.node = [r["node"] for r in rows]
        self.comp = [r["comp"] for r in rows]
        self.outside = np.array([r["outside"] for r in rows])
        self.size = np.array([r["size"] for r in rows])
        self.sig = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint8).reshape(len(rows), BANDS * ROWS)
        self.sets = [_unpacked(r["members"]) for r in rows if "members" in r]


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all x with all y: products of 0/1 columns, one for each shingle that both sides hold."""
    shared = np.intersect1d(np.concatenate(x), np.concatenate(y))
    out = np.zeros((len(x), len(y)), np.float32)

    def columns(sets: list[np.ndarray], part: np.ndarray) -> np.ndarray:
        values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(part, values), len(part) - 1)
        hit = part[at] == values
        m = np.zeros((len(sets), len(part)), np.float32)
        m[owner[hit], at[hit]] = 1
        return m

    for i in range(0, len(shared), COLUMNS):
        part = shared[i : i + COLUMNS]
        out += columns(x, part) @ columns(y, part).T
    return np.rint(out).astype(np.int64)


def _near(ask: _Packed, met: _Packed, threshold: float, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of different components may be links by their sizes and signatures; and the numbers of met's components."""
    numbers: dict[bytes, int] = {}
    ca, cm = (np.array([numbers.setdefault(c, len(numbers)) for c in p.comp]) for p in (ask, met))
    na, nm = np.array(ask.node, object), np.array(met.node, object)
    # of two members outside, the smaller one asks
    near = (ca[:, None] != cm[None, :]) & (~met.outside[None, :] | (na[:, None] < nm[None, :]).astype(bool))
    near &= 100 * np.minimum(ask.size[:, None], met.size[None, :]) >= percent * np.maximum(ask.size[:, None], met.size[None, :])
    rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    agree = np.zeros((len(rows), len(cols)), np.int16)
    for x, y in zip(ask.sig[rows].T, met.sig[cols].T, strict=True):
        agree += x[:, None] == y[None, :]
    near[np.ix_(rows, cols)] &= agree >= threshold * BANDS * ROWS
    return near, cm


def _links(ask: _Packed, met: _Packed, threshold: float, percent: int) -> Iterator[tuple[bytes, bytes]]:
    """Links between different components, of a member's links to one component the first."""
    near, comp = _near(ask, met, threshold, percent)
    rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(rows):
        return
    common = _common([ask.sets[i] for i in rows], [met.sets[j] for j in cols])
    linked = near[np.ix_(rows, cols)] & (100 * common >= percent * (ask.size[rows][:, None] + met.size[cols][None, :] - common))
    for i, row in zip(rows.tolist(), linked, strict=True):
        hit = cols[row]
        _, once = np.unique(comp[hit], return_index=True)
        for j in hit[once].tolist():
            yield ask.node[i], met.node[j]


def _cells(work):
    """The pairs (a, b) that work(h, ask, met) gives for each cell (h, ri, cj): its rows `ask` and `met` lie together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}
        for batch in batches:
            for k in range(batch.num_rows):
                cell = tuple(batch.column(c)[k].as_py() for c in (0, 1, 2))
                if cell != key:
                    key, held = cell, {}
                held[batch.column(3)[k].as_py()] = _Packed(batch.column(4)[k].as_py())
                if len(held) == 2:
                    yield work(cell[0], held[True], held[False])
                    held = {}

    return run


def _asking(threshold: float, percent: int):
    """First pass: the members of a bucket that are in a pair which sizes and signatures allow."""

    def work(h: int, ask: _Packed, met: _Packed) -> pa.RecordBatch:
        near, _ = _near(ask, met, threshold, percent)
        found = [ask.node[i] for i in np.flatnonzero(near.any(axis=1))] + [met.node[j] for j in np.flatnonzero(near.any(axis=0))]
        return pa.RecordBatch.from_arrays([pa.array([h] * len(found), pa.int64()), pa.array(found, pa.binary())], names=["h", "node"])

    return _cells(work)


def _linking(threshold: float, percent: int):
    """Second pass: the links of a cell, on full sets."""

    def work(h: int, ask: _Packed, met: _Packed) -> pa.RecordBatch:
        found = list(_links(ask, met, threshold, percent))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return _cells(work)


def _dealt_cells(rows: DataFrame, weight: Column, columns: list[str]) -> DataFrame:
    """Each bucket's members in packed rows of about BLOCK_BYTES by weight; each row of members outside meets each row of members."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = rows.groupBy("h").agg(F.ceil(F.sum(weight) / BLOCK_BYTES).cast("int").alias("mb"), F.ceil(F.sum(F.when(F.col("outside"), weight)) / BLOCK_BYTES).cast("int").alias("rb"))
    dealt = rows.join(blocks, "h")

    def packed(part: DataFrame, salt: int, own: str, other: str, ask: bool) -> DataFrame:
        block = F.pmod(F.xxhash64("node", F.lit(salt)), F.col(own)).cast("int").alias("block")
        held = part.groupBy("h", block, other).agg(F.collect_list(F.struct(*columns)).alias("rows"))
        each = held.select("h", "block", F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("at"), "rows")
        ri, cj = ("block", "at") if ask else ("at", "block")
        return each.select("h", F.col(ri).alias("ri"), F.col(cj).alias("cj"), F.lit(ask).alias("ask"), "rows")

    cells = packed(dealt.where("outside"), 1, "rb", "mb", True).unionByName(packed(dealt, 2, "mb", "rb", False))
    return cells.repartition(n, "h", "ri", "cj").sortWithinPartitions("h", "ri", "cj")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """node, comp (its smallest reachable node) of every node on an edge.

    Large-star and small-star by turns, until a round changes nothing. Each
    keeps the edges at their number or fewer, and the minimum of a node's
    neighbours is pre-aggregated before the shuffle.
    """
    edges = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(edges)
    for _ in range(max_rounds):
        # large-star: larger neighbours go to the smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        dropped(edges)
        # small-star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = written(large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        dropped(large)
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _sets_of(source: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node, members: the full sets of some nodes, from their texts."""
    ids = written(nodes.select(_doc_id(F.col("node")).alias("id")).distinct(), "ids")
    sent = F.broadcast(ids) if ids.count() <= SENT else ids
    rows = source.join(sent, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").dropDuplicates(["doc_id", "text"])
    sets = written(rows.mapInArrow(_full_sets(shingle), "node binary, members binary"), "sets")
    dropped(ids)
    return sets


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    source = text_columns(docs, id_col, text_col)
    threshold = percent / 100 - 4 * (percent / 100 * (1 - percent / 100) / (BANDS * ROWS)) ** 0.5
    feats = written(source.mapInArrow(_features(shingle), "doc_id long, n_shingles long, low long, high long, bands array<long>, sig binary"), "minhash")
    names = written(feats.select("doc_id", "n_shingles", "low", "high"), "names")
    # equal sets have equal bands and signatures, so any row stands for them
    groups = feats.where("n_shingles > 0").groupBy("low", "high").agg(F.min("doc_id").alias("least"), F.any_value("n_shingles").alias("size"), F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig"))
    nodes = written(groups.select("low", "high", "size", "bands", "sig", _node(F.col("least"), F.col("low")).alias("node")), "nodes")
    dropped(feats)

    # a bucket's rows travel by the short name of their sets; sets that share it by chance are only compared more often
    exploded = nodes.select("low", F.explode("bands").alias("h"))
    sizes = exploded.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    met = written(exploded.join(sizes, "h").join(nodes.select("low", "node"), "low").select("h", "node", "m"), "members")
    shared = met.groupBy("node").agg(F.sum("m").alias("w"))
    members = written(met.join(shared, "node").select("h", "node", "w"), "members")
    dropped(met)

    def joined(pairs: DataFrame, values: DataFrame, col: str) -> DataFrame:
        x = values.select(F.col("node").alias("a"), F.col(col).alias("x"))
        y = values.select(F.col("node").alias("b"), F.col(col).alias("y"))
        return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")

    # the most shared member of each bucket meets the others
    centers = members.groupBy("h").agg(F.max(F.struct("w", "node")).alias("c")).select("h", F.col("c.node").alias("center"))
    pairs = members.join(centers, "h").where("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    alike = written(joined(pairs, nodes, "sig").mapInArrow(_alike(threshold), "a binary, b binary"), "alike")
    sets = _sets_of(source, alike.select(F.col("a").alias("node")).unionByName(alike.select(F.col("b").alias("node"))), shingle)
    comps = connected_components(joined(alike, sets, "members").mapInArrow(_confirm(percent), "a binary, b binary"))
    dropped(alike, sets)

    # buckets that are still mixed: all pairs of a member outside the largest component with a member of another one
    seen = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    several = seen.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("h")
    rows = written(seen.join(several, "h", "left_semi").select("h", "node", "comp"), "mixed")
    core = rows.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("h").agg(F.max(F.struct("k", "comp")).alias("c")).select("h", F.col("c.comp").alias("core"))
    rows = rows.join(core, "h").join(nodes.select("node", "size", "sig"), "node").select("h", "node", "comp", (F.col("comp") != F.col("core")).alias("outside"), "size", "sig")
    columns = ["node", "comp", "outside", "size", "sig"]
    asking = _dealt_cells(rows, F.lit(BANDS * ROWS), columns).mapInArrow(_asking(threshold, percent), "h long, node binary").distinct()
    left = written(rows.join(asking, ["h", "node"], "left_semi"), "asking")
    sets = _sets_of(source, left, shingle)
    cells = _dealt_cells(left.join(sets, "node"), F.lit(BANDS * ROWS) + 6 * F.col("size"), [*columns, "members"])
    more = cells.mapInArrow(_linking(threshold, percent), "a binary, b binary")
    every = connected_components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more))
    dropped(left, sets, members)

    labelled = nodes.select("low", "high", "node").join(every, "node", "left").select("low", "high", _doc_id(F.coalesce("comp", "node")).alias("comp"))
    return (
        names.join(labelled, ["low", "high"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("comp")).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def brute_force(documents: list[tuple[int, str | None]], shingle: int, percent: int = 80) -> list[tuple[int, int, int, bool]]:
    """(doc_id, n_shingles, component_id, kept) from all pairs; for tests."""
    lower = str.maketrans(ASCII_UPPER, ASCII_LOWER)
    sets, parent = [], list(range(len(documents)))
    for _, text in documents:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both and 100 * both >= percent * (len(x) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(documents):
        least[root(i)] = min(doc, least.get(root(i), doc))
    return [(doc, len(s), least[root(i)], doc == least[root(i)]) for i, ((doc, _), s) in enumerate(zip(documents, sets, strict=True))]

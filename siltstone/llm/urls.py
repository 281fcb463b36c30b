"""Operator 7: URL filters by a Bloom filter cascade.

Level 1 encodes the listed keys, level 2 the keys of the corpus that level 1
passes wrongly, level 3 the listed keys that level 2 passes wrongly, and so on
until a level passes nothing wrongly. Over the keys that the cascade was built
for (the complete key universe of the corpus) membership is then exact, with a
few bytes of filter and no join.

A key is a host suffix followed by a path prefix. Level 1 is sized by the
ratio of the universe to the list, so the false positives that reach the
driver number about `len(rules)` whatever the size of the corpus. A second
cascade, over the listed keys alone, tells their verdicts apart. The filters
travel as one broadcast row, a few bytes for each rule; plans don't grow with
the rules.

The longest fitting key decides; of keys of equal length the one with the
longer host; of rules with the same key the one listed first. Nulls and URLs
without ``://`` have an empty host and path and fit no rule; very long URLs are
taken whole; repeated rows are judged alike; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_names, lower_ascii


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Host suffixes times path prefixes of the given lengths, longest first, of equal length the longer host first."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(lengths, reverse=True)])
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(F.filter(prefixes, lambda p: p.isNotNull()), lambda p: F.struct(F.length(s).alias("host"), F.concat(s, p).alias("key")))))
    ordered = F.array_sort(keys, lambda a, b: F.when(F.length(a["key"]) == F.length(b["key"]), b["host"] - a["host"]).otherwise(F.length(b["key"]) - F.length(a["key"])))
    return F.when(host != "", F.transform(ordered, lambda k: k["key"])).otherwise(F.array().cast("array<string>"))


def _seed(level: int) -> int:
    """The state of Spark's xxhash64 after an int column."""
    return xxhash.xxh64_intdigest(level.to_bytes(4, "little", signed=True), seed=42)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: A filter has so many bits at least: with few, double hashing has too few patterns to be as rare as asked.
LEAST_BITS = 1 << 16


@dataclass
class Bloom:
    """A Bloom filter whose bits are tested by Spark's own expressions.

    The positions of a key are (a + i * b) mod bits, where a and b are the
    31-bit halves of xxhash64(level, key).
    """

    level: int
    bits: int
    hashes: int
    words: list[int] = field(default_factory=list)

    @classmethod
    def of(cls, level: int, keys: list[str], rate: float) -> Bloom:
        bits = max(LEAST_BITS, math.ceil(-len(keys) * math.log(rate) / math.log(2) ** 2))
        bits += -bits % 64
        out = cls(level, bits, min(40, max(1, math.ceil(-math.log2(rate)))))
        words = [0] * (bits // 64)
        for key in keys:
            for at in out.positions(key):
                words[at // 64] |= 1 << at % 64
        out.words = [_signed(w) for w in words]
        return out

    def positions(self, key: str) -> list[int]:
        h = xxhash.xxh64_intdigest(key.encode(), seed=_seed(self.level))
        a, b = h >> 33, (h & 0x7FFFFFFF) | 1
        return [(a + i * b) % self.bits for i in range(self.hashes)]

    def holds(self, key: str) -> bool:
        return all(self.words[at // 64] >> at % 64 & 1 for at in self.positions(key))

    def test(self, key: Column, words: Column) -> Column:
        """words: the column that holds the filter."""
        h = F.xxhash64(F.lit(self.level), key)
        a, b = F.shiftrightunsigned(h, 33), h.bitwiseAND(F.lit(0x7FFFFFFF)).bitwiseOR(F.lit(1))

        def bit(i: Column) -> Column:
            at = (a + i * b) % F.lit(self.bits)
            return F.getbit(F.get(words, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1

        return F.forall(F.sequence(F.lit(0).cast("long"), F.lit(self.hashes - 1).cast("long")), bit)


class Cascade:
    """Exact membership of `listed` among the keys of a universe."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    @classmethod
    def over(cls, first: Bloom, listed: list[str], wrong: list[str]) -> Cascade:
        """The levels after the first, from the keys that it passes wrongly."""
        levels, inside, outside = [first], listed, wrong
        while outside:
            level = Bloom.of(len(levels) + 1, outside, 0.5)
            levels.append(level)
            inside, outside = outside, [k for k in inside if level.holds(k)]
        return cls(levels)

    @classmethod
    def build(cls, listed: list[str], universe: DataFrame, key: str = "key") -> Cascade:
        """universe: distinct keys; one pass counts them, one finds what level 1 passes wrongly."""
        listed = sorted(set(listed))
        if not listed:
            return cls([])
        first = Bloom.of(1, listed, min(0.5, len(listed) / (2 * max(1, universe.count()))))
        alone = cls([first])
        known = universe.sparkSession.createDataFrame([(k,) for k in listed], f"`{key}` string")
        passed, names = alone.attached(universe)
        wrong = [r[0] for r in passed.where(alone.test(F.col(key), names)).select(key).join(known, key, "left_anti").collect()]
        return cls.over(first, listed, wrong)

    @classmethod
    def among(cls, listed: list[str], others: list[str]) -> Cascade:
        """Tells listed keys from others, both on the driver."""
        if not listed:
            return cls([])
        first = Bloom.of(1, listed, 0.5)
        return cls.over(first, listed, [k for k in others if first.holds(k)])

    def attached(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        """df with the filters as columns (one broadcast row), and their names."""
        names = fresh_names(df, *(f"level{b.level}_" for b in self.levels))
        if not names:
            return df, names
        row = df.sparkSession.createDataFrame([tuple(b.words for b in self.levels)], ", ".join(f"`{n}` array<long>" for n in names))
        return df.crossJoin(F.broadcast(row)), names

    def test(self, key: Column, names: list[str]) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for depth in range(len(self.levels), 0, -1):
            # a key that level `depth` doesn't pass is unlisted at odd levels and listed at even ones
            out = F.when(self.levels[depth - 1].test(key, F.col(names[depth - 1])), out).otherwise(F.lit(depth % 2 == 0))
        return out


def url_filter(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row; the longest fitting rule decides.

    `default` is the verdict of URLs that no rule fits.
    """
    chosen: dict[str, str] = {}
    for r in rules:
        chosen.setdefault(r.key, r.verdict)
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    if not chosen:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keyed = rows.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), sorted({len(r.path) for r in rules})))
    cascade = Cascade.build(list(chosen), keyed.select(F.explode("keys").alias("key")).distinct())
    found, names = cascade.attached(keyed)
    found = found.select("page_id", "host", "path", F.get(F.filter("keys", lambda k: cascade.test(k, names)), F.lit(0)).alias("rule"))
    kinds = sorted(set(chosen.values()))
    verdict = F.lit(kinds[-1])
    for kind in kinds[:-1]:
        tells = Cascade.among([k for k, v in chosen.items() if v == kind], [k for k, v in chosen.items() if v != kind])
        found, names_of = tells.attached(found)
        verdict = F.when(tells.test(F.col("rule"), names_of), F.lit(kind)).otherwise(verdict)
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNull(), F.lit(default)).otherwise(verdict).alias("verdict"))

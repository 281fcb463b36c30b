"""Operator 9: document fingerprints as bottom-k sketches, in DataFrame functions only.

A fingerprint is the k least distinct 64-bit hashes of a text's shingles of
five words (words: lower-cased A-Z, split at ASCII white space; a shorter text
is one shingle, an empty or null one has none). Sketches merge across parts by
keeping the k least of their union, and estimate resemblance, containment and
the number of distinct shingles. Equal texts have equal fingerprints; two
empty sketches are alike (1.0), an empty and a full one are not (0.0).

`with_next` pairs each document with the next one in descending id order (the
last with the first) without a global sort: rows are cut into ranges at sampled
bounds, each range is ordered on its own, and the head of a range is sent to
the range before it as well. Bounds and heads travel as small broadcast tables,
so the plan doesn't grow with their number. Rows with equal ids, or without
one, are ordered by a hash of their text and cut into ranges by it too; only
rows that agree in both lie in one range. Very long texts are taken whole; an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_names, lower_ascii, text_columns

K, SHINGLE = 128, 5


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The k least distinct shingle hashes, in rising order."""
    words = F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return sketch_of_words(words, k, shingle)


def bound(value: Column, use) -> Column:
    """use(value), where value is worked out once, also if it is used within a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sketch_of_words(words: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    def hashed(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - F.lit(shingle - 1), F.lit(1)))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, shingle)))
        return F.when(F.size(w) > 0, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)).otherwise(F.array().cast("array<long>"))

    return bound(words, hashed)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_by(df: DataFrame, key: str, sketch_col: str, k: int = K) -> DataFrame:
    """key, sketch: the sketches of all rows of a key merged; never more than k hashes of a key meet."""
    hashes = df.select(key, F.explode(sketch_col).alias("__h")).distinct()
    least = hashes.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy("__h"))).where(F.col("__r") <= k)
    return least.groupBy(key).agg(F.sort_array(F.collect_list("__h")).alias("sketch"))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Jaccard similarity: of the k least hashes of both, the part that both hold."""
    def part(both: Column) -> Column:
        return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.size(both))

    return bound(merged(a, b, k), part)


def distinct_count(a: Column, k: int = K) -> Column:
    """Distinct shingles: exact below k, else (k - 1) over the k-th least hash as a part of the range."""
    part = F.element_at(a, k).cast("double") / F.lit(2.0**64) + F.lit(0.5)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / part)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The part of a's shingles that b holds, from the resemblance and the three counts."""
    union = distinct_count(merged(a, b, k), k)
    count = distinct_count(a, k)
    return F.when(count == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / count))


def packed(a: Column) -> Column:
    """A sketch as a string: its hashes as big-endian bytes in base64."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")))


#: Sampled rows for each range, to find its bounds.
SAMPLED = 20


def _bounds(placed: DataFrame, parts: int) -> list[tuple]:
    """At most parts - 1 places that cut the rows into ranges of about equal size."""
    total = placed.count() if parts > 1 else 0
    if not total:
        return []
    found = sorted(tuple(r[0]) for r in placed.sample(min(1.0, SAMPLED * parts / total), seed=7).collect())
    return sorted({found[len(found) * i // parts] for i in range(1, parts)}) if found else []


def _range_of(place: Column, bounds: Column) -> Column:
    """How many of the sorted bounds lie before a place, by bisection."""
    n = F.size(bounds)

    def step(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        left = (s["lo"] < s["hi"]) & (F.get(bounds, middle) < place)
        return F.struct(F.when(left, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(left | (s["lo"] >= s["hi"]), s["hi"]).otherwise(middle).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.alias("hi")), step, lambda s: s["lo"])


def with_next(df: DataFrame, id_col: str, carried: dict[str, Column], order: Column, parts: int | None = None) -> DataFrame:
    """df with `next_<name>` columns: `carried` of the row that follows in descending order of id_col, then `order` (a long).

    After the last row comes the first. Null ids come last. Columns of df with these names are replaced.
    """
    spark = df.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = df.drop(*[f"next_{n}" for n in carried])
    place, bounds, at, head, sends, copy = fresh_names(df, "place", "bounds", "at", "head", "sends", "copy")
    kind = "struct<n:boolean,k:long,o:long>"
    key = F.col(id_col)
    # rising places are falling ids, nulls last
    placed = df.withColumn(place, F.struct(key.isNull().alias("n"), F.coalesce(F.bitwise_not(key), F.lit(0).cast("long")).alias("k"), order.alias("o")))
    cuts = spark.createDataFrame([(_bounds(placed.select(place), parts),)], f"`{bounds}` array<{kind}>")
    ranged = placed.crossJoin(F.broadcast(cuts)).withColumn(at, _range_of(F.col(place), F.col(bounds))).drop(bounds)
    # the first row of each range: there are at most `parts` of them; each goes to the range before as well
    first = sorted((r[0], tuple(r[1])) for r in ranged.groupBy(at).agg(F.min(place)).collect())
    heads = spark.createDataFrame([(i, p, first[k - 1][0]) for k, (i, p) in enumerate(first)], f"`{at}` int, `{place}` {kind}, `{sends}` int")
    marked = ranged.join(F.broadcast(heads), [at, place], "left")
    mine, halo = (F.struct(F.lit(h).alias("halo"), F.col(c).alias("at")) for h, c in ((False, at), (True, sends)))
    dealt = marked.withColumn(copy, F.explode(F.when(F.col(sends).isNull(), F.array(mine)).otherwise(F.array(mine, halo)))).withColumns({at: F.col(f"{copy}.at"), head: F.col(f"{copy}.halo")})
    w = Window.partitionBy(at).orderBy(head, place)
    out = dealt.withColumns({f"next_{n}": F.lead(c).over(w) for n, c in carried.items()})
    return out.where(~F.col(head)).drop(place, at, head, sends, copy)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_chars, sketch, n_distinct of every row."""
    rows = text_columns(docs, id_col, text_col)
    return rows.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), sketch(F.col("text"), k, shingle).alias("sketch")).withColumn("n_distinct", distinct_count(F.col("sketch"), k))


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Each document, its edited text, the next document, and how alike their fingerprints are.

    The edit replaces the last floor(n / 2) code points by the first as many of the next document.
    """
    rows = text_columns(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("sketch", sketch(F.col("text"), k, shingle))
    paired = with_next(rows, "doc_id", {"text": F.col("text"), "sketch": F.col("sketch")}, F.xxhash64("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    paired = paired.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    paired = paired.select("doc_id", "n_chars", "sketch", "next_sketch", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited"), k, shingle).alias("edited_sketch"))
    return paired

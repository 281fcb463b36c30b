"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of other tables and of results, to clash with.
EXTRA = ", node long, hash string, score double, spans string, h long, sketch string, item string, words string, __hash long"


def words(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 5))) for _ in range(n))


def edited(text: str, every: int) -> str:
    return " ".join(f"x{i}" if i % every == every - 1 else w for i, w in enumerate(text.split(" ")))


def texts() -> list[tuple[int, str | None]]:
    shared = words(500, 60)
    out = [(1, None), (2, ""), (3, "one"), (4, "one two three"), (5, "  \n\t "), (6, "Ünïcode 梦 tëxt\n" + words(6, 50))]
    for i in range(7, 27):
        out.append((i, words(i, 80 + i)))
    out += [(i, words(7, 87)) for i in (31, 32, 33)]  # exact copies of 7
    out += [(40, edited(words(8, 88), 40)), (41, edited(words(8, 88), 44)), (42, words(8, 88).upper())]
    out += [(50, words(51, 20) + " " + shared + " " + words(52, 20)), (53, words(53, 30) + "\n" + shared), (54, shared), (55, words(55, 5) + " " + shared + " " + shared)]
    out += [(60, words(60, 20_000)), (61, "same " * 300), (62, "a" * 50_000), (63, "one two three")]
    out += [(63, "one two three"), (64, words(64, 40)), (64, words(65, 40))]  # a repeated row, a repeated id
    out += [(-5, words(70, 45)), (9_000_000_000, words(71, 45))]
    return out


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    full = [(d, t, "en", f"src{(d or 0) % 3}", len(t or ""), 1, "x", 0.5, "y", 2, "z", "i", "w", 3) for d, t in rows]
    return spark.createDataFrame(full, DOC + EXTRA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOC + EXTRA)

"""Small tables with the awkward rows that every corpus operator has to take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, ranges string, _row string, k1 string"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghinorstu") for _ in range(r.randint(2, 8))) if r.random() < 0.3 else f"w{r.randrange(vocabulary)}" for _ in range(n))


def awkward(spark):
    """Nulls in each column, empty, blank and very long texts, ties, repeated rows, wide characters, clashing column names."""
    base = [prose(i, 60 + 15 * i) for i in range(12)]
    shared = prose(99, 70)
    rows = [(i, t, "en" if i % 2 else "de", f"src{i % 3}") for i, t in enumerate(base)]
    rows += [(20, base[3], "en", "src0"), (21, base[4] + " tail", "en", None), (22, f"{base[5]}\n{shared}", None, "src1"), (23, f"{shared} {base[6]}", "en", "src1"),
             (24, None, None, None), (25, "", "en", "src2"), (26, " \t\n ", "de", "src2"), (27, "a", "en", "src0"), (28, "same five words are here", "en", "src0"),
             (None, base[7], "en", "src1"), (None, "no id " + base[8], "de", None), (None, None, None, None),
             (30, prose(7, 20000), "en", "src0"), (31, "Est " * 3000, "fr", "src1"), (32, "漢字 🙂 é " * 80, "ja", "ß"), (33, "x" * 5000, "en", "src2"),
             (40, base[9] + " twin", "en", "src0"), (40, base[9] + " twin", "en", "src0"), (41, base[10], "en", "src1"), (41, "other " + base[11], "en", "src1")]
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 7, "x", "y", "z") for i, t, lang, s in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def with_hot_groups(spark, copies: int = 150):
    """A third of the rows are copies of one text, another third near copies with one shared passage."""
    base, passage = prose(1, 120), prose(2, 60)
    rows = [(i, base) for i in range(copies)]
    rows += [(copies + i, f"{passage} {prose(3, 200)} edit{i}") for i in range(copies)]
    rows += [(2 * copies + i, f"{prose(1000 + i, 80)} {passage} {prose(5000 + i, 40)}") for i in range(copies)]
    return spark.createDataFrame([(i, t, "en", "src0", len(t), 7, "x", "y", "z") for i, t in rows], SCHEMA)


def sorted_rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: tuple((x is None, x) for x in r))

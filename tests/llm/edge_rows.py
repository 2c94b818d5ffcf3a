"""Rows that every operator must survive: NULLs, empties, ties, repeats, long texts, clashing names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, copies long, kept boolean, row long, root long, a long, b long"
EXTRA = (0.5, 7, True, 1, 2, 3, 4)


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(ws, places):
    return [f"edit{i}" if i in places else w for i, w in enumerate(ws)]


def edge_documents():
    base = words(1, 160, 5000)
    long = " ".join(words(2, 9000, 9000))
    rows = [
        (1, " ".join(base), "en", "s1"),
        (2, "  ".join(base) + "\n", "en", "s1"),  # equal but for white space, and longer
        (3, " ".join(edited(base, {40, 90})), "en", "s2"),
        (4, None, "en", "s2"),
        (5, "", None, None),
        (6, " \t\n", "de", None),
        (7, "12345 !!!", "de", "s3"),
        (8, long, "en", "s1"),
        (9, long + " tail", None, "s1"),
        (10, "word", "en", "s3"),
        (10, "word", "en", "s3"),  # repeated row
        (None, "no id here at all", "en", "s2"),
        (None, None, None, None),
        (12, "Ünïcödé İ ẞ 𝔘 K letters", "de", "s3"),
        (13, " ".join(words(3, 30, 5000)) + " " + " ".join(base[20:90]) + " " + " ".join(words(4, 30, 5000)), "en", "s3"),
        (14, "same same same " * 60, "en", "s3"),
    ]
    return [(i, t, lang, s, len(t) if t is not None else None, *EXTRA) for i, t, lang, s in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(edge_documents() if rows is None else rows, DOCS)

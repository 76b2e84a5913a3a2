"""Small hand-made tables with the awkward rows that every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(n))


def rows():
    long = prose(99, 6000)
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    out = [
        (0, base, "en", "b", 1),
        (1, base, "en", "b", 1),
        (2, " ".join(near), "en", "b", 1),
        (3, None, "en", "a", None),
        (4, "", None, None, 0),
        (5, " \t\n", "en", "", 3),
        (6, "One Two", "en", "a", 7),
        (7, long, "en", "c", len(long)),
        (8, "é€😀 É mixed ÀB 😀😀\n\nsecond section\npart", "fr", "é", 30),
        (9, "word " * 50, "en", "a", 250),
        (None, prose(5, 40), "en", "a", 3),
        (10, prose(6, 30), "en", "a", 4),
        (10, prose(6, 30), "en", "a", 4),
        (-3, prose(7, 200) + "\n" + prose(8, 90), "en", "z", 4),
    ]
    out += [(100 + i, prose(200 + i, 10 + 7 * i), "en", "abc"[i % 3], 5) for i in range(30)]
    return out


def frame(spark, some=None):
    """The table, in several partitions, with columns whose names clash with results and helpers."""
    df = spark.createDataFrame(rows() if some is None else some, DOCS).repartition(3)
    return df.selectExpr("*", "'x' as score", "1 as size", "2 as fp", "3 as spans", "'k' as fingerprint", "4 as n_words", "5 as target", "6 as block", "7 as part")

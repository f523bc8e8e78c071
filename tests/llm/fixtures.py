"""Small messy documents: nulls in every column, empty and long texts, ties, repeated rows, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, score double, value string"


def messy(n=120, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows = []

    def add(i, text, lang="en", source="s1"):
        rows.append((i, text, lang, source, len(text or ""), False, 1, 0.5, "x"))

    base = [" ".join(rng.choice(words) for _ in range(rng.randint(15, 60))) for _ in range(n)]
    for i, t in enumerate(base):
        add(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "hot", "hot", None]))
    for i in range(30):  # copies, with other case
        add(1000 + i, base[i % 5].upper() if i % 2 else base[i % 5])
    for i in range(40):  # near copies of one text, by one word each
        w = base[7].split(" ")
        w[i % len(w)] = f"x{i}"
        add(2000 + i, " ".join(w))
    shared = "This very line is shared by many documents of the table"
    for i in range(20):
        add(3000 + i, f"{base[20 + i]}\n  {shared.upper() if i % 3 else shared}\t\n\nshort\nshort")
    add(4000, None)
    add(4001, "")
    add(4002, " \t\n ")
    add(4003, "one")
    add(4004, "ONE")
    add(4005, "Été été")
    add(4006, "éTÉ été")
    add(4007, " ".join(words * 12))  # long
    add(None, base[0], None, None)
    add(None, "nobody has this id at all", None, None)
    for _ in range(3):  # a row three times
        add(5000, "the same row comes again and again and again, id and all")
    return rows


def frame(spark, rows=None, parts=3):
    return spark.createDataFrame(messy() if rows is None else rows, SCHEMA).repartition(parts)

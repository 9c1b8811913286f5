"""Small documents with the hard cases: nulls, empty and long texts, repeats, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(g, n):
    return " ".join("".join(g.choices("abcdefghijklmnop", k=g.randint(2, 7))) for _ in range(n))


def documents(spark, rows, extra=""):
    """Rows (doc_id, text[, source[, lang]]) as a documents table, with further columns of clashing names if asked."""
    data = []
    for r in rows:
        doc, text, source, lang = (*r, "s", "en")[:4] if len(r) < 4 else r
        data.append((doc, text, lang, source if len(r) > 2 else "s", len(text) if text is not None else None))
    df = spark.createDataFrame(data, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for name in ("key", "bucket", "component", "loom_drop", "digest", "host", "a", "b", "item_id", "loom_row"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def awkward(seed=1):
    g = random.Random(seed)
    long = words(g, 30_000)
    return [(1, None), (2, ""), (3, "  \n\t "), (None, "null id text here now"), (4, "one"), (5, long), (6, long), (6, long), (7, "!!! ... ???"), (8, "é😀 ünï\r\ncode")]

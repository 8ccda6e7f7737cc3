"""Small inputs and plain versions that the tests of the text operators share."""

import re
from collections import Counter

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(text or "")


def docs(spark, rows):
    """Documents from (id, text) or (id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def with_odd_columns(df):
    """The same rows with columns whose names an operator might make itself."""
    names = "score size target taken ids decoded key words bands sig rep bucket band n h g w c pos gone hit row list part block t e s f kinds starts ends terms failed kept predicted held_out"
    for name in names.split():
        df = df.withColumn(name, F.lit("mine"))
    return df


def shingles(text, size=5):
    w = words_of(text)
    if len(w) < size:
        return Counter([tuple(w)] if w else [])
    return Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    both = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


def sentence(draw, n, names=2000):
    return " ".join(f"w{draw.randrange(names)}" for _ in range(n))

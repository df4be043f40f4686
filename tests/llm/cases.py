"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = ["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "ou", "is", "été", "größe"]


def prose(seed, words=60):
    rng = random.Random(seed)
    made = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    return "".join(w + rng.choice([" ", " ", " ", ". ", ", ", "\n"]) for w in made).strip()


def texts():
    base = prose(1, 120)
    words = base.split(" ")
    near = " ".join(words[:50] + ["changed"] + words[51:])
    far = " ".join(w if k % 3 else "other" for k, w in enumerate(words))
    odd = ["", " ", "\n\n", "a", "one two", "one  two\tthree", "A-b_C, d!", "é́   x", "<|endoftext|> x", "\x1c y", "12 3.4.5.6 7"]
    return [None, *odd, base, base, near, far, base.upper(), prose(2, 3), prose(3, 6000), *(prose(k) for k in range(4, 20))]


def docs(spark, rows=None):
    """doc_id, text, lang, source, n_chars; one row twice; the columns that operators might use are there as well."""
    rows = list(enumerate(texts())) if rows is None else rows
    rows = [*rows, rows[-1]] if rows else rows
    made = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows], SCHEMA)
    return made.repartition(3).withColumns({c: F.lit(7) for c in ("id", "n", "bucket", "hub", "component", "score", "shard", "piece", "length", "next_text", "text_hash", "e", "t", "a", "b", "part", "kept")})


def empty(spark):
    return docs(spark, [])

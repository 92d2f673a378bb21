"""Small fixtures and the documents' schema."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE_WORDS = re.compile("[^\x20\x09-\x0d]+")


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, DOCS)


def prose(seed, n, vocabulary=4000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)

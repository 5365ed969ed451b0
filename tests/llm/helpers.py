"""Small inputs for the corpus operators."""

import random
import zlib

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, score DOUBLE, node STRING, _s STRING, word STRING"


def table(spark, texts, langs=None):
    """documents with columns whose names clash with those that operators make; texts: text or (id, text)."""
    rows = []
    for k, t in enumerate(texts):
        i, t = t if isinstance(t, tuple) else (k, t)
        rows.append((i, t, langs[k] if langs else None, None, None if t is None else len(t), None, "x", None, "y"))
    return spark.createDataFrame(rows, SCHEMA)


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def rng(seed=0):
    return random.Random(seed)

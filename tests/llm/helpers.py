from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, parts=3):
    """(doc_id, text) rows as documents."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA).repartition(parts)


def words(rng: random.Random, n: int, size: int = 400) -> str:
    return " ".join(f"w{int(size * rng.random() ** 2)}" for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls, empties, white space, repeats, ties, a long text, letters beyond ASCII."""
    rng = random.Random(5)
    long = words(rng, 6000)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "Ünïcode  straße — 東京 İ"), (7, long), (8, long), (8, long), (9, long + " end"), (None, "no id at all"), (None, "no id at all"), (10, "it's they'll  double  spaces 12345 <|endoftext|> x"), (11, "a " * 50)]


def collected(df, *keys):
    return sorted((tuple(r) for r in df.collect()), key=repr)

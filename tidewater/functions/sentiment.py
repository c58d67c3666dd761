"""Sentiment of headlines: a lexicon as Column expressions, or any model by batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.scalars import col, signed_label, signed_sentiment

POSITIVE = ("beat", "gain", "gains", "growth", "jump", "profit", "raise", "record", "rally", "strong", "surge", "upgrade")
NEGATIVE = ("cut", "decline", "downgrade", "drop", "fall", "fraud", "lawsuit", "loss", "miss", "plunge", "recall", "weak")


def words_of(text: Column | str) -> Column:
    """The lower-cased words; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def lexicon_score(text: Column | str, positive: tuple[str, ...] = POSITIVE, negative: tuple[str, ...] = NEGATIVE) -> Column:
    """(positive - negative words) / both, in [-1, 1]; 0 without any."""
    words = words_of(text)
    count = lambda lexicon: F.size(F.filter(words, lambda w: w.isin(*lexicon)))
    p, n = count(positive), count(negative)
    return F.when(p + n == 0, F.lit(0.0)).otherwise((p - n) / (p + n))


def lexicon_label(score: Column | str) -> Column:
    score = col(score)
    return F.when(score > 0, "positive").when(score < 0, "negative").otherwise("neutral")


def scored_texts(df: DataFrame, text: str, model: Callable[[list[str]], list[tuple[str, float]]]) -> DataFrame:
    """Adds sentiment_label and sentiment_score of a classifier that gives (label, confidence) for each text of a batch.

    The model gets whole texts; one that takes no more than so many tokens cuts them itself.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = model([t or "" for t in pdf[text]])
            yield pdf.assign(_label=[f[0] for f in found], _score=[float(f[1]) for f in found])

    out = df.mapInPandas(run, f"{schema}, _label string, _score double")
    return out.withColumns({"sentiment_label": signed_label("_label"), "sentiment_score": signed_sentiment("_label", "_score")}).drop("_label", "_score")

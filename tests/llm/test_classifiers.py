from __future__ import annotations

import random
import tracemalloc
import zlib

import numpy as np
import pytest

from tidewater.llm import quality, toxicity

from .helpers import collected, frame, odd_rows, words

LABELS = "doc_id long, quality int, toxic int"


def labelled(spark, n=400):
    """Texts with slurs are toxic, shouting is of low quality."""
    rng, rows, labels = random.Random(1), [], []
    for i in range(n):
        toxic, bad = rng.random() < 0.3, rng.random() < 0.3
        text = words(rng, 60) + (" you grumblefoo." if toxic else ".") + (" the women here." if rng.random() < 0.5 * toxic + 0.1 else "")
        rows.append((i, text.upper() + "!!!" if bad else text))
        labels.append((i, int(not bad), int(toxic)))
    labels += [(5, None, None), (None, 1, 1), (10**6, 0, 1)]
    return rows, spark.createDataFrame(labels, LABELS), {i: (q, t) for i, q, t in labels if q is not None}


@pytest.mark.parametrize(("op", "label", "folds", "fold", "threshold"), [(toxicity.toxicity, 1, 5, 0, 0.5), (quality.quality, 0, 4, 2, 0.7)])
def test_held_out_accuracy(spark, op, label, folds, fold, threshold):
    rows, labels, truth = labelled(spark)
    docs = frame(spark, rows + [(1000 + (i or 0), t) for i, t in odd_rows()] + [(None, "none"), (3, rows[3][1])]).withColumnsRenamed({"lang": "y", "source": "h"})
    got = op(docs, labels).collect()
    assert len(got) == len(rows) + len(odd_rows()) + 2
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % folds == fold)
    out = [r for r in got if r["held_out"] and r["doc_id"] in truth and r["doc_id"] < 1000]
    assert np.mean([r["predicted"] == truth[r["doc_id"]][label] for r in out]) > 0.9


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    rows, labels, _ = labelled(spark, 150)
    docs = frame(spark, rows)
    flipped = labels.selectExpr("doc_id", "quality", "if(pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0, 1 - toxic, toxic) as toxic")
    assert collected(toxicity.toxicity(docs, labels)) == collected(toxicity.toxicity(docs, flipped))


@pytest.mark.parametrize("op", [toxicity.toxicity, quality.quality])
def test_few_labels(spark, op):
    none = spark.createDataFrame([], LABELS)
    assert [r["score"] < 0.01 for r in op(frame(spark, [(1, "a"), (2, None)]), none).collect()] == [True, True]
    one = spark.createDataFrame([(1, 1, 1), (3, 1, 1)], LABELS)
    assert all(r["score"] > 0.99 for r in op(frame(spark, [(1, "a"), (3, "b"), (4, None)]), one).collect())
    assert op(frame(spark, []), one).count() == 0


def test_counterfactuals_take_the_weight_from_group_names():
    """Toxic texts here mostly name a group; without the penalty its name is held against neutral mentions."""
    rng, texts, y, pairs = random.Random(2), [], [], []
    for _ in range(400):
        toxic = rng.random() < 0.4
        text = words(rng, 8) + (" grumblefoo" if toxic and rng.random() < 0.7 else "") + (" muslims" if rng.random() < (0.8 if toxic else 0.05) else "")
        texts.append(np.array(sorted(toxicity.features(toxicity.words_of(text)))))
        y.append(toxic)
        pairs += [(np.array(a), np.array(b)) for a, b in toxicity.counterfactuals(text)]
    score = lambda model, text: toxicity.Scorer(*model).score(text)
    free = toxicity.fit(texts, np.array(y, float), pairs, counterfactual=0.0)
    held = toxicity.fit(texts, np.array(y, float), pairs, counterfactual=20.0)
    mention, neutral = "w1 muslims", "w1"
    assert score(held, mention) - score(held, neutral) < 0.3 * (score(free, mention) - score(free, neutral))
    assert score(held, "w1 grumblefoo") > 0.5


def test_swaps():
    assert toxicity.counterfactuals("No names here. Women sing! Fine") == [(sorted(toxicity.features({"women", "sing"}) - toxicity.features({"men", "sing"})), sorted(toxicity.features({"men", "sing"}) - toxicity.features({"women", "sing"})))]
    assert toxicity.counterfactuals("") == []


def test_flattened_trees_are_the_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.5)).astype(float)
    forest = quality.fit(x, y, trees=20)

    def one(row):
        total = forest.base
        for at in forest.roots:
            while forest.statistic[at] >= 0:
                at = forest.left[at] + (row[forest.statistic[at]] > forest.threshold[at])
            total += forest.value[at]
        return total

    assert np.allclose(forest.raw(x), [one(r) for r in x])
    assert ((forest.scores(x) > 0.5) == y).mean() > 0.95
    assert len(quality.statistics("a B.\nc")) == len(quality.STATISTICS) == len(quality.statistics(None))


def test_rejected_documents_go(spark):
    rows, labels, _ = labelled(spark, 200)
    docs = frame(spark, rows)
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, labels).collect()}
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, p in scored.items() if not p)


def test_labelled_rows_are_bounded_after_the_join(spark):
    docs = frame(spark, [(1, f"text {i}") for i in range(50)] + [(2, "two"), (3, "three")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    assert toxicity.labelled(docs, labels, "toxic", 5, 0, 10).count() <= 10


def test_the_fit_holds_little_beside_its_rows(monkeypatch):
    """Six million features of rows: two numbers of 4 bytes each, and what a piece takes."""
    monkeypatch.setattr(toxicity, "STEPS", 2)
    texts = [np.arange(i % 7, 3000 + i % 7, dtype=np.int32) for i in range(2000)]
    tracemalloc.start()
    toxicity.fit(texts, np.arange(2000) % 2 * 1.0, [])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_products_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(toxicity, "PIECE", piece, raising=False)
    rng = np.random.default_rng(4)
    lists = [np.unique(rng.integers(0, 40, n)) for n in (5, 0, 30, 1, 0, 25, 12, 3)]
    x = toxicity.Sparse(lists)
    dense = np.array([[int(k in row) for k in x.known] for row in lists])
    assert x.known.tolist() == [k for k in range(40) if sum(k in row for row in lists) >= toxicity.MIN_TEXTS]
    w, v = rng.normal(size=len(x.known)), rng.normal(size=len(lists))
    assert np.allclose(x.times(w), dense @ w) and np.allclose(x.transposed(v), dense.T @ v)
    assert toxicity.Sparse([], x.known).times(w).tolist() == []

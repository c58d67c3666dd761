from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import periodic
from tidewater.llm.registry import op12_periodic_runs

from .helpers import frame, odd_rows, words


def plain_runs(seq, min_length=6, exponent=4):
    """Every period's stretches of words that are equal to those q further on, the smallest period of each."""
    found, n = {}, len(seq)
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and seq[j] == seq[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(min_length, exponent * q):
                found.setdefault((i, length), q)
            i = max(j, i) + 1
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("ab"), min_size=1, max_size=5), st.integers(1, 7)), max_size=9), st.sampled_from([(6, 4), (3, 3), (9, 3), (2, 5)]))
def test_runs_of_small_alphabets(parts, limits):
    seq = [w.encode() for part, times in parts for w in part * times]
    assert periodic.block_runs([seq, seq[::-1]], *limits) == [plain_runs(seq, *limits), plain_runs(seq[::-1], *limits)]


def test_runs_in_long_texts():
    rng = random.Random(1)
    texts = []
    for _ in range(30):
        text = words(rng, 400, 60).split()
        for _ in range(rng.randrange(4)):
            at, p = rng.randrange(len(text)), rng.randrange(1, 40)
            text[at:at] = (text[at : at + p] * 6)[: rng.randrange(1, 6 * p + 1)]
        texts.append([w.encode() for w in text])
    passage = [w.encode() for w in words(rng, 300, 10_000).split()]
    texts += [[b"a"] * 2000, [b"a", b"b"] * 900, passage * 5, (passage + [b"x"] * 9) * 3, [], [b"a"]]
    found = periodic.block_runs(texts)
    assert found == [plain_runs(t) for t in texts]
    assert found[30:33] == [[(0, 2000, 1)], [(0, 1800, 2)], [(0, 1500, 300)]]


def test_one_word_and_one_period_are_no_quadratic_work():
    import time

    began = time.perf_counter()
    found = periodic.block_runs([[b"a"] * 200_000, [str(i % 977).encode() for i in range(200_000)]])
    assert found == [[(0, 200_000, 1)], [(0, 200_000, 977)]]
    assert time.perf_counter() - began < 60


def test_low_exponents_are_refused():
    with pytest.raises(ValueError):
        periodic.block_runs([[b"a"]], 6, 2)


def plain_row(doc_id, text):
    ws = (text or "").encode().split()
    if doc_id is not None and ws:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % len(ws)
            p = 1 + (len(ws) - a) // (3 + g % 8)
            ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
    runs = plain_runs(ws)
    over = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(ws) if i not in over)))


def rows_of_everything():
    rng = random.Random(2)
    rows = odd_rows()
    rows += [(k, words(rng, rng.choice([3, 9, 40, 400]), 50)) for k in range(100, 300)]
    rows += [(k, " ".join(["x"] * 7 + ["y z"] * 4 + ["w"] * 28)) for k in range(400, 420)]  # ties
    return rows


def test_query_on_odd_rows(spark, tmp_path):
    rows = rows_of_everything()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = op12_periodic_runs(spark, str(tmp_path))
    assert dict(found.dtypes) == {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"}
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((plain_row(*r) for r in rows), key=repr)


def test_query_on_the_table(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    long = {r[0] for r in docs if len((r[1] or "").split()) >= 3000}
    assert sorted(tuple(x) for x in op12_periodic_runs(spark, d).collect() if x["doc_id"] not in long) == sorted(plain_row(*r) for r in docs if r[0] not in long)


def test_operator_of_nothing_and_with_clashing_columns(spark):
    empty = frame(spark, [])
    assert periodic.find_runs(empty).count() == 0
    assert periodic.digests(periodic.find_runs(empty)).count() == 0
    clash = spark.createDataFrame([(1, "a b " * 6, 5, "x")], "doc_id long, text string, runs int, collapsed string")
    row = periodic.find_runs(clash).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 12, 2)] and row["collapsed"] == "a b" and row["n_words"] == 12

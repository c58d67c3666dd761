from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest

from tidewater.llm import hyperminhash
from tidewater.llm.registry import ORACLES, op13_minhash

from .helpers import frame, odd_rows, words
from .test_duplicates import reachable
from .test_similar import changed


def plain_set(text, n=4):
    parts = (text or "").encode().lower().split()
    return {tuple(parts[i : i + n]) for i in range(max(1, len(parts) - n + 1))} if parts else set()


def plain_rows(rows):
    sets = [plain_set(t) for _, t in rows]
    label = reachable(list(range(len(rows))), lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    least = {}
    for (i, _), k in zip(rows, label, strict=True):
        if i is not None:
            least[k] = min(i, least.get(k, i))
    out = []
    for (i, _), k, s in zip(rows, label, sets, strict=True):
        component = least.get(k) if s else i
        out.append((i, len(s), component, i == component))
    return sorted(out, key=repr)


def near_and_far():
    rng = random.Random(3)
    rows = odd_rows()
    for k in range(14):
        base = words(rng, rng.choice([5, 8, 12, 30, 90, 300]), 200)
        n = len(base.split())
        rows += [(1000 + 20 * k + i, changed(rng, base, rng.choice([0, 1, 1, 2, n // 40, n // 25, n // 20]))) for i in range(14)]
    passage = words(rng, 60, 5000)
    rows += [(2000 + i, f"{words(rng, 12, 5000)} {passage} {words(rng, 12, 5000)}") for i in range(60)]
    rows += [(2100 + i, f"{passage} {words(rng, 2 + i % 9, 5000)}") for i in range(60)]
    return rows


@pytest.mark.parametrize("block", [2048, 7])
def test_every_link_is_found(spark, block):
    rows = near_and_far()
    found = hyperminhash.near_duplicates(frame(spark, rows), block=block)
    assert found.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert sorted(map(tuple, found.collect()), key=repr) == plain_rows(rows)


def test_query_against_its_sql(spark):
    d = "/root/testdata/sf0.001"
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet')")
        names = ("doc_id", "n_shingles", "component_id", "kept")
        expected = db.sql(f"SELECT {', '.join(names)} FROM ({ORACLES['op13_minhash']})").fetchall()
    assert sorted(tuple(r) for r in op13_minhash(spark, d).select(*names).collect()) == sorted(expected)


def test_nothing_empties_and_clashing_columns(spark):
    assert hyperminhash.near_duplicates(frame(spark, [])).count() == 0
    rows = [(5, None), (4, ""), (3, " \n"), (2, "\u00a0"), (1, "\u00a0 ")]
    assert sorted(map(tuple, hyperminhash.near_duplicates(frame(spark, rows)).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True)]
    clash = spark.createDataFrame([(1, "a b c d e", 7, "x"), (2, "A b c d e", 8, "y")], "doc_id long, text string, node int, key string")
    assert sorted(map(tuple, hyperminhash.near_duplicates(clash).collect())) == [(1, 2, 1, True), (2, 2, 1, False)]


def random_sets(rng, n, shared):
    both = rng.integers(0, 1 << 64, shared, np.uint64)
    return [np.unique(np.concatenate([both, rng.integers(0, 1 << 64, n - shared, np.uint64)])) for _ in range(2)]


def test_registers_keep_zeros_and_mantissa_of_the_least():
    rng = np.random.default_rng(1)
    for n in (1, 5, 300, 5000):
        s, _ = random_sets(rng, n, n)
        for k, reg in enumerate(hyperminhash.registers(s).tolist()):
            of = [int(h) & ((1 << 57) - 1) for h in s.tolist() if int(h) >> 57 == k]
            if not of:
                assert reg == 0
                continue
            bits = f"{min(of):057b}"[:52]
            zeros = len(bits) - len(bits.lstrip("0"))
            assert reg - 1 == zeros << 10 | int((bits[zeros + 1 :] + "0" * 10)[:10], 2)


def test_estimates_are_near_and_corrected_for_accidents():
    rng = np.random.default_rng(2)
    for shared in (0, 1000, 1500, 1778):
        pairs = [random_sets(rng, 2000, shared) for _ in range(200)]
        x, y = (np.stack([hyperminhash.registers(p[k]) for p in pairs]) for k in (0, 1))
        n = np.full(200, 2000)
        guess, either = hyperminhash.estimated(x, y, n, n)
        assert abs(guess.mean() - shared / (4000 - shared)) < 0.012 and (either == 128).all()
        if shared == 1778:  # 0.8
            assert hyperminhash.near(x, y, n, n).all()
        if not shared:
            assert not hyperminhash.near(x, y, n, n).any()
    # Few bits of mantissa make accidents common: their number follows the closed form.
    x, y = ((rng.exponential(1 / 15.6, 200_000)) for _ in range(2))
    cell = lambda v: (np.floor(-np.log2(v)), np.floor((v * 2.0 ** (np.floor(-np.log2(v)) + 1) - 1) * 1024))
    equal = np.mean([(p == q).all() for p, q in zip(np.stack(cell(x), 1), np.stack(cell(y), 1), strict=True)])
    assert abs(equal * 128 - hyperminhash.by_accident([2000], [2000])[0]) < 0.02


def test_bands_of_empty_registers_are_no_keys():
    regs = np.zeros((2, 128), np.uint16)
    regs[1, 5] = 9
    row, band, key = hyperminhash.bands(regs)
    assert row.tolist() == [1] and band.tolist() == [1] and len(key) == 1


@pytest.mark.parametrize("columns", [1024, 3])
def test_links_of_a_bucket_join_what_all_links_join(monkeypatch, columns):
    monkeypatch.setattr(hyperminhash, "COLUMNS", columns)
    rng = random.Random(columns)
    base = [rng.sample(range(400), 60) for _ in range(4)]
    sets = []
    for _ in range(70):
        s = rng.choice(base)[:]
        for k in rng.sample(range(60), rng.choice([0, 2, 4, 7, 12])):
            s[k] = 1000 + rng.randrange(10_000)
        sets.append(np.unique(np.array(s, np.uint64)))
    of = np.array([rng.randrange(200) for _ in sets])
    similar = lambda a, b: 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b])) and of[a] != of[b]
    links = hyperminhash.spanning_links(sets, of)
    assert links and all(similar(a, b) for a, b in links) and len(links) < len(sets)
    known = {frozenset(x) for x in links}
    everyone = list(range(len(sets)))
    assert reachable(everyone, similar) == reachable(everyone, lambda a, b: frozenset((a, b)) in known)


def test_partners_are_looked_at_in_the_first_band_that_they_share():
    rng = np.random.default_rng(3)
    sets = random_sets(rng, 900, 850)
    regs = np.stack([hyperminhash.registers(s) for s in sets])
    both = np.flatnonzero((regs[0] == regs[1])[:126].reshape(42, 3).all(axis=1)).tolist()
    looked = [b for b in both if hyperminhash.with_partners(b, 0, 0, np.zeros(2, int), np.array([900, 900]), np.array([1, 2]), regs, (4, 5)).all()]
    assert len(both) > 10 and looked == both[:1]
    assert hyperminhash.with_partners(hyperminhash.NO_BAND, 0, 0, np.zeros(2, int), np.array([900, 900]), np.array([1, 2]), regs, (4, 5)).all()
    assert not hyperminhash.with_partners(both[0], 0, 0, np.zeros(2, int), np.array([900, 900]), np.array([1, 1]), regs, (4, 5)).any()

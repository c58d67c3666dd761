from __future__ import annotations

import random

import pytest

from tidewater.llm import similar

from .helpers import frame, odd_rows, words
from .test_duplicates import plain_fingerprint, reachable


def plain_set(text):
    parts = (text or "").encode().lower().split()
    return {tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))}


def changed(rng, text, n):
    parts = text.split()
    for i in rng.sample(range(len(parts)), n):
        parts[i] = f"x{rng.random()}"
    return " ".join(parts)


@pytest.mark.parametrize("common", [8, 2])
def test_near_copies_at_four_fifths(spark, monkeypatch, common):
    """Every pair with 0.8 of its five-word shingles in common is linked, and none below."""
    monkeypatch.setattr(similar, "COMMON", common)
    rng = random.Random(3)
    rows = odd_rows()
    for k in range(12):
        base = words(rng, rng.choice([30, 90, 300]))
        rows += [(1000 + 20 * k + i, changed(rng, base, rng.choice([0, 1, 2, len(base.split()) // 40, len(base.split()) // 20]))) for i in range(12)]
    sets, fps = [plain_set(t) for _, t in rows], [plain_fingerprint(t) for _, t in rows]
    near = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    label = reachable(list(range(len(rows))), near)
    least = [min((i for (i, _), m in zip(rows, label, strict=True) if m == k and i is not None), default=None) for k in set(label)]
    kept = similar.keep_one_of_similar(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(least, key=repr)
    by_bits = reachable(list(range(len(rows))), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    assert len(set(label)) < len(set(by_bits))


def test_similar_documents_of_nothing(spark):
    assert similar.keep_one_of_similar(frame(spark, [])).count() == 0


def test_the_stage_takes_out_near_copies(spark):
    import corpus_pipeline

    rng = random.Random(4)
    base = words(rng, 300)
    rows = [(1, base), (2, changed(rng, base, 6)), (3, words(rng, 300))]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect()) == [1, 3]


def test_short_texts_that_are_not_similar_stay(spark):
    """SimHashes of short texts are often near by chance: of 4,000 texts of 11 words that share 0.4 of their shingles all stay."""
    rng = random.Random(9)
    rows = [(i, " ".join([f"common{k}" for k in range(8)] + [f"own{rng.random()}" for _ in range(3)])) for i in range(4000)]
    assert similar.keep_one_of_similar(frame(spark, rows)).count() == 4000


def test_every_document_is_counted_for_the_order(spark):
    """A passage in one of a hundred documents comes last, wherever in the table it is: here, in no document that one in three, by hash, would draw."""
    texts = [f"a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i} i{i} j{i} k{i} l{i}" for i in range(40_010)]
    docs = frame(spark, list(enumerate(texts)))
    drawn = {r["doc_id"] for r in docs.selectExpr("doc_id", "pmod(xxhash64(concat(text, ' and terms of use are here'), 1), 3) as k").where("k = 0").collect()}
    at = [i for i in range(len(texts)) if i not in drawn][:400]
    for i in at:
        texts[i] += " and terms of use are here"
    docs = frame(spark, list(enumerate(texts)))
    common = spark.sparkContext.broadcast(similar._common_shingles(docs, similar.WORDS))
    key = similar.shingles("terms of use are here")[0]
    rows = similar._rows(similar.with_row_key(docs), common, similar.WORDS, similar.SIMILAR).where("size = 14")
    prefixes = [similar.np.frombuffer(r["prefix"], similar.np.uint64) for r in rows.collect()]
    assert len(prefixes) == 400
    assert not any(key in p for p in prefixes)


def test_what_a_bucket_leaves_is_not_written_as_pairs(spark, monkeypatch):
    """300 texts of which any two share about 0.7 of their shingles: next to none goes, and no table has a row for each two."""
    rng = random.Random(6)
    base = words(rng, 300)
    rows = [(i, changed(rng, base, 6)) for i in range(300)]
    sets = [plain_set(t) for _, t in rows]
    label = reachable(list(range(300)), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    saved, sizes = similar.saved, {}

    def counted(df, name):
        out = saved(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(similar, "saved", counted)
    assert similar.keep_one_of_similar(frame(spark, rows)).count() == len(set(label)) > 200
    rows_of = {k: v for k, v in sizes.items() if k not in ("meetings", "members")}
    assert max(rows_of.values()) < 300 * 20, sizes


def test_what_a_middle_has_not_joined_is_linked(spark, monkeypatch):
    """Chains, in which neighbours are similar and others aren't, become one class each, in blocks of three sets too."""
    monkeypatch.setattr(similar, "BLOCK", 3)
    rng = random.Random(12)
    rows = []
    for k in range(4):
        parts = words(rng, 200).split()
        for i in range(25):
            parts = changed(rng, " ".join(parts), rng.choice([2, 3, 4])).split()
            rows.append((100 * k + i, " ".join(parts)))
    rng.shuffle(rows)
    sets = [plain_set(t) for _, t in rows]
    label = reachable(list(range(len(rows))), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    least = sorted(min(i for (i, _), m in zip(rows, label, strict=True) if m == k) for k in set(label))
    assert sorted(r["doc_id"] for r in similar.keep_one_of_similar(frame(spark, rows)).collect()) == least
    assert 4 <= len(least) < 90


def test_sketches_never_turn_similar_sets_away():
    np, rng = similar.np, random.Random(5)
    turned_away = 0
    for n in (1, 4, 9, 90, 900, 2040, 9000):
        a = np.array(sorted(rng.sample(range(2**62), n)), np.uint64)
        for gone in (0, n // 20, n // 9, n // 9 + 1, n // 2):
            for new in (0, gone, n // 9):
                b = np.unique(np.concatenate([a[gone:], np.array(rng.sample(range(2**62), new), np.uint64)]))
                sketches = similar.Sketches([similar.sketch_of(s) for s in (a, b, b)])
                bits = sketches.differ(0, np.array([1, 2]))
                assert (bits <= len(np.setxor1d(a, b))).all()
                near = similar._near_by_bits(bits, len(a), np.array([len(b)] * 2), similar.SIMILAR)
                assert near.all() or not similar.similar(a, b)
                turned_away += not near.any()
    assert turned_away > 5
    for n in (300, 1500, 3000, 9000):
        far = similar.Sketches([similar.sketch_of(np.array(sorted(rng.sample(range(2**62), k)), np.uint64)) for k in (n, n + 30)])
        assert not similar._near_by_bits(far.differ(0, np.array([1])), n, np.array([n + 30]), similar.SIMILAR).any()


def test_the_driver_gets_a_bit_for_each_slot_not_its_count(spark, monkeypatch):
    rng = random.Random(8)
    docs = frame(spark, [(i, words(rng, 300)) for i in range(60)] + [(100 + i, "terms of use are here") for i in range(30)] + [(200, None)])
    got, collect = [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda df: got.append(collect(df)) or got[-1])
    bits = similar._common_shingles(docs, similar.WORDS)
    assert 0 < sum(t.nbytes for t in got) < 1 << 20
    counts = similar.np.zeros(similar.COUNTERS, int)
    for r in docs.collect():
        counts[similar._counter_of(similar.shingles(r["text"])).astype(int)] += 1
    assert similar.np.unpackbits(bits).tolist() == (counts >= max(similar.COMMON, len(docs.collect()) / similar.RARE) + counts.mean()).astype(int).tolist()

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from tidewater.llm import components, fingerprint, simhash, similar, substrings

from .helpers import collected, frame, odd_rows, words


def plain_fingerprint(text):
    parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not parts:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(parts[i : i + 3]).encode(), 42) for i in range(max(1, len(parts) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(values, near):
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i in range(len(values)):
            for j in range(i):
                if label[i] != label[j] and near(values[i], values[j]):
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_simhash(spark):
    rng = random.Random(1)
    base = words(rng, 900)
    rows = odd_rows() + [(50 + i, base if i % 3 else " ".join(w if rng.random() > 0.004 else "x" for w in base.split())) for i in range(25)]
    got = simhash.near_duplicates(frame(spark, rows).withColumnsRenamed({"lang": "fp", "source": "component"}))
    fps = [plain_fingerprint(t) for _, t in rows]
    label = reachable(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {k: min((i for (i, _), m in zip(rows, label, strict=True) if m == k and i is not None), default=None) for k in set(label)}
    assert collected(got) == sorted(((i, f"{f:016x}", least[m]) for (i, _), f, m in zip(rows, fps, label, strict=True)), key=repr)
    kept = simhash.keep_one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(least.values(), key=repr)


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_links_of_random_fingerprints(spark, radius):
    rng = np.random.default_rng(radius)
    seeds = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = {int(s) ^ int(sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 6)).tolist()))) for s in seeds for _ in range(40)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long").repartition(3)
    found = {(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in simhash.links(df, radius).collect()}
    assert all((a ^ b).bit_count() <= radius for a, b in found)
    near = lambda a, b: (a ^ b).bit_count() <= radius
    assert reachable(fps, near) == reachable(fps, lambda a, b: (a, b) in found or (b, a) in found)


def test_simhash_of_nothing(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(0, 60)], [(0, i) for i in range(1, 50)] + [(100, 101), (101, 100)], [((i * 37) % 200, (i * 91 + 5) % 200) for i in range(120)]])
def test_components(spark, edges):
    got = dict(tuple(r) for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    nodes = sorted({x for e in edges for x in e})
    label = reachable(nodes, lambda a, b: (a, b) in edges or (b, a) in edges)
    assert got == {n: nodes[m] for n, m in zip(nodes, label, strict=True)}


def test_components_count_what_is_left_as_it_is_written(spark, monkeypatch):
    """No job of its own asks whether a round was the last."""
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    for name in ("count", "limit"):
        monkeypatch.setattr(type(chain), name, lambda *_: pytest.fail("a job of its own"))
    assert {r["component"] for r in components.connected_components(chain).collect()} == {0}


def plain_removal(rows, window):
    first: dict[tuple, float] = {}
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    key = lambda i: float("inf") if i is None else i
    for (i, _), ws in zip(rows, split, strict=True):
        for k in range(len(ws) - window + 1):
            g = tuple(ws[k : k + window])
            first[g] = min(first.get(g, key(i)), key(i))
    out = []
    for (i, _), ws in zip(rows, split, strict=True):
        gone = {k + j for k in range(len(ws) - window + 1) if first[tuple(ws[k : k + window])] < key(i) for j in range(window)}
        text = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(text.encode()).hexdigest(), text))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "bits"), [(1 << 24, 1 << 24), (2000, 1 << 24), (2000, 1 << 12)])
def test_substrings(spark, monkeypatch, block, bits):
    """Also with a sketch that is far too small: slower, not different."""
    monkeypatch.setattr(substrings, "BLOCK_BYTES", block)
    monkeypatch.setattr(substrings, "CHUNK", 1 << 10)
    rng = random.Random(3)
    passage = words(rng, 30)
    rows = odd_rows() + [(20 + i, f"{words(rng, 40)} {passage if i % 3 == 0 else ''} {words(rng, 20)} {passage if i % 5 == 0 else ''}") for i in range(30)]
    rng.shuffle(rows)
    docs = frame(spark, rows, 4).withColumnsRenamed({"lang": "ref", "source": "part"})
    got = substrings.remove_repeats(docs, max_bits=bits, with_text=True)
    assert collected(got) == plain_removal(rows, 13)


def test_substrings_of_nothing(spark):
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


def test_blocks_of_a_task_share_a_sketch(spark, monkeypatch):
    """A task sends a chunk once for all the windows that it holds, not once a block: slots lie denser and take fewer bytes."""
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 2000)
    rng = random.Random(4)
    rows = [(i, words(rng, 60)) for i in range(200)]
    parts, merged = [], substrings.merged
    monkeypatch.setattr(substrings, "merged", lambda sent, *rest: parts.append(sent.count()) or merged(sent, *rest))
    docs = frame(spark, rows, 1)
    substrings.merged_sketch(docs, 13, 2, substrings.CHUNK)
    assert parts == [2]
    monkeypatch.setattr(substrings, "SKETCH_WINDOWS", 100)
    monkeypatch.setattr(substrings, "ASKED_WINDOWS", 100)
    monkeypatch.setattr(substrings, "PACKED_SLOTS", 7)
    monkeypatch.setattr(substrings, "CHUNK", 1 << 10)
    rows += [(1000 - i, t) for i, t in rows[:50]]
    assert collected(substrings.remove_repeats(frame(spark, rows, 2), with_text=True)) == plain_removal(rows, 13)


def test_packed_runs_of_documents():
    """Beside hashes (12 bytes) and reference (8) a document's only window in a part takes few bytes, and comes back."""
    rng = np.random.default_rng(5)
    docs = np.cumsum(rng.integers(1, 200, 2000)) + 10**12
    docs[-1] = substrings.NO_ID
    refs, h1 = rng.integers(-(1 << 63), 1 << 63, 2000), rng.integers(0, 1 << 64, 2000, dtype=np.uint64)
    pos, h2 = rng.integers(0, 600, 2000).astype(np.int32), rng.integers(0, 1 << 32, 2000).astype(np.uint32)
    data = substrings.pack(docs, refs, pos, h1, h2)
    assert len(data) < 2000 * (20 + 4.5)
    back = substrings.unpack(data, True)
    assert all((x == y).all() for x, y in zip(back, (docs, refs, np.ones(2000), pos, h1, h2), strict=True))


def test_packed_gaps():
    slots = np.array([0, 1, 254, 255, 256, 1000, 1001, 65535], np.int64)
    assert substrings.unpacked(substrings.packed(slots)).tolist() == slots.tolist()
    assert substrings.unpacked(substrings.packed(slots[:0])).tolist() == []
    slots = np.array([3, 513, 768, 1023], np.int64)
    assert substrings.unpacked(substrings.packed(slots)).tolist() == slots.tolist()


def test_fingerprints(spark):
    rows = [*odd_rows(), (70, "ONE  Two"), (71, "\tone two\n"), (72, "ｏｎｅ two"), (73, "Straße"), (74, "STRASSE")]
    got = fingerprint.exact_duplicates(frame(spark, rows).withColumnRenamed("lang", "digest"))
    by = {}
    for i, t in rows:
        by.setdefault(fingerprint.canonical(t), []).append(i)
    want = sorted(((i, min((x for x in by[fingerprint.canonical(t)] if x is not None), default=None), len(by[fingerprint.canonical(t)])) for i, t in rows), key=repr)
    assert collected(got.select("doc_id", "class_id", "copies")) == want
    assert fingerprint.canonical("ONE  Two") == fingerprint.canonical("ｏｎｅ two") and fingerprint.canonical("Straße") == fingerprint.canonical("STRASSE")


def test_digests_that_collide(spark, monkeypatch):
    """With a digest of one letter, buckets hold different texts, which the bytes keep apart."""
    monkeypatch.setattr(fingerprint, "digest", lambda data: f"{len(data) % 2:032x}")
    rows = [(i, t) for i, t in enumerate(["a", "b", "a", "cc", "dd", "c"])]
    docs = frame(spark, rows)
    digests = spark.createDataFrame([(i, fingerprint.digest(t.encode())) for i, t in rows], "doc_id long, digest string")
    found = fingerprint.collisions(docs, digests)
    odd, even = f"{1:032x}", f"{0:032x}"
    assert found == {(odd, b"a"): 0, (odd, b"b"): 1, (odd, b"c"): 2, (even, b"cc"): 0, (even, b"dd"): 1}
    assert [fingerprint.fingerprint(x, found) for x in (b"a", b"b", b"c")] == [odd, f"{odd}-1", f"{odd}-2"]


@pytest.mark.parametrize("range_rows", [1, 4, 500])
def test_compared_with_next(spark, monkeypatch, range_rows):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", range_rows)
    rows = [r for r in odd_rows() if r[0] is not None and r != (8, odd_rows()[7][1])] + [(i, f"text {i // 2}") for i in range(30, 50)]
    got = {r["doc_id"]: r for r in fingerprint.compared_with_next(frame(spark, rows)).collect()}
    rows = sorted(((i, t or "") for i, t in rows), reverse=True)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(t) // 3
        new = t[: len(t) - n] + after[:n]
        form = fingerprint.canonical
        assert got[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert got[i]["near_next"] == float(form(t) == form(after)) and got[i]["near_edited"] == float(form(t) == form(new))
        assert (got[i]["fingerprint"] == got[i]["edited_fingerprint"]) == (form(t) == form(new))


def test_compared_with_next_of_few(spark):
    assert fingerprint.compared_with_next(frame(spark, [])).count() == 0
    assert fingerprint.compared_with_next(frame(spark, [(1, "abcabc")])).collect()[0]["near_next"] == 1.0
    assert fingerprint.compared_with_next(frame(spark, [(None, "a"), (None, "b"), (3, "c"), (3, "c")])).count() == 4


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0), (2, 0, 1)])
def test_rows_that_share_an_id_are_told_apart(spark, order):
    """(5, B) is the only copy of its text and stays; (5, A) is a copy of (3, A) and goes, in whatever order they come."""
    a, b = words(random.Random(1), 80), words(random.Random(2), 80)
    rows = [(3, a), (5, a), (5, b)]
    docs = frame(spark, [rows[i] for i in order], 1)
    for keep in (simhash.keep_one_of_each, similar.keep_one_of_similar):
        assert collected(keep(docs).select("doc_id", "text")) == [(3, a), (5, b)]
        assert collected(keep(docs.union(docs)).select("doc_id", "text")) == [(3, a), (5, b)]

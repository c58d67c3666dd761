from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tidewater.llm import packing, registry, tokens

from .helpers import collected, frame, odd_rows, words

Tokenizer = pytest.importorskip("tokenizers").Tokenizer
pytest.importorskip("public_tokenizers")


def file(name):
    return registry.vocabulary_file(name)


@pytest.mark.parametrize("hot", [0, 3, 1 << 18])
def test_token_counts(spark, hot):
    t = Tokenizer.from_file(file("byte_bpe_50k.json"))
    rng = random.Random(1)
    rows = odd_rows() + [(100 + i, words(rng, 30) + rng.choice(["", "\n", "\n x", " ", ".\nThe", "été ß!"])) for i in range(40)]
    got = tokens.count_tokens(frame(spark, rows).withColumnsRenamed({"lang": "unit", "source": "freq"}), lambda: file("byte_bpe_50k.json"), hot)
    want = sorted(((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False))) for i, x in rows), key=repr)
    assert collected(got.select("doc_id", "n_bytes", "n_tokens")) == want


SCRIPTS = ["“Curly” quotes — and dashes…", "Привет, как дела?  Хорошо", "我喜欢在北京的公园里散步 和看书。", "日本語の文章です。", "نص عربي قصير", "สวัสดีครับ", "한국어 문장", "emoji 👩‍💻 🇩🇪 ok", "nbsp\u00a0here \u00a0 there\u3000x", "a\u200bb \u200b c", "tab\t\tx \t y\v\fz", "  leading and trailing  ", "x\n\n  indented\n\tcode {\n    }\n"]


def test_units_add_up_in_any_script():
    """Of random strings that may be cut, the sum over units is what the library gives; only odd control letters aren't cut."""
    t = Tokenizer.from_file(file("byte_bpe_50k.json"))
    assert tokens.by_units(t) and not tokens.by_units(Tokenizer.from_file(file("word_bpe_49k.json")))
    rng = random.Random(9)
    some = [*SCRIPTS, "it's", "WE'LL", " ", "  ", "\n", "\t", "\u2028", "\u3000", "\x85", "\u00a0", "1234", "___", "!?", "é", "\u0301", "\u180e", "\x1d", "\ufeff", "京", "-"]
    whole = 0
    for _ in range(4000):
        text = "".join(rng.choice(some) for _ in range(rng.randrange(1, 9)))
        if not tokens.plain(text):
            whole += 1
            continue
        others, rest = tokens.units(text)
        every = others + [f" {u}" for u in rest]
        assert sorted("".join(every)) == sorted(text)
        assert sum(len(e.ids) for e in t.encode_batch(every, add_special_tokens=False)) == len(t.encode(text, add_special_tokens=False).ids), text
    assert whole < 1600 and all(tokens.plain(x) for x in SCRIPTS)


@pytest.mark.parametrize("hot", [0, 1 << 18])
def test_scripts_take_the_way_of_units(spark, hot):
    t = Tokenizer.from_file(file("byte_bpe_50k.json"))
    rows = [(i, " ".join(SCRIPTS[i % len(SCRIPTS) :] * (1 + i % 3))) for i in range(40)]
    got = tokens.count_tokens(frame(spark, rows), lambda: file("byte_bpe_50k.json"), hot).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == [(i, len(t.encode(x, add_special_tokens=False).ids)) for i, x in rows]
    assert all(r["n_units"] > 1 for r in got)


def test_other_tokenizers_count_whole_texts(spark):
    t = Tokenizer.from_file(file("word_bpe_49k.json"))
    rows = [(i, x) for i, x in enumerate(SCRIPTS)]
    got = tokens.count_tokens(frame(spark, rows), lambda: file("word_bpe_49k.json")).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_units"]) for r in got) == [(i, len(t.encode(x, add_special_tokens=False).ids), 1) for i, x in rows]


def test_token_counts_of_nothing(spark):
    assert tokens.count_tokens(frame(spark, []), lambda: file("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing(spark, rule):
    t = Tokenizer.from_file(file("word_bpe_49k.json"))
    rng = random.Random(2)
    rows = odd_rows() + [(100 + i, words(rng, int(200 * rng.random()))) for i in range(120)]
    got = packing.pack(frame(spark, rows).withColumnRenamed("lang", "rank"), lambda: file("word_bpe_49k.json"), 256, rule=rule).toPandas()
    want = []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        want += [(i, k // 256, k, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k in range(0, len(ids), 256) for p in [ids[k : k + 256]]]
    have = [tuple(None if v != v else v for v in r) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(map(repr, (tuple(None if v is None else int(v) for v in r) for r in have))) == sorted(map(repr, want))
    for _, one in got.sort_values("offset").groupby("sequence_id"):
        assert one["offset"].tolist() == [0, *one["length"].cumsum().tolist()[:-1]] and one["length"].sum() <= 256
    assert got["sequence_id"].nunique() <= 1.05 * got["length"].sum() / 256 + 1


def test_all_capacities_hold(spark):
    rng = random.Random(3)
    docs = frame(spark, [(i, words(rng, 1 + int(40 * rng.random()))) for i in range(200)])
    got = packing.pack(docs, lambda: file("word_bpe_49k.json"), 256, max_docs=5, max_cost=30_000).toPandas()
    by = got.groupby("sequence_id")["length"]
    assert len(got) == 200 and by.count().max() <= 5 and (got["length"] ** 2).groupby(got["sequence_id"]).sum().max() <= 30_000 and by.sum().max() <= 256


def test_the_plan_is_what_single_placements_give():
    rng = random.Random(4)
    for _ in range(30):
        lengths = sorted((rng.randrange(1, 60) for _ in range(rng.randrange(1, 80))), reverse=True)
        histogram = {n: lengths.count(n) for n in lengths}
        plan = packing.make_plan(histogram, 100, 100, 10_000, weights=(1.0, 0.0, 0.0))
        bins: list[int] = []
        for n in lengths:
            fits = [i for i, r in enumerate(bins) if r >= n]
            if fits:
                bins[min(fits, key=lambda i: bins[i])] -= n
            else:
                bins.append(100 - n)
        assert plan.bins == len(bins)
        used: dict[int, list[tuple[int, int]]] = {}
        for n, count in histogram.items():
            for rank in range(count):
                number, offset = plan.place(n, rank)
                used.setdefault(number, []).append((offset, n))
        for spans in used.values():
            at = 0
            for offset, n in sorted(spans):
                assert offset == at
                at += n
            assert at <= 100
    with pytest.raises(ValueError):
        packing.make_plan({101: 1}, 100, 100, 20_000)


def test_packing_of_nothing(spark):
    assert packing.pack(frame(spark, []), lambda: file("word_bpe_49k.json")).count() == 0


def test_a_task_encodes_each_of_many_words_once():
    """A task of 16 MB meets some 500,000 words: all are remembered.  Very long ones aren't, so that the memory is bounded."""
    from types import SimpleNamespace

    from tidewater.llm import packing

    asked = []
    model = SimpleNamespace(tokenize=lambda part: asked.append(part) or [SimpleNamespace(id=len(part))])
    words = packing.WordIds(SimpleNamespace(model=model))
    of = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(5))
    for _ in range(2):
        for i in range(300_000):
            assert words[of(i)] == b"\5\0\0\0"
    assert len(asked) == 300_000
    assert words["x" * 500] == b"\xf4\1\0\0"
    assert "x" * 500 not in words

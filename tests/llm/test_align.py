from __future__ import annotations

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewater.llm import align
from tidewater.llm.registry import op11_token_alignment, vocabulary_file

from .helpers import frame, odd_rows, words


def token_bytes():
    """Both libraries, and every token's bytes, by a plain reading of the files."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    a = Tokenizer.from_file(vocabulary_file("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary_file("piece_bpe_32k.model"))
    letter = {}
    for c in map(chr, [*range(0x800), *range(0x800, 0xD800, 0x400), *range(0xE000, 0x110000, 0x400)]):
        for x, y in zip(c.encode(), ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0], strict=True):
            letter[y] = x
    return a, b, letter


def plain_tokens(text, a, b, letter):
    """(id, start, end) of both whole texts, or nothing where the bytes differ."""
    if not text:
        return [], []
    out = []
    ids = a.encode(f" {text}", add_special_tokens=False).ids
    out.append([(i, bytes(letter[c] for c in a.id_to_token(i))) for i in ids])
    pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
    out.append([(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("\u2581", " ").encode()) for i, p in pieces])
    if any(b"".join(x for _, x in tokens) != f" {text}".encode() for tokens in out):
        return [], []
    placed = []
    for tokens in out:
        end, spans = 0, []
        for i, x in tokens:
            spans.append((i, end, end + len(x)))
            end += len(x)
        placed.append(spans)
    return placed


def plain_rows(rows):
    """The contract, link by link."""
    parts = token_bytes()
    counts, per_doc = Counter(), []
    for doc_id, text in rows:
        a, b = plain_tokens(text, *parts)
        links = []
        j = 0
        for x, s, e in a:
            while j and b[j - 1][2] > s:
                j -= 1
            while j < len(b) and b[j][1] < e:
                if b[j][2] > s:
                    links.append((x, b[j][0]))
                j += 1
        counts.update(links)
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = [([], []) for _ in ends]
        for k, side in enumerate((a, b)):
            for i, _, e in side:
                groups[bisect_left(ends, e)][k].append(str(i))
        per_doc.append((doc_id, len(a), len(b), len(groups), links, ";".join("|".join(map(",".join, g)) for g in groups)))
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [
        (i, a, b, g, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if said else "")
        for i, a, b, g, links, said in per_doc
    ]


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    (50, "two  spaces   three"), (51, " leading and trailing "), (52, "line\nbreak \n mixed\t\ttabs \r\n end\n"), (53, "a\u2581b piece sign"), (54, "\u00a0no\u00a0break space\u2003em"),
    (55, "<|endoftext|> <s> </s> <unk> <0x0A> <0xff>"), (56, "\U0001f600 \U0001f468\u200d\U0001f469\u200d\U0001f467 emoji 日本語 テキスト ไทย"), (57, "e\u0301 é ﬁ Å"), (58, " "), (59, "   "), (60, "\x00 \x1c \x85 \u180e x"), (61, "x" * 300),
    (62, "it's they'LL 12345 3.14 a_b-c/d C:\\x"), (63, "naïve façade\u3000ideographic"),
]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(8)
    letters = "ab é日\u2581 \n\t.,1'\u00a0"
    rows = odd_rows() + ODD + [(k, words(rng, 60, 90)) for k in range(100, 130)] + [(k, "".join(rng.choice(letters) for _ in range(40))) for k in range(200, 260)]
    path = str(tmp_path_factory.mktemp("align"))
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    return path, rows


def found(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=repr)


def test_query_on_odd_rows(spark, table):
    path, rows = table
    out = op11_token_alignment(spark, path)
    assert {c: t for c, t in out.dtypes if c in NAMES} == {**dict.fromkeys(NAMES, "bigint"), "groups_sha256": "string"}
    assert found(out) == sorted(plain_rows(rows), key=repr)


@pytest.mark.parametrize(("hot", "whole", "units"), [(0, False, 10), (40, False, 150_000), (1 << 18, True, 10)])
def test_few_hot_pairs_whole_texts_and_a_short_memory(spark, table, monkeypatch, hot, whole, units):
    path, rows = table
    monkeypatch.setattr(align, "KNOWN_UNITS", units)
    both = align.Alignment(lambda: vocabulary_file("byte_bpe_50k.json"), lambda: vocabulary_file("piece_bpe_32k.model"))
    assert not both.whole
    both.whole = whole
    docs = spark.read.parquet(f"{path}/documents.parquet")
    counts = both.pair_counts(docs)
    out = align.with_counts(both.documents(docs, counts, hot).withColumn("groups_sha256", align.digest("groups")).drop("groups"), counts)
    assert found(out) == sorted(plain_rows(rows), key=repr)


def test_query_on_the_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert found(op11_token_alignment(spark, d)) == sorted(plain_rows(rows), key=repr)


def test_groups_are_real_and_nothing_has_no_rows(spark):
    both = align.Alignment(vocabulary_file("byte_bpe_50k.json"), vocabulary_file("piece_bpe_32k.model"))
    clash = spark.createDataFrame([(1, "Hello world", 3, "x")], "doc_id long, text string, n_a int, pair string")
    counts = both.pair_counts(clash)
    row = both.documents(clash, counts).first()
    sides = [g.split("|") for g in row["groups"].split(";")]
    assert len(sides) == row["n_groups"] == 2 and all(x and y for x, y in sides)
    empty = frame(spark, [])
    none = both.pair_counts(empty)
    assert none.count() == 0 and both.documents(empty, none).count() == 0


def test_pairs_are_counted_without_groups():
    """The first pass needs no groups: it finds the same pairs without writing any."""
    both = align.Alignment(vocabulary_file("byte_bpe_50k.json"), vocabulary_file("piece_bpe_32k.model"))
    texts = [t for _, t in odd_rows() + ODD] + [words(random.Random(3), 200)]
    pairs, plain = both.aligner(with_groups=False), both.aligner()
    numbers, bounds = pairs.numbers(texts)
    assert [x.tolist() for x in (numbers, bounds)] == [x.tolist() for x in plain.numbers(texts)]
    assert len(pairs.groups) == 0 and len(plain.groups) == len(plain.units)
    assert pairs.pairs.tolist() == plain.pairs.tolist() and pairs.bounds.tolist() == plain.bounds.tolist()
    assert pairs.fields[:, [0, 1, 3, 4]].tolist() == plain.fields[:, [0, 1, 3, 4]].tolist()


def test_lines_are_cut():
    """A newline between two other characters begins a unit: words at the ends of lines aren't aligned anew with each other."""
    both = align.Alignment(vocabulary_file("byte_bpe_50k.json"), vocabulary_file("piece_bpe_32k.model"))
    aligner = both.aligner()
    names = [f"w{i}" for i in range(20)]
    aligner.numbers([f"{x}\n{y} {x}\n{y}" for x in names for y in names])
    assert len(aligner.units) == 40
    assert align.cut("a b\nc\n\nd \ne\n", True) == ["a", "b", "\nc\n\nd \ne\n"]
    assert align.cut("\na\nb", True) == ["\n\na", "\nb"] and align.cut("\na\nb") == ["\na\nb"]
    rng = random.Random(9)
    for text in ("".join(rng.choice("ab \n\t\u00a0é") for _ in range(rng.randint(1, 12))) for _ in range(3000)):
        units = align.cut(text, True)
        assert "".join(u if align.begins_line(u) else f" {u[u[0] == chr(10) :]}" for u in units) == f" {text}"


def test_a_line_is_not_a_text_that_begins_with_a_newline(spark):
    rows = [(i, t) for i, t in enumerate(["\nWas", "x\nWas", "\nWas x\nWas", "\n\nWas", "x\n\nWas\n", "\n", "日\n日", "\u2581\na", "a\n\u2581", "a\n\x00b\nWas", "\r\nWas", "x \nWas"])]
    both = align.Alignment(lambda: vocabulary_file("byte_bpe_50k.json"), lambda: vocabulary_file("piece_bpe_32k.model"))
    docs = frame(spark, rows, 1)
    counts = both.pair_counts(docs)
    out = align.with_counts(both.documents(docs, counts).withColumn("groups_sha256", align.digest("groups")).drop("groups"), counts)
    assert found(out) == sorted(plain_rows(rows), key=repr)


def test_frequent_units_stay_known(monkeypatch):
    """A task that has met too many units forgets those met once; the others aren't aligned anew."""
    monkeypatch.setattr(align, "KNOWN_UNITS", 40)
    both = align.Alignment(vocabulary_file("byte_bpe_50k.json"), vocabulary_file("piece_bpe_32k.model"))
    aligner, fresh, text = both.aligner(), both.aligner(), "often met, words\nstay known"
    numbers, _ = aligner.numbers([text, words(random.Random(2), 60), " ".join(f"q{k}z" for k in range(60)), text])
    assert aligner.full()
    kept = aligner.forget_rare(align.counted(numbers, len(aligner.units), np.zeros(0, np.int64)))
    assert 5 <= len(kept) == len(aligner.units) <= 20
    monkeypatch.setattr(aligner, "_align", lambda units: pytest.fail(f"aligned anew: {units}") if units else None)
    (n, b), (m, c) = aligner.numbers([text]), fresh.numbers([text])
    assert aligner.said(n, b).to_pylist() == fresh.said(m, c).to_pylist()
    assert aligner.fields[n].tolist() == fresh.fields[m].tolist()
    pairs = lambda a, k: [a.pairs[a.bounds[i] : a.bounds[i + 1]].tolist() for i in k.tolist()]
    assert pairs(aligner, n) == pairs(fresh, m)
    assert len(aligner.forget_rare(np.full(len(kept), 5))) == len(kept)

from __future__ import annotations

import base64
import bz2
import gzip
import hashlib
import random
import re
import zlib

import pytest

from tidewater.llm import decontaminate as dec
from tidewater.llm import secrets as sec

from .helpers import collected, frame, odd_rows, words


def plain_distance(pattern, text):
    """The least edit distance of the pattern to any run of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row = row, [i] + [0] * len(text)
        for j, t in enumerate(text, 1):
            row[j] = min(last[j - 1] + (p != t), last[j] + 1, row[j - 1] + 1)
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(300):
        pattern = [rng.choice("abc") for _ in range(rng.randrange(1, 90))]
        text = [rng.choice("abc") for _ in range(rng.randrange(0, 120))]
        assert dec.best_match(pattern, text)[0] == plain_distance(pattern, text)


def changed(rng, text, n):
    ws = text.split()
    for _ in range(n):
        k = rng.randrange(len(ws))
        ws[k : k + 1] = rng.choice([[], ["zzz"], [ws[k], "yyy"]])
        ws = ws or ["q"]
    return " ".join(ws)


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("a_pass", [2, 1000])
def test_leaks_are_those_within_the_budget(spark, a_pass):
    rng = random.Random(2)
    items = [(k, words(rng, 8 + 5 * k)) for k in range(8)] + [(50, None), (51, ""), (52, "too few"), (53, words(rng, 12)), (54, None)]
    items.append((60, items[3][1]))
    items += [(61, "two"), (62, "Unïcode, strasse"), (63, "我喜欢在北京的公园里散步和看书"), (64, "京")]
    rows = [*odd_rows(), (30, "今天我喜欢在北京的公园里跑步和看书。"), (31, "我不喜欢散步"), (32, "TOO few"), (33, "few too"), (34, "two-too-few")]
    for k in range(60):
        text = items[rng.randrange(8)][1]
        rows.append((100 + k, f"{words(rng, rng.randrange(30))} {changed(rng, text, rng.randrange(12)).upper().replace(' ', rng.choice([' ', ', ', chr(10)]))}! {words(rng, rng.randrange(30))}"))
    docs = frame(spark, rows).withColumnsRenamed({"lang": "item_id", "source": "distance"})
    got = dec.find_leaks(docs, benchmark(spark, items), items_a_pass=a_pass)
    want = []
    for i, t in rows:
        ws = dec.normalised(t).split()
        for j, b in items:
            pattern = dec.normalised(b).split()
            if pattern and (d := plain_distance(pattern, ws)) <= int(0.2 * len(pattern)):
                want.append((i, j, d, int(0.2 * len(pattern))))
    assert collected(got.select("doc_id", "item_id", "distance", "budget")) == sorted(want, key=repr)
    for r in got.collect():
        t = next(x for i, x in rows if i == r["doc_id"])
        run = dec.normalised(t).split()[r["first_word"] : r["last_word"]]
        assert plain_distance(dec.normalised(dict(items)[r["item_id"]]).split(), run) == r["distance"]
    clean = dec.without_leaks(docs, benchmark(spark, items), items_a_pass=a_pass)
    assert clean.columns == docs.columns
    assert collected(clean.select("doc_id")) == sorted(((i,) for i, _ in rows if i not in {w[0] for w in want}), key=repr)


def test_nothing_to_match(spark):
    assert dec.find_leaks(frame(spark, odd_rows()), benchmark(spark, [])).count() == 0
    assert dec.find_leaks(frame(spark, []), benchmark(spark, [(1, "a b c d e f")])).count() == 0
    assert dec.without_leaks(frame(spark, odd_rows()), benchmark(spark, [(1, None)])).count() == len(odd_rows())


KEY = "AKIA" + "ABCDEFGH12345678"
HEX = "0123456789abcdef" * 2


def kinds(text):
    return sec.find_secrets(text)[1]


def test_base_finds():
    text = f'password = "hunter2hunter2" TOKEN:short {KEY} {HEX}0 x api-key=abc apikey=abcdefgh Secret="aaaaaaaa'
    base, every = sec.find_secrets(text)
    assert base == every
    assert [(k, text[a:b]) for k, a, b in base] == [("assign", 'password = "hunter2hunter2'), ("access", KEY), ("hex", HEX + "0"), ("assign", "apikey=abcdefgh"), ("assign", 'Secret="aaaaaaaa')]
    assert kinds("paſſword=abcdefghij") == []


@pytest.mark.parametrize(
    "wrap",
    [
        lambda s: base64.b64encode(s.encode()).decode(),
        lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("="),
        lambda s: "".join(f"%{b:02X}" for b in s.encode()),
        lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
        lambda s: "".join(f"\\x{ord(c):02x}" for c in s),
        lambda s: "".join(f"&#{ord(c)};" for c in s),
        lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
        lambda s: base64.b64encode(zlib.compress(s.encode())).decode(),
        lambda s: base64.b64encode(bz2.compress(s.encode())).decode(),
        lambda s: base64.b64encode(base64.b64encode(s.encode())).decode(),
        lambda s: "".join(f"%{b:02x}" for b in base64.b64encode(gzip.compress(base64.b64encode(s.encode())))),
    ],
)
def test_layers(wrap):
    run = wrap(f"k {KEY} k")
    text = f"é before {run} after"
    base, every = sec.find_secrets(text)
    found = [f for f in every if f not in base]
    assert found and all(f[0] == "access" for f in found)
    assert all(9 <= a < b <= 9 + len(run) for _, a, b in found)


def test_escapes_keep_their_places():
    text = f"see {KEY[:6]}%41{KEY[7:]} end".replace("%41", f"%{ord(KEY[6]):02X}")
    assert ("access", 4, 4 + len(KEY) + 2) in kinds(text)


def test_layers_end():
    assert kinds("%2525252525252541 \\u005cu005cu0041 &#38;#38;#65;") == []
    text = "x"
    for _ in range(30):
        text = base64.b64encode(text.encode()).decode()
    assert isinstance(kinds(text), list)


def plain_base(text):
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_scan_and_redaction(spark):
    rows = [*odd_rows(), (20, f"token=abcdefgh{KEY} {HEX}"), (21, f"a {KEY}AKIA b {'f' * 31} secret: '12345678' passwd=token=secret=abc"), (22, base64.b64encode(f"pw {KEY}".encode()).decode())]
    docs = frame(spark, rows).withColumnRenamed("lang", "spans")
    got = {r["doc_id"]: r for r in sec.secret_scan(docs).collect()}
    for i, t in rows:
        base = plain_base(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in base)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(sum(f[2] == k for f in base) for k in sec.KINDS)
        assert set(joined.split(",")) - {""} <= set(got[i]["spans"].split(","))
    assert got[22]["spans"] == f"access:0:{len(rows[-1][1])}"
    clean = sec.redacted(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    after = {r["doc_id"]: r for r in clean.collect()}
    assert KEY not in after[20]["text"] and after[22]["text"] == "[secret]" and after[4]["text"] == "one" and after[1]["text"] is None
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in clean.collect())
    assert sec.secret_scan(frame(spark, [])).count() == 0 and sec.redacted(frame(spark, [])).count() == 0
    assert sec.redact("abcdef", [("x", 1, 3), ("y", 2, 4), ("z", 4, 5)]) == "a[secret][secret]f"

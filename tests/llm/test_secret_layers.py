from __future__ import annotations

import base64
import bz2
import gzip
import html
import lzma
import random
import re
import textwrap
import time
import zlib
from urllib.parse import quote_from_bytes

import pytest

from tidewater.llm import secrets as sec

SECRET = "password=hunter2hunter2"


def assert_masked(text, run):
    """A find covers the run, and what is left around it isn't touched."""
    at = text.index(run)
    base, every = sec.find_secrets(text)
    assert ("assign", at, at + len(run)) in every and base == []
    assert sec.redact(text, every) == text.replace(run, sec.MASK)


def test_urlsafe_runs_are_whole():
    run = base64.urlsafe_b64encode(f"what is this? why? ok? >>> ??? ~~~ {SECRET}".encode()).decode()
    assert "_" in run[16:] or "-" in run[16:]
    assert_masked(f"é {run} after", run)
    rng = random.Random(2)
    for _ in range(200):
        noise = "".join(chr(rng.randrange(33, 127)) for _ in range(200))
        run = base64.urlsafe_b64encode(zlib.compress(f"{noise} {SECRET}".encode())).decode()
        assert_masked(f"see ({run}) after", run)


def test_runs_of_one_alphabet_beside_the_other():
    run = base64.b64encode(f"??>>~~ {SECRET}!".encode()).decode().rstrip("=")
    assert "assign" in [k for k, _, _ in sec.find_secrets(f"{run}-suffix-of-it")[1]]


@pytest.mark.parametrize("width", [64, 76])
@pytest.mark.parametrize("brk", ["\n", "\r\n", "\n    "])
@pytest.mark.parametrize("encode", [base64.b64encode, base64.urlsafe_b64encode])
def test_wrapped_base64_is_one_run(width, brk, encode):
    rng = random.Random(width)
    for n in (150, 151, 400, 1000):
        noise = "".join(chr(rng.randrange(33, 127)) for _ in range(n))
        run = brk.join(textwrap.wrap(encode(zlib.compress(f"{noise} {SECRET}".encode())).decode(), width, break_on_hyphens=False))
        assert_masked(f"see\n\n{run}\n\nafter", run)
        assert_masked(f"Attached: x\n\n{run}\n\nThe end", run)


def test_lines_on_their_own_are_decoded_too():
    run = base64.b64encode(f"{SECRET}..".encode()).decode().rstrip("=")
    other = "A" * len(run)
    for text in (f"{other}\n{run}\n{other}", f"{run}\nThe next words", f"-----BEGIN X-----\n{run}"):
        assert any(k == "assign" for k, _, _ in sec.find_secrets(text)[1])


def encoded(data: bytes) -> str:
    return base64.b64encode(data).decode()


@pytest.mark.parametrize("data", [f"mot de passe : {SECRET}".encode(), f"﻿​­\x01 {SECRET}".encode(), b"\xff\xfe bad \xc3 " + SECRET.encode()])
def test_layers_that_are_not_printable(data):
    for run in (encoded(data), encoded(zlib.compress(data))):
        assert_masked(f"see {run} after", run)


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress])
def test_all_members_are_unpacked(pack):
    run = encoded(pack(b"first member") + pack(b"second") + pack(f" {SECRET}".encode()))
    assert_masked(f"see {run} after", run)
    run = encoded(pack(b"first member") + f" then {SECRET}".encode())
    assert_masked(f"see {run} after", run)


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress])
def test_large_layers_are_unpacked_whole(pack):
    rng = random.Random(7)
    noise = bytes(rng.randrange(33, 60) for _ in range(30_000))
    for data in (noise + b" " + SECRET.encode(), noise[: 4096 - 10] + b" " + SECRET.encode() + b" " + noise):
        for run in (encoded(pack(data)), encoded(pack(pack(data)))):
            assert any(k == "assign" for k, _, _ in sec.find_secrets(f"see {run} after", 4096)[1])
    assert any(k == "assign" for k, _, _ in sec.find_secrets(encoded(pack(b"\0" * (3 << 20) + b" " + SECRET.encode())), 1 << 20)[1])


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress])
def test_compressed_bytes_in_escapes(pack):
    data = pack(f"what is this {SECRET}".encode())
    for run in ("".join(f"%{b:02x}" for b in data), quote_from_bytes(data, safe=""), "".join(f"\\x{b:02x}" for b in data), repr(data)[2:-1]):
        assert_masked(f"data={run} after", run)


def test_damaged_layers_are_scanned_as_far_as_they_go():
    noise = "".join(map(str, range(3000)))
    run = encoded(gzip.compress(f"{SECRET} {noise}".encode())[:-2000])
    assert any(k == "assign" for k, _, _ in sec.find_secrets(run)[1])
    run = encoded(f"x^ not packed {SECRET}".encode())
    assert_masked(f"see {run} after", run)


# A plain recursive decoder: every letter carries its span, every level is scanned, nothing is remembered but what was seen.


def plain_escapes(letters):
    """One level of escapes of [(letter, start, end)], tried letter by letter; None if there are none."""
    text, out, at, any_found = "".join(x for x, _, _ in letters), [], 0, False
    one = re.compile(r"%[0-7][0-9A-Fa-f]|(?:%[89A-Fa-f][0-9A-Fa-f])+|\\u(?![dD][89A-Fa-f])[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|&#[0-9]{1,9};|&#x[0-9A-Fa-f]{1,8};|&(?:equals|quot|amp|percnt|bsol);")
    while at < len(text):
        if m := one.match(text, at):
            e = m[0]
            high = e[0] == "%" and e[1] > "7"
            new = html.unescape(e) if e[0] == "&" else bytes.fromhex(e.replace("%", "")).decode("utf-8", "replace") if high else chr(int(e.strip("%\\uUx{}"), 16))
            out += [(c, letters[at][1], letters[m.end() - 1][2]) for c in new]
            at, any_found = m.end(), True
        else:
            out.append(letters[at])
            at += 1
    return out if any_found else None


def plain_base64(letters):
    text = "".join(x for x, _, _ in letters)
    for m in re.finditer(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{16,}(={0,2})", text):
        body = m[0].rstrip("=")
        for k in range(4):
            run = body[k:]
            run = run[: len(run) - (len(run) % 4 == 1)]
            data = base64.b64decode(run + "=" * (-len(run) % 4))
            whole = (letters[m.start()][1], letters[m.end() - 1][2])
            spans = [whole if k == 0 else (letters[m.start() + k + 4 * (i // 3)][1], letters[min(m.end(), m.start() + k + 4 * (i // 3 + 1)) - 1][2]) for i in range(len(data))]
            yield [(chr(b), *s) for b, s in zip(data, spans, strict=True)]


def plain_spans(text):
    found, seen, work = set(), set(), [[(c, i, i + 1) for i, c in enumerate(text)]]
    while work:
        letters = work.pop()
        if not letters or tuple(letters) in seen:
            continue
        seen.add(tuple(letters))
        for kind, a, b in sec.scan("".join(x for x, _, _ in letters)):
            found.add((kind, letters[a][1], letters[b - 1][2]))
        if inner := plain_escapes(letters):
            work.append(inner)
        work += plain_base64(letters)
    return found


@pytest.mark.parametrize("seed", range(40))
def test_random_nestings_against_a_plain_decoder(seed):
    rng = random.Random(seed)
    wraps = [
        lambda s: "".join(f"%{ord(c):02X}" if rng.random() < 0.4 else c for c in s),
        lambda s: "".join(f"\\u{ord(c):04x}" if rng.random() < 0.3 else c for c in s),
        lambda s: "".join(f"\\x{ord(c):02x}" if rng.random() < 0.3 else c for c in s),
        lambda s: "".join(f"\\U{ord(c):08x}" if rng.random() < 0.2 else f"\\u{{{ord(c):x}}}" if rng.random() < 0.2 else c for c in s),
        lambda s: "".join(f"&#{ord(c)};" if rng.random() < 0.3 else c for c in s).replace("=", "&equals;"),
        lambda s: base64.b64encode(s.encode()).decode(),
        lambda s: "/" + rng.choice(["a", "ab/c", "path/x"]) + "/" + base64.b64encode(s.encode()).decode(),
    ]
    for _ in range(25):
        text = rng.choice([SECRET, "AKIA" + "ABCD1234" * 2, "token: " + "deadbeef" * 5, "0123456789abcdef" * 2])
        text = f"{rng.choice(['', 'x ', 'k='])}{text}{rng.choice(['', ' y', '&'])}"
        for _ in range(rng.randrange(1, 4)):
            text = rng.choice(wraps)(text)
            if rng.random() < 0.5:
                text = f"{rng.choice(['see ', '%', 'a&', 'b '])}{text} {rng.choice(['end', '=', '%4', 'z'])}"
        base, every = sec.find_secrets(text)
        assert set(every) == plain_spans(text), text
        assert set(base) <= set(every)


@pytest.mark.parametrize("chain", [lambda n, c: "%" + "25" * n + f"{ord(c):02x}", lambda n, c: "\\u005c" + "u005c" * n + f"u{ord(c):04x}", lambda n, c: "&" + "#38;" * n + f"#{ord(c)};", lambda n, c: "&" + "amp;" * n + f"#{ord(c)};"])
def test_long_chains_take_linear_time(chain):
    secret = "".join(chain(rng, c) for rng, c in zip([3, 9, 40, 0, 7] * 5, "password=hunter2hunter2", strict=False))
    run = f"see {secret} after"
    assert ("assign", 4, 4 + len(secret)) in sec.find_secrets(run)[1]
    begun = time.process_time()
    text = chain(200_000, "=").join(["password", "hunter2hunter2"])
    assert ("assign", 0, len(text)) in sec.find_secrets(text)[1]
    assert time.process_time() - begun < 10


def test_one_pass_ends_where_the_levels_end():
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice(["%", "25", "41", "\\u005c", "u0025", "&", "#38;", "amp;", "x41", "%5c", ";", "a", "3", "&#x26;", "\\", "{26}", "u"]) for _ in range(rng.randrange(1, 14)))
        end = text
        while (out := sec.one_level(end)).starts:
            end = out.text()
        assert sec.all_levels(text).text() == end, text


@pytest.mark.parametrize("text", ["a" * 500_000 + "%zz%41", "%zz" * 200_000, "/" * 500_000, "x^" * 200_000 + "%41", "&amp" * 200_000, "password " * 100_000, "a/b-" * 200_000, "/eJx" * 100_000, ("a" * 15 + "\n") * 40_000, "%1f%8b%08" * 20_000])
def test_texts_that_only_look_encoded_take_linear_time(text):
    begun = time.process_time()
    sec.find_secrets(text)
    assert time.process_time() - begun < 10


def test_layers_that_were_missed():
    for text in (
        f"https://host/path/to/{encoded(SECRET.encode())}",
        f"https://host/x-{base64.urlsafe_b64encode(gzip.compress(SECRET.encode())).decode()}",
        f"id_{encoded(zlib.compress(SECRET.encode()))}",
        "password\\U0000003dhunter2hunter2",
        "password\\u{3d}hunter2hunter2",
        "password&equals;&quot;hunter2hunter2&quot;",
        "password%u003dhunter2hunter2",
        "password%3D hunter2hunter2",
        encoded(SECRET.encode("utf-16-le")),
        encoded(gzip.compress(SECRET.encode("utf-16"))),
    ):
        base, every = sec.find_secrets(text)
        assert base == [] and any(k == "assign" for k, _, _ in every), text

"""Secret scans with a worklist of decoded layers.

Every text is scanned, and what in it looks encoded is decoded into a layer of its own: percent escapes, \\u, \\U and
\\x escapes and HTML character references, one level of all of them a layer; base64 of either alphabet, at all four
alignments; bytes that begin like gzip, zlib, bzip2 or xz data are unpacked.  Layers are scanned and searched for
further layers in turn until nothing new comes up; a layer whose content and place have been seen isn't taken up again,
which ends cycles.  Escapes that decode to escapes are scanned level by level for `LEVELS` levels; what is nested more
deeply is unwrapped to its end in one pass, so that long chains take linear time.

A find in a layer is mapped through the layers to the code points of the text that it was decoded from: escapes keep
their places, for whole base64 runs and compressed data the span is the encoded run, for base64 that starts elsewhere in
a run the part of it that holds the find.

Decoded bytes are scanned whether or not they are valid or printable UTF-8, with and without their zero bytes (UTF-16).
Compressed data is unpacked whole, with all its members, in pieces; of more than `max_layer_bytes` each chunk of that
size is a layer, with a quarter of the one before, so memory is bounded (time isn't: a bomb is unpacked to its end).
Null texts are empty.  Repeated rows each get their row.  Other columns are ignored, or kept as they are by `redacted`.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.entities import html5
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, records

KINDS = ("assign", "access", "hex")
MAX_LAYER_BYTES = 64 << 20
MASK = "[secret]"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")

#: One escape; bytes of UTF-8 sequences and surrogates that follow each other are one.
_ESCAPE = re.compile(
    r"%[0-7][0-9A-Fa-f]|(?:%[89A-Fa-f][0-9A-Fa-f])+|%u[0-9A-Fa-f]{4}"
    r"|(?:\\u[dD][89A-Fa-f][0-9A-Fa-f]{2})+|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}"
    r"|&#[0-9]{1,9};|&#[xX][0-9A-Fa-f]{1,8};|&[A-Za-z][A-Za-z0-9]{1,31};"
)
#: What escapes, and escapes in escapes, are made of.
_CHAIN = re.compile(r"[%\\&][%\\&#;{}0-9A-Za-z]*")
_ENDS, _LONGEST = frozenset("0123456789abcdefABCDEF;}"), 36
#: Levels of escapes in escapes that are layers each.
LEVELS = 4
#: Without any of this a layer holds no find and no other layer.
_WORTH = re.compile(r"passw|secret|token|api_?key|AKIA|[0-9a-f]{32}|[a-z0-9+/_-]{16}|%u?[0-9a-f]{2}|\\[ux]|&[#a-z]", re.IGNORECASE | re.ASCII)
#: One run of either alphabet, the run that a line break leads to, a short run just before a line break, what ends a last line.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}")
_NEXT_LINE = re.compile(r"[ \t]*\r?\n[ \t]*([A-Za-z0-9+/_-]+)")
_LINE_BEFORE = re.compile(r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{1,15})[ \t]*\r?\n[ \t]*\Z")
_PROSE_AFTER = re.compile(r"[ \t]+[^\s]")
_PADDING = re.compile(r"={0,2}")
#: How base64 of compressed data begins, after something that may stand before it.
_PACKED_BASE64 = re.compile(r"(?<=[/+_-])(?:H4sI|eJ[wxyz]|eA[EFGH]|eF[4567]|eN[opqr]|Qlpo|[/_]Td6)")
#: Escaped bytes and those left as they are, and how compressed data begins in them.
_PERCENT_BYTE = re.compile(r"%[0-9A-Fa-f]{2}|[!-$&-~]")
_ESCAPE_BYTE = re.compile(r"""\\(?:x[0-9A-Fa-f]{2}|[abfnrtv0'"\\])|[\x20-\x5b\x5d-\x7e]""")
_PACKED = re.compile(r"(?:%|\\x)1[fF](?:%|\\x)8[bB](?:%|\\x)08|(?:x|(?:%|\\x)78)(?:(?:%|\\x)(?:01|5[eE]|9[cC]|[dD][aA])|\^)|(?:B|(?:%|\\x)42)(?:Z|(?:%|\\x)5[aA])(?:h|(?:%|\\x)68)|(?:%|\\x)[fF][dD](?:7|(?:%|\\x)37)(?:z|(?:%|\\x)7[aA])")
_SHORT = {"a": b"\a", "b": b"\b", "f": b"\f", "n": b"\n", "r": b"\r", "t": b"\t", "v": b"\v", "0": b"\0", "'": b"'", '"': b'"', "\\": b"\\"}
#: Bytes unpacked at a time, those that tell whether unpacked data is compressed again, and whether bytes are compressed.
PIECE, HEAD, PROBE = 1 << 20, 1 << 16, 1 << 16

Span = tuple[int, int]


def scan(text: str) -> list[tuple[str, int, int]]:
    """The base finds, (kind, start, end) in code points."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def _decompressor(data: bytes):
    """What unpacks bytes that begin like compressed data; None if they don't."""
    if data[:3] == b"\x1f\x8b\x08":
        return zlib.decompressobj(31)
    if data[:1] == b"\x78" and len(data) > 2 and int.from_bytes(data[:2]) % 31 == 0:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


class _Stream:
    """Bytes in pieces; `get` takes at least n of them, where there are."""

    def __init__(self, pieces: Iterator[bytes], rest: bytes = b"") -> None:
        self.pieces, self.rest = pieces, rest

    def get(self, n: int) -> bytes:
        parts, size = [self.rest], len(self.rest)
        while size < n and (piece := next(self.pieces, None)) is not None:
            parts.append(piece)
            size += len(piece)
        self.rest = b""
        return b"".join(parts)


def _members(stream: _Stream, state: dict) -> Iterator[bytes]:
    """All members of a compressed stream, unpacked piece by piece, and what follows them as it is.

    state: `whole` is false if a member is damaged or cut short, `left` the bytes of the source's last piece after the last member.
    """
    data = stream.get(6)
    while z := _decompressor(data):
        try:
            while not z.eof:
                out = z.decompress(data, PIECE)
                data = z.unconsumed_tail if hasattr(z, "unconsumed_tail") else b""
                if out:
                    yield out
                if not z.eof and not data and (z.needs_input if hasattr(z, "needs_input") else len(out) < PIECE):
                    data = stream.get(1)
                    if not data:
                        state["whole"] = False
                        # zlib may still hold output when its input ends.
                        if hasattr(z, "flush") and (out := z.flush()):
                            yield out
                        return
        except (zlib.error, OSError, lzma.LZMAError, EOFError):
            state["whole"] = False
            return
        data = z.unused_data
        if len(data) < 6:
            stream.rest = data
            data = stream.get(6)
        state["left"] = len(data)
    if state.get("follow", True):
        while data:
            yield data
            data = stream.get(1)


def _unpacked(data: bytes) -> tuple[Iterator[bytes], list[dict]] | None:
    """Bytes that begin like compressed data, unpacked through all its layers as pieces, with a state of each layer; None if they don't."""
    stream, states, seen = _Stream(iter([data])), [], set()
    while True:
        head = stream.get(HEAD)
        mark = hashlib.sha256(head).digest()
        # A layer that unpacks to itself isn't taken up again.
        if _decompressor(head) is None or mark in seen:
            return (chain([head], stream.pieces), states) if states else None
        seen.add(mark)
        states.append({"whole": True})
        stream = _Stream(_members(_Stream(stream.pieces, head), states[-1]))


def _texts(pieces: Iterator[bytes], most: int) -> Iterator[str]:
    """The bytes as texts of about `most` bytes each with the last quarter of the one before; what isn't UTF-8 is replaced."""
    held, size, new = [], 0, False
    for piece in pieces:
        for k in range(0, len(piece), most):
            part = piece[k : k + most]
            held.append(part)
            size, new = size + len(part), True
            if size >= most:
                every = b"".join(held)
                yield from _readings(every)
                held = [every[len(every) - most // 4 :]]
                size, new = len(held[0]), False
    if new:
        yield from _readings(b"".join(held))


def _readings(data: bytes) -> Iterator[str]:
    """The bytes as UTF-8, and without zero bytes where there are some: what UTF-16 makes of ASCII."""
    yield data.decode("utf-8", "replace")
    if b"\0" in data:
        yield data.replace(b"\0", b"").decode("utf-8", "replace")


def _layers_of(data: bytes, most: int) -> Iterator[str]:
    """Decoded bytes as texts: unpacked, and as they are if they aren't compressed or are damaged."""
    found = _unpacked(data)
    if found:
        yield from _texts(found[0], most)
    if not found or not all(s["whole"] for s in found[1]):
        yield from _texts(iter([data]), most)


def _base64_bytes(run: str) -> bytes:
    """The bytes of a run in either alphabet; a letter too much is left out."""
    body = run.rstrip("=")
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4))


def _base64_runs(text: str) -> Iterator[tuple[int, int, str, bool]]:
    """(start, end, run, whether it is on one line) of what may be base64: runs of both alphabets together, and lines that belong together."""
    done = 0
    for m in _BASE64.finditer(text):
        if m.start() < done:
            continue
        lines = [m.span()]
        if before := _LINE_BEFORE.search(text, max(done, m.start() - 80), m.start()):
            lines.insert(0, before.span(1))
        while more := _NEXT_LINE.match(text, lines[-1][1]):
            lines.append(more.span(1))
        done = lines[-1][1]
        for a, b in lines:
            if b - a >= 16:
                yield a, _PADDING.match(text, b).end(), text[a:b], True
        for i, j in _wrapped([b - a for a, b in lines]):
            if j < len(lines) - 1 or not _PROSE_AFTER.match(text, lines[j][1]):
                yield lines[i][0], _PADDING.match(text, lines[j][1]).end(), "".join(text[a:b] for a, b in lines[i : j + 1]), False


def _wrapped(widths: list[int]) -> Iterator[tuple[int, int]]:
    """(first, last) of the lines that may be one wrapped run: lines as wide as each other, with a shorter one (or a line's end) before and after."""
    i = 0
    while i < len(widths):
        j = i
        while j + 1 < len(widths) and widths[j + 1] == widths[i]:
            j += 1
        firsts = [i, i - 1] if i and widths[i - 1] < widths[i] else [i]
        lasts = [j, j + 1] if j + 1 < len(widths) and widths[j + 1] < widths[i] else [j]
        if widths[i] >= 16:
            yield from ((a, b) for a in firsts for b in lasts if a < b)
        i = j + 1


class Layer:
    """A decoded text; `up` maps a stretch of it to the layer that it was decoded from, `depth` counts levels of escapes."""

    def __init__(self, text: str, parent: Layer | None = None, up: Callable[[int, int], Span] | None = None, depth: int = 0) -> None:
        self.text, self.parent, self.up, self.depth = text, parent, up, depth

    def place(self, start: int, end: int) -> Span:
        """The stretch of the original that holds what start to end was decoded from."""
        layer = self
        while layer.parent is not None:
            start, end = layer.up(start, end)
            layer = layer.parent
        return start, end

    def inside(self, text: str, start: int, end: int) -> Layer:
        """A layer decoded from the whole of start to end."""
        return Layer(text, self, lambda a, b: (start, end))


@lru_cache(1 << 14)
def _decoded(escape: str) -> str:
    """What one escape stands for; itself if it stands for nothing."""
    if escape[0] == "&":
        if escape[1] != "#":
            return html5.get(escape[1:], escape)
        code = int(escape[3:-1], 16) if escape[2] in "xX" else int(escape[2:-1])
    elif escape[:2] in ("%u", r"\U"):
        code = int(escape[2:], 16)
    elif escape[:3] == r"\u{":
        code = int(escape[3:-1], 16)
    elif escape[0] == "%":
        return bytes.fromhex(escape.replace("%", "")).decode("utf-8", "replace")
    else:
        return b"".join(int(x, 16).to_bytes(2, "little") for x in escape.replace("x", "u").split(r"\u")[1:]).decode("utf-16-le", "replace")
    return escape if code > 0x10FFFF else "�" if 0xD800 <= code < 0xE000 else chr(code)


class _Pieces:
    """A text put together from stretches of another and from what escapes stand for, with the way back."""

    def __init__(self, source: str) -> None:
        self.source, self.parts, self.done, self.size = source, [], 0, 0
        self.begins, self.ends, self.starts, self.stops = [], [], [], []

    def add(self, new: str, start: int, stop: int) -> None:
        """`new` in place of start to stop; the source before that as it is."""
        self.parts += (self.source[self.done : start], new)
        self.size += start - self.done
        self.begins.append(self.size)
        self.size += len(new)
        self.ends.append(self.size)
        self.starts.append(start)
        self.stops.append(stop)
        self.done = stop

    def text(self) -> str:
        return "".join([*self.parts, self.source[self.done :]])

    def _one(self, at: int) -> Span:
        i = bisect_right(self.begins, at) - 1
        if i < 0:
            return at, at + 1
        if at < self.ends[i]:
            return self.starts[i], self.stops[i]
        at += self.stops[i] - self.ends[i]
        return at, at + 1

    def up(self, start: int, end: int) -> Span:
        return self._one(start)[0], self._one(end - 1)[1]


def one_level(text: str) -> _Pieces:
    """Every escape decoded once."""
    out = _Pieces(text)
    for m in _ESCAPE.finditer(text):
        if (new := _decoded(m[0])) != m[0]:
            out.add(new, *m.span())
    return out


def _may_end(first: str, last: str, n: int) -> bool:
    """Whether n letters with these at the ends can be an escape."""
    if first == "&":
        return last == ";" and n <= _LONGEST
    return n in (3, 6) if first == "%" else n in (4, 6, 10) or last == "}" and n <= 10


def all_levels(text: str) -> _Pieces:
    """Every escape decoded, also those that decoding makes, in one pass: each letter is taken off the stack once."""
    out = _Pieces(text)
    for m in _CHAIN.finditer(text):
        stack: list[tuple[str, int, int]] = []
        marks: list[int] = []
        for at, letter in enumerate(m[0], m.start()):
            todo = [(letter, at, at + 1)]
            while todo:
                one = todo.pop()
                if one[0] in "%\\&":
                    marks.append(len(stack))
                stack.append(one)
                if marks and one[0] in _ENDS and _may_end(stack[marks[-1]][0], one[0], len(stack) - marks[-1]):
                    escape = "".join(x[0] for x in stack[marks[-1] :])
                    if _ESCAPE.fullmatch(escape) and (new := _decoded(escape)) != escape:
                        start = stack[marks[-1]][1]
                        del stack[marks.pop() :]
                        todo += [(x, start, one[2]) for x in reversed(new)]
        for letter, start, stop in stack:
            if stop - start > 1:
                if out.starts and out.starts[-1] == start and out.done == stop:  # of the same escape
                    out.parts[-1] += letter
                    out.size += 1
                    out.ends[-1] += 1
                else:
                    out.add(letter, start, stop)
    return out


def layers_in(layer: Layer, most: int, taken: set) -> Iterator[Layer]:
    """What is encoded in a layer, each as a layer of its own; base64 runs that are in `taken` with their place are not decoded again."""
    text = layer.text
    marked = "%" in text or "\\" in text
    if (marked or "&" in text) and _ESCAPE.search(text):
        out = one_level(text) if layer.depth < LEVELS else all_levels(text)
        if out.starts:
            yield Layer(out.text(), layer, out.up, layer.depth + 1)
    for start, end, run, one_line in _base64_runs(text):
        key = (layer.place(start, end), hashlib.sha256(run.encode()).digest())
        if key in taken:
            continue
        taken.add(key)
        for inner in _layers_of(_base64_bytes(run), most):
            yield layer.inside(inner, start, end)
        if one_line:
            for k in (1, 2, 3):  # base64 that starts after other letters
                inner = _base64_bytes(run[k:]).decode("latin-1")
                yield Layer(inner, layer, lambda a, b, at=start + k, end=end: (at + 4 * (a // 3), min(end, at + 4 * ((b + 2) // 3))))
            for m in _PACKED_BASE64.finditer(run):
                if all(_begins_packed(_base64_bytes(run[m.start() : m.start() + n])) for n in (64, 2 * PROBE)):
                    for inner in _texts(_unpacked(_base64_bytes(run[m.start() :]))[0], most):
                        yield layer.inside(inner, start + m.start(), end)
                    break
    if "%" in text:
        yield from _packed_escapes(layer, _PERCENT_BYTE, most)
    if "\\x" in text:
        yield from _packed_escapes(layer, _ESCAPE_BYTE, most)


def _begins_packed(data: bytes) -> bool:
    """Whether the first `PROBE` bytes begin like compressed data and unpack so far; a header longer than that doesn't."""
    if (z := _decompressor(data)) is None or (data[:3] == b"BZh" and data[4:10] not in (b"1AY&SY", b"\x17rE8P\x90")):
        return False
    try:
        out = z.decompress(data[:PROBE], 1)
    except (zlib.error, OSError, lzma.LZMAError, EOFError):
        return False
    return bool(out) or len(data) < PROBE or not hasattr(z, "unconsumed_tail")


def _packed_escapes(layer: Layer, one: re.Pattern, most: int) -> Iterator[Layer]:
    """Compressed data written with escaped bytes; the place is that of its members."""
    text, done = layer.text, 0
    data, starts, ends, stop = b"", [], [], 0
    for m in _PACKED.finditer(text):
        if m.start() < done:
            continue
        if m.start() >= stop:  # the bytes from here on, as far as they go, are decoded once
            found, starts, ends, at = bytearray(), [], [], m.start()
            while unit := one.match(text, at):
                part = _byte_of(unit[0])
                found += part
                starts += [at] * len(part)
                at = unit.end()
                ends += [at] * len(part)
            data, stop = bytes(found), at
        at = bisect_left(starts, m.start())
        if at == len(starts) or starts[at] != m.start() or not _begins_packed(data[at : at + PROBE]):
            continue
        state = {"whole": True, "follow": False, "left": 0}
        if not sum(1 for _ in _members(_Stream(iter([data[at:]])), state)):
            continue
        used = len(data) - (state["left"] if state["whole"] else 0)
        done = ends[used - 1]
        for inner in _layers_of(data[at:used], most):
            yield layer.inside(inner, m.start(), done)


def _byte_of(escape: str) -> bytes:
    if escape[0] == "%" and len(escape) == 3:
        return bytes.fromhex(escape[1:])
    if escape[0] == "\\" and len(escape) > 1:
        return bytes.fromhex(escape[2:]) if escape[1] == "x" else _SHORT[escape[1]]
    return escape.encode()


def find_secrets(text: str, max_layer_bytes: int = MAX_LAYER_BYTES) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base finds, all finds), each sorted by start and then kind, without repeats."""
    order = lambda found: sorted(set(found), key=lambda f: (f[1], KINDS.index(f[0]), f[2]))
    base = order(scan(text))
    seen: set = set()
    taken: set = set()
    found, work = list(base), [layers_in(Layer(text), max_layer_bytes, taken)]
    while work:
        inner = next(work[-1], None)
        if inner is None:
            work.pop()
        elif _WORTH.search(inner.text):
            # Layers are told apart by a digest, so that the chunks of a large one aren't held.
            key = (hashlib.sha256(inner.text.encode("utf-8", "surrogatepass")).digest(), inner.place(0, len(inner.text)))
            if key not in seen:
                seen.add(key)
                found += [(kind, *inner.place(a, b)) for kind, a, b in scan(inner.text)]
                work.append(layers_in(inner, max_layer_bytes, taken))
    return base, order(found)


def _joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def secret_scan(docs: DataFrame, max_layer_bytes: int = MAX_LAYER_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex and base_sha256 of the base finds, spans of all finds."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])
        for batch in blocks(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                base, found = find_secrets(text or "", max_layer_bytes)
                rows.append((*(sum(f[0] == k for f in base) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found)))
            yield records(schema, [batch.column(0), *(list(c) for c in zip(*rows, strict=True))] if rows else [[]] * 6)

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, found: list[tuple[str, int, int]], mask: str = MASK) -> str:
    """The text with the mask in place of each run of overlapping finds."""
    out, at = [], 0
    for a, b in sorted((a, b) for _, a, b in found):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, mask: str = MASK, max_layer_bytes: int = MAX_LAYER_BYTES) -> DataFrame:
    """The documents with their secrets masked; n_chars, where there is one, follows the text."""
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            texts = [t if not t else redact(t, find_secrets(t, max_layer_bytes)[1], mask) for t in batch.column(names.index("text")).to_pylist()]
            for i, name in enumerate(names):
                if name == "text":
                    batch = batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))
                elif name == "n_chars":
                    counts = [n if t is None else len(t) for n, t in zip(batch.column(i).to_pylist(), texts, strict=True)]
                    batch = batch.set_column(i, batch.schema.field(i), pa.array(counts, batch.schema.field(i).type))
            yield batch

    return docs.mapInArrow(work, docs.schema)

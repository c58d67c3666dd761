"""Alignment of two tokenizers' tokens: the byte offsets where tokens of both end cut a text into groups.

Each tokenizer's cumulative ends go into a dictionary from end to index; the keys that both have, sorted, slice both lists
of ids into groups, and each slice is expanded into its links, the pairs of tokens whose bytes overlap.

A text is cut into units before it is encoded: at each single space between two other characters both tokenizers end a
token, whatever stands around it, so the tokens, groups and links of a text are those of its units one after the other.
A single newline between two others is a token of its own in both and begins a unit, so that no unit is made of two words.
A task aligns each unit that it meets once, as long as it remembers it; those met only once are forgotten first.  Where the tokenizers' files don't promise this,
a text is one unit.

Two passes: (1) every task sums the links of each id pair over the documents that it reads, without their groups, and the
sums are grouped by pair; (2) the documents are read again and look their links up.  The `hot_pairs` most frequent pairs, a fixed number, are
broadcast in sorted arrays; documents with others send those to a join, by themselves, and get back two numbers.  Groups
are never shuffled.

Texts that are null or empty, or whose tokens' bytes aren't those of the text after a space, have no tokens: zeros, and no
part in the counts.  Repeated rows count and get their row each.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, blocks, records, saved
from .tokens import by_units, load_tokenizer

#: Pairs broadcast; the rest is joined by a shuffle.
HOT_PAIRS = 1 << 18
#: Bytes of text taken together; units, and their characters, that a task remembers.
BLOCK_BYTES, KNOWN_UNITS, KNOWN_CHARS = 4 << 20, 400_000, 8 << 20

Where = str | Callable[[], str]
#: What stands for a space in the pieces, and bytes that are pieces of their own.
SPACE, _BYTE = "▁", re.compile(r"<0x([0-9A-F]{2})>")
_CUT, _CUT_LINES = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)")
#: What ASCII texts hold that are cut with more care; the last four count as white space here only, which makes longer units.
_CARE = ("  ", " \n", "\n ", "\n\n", *"\t\v\f\r\x1c\x1d\x1e\x1f")
#: Units that A encodes as one text: it ends a token at each of their spaces.
TOGETHER = 500


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is printable, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """A byte-level tokenizer (A) and a model of pieces (B) with the bytes of every token."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece

        self.a = load_tokenizer(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        self.a_bytes = {}
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            plain = all(c in letters for c in token)
            self.a_bytes[i] = bytes(letters[c] for c in token) if plain else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) and self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self._pieces = pieces

    def cuts_at_spaces(self) -> bool:
        """Whether no token of either reaches over a single space between two other characters."""
        inside = any(x != SPACE and y == SPACE for p in self._pieces for x, y in zip(p, p[1:], strict=False))
        return by_units(self.a) and not inside and self.b.encode("a", out_type=str)[0].startswith(SPACE)

    def cuts_at_lines(self) -> bool:
        """Whether a newline between two other characters is always a token by itself, in B after a space of its own, too."""
        ids = self.b.encode("\na")
        return self.cuts_at_spaces() and not any("\n" in p and p != "\n" for p in self._pieces) and [self.b_bytes[i] for i in ids[:2]] == [b" ", b"\n"]

    def by_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def by_b(self, texts: list[str]) -> list[list[int]]:
        """B puts a space of its own before each text."""
        return self.b.encode(texts, num_threads=1)


def cut(text: str, lines: bool = False) -> list[str]:
    """The units of a text: what is between single spaces that have no white space beside them.

    With `lines`, a single newline between two others begins a unit as well, and stays its first character; a first unit that
    begins with a newline gets another one before it.
    """
    parts = (text.replace("\n", " \n") if lines else text).split(" ")
    if text.isascii() and text[0] not in " \n" and text[-1] not in " \n" and not any(x in text for x in _CARE):
        return parts
    for p in parts:
        start = p[1:2] if lines and p[:1] == "\n" else p[:1]
        if not start or start.isspace() or p[-1].isspace():
            parts = (_CUT_LINES if lines else _CUT).split(text)
            break
    if lines and text[0] == "\n":
        parts[0] = "\n" + parts[0]
    return parts


def begins_line(unit: str) -> bool:
    """Whether a unit of lines was cut off before its newline; else one at its start is doubled."""
    return unit[0] == "\n" and not unit[1].isspace()


def common_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A's index, B's index) of the tokens that end together, in order."""
    a_at, b_at = (dict(zip(ends.tolist(), range(len(ends)), strict=True)) for ends in (a_ends, b_ends))
    both = sorted(a_at.keys() & b_at.keys())
    return tuple(np.fromiter(map(at.__getitem__, both), np.int64, len(both)) for at in (a_at, b_at))


def links_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A's index, B's index, end of the shared bytes) of all tokens that overlap: two of them share what is between two neighbouring ends of either, once."""
    ends = np.concatenate([a_ends, b_ends])
    ends.sort(kind="stable")  # merges two runs
    ends = ends[np.diff(ends, prepend=-1) > 0]
    return np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends), ends


def _written(ids: np.ndarray, last: np.ndarray) -> pa.Array:
    """The ids of each group as text; `last` are the indexes of the groups' last tokens."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], last + 1]), pa.int32()), pa.array(ids).cast(pa.string())), ",")


class _Units(dict):
    """Unit to its number; `new` has the units that aren't aligned yet."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        self.new.append(unit)
        return n


class Aligner:
    """Aligns units and remembers what came out; the groups, too, unless only pairs are asked for."""

    #: n_a, n_b, n_groups, n_links, whether the bytes aren't those of the unit.
    FIELDS = 5

    def __init__(self, a_path: str, b_path: str, whole: bool, with_groups: bool = True) -> None:
        self.tokenizers, self.whole, self.with_groups = Tokenizers(a_path, b_path), whole, with_groups
        t = self.tokenizers
        self.lines = not whole and t.cuts_at_lines()
        self.sizes = (np.array([len(t.a_bytes.get(i, b"")) for i in range(max(t.a_bytes) + 1)]), np.array(list(map(len, t.b_bytes))))
        self.forget()

    def forget(self) -> None:
        self.units, self.chars = _Units(), 0
        self.fields = np.zeros((0, self.FIELDS), np.int64)
        self.pairs, self.bounds = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.groups = pa.array([], pa.string())

    def forget_rare(self, times: np.ndarray) -> np.ndarray:
        """Forgets the units met once, by how often each was, and more where over half the memory would stay; the numbers of those kept, which become 0, 1, ..."""
        least = max(2, int(np.sort(times)[-(KNOWN_UNITS // 2) - 1]) + 1 if len(times) > KNOWN_UNITS // 2 else 0)
        kept = np.flatnonzero(times >= least)
        units = list(self.units)
        units = [units[k] for k in kept.tolist()]
        fields, pairs, bounds, groups = self.fields[kept], self.pairs, self.bounds, self.groups
        self.forget()
        if (chars := sum(map(len, units))) > KNOWN_CHARS // 2:
            return kept[:0]
        self.units.update(zip(units, range(len(units)), strict=True))
        n = np.diff(bounds)[kept]
        self.chars, self.fields, self.bounds = chars, fields, np.concatenate([[0], np.cumsum(n)])
        self.pairs = pairs[np.arange(int(n.sum())) + np.repeat(bounds[kept] - self.bounds[:-1], n)]
        if self.with_groups:
            self.groups = groups.take(pa.array(kept))
        return kept

    def full(self) -> bool:
        return len(self.units) > KNOWN_UNITS or self.chars > KNOWN_CHARS

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, bounds): the numbers of the texts' units, one text after the other, and where each text's begin; `fields`, `pairs` and `groups` have what was found for them."""
        of = self.units.__getitem__
        parts = [[t] if self.whole else cut(t, self.lines) for t in (t or "" for t in texts) if t]
        counts = np.zeros(len(texts) + 1, np.int64)
        counts[1:][[bool(t) for t in texts]] = list(map(len, parts))
        found = np.fromiter(map(of, chain.from_iterable(parts)), np.int64, int(counts.sum()))
        del parts
        new, self.units.new = self.units.new, []
        for k in range(0, len(new), 20_000):
            self._align(new[k : k + 20_000])
        return found, np.cumsum(counts)

    def _align(self, units: list[str]) -> None:
        t = self.tokenizers
        self.chars += sum(map(len, units))
        line = np.fromiter(map(begins_line, units), bool, len(units)) if self.lines else np.zeros(len(units), bool)
        if self.lines:
            units = [u[1:] if u[0] == "\n" and not new else u for u, new in zip(units, line.tolist(), strict=True)]
        raw_b = [b" " + u.encode() for u in units]
        raw_a = [r[1:] if new else r for r, new in zip(raw_b, line.tolist(), strict=True)]
        long_b = np.fromiter(map(len, raw_b), np.int64, len(raw_b))
        long_a = long_b - line
        wrong = np.zeros(len(units), bool)
        sides = []
        texts = [u if new else f" {u}" for u, new in zip(units, line.tolist(), strict=True)]
        for ids, sizes, names, raw, long in ((self._by_a(texts, long_a), self.sizes[0], t.a_bytes, raw_a, long_a), (t.by_b(units), self.sizes[1], t.b_bytes, raw_b, long_b)):
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))
            ends = np.cumsum(sizes[flat])
            if len(ids) < len(units):  # of several units together
                n = np.diff(np.searchsorted(ends, np.cumsum(long), "right"), prepend=0)
            by_unit = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])])
            if (by_unit != long).any() or b"".join(map(names.__getitem__, flat.tolist())) != b"".join(raw):
                lists = np.split(flat, np.cumsum(n)[:-1])
                wrong |= [b"".join([names[i] for i in x.tolist()]) != r for x, r in zip(lists, raw, strict=True)]
            sides.append((flat, n))
        n_tokens = []
        kept = []
        for (flat, n), sizes in zip(sides, self.sizes, strict=True):
            if wrong.any():
                flat, n = flat[~np.repeat(wrong, n)], np.where(wrong, 0, n)
            if sizes is self.sizes[1] and line.any():
                # B's own space before a line isn't in the text.
                own = line & ~wrong
                flat, n = np.delete(flat, (np.cumsum(n) - n)[own]), n - own
            n_tokens.append(n)
            kept.append((flat, np.cumsum(sizes[flat])))
        (a, a_ends), (b, b_ends) = kept
        # The units' bytes follow each other on both sides, so that all are aligned at once.
        unit_ends = np.cumsum(np.where(wrong, 0, long_a))
        x, y, ends = links_of(a_ends, b_ends)
        count = lambda ends: np.diff(np.searchsorted(ends, unit_ends, "right"), prepend=0)
        n_groups, n_links = np.zeros(len(units), np.int64), count(ends)
        if self.with_groups:
            a_last, b_last = common_ends(a_ends, b_ends)
            n_groups = count(a_ends[a_last])
            groups = pc.binary_join_element_wise(_written(a, a_last), _written(b, b_last), "|")
            groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_groups)]), pa.int32()), groups), ";")
            self.groups = pa.concat_arrays([self.groups, groups])
        self.fields = np.concatenate([self.fields, np.stack([*n_tokens, n_groups, n_links, wrong], axis=1)])
        self.pairs = np.concatenate([self.pairs, a[x] << 32 | b[y]])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(n_links)])

    def _by_a(self, texts: list[str], long: np.ndarray) -> list[list[int]]:
        """A's ids of the units' texts: of many together where that gives their bytes, else of each."""
        if not self.whole:
            ids = self.tokenizers.by_a(["".join(texts[k : k + TOGETHER]) for k in range(0, len(texts), TOGETHER)])
            ends = np.cumsum(self.sizes[0][np.fromiter(chain.from_iterable(ids), np.int64)])
            if len(ids) < len(texts) and np.isin(np.cumsum(long), ends, assume_unique=True).all():
                return ids
        return self.tokenizers.by_a(texts)

    def pair_sums(self, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pairs, links) of the units, each taken so many times."""
        links = np.repeat(times, np.diff(self.bounds)[: len(times)])
        pairs = self.pairs[: len(links)]
        order = np.argsort(pairs)
        pairs, first = pairs[order], np.flatnonzero(np.diff(pairs[order], prepend=-1))
        sums = np.add.reduceat(links[order], first) if len(first) else np.zeros(0, np.int64)
        some = sums > 0
        return pairs[first][some], sums[some]

    def said(self, numbers: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The groups of each text."""
        lists = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), self.groups.take(pa.array(numbers)))
        return pc.binary_join(lists, ";")


def by_text(values: np.ndarray, numbers: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sums of the units' values over each text."""
    sums = np.concatenate([np.zeros((1, values.shape[1]), np.int64), np.cumsum(values[numbers], axis=0)])
    return np.diff(sums[bounds], axis=0)


def counted(numbers: np.ndarray, n: int, before: np.ndarray) -> np.ndarray:
    """How often each of n units was met, added to the counts before."""
    times = np.bincount(numbers, minlength=n)
    times[: len(before)] += before
    return times


class Alignment:
    """What two tokenizers make of a table of documents; the paths are taken where the tokenizers are loaded, so that files may be in other places on executors."""

    def __init__(self, a_path: Where, b_path: Where) -> None:
        self.where = [p if callable(p) else (lambda p=p: p) for p in (a_path, b_path)]
        self.whole = not Tokenizers(*(w() for w in self.where)).cuts_at_spaces()

    def aligner(self, with_groups: bool = True) -> Aligner:
        return Aligner(*(w() for w in self.where), self.whole, with_groups)

    def pair_counts(self, docs: DataFrame) -> DataFrame:
        """pair (A's id in the upper half, B's in the lower), n, the links of all documents that hold it, and best, whether no pair of its B id has more."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])
            aligner, times = self.aligner(with_groups=False), np.zeros(0, np.int64)
            for batch in blocks(batches, "text", BLOCK_BYTES):
                if aligner.full():
                    yield records(schema, [pa.array(x) for x in aligner.pair_sums(times)])
                    aligner.forget_rare(times)
                    times = np.zeros(0, np.int64)
                numbers, bounds = aligner.numbers(batch.column(0).to_pylist())
                wrong = by_text(aligner.fields[:, 4:], numbers, bounds)[:, 0] > 0
                if wrong.any():
                    numbers = numbers[~np.repeat(wrong, np.diff(bounds))]
                times = counted(numbers, len(aligner.units), times)
            yield records(schema, [pa.array(x) for x in aligner.pair_sums(times)])

        counts = docs.select("text").mapInArrow(work, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        counts = saved(counts, "pairs")
        b = F.col("pair").bitwiseAND((1 << 32) - 1)
        most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
        return saved(counts.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")

    def documents(self, docs: DataFrame, counts: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
        """One row per input row: doc_id, ref (a hash of the row), n_a, n_b, n_groups, n_links, groups, the links of the hot pairs (hot_best of them best, hot_sum by count), and the other pairs with how often."""
        top = most_frequent(counts, hot_pairs).select("pair", "n", "best").toArrow()
        pairs = top.column("pair").to_numpy()
        order = np.argsort(pairs)
        hot = docs.sparkSession.sparkContext.broadcast((pairs[order], top.column("n").to_numpy()[order], top.column("best").to_numpy()[order].astype(np.int64)))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ("doc_id", "ref", "n_a", "n_b", "n_groups", "n_links", "groups", "hot_best", "hot_sum", "cold", "times")
            kinds = (*[pa.int64()] * 6, pa.string(), *[pa.int64()] * 2, pa.list_(pa.int64()), pa.list_(pa.int64()))
            schema, (known, n, best) = pa.schema(list(zip(names, kinds, strict=True))), hot.value
            aligner, looked, times_met = self.aligner(), np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
            for batch in blocks(batches, "text", BLOCK_BYTES):
                if aligner.full():
                    looked = looked[aligner.forget_rare(times_met)]
                    times_met = np.zeros(0, np.int64)
                numbers, bounds = aligner.numbers(batch.column(1).to_pylist())
                times_met = counted(numbers, len(aligner.units), times_met)
                # The links of the new units.
                first = len(looked)
                new = aligner.pairs[aligner.bounds[first] :]
                at, there = looked_up(known, new)
                values = np.stack([best[at] * there, n[at] * there, ~there], axis=1) if len(known) else np.ones((len(new), 3), np.int64) * [0, 0, 1]
                sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(values, axis=0)])
                looked = np.concatenate([looked, np.diff(sums[aligner.bounds[first:] - aligner.bounds[first]], axis=0)])
                every = by_text(np.concatenate([aligner.fields, looked], axis=1), numbers, bounds)
                wrong = every[:, 4] > 0
                every[wrong] = 0
                others, times, lists = [], [], [0]
                for k, rare in enumerate((every[:, 7] > 0).tolist()):
                    if rare:
                        of = numbers[bounds[k] : bounds[k + 1]]
                        pairs = np.concatenate([aligner.pairs[aligner.bounds[i] : aligner.bounds[i + 1]] for i in of.tolist()])
                        pairs, found = np.unique(pairs[~looked_up(known, pairs)[1]], return_counts=True)
                        others.append(pairs)
                        times.append(found)
                    lists.append(lists[-1] + (len(others[-1]) if rare else 0))
                groups = aligner.said(numbers, bounds)
                if wrong.any():
                    groups = pc.if_else(pa.array(wrong), "", groups)
                offsets = pa.array(lists, pa.int32())
                rest = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *x]))) for x in (others, times)]
                column = lambda k: pa.array(np.ascontiguousarray(every[:, k]))
                yield records(schema, [batch.column(0), batch.column(2), *map(column, range(4)), groups, *map(column, (5, 6)), *rest])

        rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("ref"))
        return rows.mapInArrow(work, "doc_id long, ref long, n_a long, n_b long, n_groups long, n_links long, groups string, hot_best long, hot_sum long, cold array<long>, times array<long>")


def looked_up(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each wanted value in sorted ones."""
    at = np.minimum(np.searchsorted(known, wanted), max(len(known) - 1, 0))
    return at, known[at] == wanted if len(known) else np.zeros(len(wanted), bool)


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of the highest levels of n, a sixteenth of a power of two each, that are `most` at most."""
    level = F.floor(16 * F.log2("n"))
    least, above = 1 << 20, 0
    # There are 1,024 levels at most.
    for row in sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect(), key=lambda r: -r["level"]):
        above += row["rows"]
        if above > most:
            break
        least = row["level"]
    return counts.where(level >= least)


def digest(groups: str) -> Column:
    """The SHA-256 of the groups as hex; nothing for texts without tokens."""
    return F.when(F.col(groups) == "", F.lit("")).otherwise(F.sha2(groups, 256))


def with_counts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows of `Alignment.documents` with n_best and count_sum over all their links; rows should be narrow by now."""
    rows = saved(rows.withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID))), "aligned")
    # Rows that are equal have equal pairs: one of them asks.
    rare = rows.where(F.size("cold") > 0).select("doc", "ref", "cold", "times").dropDuplicates(["doc", "ref"])
    rare = rare.select("doc", "ref", "times", F.posexplode("cold").alias("at", "pair")).select("doc", "ref", "pair", F.element_at("times", F.col("at") + 1).alias("k"))
    rare = rare.join(counts, "pair").groupBy("doc", "ref").agg(F.sum(F.col("k") * F.col("best").cast("long")).alias("cold_best"), F.sum(F.col("k") * F.col("n")).alias("cold_sum"))
    both = lambda hot, cold: F.col(hot) + F.coalesce(cold, F.lit(0))
    out = rows.join(rare, ["doc", "ref"], "left").withColumns({"n_best": both("hot_best", "cold_best"), "count_sum": both("hot_sum", "cold_sum")})
    return out.drop("doc", "ref", "cold", "times", "hot_best", "hot_sum", "cold_best", "cold_sum")

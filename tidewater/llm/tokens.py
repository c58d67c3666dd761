"""Token counts: pieces are counted once per distinct pre-token and joined to per-document pre-token frequencies.

A pre-token here is a unit: a run of other characters with all the white space before it.  No match of the
byte-level pattern goes from another character into white space, and none looks back, so the token count of
a text is the sum over its units, in any script.  Texts that may hold a special token, or one of the few
characters that libraries don't agree on as white space, go to the library whole; so do all texts where the
tokenizer's file has a normaliser or another pre-tokenizer than that pattern.  `n_units` is 1 for them.

Plan: (1) distinct units with their frequency, combined in each task, then `groupBy`; (2) the
tokenizer sees each distinct unit once; (3) the `hot_units` most frequent units, a fixed number, are
broadcast and summed where the documents are read; (4) only the rare rest is shuffled and joined, then
summed by row.  No token id is kept.

Null texts count as empty (0 bytes, 0 tokens).  Repeated rows each get their own result row.  Other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, records, saved, texts_of

#: Units broadcast; the rest is joined by a shuffle.
HOT_UNITS = 1 << 18
#: Distinct units that a task gathers before it hands them on.
FLUSH_UNITS = 400_000

#: White space, and what isn't the same everywhere.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNSURE = re.compile(r"[\x1c-\x1f\u180e\ud800-\udfff]")
_UNIT = re.compile(rf"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_BESIDE = re.compile(rf"[{_SPACE}] | [{_SPACE}]|^ | $")
_ASCII_BESIDE = ("  ", *(f"{c} " for c in "\n\t\r\v\f"), *(f" {c}" for c in "\n\t\r\v\f"))


def plain(text: str) -> bool:
    """Whether the text is the sum of its units."""
    return "<|" not in text and not _UNSURE.search(text)


def after_one_space(unit: str) -> bool:
    return unit[0] == " " and len(unit) > 1 and not unit[1].isspace()


def units(text: str) -> tuple[list[str], list[str]]:
    """The units of a plain text: the others, and those after one space without it."""
    if text.isascii() and text[0] != " " and text[-1] != " " and not any(x in text for x in _ASCII_BESIDE) or not _BESIDE.search(text):
        # No space is beside white space: what is between spaces is a unit or several, which add up as well.
        first, *rest = text.split(" ")
        return [first], rest
    others, rest = [], []
    for unit in _UNIT.findall(text):
        if after_one_space(unit):
            rest.append(unit[1:])
        else:
            others.append(unit)
    return others, rest


def by_units(tokenizer) -> bool:
    """Whether the tokenizer is one whose counts add up over units."""
    import json

    spec = json.loads(tokenizer.to_str())
    pattern = spec["pre_tokenizer"] or {}
    return spec["normalizer"] is None and (pattern.get("type"), pattern.get("add_prefix_space"), pattern.get("use_regex", True)) == ("ByteLevel", False, True) and all(t["content"].startswith("<|") for t in spec["added_tokens"])


def load_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def count_tokens(docs: DataFrame, tokenizer_path: str | Callable[[], str], hot_units: int = HOT_UNITS) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, n_units (distinct pre-tokens of the text; 1 for texts taken whole)."""
    spark = docs.sparkSession
    where = tokenizer_path if callable(tokenizer_path) else lambda: tokenizer_path
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("ref"))

    additive = by_units(load_tokenizer(where()))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("unit", pa.string()), ("freq", pa.int64())])
        firsts: Counter = Counter()
        found: Counter = Counter()
        for batch in batches:
            for text in texts_of(batch, "text"):
                if text and additive and plain(text):
                    others, rest = units(text)
                    firsts.update(others)
                    found.update(rest)
                    if len(firsts) >= FLUSH_UNITS:
                        yield records(schema, [list(firsts), list(firsts.values())])
                        firsts = Counter()
                    if len(found) >= FLUSH_UNITS:
                        yield records(schema, [[f" {u}" for u in found], list(found.values())])
                        found = Counter()
        yield records(schema, [[f" {u}" for u in found], list(found.values())])
        yield records(schema, [list(firsts), list(firsts.values())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("unit", pa.string()), ("freq", pa.int64()), ("pieces", pa.int32())])
        tokenizer = load_tokenizer(where())
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                n = [len(e) for e in tokenizer.encode_batch_fast(part.column(0).to_pylist(), add_special_tokens=False)]
                yield records(schema, [part.column(0), part.column(1), n])

    vocabulary = docs.mapInArrow(distinct, "unit string, freq long").groupBy("unit").agg(F.sum("freq").alias("freq"))
    vocabulary = saved(vocabulary.mapInArrow(pieces, "unit string, freq long, pieces int"), "units")
    # The units of the highest levels of frequency that are hot_units at most; levels are few, and no task sorts.
    level = F.floor(16 * F.log2("freq"))
    least, above = 1 << 20, 0
    for row in sorted(vocabulary.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["level"]):
        above += row["n"]
        if above > hot_units:
            break
        least = row["level"]
    top = vocabulary.where(level >= least).select("unit", "pieces").toArrow()
    hot = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True)))

    def by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("ref", pa.int64()), ("n_bytes", pa.int64()), ("n_units", pa.int64()), ("sum_hot", pa.int64()), ("cold", pa.list_(pa.string())), ("times", pa.list_(pa.int32()))])
        tokenizer = None
        known = {u[1:]: n for u, n in hot.value.items() if after_one_space(u)}
        starts = {u: n for u, n in hot.value.items() if not after_one_space(u)}
        for batch in batches:
            sizes, n_units, sums = [], [], []
            cold, times, ends = [], [], [0]
            for text in texts_of(batch):
                n = total = 0
                if text and additive and plain(text):
                    others, rest = units(text)
                    found, begin = Counter(rest), Counter(others)
                    n = len(found) + len(begin)
                    for unit, k in begin.items():
                        if unit in starts:
                            total += starts[unit] * k
                        else:
                            cold.append(unit)
                            times.append(k)
                    for unit, k in found.items():
                        if unit in known:
                            total += known[unit] * k
                        else:
                            cold.append(f" {unit}")
                            times.append(k)
                elif text:
                    tokenizer = tokenizer or load_tokenizer(where())
                    n, total = 1, len(tokenizer.encode(text, add_special_tokens=False))
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                n_units.append(n)
                sums.append(total)
                ends.append(len(cold))
            ends = pa.array(ends, pa.int32())
            yield records(schema, [batch.column(0), batch.column(2), sizes, n_units, sums, pa.ListArray.from_arrays(ends, pa.array(cold, pa.string())), pa.ListArray.from_arrays(ends, pa.array(times, pa.int32()))])

    rows = saved(docs.mapInArrow(by_document, "doc_id long, ref long, n_bytes long, n_units long, sum_hot long, cold array<string>, times array<int>"), "unit-counts")
    # Twice the frequency, and one for the row's first entry: rows that repeat share (doc, ref), so their
    # sums add up and so do their first entries.  A null doc_id has a place of its own among the keys.
    doc = F.coalesce("doc_id", F.lit(NO_ID)).alias("doc")
    rare = rows.select(doc, "ref", "times", F.posexplode("cold").alias("pos", "unit"))
    rare = rare.select("doc", "ref", "unit", (2 * F.element_at("times", F.col("pos") + 1) + (F.col("pos") == 0).cast("int")).alias("times"))
    rare = rare.join(vocabulary.select("unit", "pieces"), "unit")
    rare = rare.groupBy("doc", "ref").agg((F.sum(F.floor(F.col("times") / 2) * F.col("pieces")) / F.sum(F.col("times") % 2)).cast("long").alias("sum_cold"))
    rows = rows.select("doc_id", doc, "ref", "n_bytes", "sum_hot", "n_units").join(rare, ["doc", "ref"], "left")
    return rows.select("doc_id", "n_bytes", (F.col("sum_hot") + F.coalesce("sum_cold", F.lit(0))).alias("n_tokens"), "n_units")

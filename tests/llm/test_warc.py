from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random
import zlib

import pytest

from tidewater.llm import warc

from .helpers import collected

SCHEMA = "page_id long, url string, html string, sha string, response long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)


def expected(rows, least=0):
    out = []
    for i, url, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == data and j is not None]
        top = max(same, default=None)
        revisit = len(data) >= least and top is not None and i != top and sum((h or "").encode() == data for _, _, h in rows) > 1
        out.append((i, url or "", "revisit" if revisit else "response", top if revisit else None, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), b"" if revisit else data))
    return sorted(out, key=repr)


ROWS = [(1, "http://a/?q=1", "<p>ä"), (2, "http://b/\r\nX: y", "<p>ä"), (3, None, None), (4, "u", ""), (5, "u", "z" * 300_000), (6, "u%20 v", "WARC/1.1\r\n\r\n"), (7, "dup", "once"), (7, "dup", "once"), (8, "same", "<p>ä"), (None, "n", "nobody"), (None, "n", "<p>ä")]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    got = warc.archived(pages(spark, ROWS), least).collect()
    rows = sorted(((r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], bytes(r["payload"])) for r in got), key=repr)
    assert rows == expected(ROWS, least)


def test_nothing(spark):
    assert warc.archived(pages(spark, [])).count() == 0


@pytest.mark.parametrize("size", ["64", "1000", "5k"])
def test_small_ranges(spark, size):
    """Ranges far smaller than records: each record comes out once."""
    rng = random.Random(1)
    rows = [(i, f"http://h/{i}", "".join(rng.choice("abcdefgh <>") for _ in range(rng.randrange(3000)))) for i in range(60)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = warc.archived(pages(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r["page_id"], bytes(r["payload"]).decode()) for r in got) == sorted((i, h) for i, _, h in rows)


def test_archives_are_ordinary_gzip(spark, tmp_path):
    warc.write_archives(pages(spark, ROWS), f"file://{tmp_path}/w")
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    text = gzip.GzipFile(fileobj=io.BytesIO(data)).read()
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == len(ROWS) and text.count(b"WARC-Type: revisit") == sum(r[2] == "revisit" for r in expected(ROWS))


@pytest.mark.parametrize("size", ["200", "3000", "1g"])
def test_false_magic_in_stored_data(spark, tmp_path, size):
    """Stored members hold the magic many times, also where a range begins; padding stands between members."""
    payload = (b"x" * 150 + warc.MAGIC) * 40
    folder = tmp_path / "w"
    folder.mkdir()
    want = []
    for f in range(2):
        out = b""
        for i in range(5):
            data = warc.record(10 * f + i, "u", payload[i:], warc.digest_of(payload[i:]), None)
            z = zlib.compressobj(0, zlib.DEFLATED, 31)
            out += z.compress(data) + z.flush() + b"\0" * (i % 3)
            want.append((10 * f + i, len(payload) - i))
        (folder / f"part-{f}").write_bytes(out)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = warc.read_archives(spark, f"file://{folder}").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r["page_id"], len(r["payload"])) for r in got) == sorted(want)
    assert all(warc.digest_of(bytes(r["payload"])) == r["payload_digest"] for r in got)
    assert collected(warc.read_archives(spark, f"file://{folder}").select("record_type").distinct()) == [("response",)]

from __future__ import annotations

import hashlib
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tidewater.llm import decontaminate, packing, registry, secrets, toxicity  # noqa: E402

from .helpers import frame, odd_rows  # noqa: E402
from .test_duplicates import reachable  # noqa: E402
from .test_similar import plain_set  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def plain_classes(texts):
    """Near-duplicates by the stage's rule: 0.8 of the five-word shingles in common."""
    sets = [plain_set(t) for t in texts]
    return reachable(list(range(len(texts))), lambda i, j: (5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j])) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])))


def test_stages_against_plain_versions(spark, tmp_path):
    """Every stage on what the one before kept, against the same decision taken row by row in Python: ids, texts, places."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("labels", "benchmark"))
    known = docs.collect()
    odd = [*odd_rows(), (known[0]["doc_id"], "another text under an id that is taken"), (known[1]["doc_id"], known[1]["text"]), (9001, known[2]["text"]), (9002, f"{known[3]['text']} token=abcdefgh12345678")]
    docs = docs.unionByName(frame(spark, odd).withColumns({c: F.col(c).cast(docs.schema[c].dataType) for c in docs.columns}))
    for name, table in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    key = lambda r: (float("inf") if r[0] is None else r[0], b"" if r[1] is None else hashlib.md5(r[1].encode()).digest())
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    scorer = toxicity.Scorer(*toxicity.train(docs, labels))
    rows = [r for r in rows if scorer.score(r[1]) < 0.5]
    label = plain_classes([t or "" for _, t in rows])
    rows = [min((r for r, m in zip(rows, label, strict=True) if m == k), key=key) for k in sorted(set(label))]
    items = [(r["item_id"], r["text"].split()) for r in benchmark.collect()]
    matcher = decontaminate.Matcher([(i, decontaminate.normalised(" ".join(w))) for i, w in items], decontaminate.RATE)
    rows = [r for r in rows if not matcher.find(r[1])]
    rows = [(i, t and secrets.redact(t, secrets.find_secrets(t)[1])) for i, t in rows]
    tokenizer = packing.load_tokenizer(registry.vocabulary_file("word_bpe_49k.json"))
    want = []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, len(ids), 4096)]
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    pieces = [tuple(None if x != x else int(x) for x in r) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(pieces, key=repr) == sorted(want, key=repr)
    for _, places in got.sort_values("offset").groupby("sequence_id"):
        assert (places["offset"].to_numpy() == np.cumsum([0, *places["length"]])[:-1]).all() and places["length"].sum() <= 4096
    assert 0 < len(rows) < docs.count()
    assert got["sequence_id"].nunique() <= 1.05 * got["length"].sum() / 4096 + 1
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "best_fit_packing"]


def test_the_pipeline_of_nothing(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns


def test_all_thirteen_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 14))

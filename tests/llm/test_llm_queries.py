"""The registered queries of this package against their SQL, and the pipeline against a brute-force version."""

import hashlib
import math
import os
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import corpus_pipeline  # noqa: E402
from compare import check, connect  # noqa: E402
from popstat.llm.encoding import encoder  # noqa: E402
from popstat.llm.queries import QUERIES, SQL  # noqa: E402
from popstat.llm.toxicity import fit_on_labels  # noqa: E402
from test_near_texts import brute_groups  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql_or_gives_every_row(spark, name):
    assert check(spark, connect(FOLDER), FOLDER, name, SQL.get(name)) == ""


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_pipeline_equals_brute_force(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    score = fit_on_labels(documents, spark.read.parquet(f"{FOLDER}/labels.parquet")).scorer()
    docs = [r for r in documents.collect() if score(r.text) < 0.5]
    first = brute_groups({r.doc_id: r.text for r in docs})
    docs = [r for r in docs if first[r.doc_id] == r.doc_id]
    flat = lambda text: " ".join((text or "").lower().split())
    items = [flat(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    docs = [r for r in docs if not any(i in flat(r.text) for i in items)]
    sizes = {}
    for r in docs:
        sizes[r.source] = sizes.get(r.source, 0) + 1
    total = sum(math.sqrt(n) for n in sizes.values())
    expected, start = [], 0
    for r in sorted(docs, key=lambda r: r.doc_id):
        mean = math.sqrt(sizes[r.source]) / total * len(docs) / sizes[r.source]
        assert mean <= 16
        u, p, k = int(hashlib.md5(f"42:{r.doc_id}:1".encode()).hexdigest()[:13], 16) / 2**52, math.exp(-mean), 0
        c = p
        while c <= u:
            k += 1
            p *= mean / k
            c += p
        ids = [*encoder(public_tokenizers.path("byte_bpe_50k.json")).whole(r.text or "").tolist(), 2]
        for _ in range(k):
            expected.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, FOLDER).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == sorted(expected)


def test_pipeline_stages_take_any_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "same text here", None, "s", 1), (2, "same text here", "en", "s", 1), (3, "x " * 20_000, "en", "s", 1)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, FOLDER)
            out.collect()
            assert out.columns == docs.columns or i == len(corpus_pipeline.STAGES) - 1

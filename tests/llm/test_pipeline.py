"""The pipeline against its stages done by brute force, and on awkward documents."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from pagewright.llm import bpe, mixing, pii, quality
from tests.llm.test_operators import ROWS, brute_groups, brute_mix, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `keep` string, quality double"


def corpus() -> list[tuple]:
    r, out = random.Random(12), []
    for i in range(160):
        text = prose(r.randint(5, 120), 500 + i // 2 if i % 10 == 1 else 900 + i)
        if i % 10 == 1:
            text = out[-1][1] + " and more" if i % 20 == 1 else out[-1][1]
        if i % 7 == 0:
            text += f" mail a{i}.b@mail{i % 10}.example.com now"
        if i % 9 == 4:
            text = " ".join(w.upper() + "!!" for w in text.split())
        out.append((i, text, ("en", "de", "fr", "es")[i % 4], f"src{i % 6}", len(text), "x", 0.0))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    def make(items: list, labels: list) -> str:
        at = str(tmp_path_factory.mktemp("sf"))
        spark.createDataFrame(items, SCHEMA).coalesce(2).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        return at

    return make


def test_pipeline_is_brute_force(spark, folder):
    items = corpus()
    labels = [(i, int(i % 9 != 4), 0) for i in range(0, 160, 2)]
    sf = folder(items, labels)
    model = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    docs = []
    for row in items:
        raw = np.frombuffer(row[1].encode(), np.uint8)
        p = quality.score(model, *quality.features(raw, np.array([0, len(raw)]), [row[2]], [row[3]]))[0]
        if round(p, 6) >= model.threshold:
            docs.append(row)
    assert 100 < len(docs) < 160
    docs = [docs[min(g)] for g in brute_groups([(d[0], d[1]) for d in docs])]
    trees, limits = pii.model()
    clean = {d[0]: pii.replace(d[1], pii.find([d[1]], trees, limits)[0]) for d in docs}
    assert any("[EMAIL]" in t for t in clean.values())
    mixed = brute_mix([(d[0], clean[d[0]], d[2], d[3]) for d in docs])
    encode = bpe.vocabulary(bpe.RANKS)[0]
    import tiktoken

    plain = tiktoken.Encoding("own", pat_str=bpe.PATTERN.removeprefix("(?U)"), mergeable_ranks=encode._mergeable_ranks, special_tokens={})
    want = sorted((d, plain.encode_ordinary(clean[d]), clean[d]) for d, _, _ in mixed)
    got = corpus_pipeline.run(spark, sf)
    assert sorted((r["doc_id"], r["token_ids"], r["decoded"]) for r in got.collect()) == want
    assert all(r["n_tokens"] == len(r["token_ids"]) for r in got.collect())


def test_stages_keep_the_columns(spark, folder):
    items = [(*r, None if r[1] is None else len(r[1]), "k", 0.5) for r in ROWS]
    sf = folder(items, [(1, 1, 0), (None, 0, 0)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert len(corpus_pipeline.run(spark, sf).collect()) > 0


def test_empty_tables(spark, folder):
    assert corpus_pipeline.run(spark, folder([], [])).collect() == []
    assert mixing.budgets({}, 0) == {}

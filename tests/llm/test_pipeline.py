"""Pipeline stages against brute force on awkward rows."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citeweave.llm import quality
from tests.llm.test_llm import brute

pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row_key string, `decided.x` string, `Decided0` string, kept string"
LONG = " ".join(f"word{i}" for i in range(60))
TEXTS = [
    (1, "One text of some words that stands here twice"), (2, "one TEXT of some words that stands here twice"), (2, "one TEXT of some words that stands here twice"),
    (3, LONG), (4, LONG + " end"), (5, LONG + " other end"), (5, "another text under the same id as a near copy"), (None, "text without an id"), (None, "Text without an id"),
    (None, LONG + " end"), (6, None), (7, ""), (8, " \n "), (9, "password: abcdefgh1234"), (10, "x" * 50_000), (None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t), "clash", "clash", "clash", "clash") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


def held(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_exact_stage(spark, docs):
    got = corpus_pipeline.exact_stage(spark, docs, "")
    assert got.columns == docs.columns
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(low(t), []).append(i)
    rows = held(got)
    for text, ids in groups.items():
        stay = [i for (i, t), n in rows.items() for _ in range(n) if low(t) == text]
        assert stay == [max((i for i in ids if i is not None), default=None)]
    assert sum(rows.values()) == len(groups)


def test_near_stage(spark, docs):
    got = held(corpus_pipeline.near_stage(spark, docs, ""))
    # The brute force names components by position; rows in order of id, those without one last.
    order = sorted(TEXTS, key=lambda r: (r[0] is None, r[0] or 0))
    want = brute([t for _, t in order])
    firsts = Counter(order[c] for n, c in want if n)
    for n, c in want:
        if n:
            members = [order[i] for i, (m, d) in enumerate(want) if m and d == c]
            stay = [(i, t) for (i, t), k in got.items() for _ in range(k) if (i, t) in members]
            assert len(stay) == 1 and stay[0][0] == order[c][0]
    assert sum(got.values()) == len({c for n, c in want if n}) + sum(1 for n, _ in want if not n)
    assert firsts


def test_empty_and_other_stages(spark, docs, tmp_path):
    empty = docs.limit(0)
    for _, stage in (corpus_pipeline.STAGES[1], corpus_pipeline.STAGES[2], corpus_pipeline.STAGES[3]):
        assert stage(spark, empty, "").count() == 0
    assert corpus_pipeline.packing_stage(spark, empty, "").count() == 0
    labels = f"{tmp_path}/labels.parquet"
    spark.createDataFrame([(3, 1), (10, 0), (None, 1), (1, None)], "doc_id bigint, quality int").write.parquet(labels)
    got = corpus_pipeline.quality_stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    model = quality.learn(quality.document_statistics(docs), spark.read.parquet(labels), F.lit(True))
    want = Counter((i, t) for i, t in TEXTS if model.scores(quality.np.array([quality.statistics(t or "")]))[0] >= quality.THRESHOLD)
    assert held(got) == want
    assert corpus_pipeline.quality_stage(spark, empty, str(tmp_path)).count() == 0
    masked = corpus_pipeline.secrets_stage(spark, docs, "").collect()
    assert len(masked) == len(TEXTS) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in masked)
    assert not any("abcdefgh1234" in (r.text or "") for r in masked)
    pieces = corpus_pipeline.packing_stage(spark, docs, "").collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == Counter(i for i, _ in TEXTS)


def test_pipeline(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.materialize(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert docs.columns == before.columns and 0 < docs.count() <= before.count()
    ids = {r[0] for r in docs.select("doc_id").collect()}
    assert {r[0] for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").select("doc_id").collect()} == ids

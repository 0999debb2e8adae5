"""The pipeline against plain Python on the smallest tables, and its promises on planted rows."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from test_decontamination import words
from test_jaccard import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, spark.createDataFrame(out[-1], docs.schema), SF).collect(), stage(spark, docs.limit(0), SF).schema)
        out.append(docs.collect())
    return out


def test_stages(spark, stages):
    raw, known, single, clean, mixed, placed = stages
    # language: only texts without letters or of no prevailing language go
    assert len(known) >= 0.95 * len(raw) and {r.doc_id for r in known} <= {r.doc_id for r in raw}
    # one of each component
    want = {c if n else d for d, n, c in brute([(r.doc_id, r.text) for r in known], 80, n=5)}
    assert sorted(r.doc_id for r in single) == sorted(want)
    # no benchmark window, and nothing else is lost
    bench = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        bench |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))}
    hit = lambda w: any(tuple(w[k : k + n]) in bench for n in {len(x) for x in bench} for k in range(len(w) - n + 1))
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in single if not hit(words(r.text)))
    # copies
    counts = Counter(r.doc_id for r in mixed)
    assert set(counts) <= {r.doc_id for r in clean} and max(counts.values()) <= 2
    size = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows)
    assert abs(size(mixed) / (1.5 * size(clean)) - 1) < 0.15
    assert Counter(r.doc_id for r in placed) == counts
    assert all(len({r.shard for r in placed if r.doc_id == d}) == 1 for d in counts)


def test_columns(spark, stages):
    names = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(list(rows[0].asDict()) == names for rows in stages[:-1])
    assert set(stages[-1][0].asDict()) == {*names, "shard"}


def test_run_registers():
    queries, sql = corpus_pipeline.register()
    assert "pipeline" in queries and "pipeline" not in sql and sum(x.startswith("op") for x in queries) == 13
    assert len(corpus_pipeline.STAGES) == 5

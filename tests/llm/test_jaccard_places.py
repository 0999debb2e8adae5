"""Texts are moved only where they may be compared."""

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.llm import jaccard


def chain(spark, n):
    """Classes of one family: each shares a region with the next one only."""
    rows = [(region, k, k) for region in range(n - 1) for k in (region, region + 1)]
    return spark.createDataFrame(rows, "region long, class long, label long"), spark.createDataFrame([(k, 300) for k in range(n)], "class long, n long")


def test_members_meet_where_they_share_regions(spark, monkeypatch):
    """Before, each member went to all blocks of its family: 400 members to 25 blocks."""
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 16)
    open_, sizes = chain(spark, 400)
    rows = jaccard.places(open_, sizes).collect()
    assert len(rows) < 400 * 4
    meetings = {}
    for r in rows:
        meetings.setdefault((min(r.block, r.other), max(r.block, r.other)), set()).add(r["class"])
    assert all(any({k, k + 1} <= m for m in meetings.values()) for k in range(399))
    assert max(map(len, meetings.values())) <= 4 * 16


def test_members_of_one_label_need_not_meet(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 16)
    open_, sizes = chain(spark, 100)
    same = open_.withColumn("label", F.when(F.col("class") < 90, F.lit(0)).otherwise(F.col("label")).cast("long"))
    assert {r["class"] for r in jaccard.places(same, sizes).collect()} == set(range(89, 100))


def test_wide_stars_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 16)
    rows = [(0, k, k) for k in range(160)]
    open_ = spark.createDataFrame(rows, "region long, class long, label long")
    placed = jaccard.places(open_, spark.createDataFrame([(k, 300) for k in range(160)], "class long, n long"))
    blocks = dict(placed.select("class", "block").distinct().groupBy("block").count().collect())
    assert sum(blocks.values()) == 160 and max(blocks.values()) < 40
    meets = {(r["class"], r.other) for r in placed.collect()}
    assert meets == {(k, b) for k in range(160) for b in blocks}


@pytest.mark.parametrize("most", [1 << 25, 1 << 15])
def test_only_wanted_texts_are_packed(spark, monkeypatch, most):
    """Before, every text of the table was compressed and shuffled where the wanted ones are no small table."""
    monkeypatch.setattr(jaccard, "MOST_BITS", most)
    docs = spark.createDataFrame([(k % 2000, f"text {k % 2000}") for k in range(6000)] + [(-1, None)], "doc_id long, text string").coalesce(1)
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("__text"))
    wanted = hashed.where("doc_id % 20 = 7").select("__text").distinct()
    rows = jaccard.pressed(docs, "text", wanted).collect()
    texts = {r["__text"]: zstandard.ZstdDecompressor().decompress(r["__packed"]).decode() for r in rows}
    assert {r["__text"] for r in wanted.collect()} <= set(texts) and len(rows) == len(texts) < 300
    known = {r["__text"]: r.text for r in hashed.collect()}
    assert all(known[k] == v for k, v in texts.items())
    assert jaccard.pressed(docs, "text", wanted.limit(0)).count() == 0


def test_marks_keep_all_hashes(spark):
    hashes = [-(2**63), 2**63 - 1, -1, 0, 1, 32767, 32768, 32769, *range(-5000, 5000, 37)]
    bitmap = jaccard.marks(spark.createDataFrame([(h,) for h in hashes], "h long"), "h")
    assert jaccard.marked(bitmap, pa.array(hashes, pa.int64()).to_numpy()).all()
    assert jaccard.marked(bitmap, pa.array(range(10**6, 10**6 + 1000), pa.int64()).to_numpy()).mean() < 0.3

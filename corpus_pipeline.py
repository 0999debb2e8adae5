"""A corpus from raw documents to placed shards: each stage is one operator on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, jaccard, language, mixing, queries, sharding
from tidemark.llm.registry import ORACLES, QUERIES
from tidemark.llm.shared import fresh

#: A document goes if no language has at least this share of it.
LEAST_SHARE = 0.5
#: Near copies share at least this percentage of their shingles of so many words.
COPY_WORDS, COPY_PERCENT = 5, 80


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; those without a letter, or in which no language prevails, go."""
    model = language.learn(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.identify(docs, model).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return found.select(docs.columns)


def join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 5-word shingles, Jaccard similarity of 0.8 or more (the query op4 has 3 words and 0.9)."""
    return jaccard.one_per_component(docs, n=COPY_WORDS, percent=COPY_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontamination.without_hits(docs, queries.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard that they go to; copies of one document go together."""
    return sharding.place(docs, queries.SHARDS)


STAGES = [("language", identify), ("jaccard-join", join), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: The language stage is an iterative model, so SQL can't express the pipeline; tests/llm compares it with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def register() -> tuple[dict, dict]:
    """The queries and SQL of the operators and of the pipeline."""
    return QUERIES | {"pipeline": run}, dict(ORACLES) if ORACLE_SQL is None else ORACLES | {"pipeline": ORACLE_SQL}

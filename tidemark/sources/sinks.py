"""Writers that can be rerun."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import clean


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    df.select(*fields).write.mode("overwrite").option("header", True).csv(path)


def write_news_archive(df: DataFrame, path: str) -> None:
    """JSON lines, newest first, unknown times last."""
    df.orderBy(F.desc_nulls_last("published_at_utc"), "id").write.mode("overwrite").json(path)


def write_asof(df: DataFrame, path: str, asof: str, fmt: str = "parquet") -> None:
    """Replace the output of one as-of date and leave all other dates alone."""
    (df.withColumn("asof", F.lit(asof).cast("date")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("asof").format(fmt).save(path))


def read_latest(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The newest as-of date; the maximum is a subquery, so older partitions are not read."""
    df = spark.read.format(fmt).load(path)
    return df.filter(F.col("asof") == df.agg(F.max("asof")).scalar())


def write_snapshot(df: DataFrame, root: str, name: str) -> None:
    """Data in a folder of its own, then a manifest, then a numbered commit that names the manifest and its hash.

    Nothing that a reader may hold is overwritten: a commit is created only where no other writer has taken its number, else the
    next number is tried. A run that breaks off leaves the last commit in force.
    """
    spark = df.sparkSession
    part = f"{name}/{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{part}/daily")
    manifest = json.dumps({"snapshot": name, "data": f"{part}/daily", "columns": df.columns})
    _write_line(spark, manifest, f"{root}/{part}/MANIFEST.json")
    found = clean.file_hashes(spark, f"{root}/{part}/MANIFEST.json").select("sha256").first()["sha256"]
    commit(spark, root, json.dumps({"manifest": f"{part}/MANIFEST.json", "sha256": found}))


def commit(spark: SparkSession, root: str, line: str) -> int:
    """Put the line under the next free number of root/commits and return the number."""
    number = max([n for n, _ in commits(spark, root)], default=0) + 1
    while not _put_if_absent(spark, line, f"{root}/commits/{number:010d}.json"):
        number += 1
    return number


def commits(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, path) of the commits under root, newest first; only the listing is read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/commits")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(((int(n[:-5]), f"{root}/commits/{n}") for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)


def _put_if_absent(spark: SparkSession, line: str, path: str) -> bool:
    """Create the file, which fails where it exists; the store decides between two writers."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = files.create(target, False)
    except Py4JJavaError as error:
        if files.exists(target):
            return False
        raise error
    out.write(bytearray(line, "utf-8"))
    out.close()
    return True


def _write_line(spark: SparkSession, line: str, path: str) -> None:
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def collection_report(df: DataFrame, keys: list[str], t: str, value: str, error: str) -> DataFrame:
    """Rows, first and last date per series, with the distinct errors met on the way."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("rows"), F.min(F.when(F.col(value).isNotNull(), F.col(t))).alias("first"),
        F.max(F.when(F.col(value).isNotNull(), F.col(t))).alias("last"),
        F.array_join(F.array_sort(F.collect_set(error)), ",").alias("errors"))

"""Line deduplication by site-relative frequency, in DataFrame functions only.

The share of a line on a host is the number of the host's pages that contain it over the number of
the host's pages. Lines above the boilerplate ratio go from every page of that host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written

#: A line on more than this share of a host's pages is boilerplate.
RATIO = 0.05
#: ... but only if that many pages contain it; a host of few pages tells nothing.
LEAST_PAGES = 5


def lines_of(text: Column) -> Column:
    r"""\n-split lines of a text."""
    return F.split(text, "\n", -1)


def key_of(line: Column) -> Column:
    """64-bit key of a line without the spaces around it."""
    return F.xxhash64(F.trim(line))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(__host, __lines): per host the keys of its boilerplate lines.

    A page counts once for a line that it repeats. Blank lines are never boilerplate. An array holds
    at most the mean number of lines of a page over the ratio, however large the host is. Counts are
    summed before the shuffle and keyed by line, so that a hot host is spread over all tasks.
    """
    pages = docs.select(F.col(host).alias("__host"), F.col(text).alias("__text"))
    totals = pages.groupBy("__host").agg(F.count(F.lit(1)).alias("__pages"))
    full = F.filter(lines_of(F.col("__text")), lambda x: F.trim(x) != "")
    lines = pages.select("__host", F.explode(F.array_distinct(F.transform(full, key_of))).alias("__line"))
    counts = lines.groupBy("__host", "__line").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least_pages)
    shares = counts.join(totals, counts["__host"].eqNullSafe(totals["__host"])).drop(totals["__host"])
    kept = shares.where(F.col("__n") > F.lit(ratio) * F.col("__pages"))
    return kept.groupBy("__host").agg(F.sort_array(F.collect_list("__line")).alias("__lines"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, dropped_column: str | None = None) -> DataFrame:
    r"""docs with the boilerplate lines taken out of the text; the other lines are joined by \n again.

    Rows are neither added nor lost. Null texts stay null, empty ones empty; null hosts are one host.
    `dropped_column` names a column for the number of lines taken (0 for null texts); a column of docs
    with that name is replaced.
    """
    # written first, so that Spark knows its size when it plans the join
    bad = written(boilerplate(docs, host, text, ratio, least_pages), "boilerplate").withColumnRenamed("__host", "__bad_host")
    joined = docs.join(bad, docs[host].eqNullSafe(bad["__bad_host"]), "left")
    lines = lines_of(F.col(text))
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("__lines"), key_of(x)) | (F.trim(x) == ""))
    some = F.col("__lines").isNotNull() & F.col(text).isNotNull()
    out = joined.withColumn("__kept", F.when(some, kept))
    if dropped_column:
        out = out.withColumn(dropped_column, F.when(some, F.size(lines) - F.size("__kept")).otherwise(0).cast("long"))
    return out.withColumn(text, F.when(some, F.array_join("__kept", "\n")).otherwise(F.col(text))).drop("__bad_host", "__lines", "__kept")

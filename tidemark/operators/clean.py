"""Data-quality operators: every check returns the offending rows, nothing is repaired silently."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import sha256
from tidemark.functions.scalars import ordered
from tidemark.session import materialise


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def envelope_ok() -> Column:
    """high is the greatest and low the least of the four prices."""
    return (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close", "high"))


def violations(df: DataFrame, rule: str, ok: Column, keys: Sequence[str]) -> DataFrame:
    """Rows that fail (or cannot be decided), as (rule, keys)."""
    return df.filter(~F.coalesce(ok, F.lit(False))).select(F.lit(rule).alias("rule"), *keys)


def close_to(a, b, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    a, b = F.col(a), F.col(b)
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def quarantine(df: DataFrame, exclusions: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(clean, flagged): excluded observations are set apart and never imputed."""
    keys = exclusions.select(*on)
    return df.join(keys, list(on), "left_anti"), df.join(keys, list(on), "left_semi")


def parse_and_dedupe(df: DataFrame, keys: Sequence[str], parsed: dict[str, Column], position: str) -> DataFrame:
    """Apply parsers, drop rows in which any of them failed, keep the first row per key."""
    df = df.withColumns(parsed).dropna(subset=list(parsed))
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(position)).alias("__r")).select(*keys, "__r.*")


def source_conflicts(a: DataFrame, b: DataFrame, on: Sequence[str], x: str, tol: float) -> DataFrame:
    """Compare two sources: conflict if |a-b|/b > tol, otherwise match or only in one."""
    both = a.select(*on, F.col(x).alias("a")).join(b.select(*on, F.col(x).alias("b")), list(on), "full")
    gap = F.try_divide(F.abs(F.col("a") - F.col("b")), F.col("b"))
    status = (
        F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b")
        .when(gap > tol, "conflict").otherwise("match")
    )
    return both.withColumns({"gap": gap, "status": status})


def jump_flags(df: DataFrame, keys, t: str, x: str, tol: float) -> DataFrame:
    """Rows whose move from the previous observation is over tol."""
    w = ordered(keys, t)
    df = df.withColumn("previous", F.lag(x).over(w)).withColumn("move", F.try_divide(x, "previous") - 1)
    return df.filter(F.abs("move") > tol)


def missing_dates(calendar: DataFrame, observed: DataFrame, on: Sequence[str]) -> DataFrame:
    return calendar.select(*on).join(observed.select(*on), list(on), "left_anti")


def expected_weekdays(df: DataFrame, keys, t: str) -> DataFrame:
    """All Mondays to Fridays between the first and last date of each series."""
    span = df.groupBy(*keys).agg(F.min(t).alias("a"), F.max(t).alias("b"))
    days = span.select(*keys, F.explode(F.sequence("a", "b")).alias(t))
    return days.filter(F.weekday(t) < 5)


def expected_months(df: DataFrame, keys, t: str) -> DataFrame:
    span = df.groupBy(*keys).agg(F.min(F.trunc(t, "MM")).alias("a"), F.max(F.trunc(t, "MM")).alias("b"))
    return span.select(*keys, F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("month"))


#: Bytes of a file that one task hashes at once; of a larger file a task takes `SPAN` bytes and hands its state on.
WHOLE, SPAN = 128 << 20, 256 << 20
#: Bytes per row in which a larger file is passed on, so that a batch of 10,000 rows stays small.
PIECE = 8 << 10
#: Endings that Spark's line reader unpacks, so that the bytes of such files can only be had whole.
PACKED = r"\.(gz|bz2|deflate|snappy|lz4|zst|passthrough)$"


def file_hashes(spark, path: str, whole: int = WHOLE, span: int = SPAN) -> DataFrame:
    """Size and SHA-256 of every file under a path.

    A digest follows its file byte by byte. A file over `whole` bytes is therefore cut by Spark's line reader, written in pieces and hashed
    in rounds, all such files side by side: a task reads about `span` bytes of a file and goes on from the state of the round before.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = reader.load(path)
    # content is read only of files whose length the reader is asked for
    hashed = lambda df: df.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    out = hashed(files.where(F.col("length") <= whole))
    large = files.where(F.col("length") > whole).select("path", F.col("length").alias("bytes"), F.col("_metadata.file_path").alias("file")).collect()
    if packed := [r["path"] for r in large if re.search(PACKED, r["path"])]:
        out = out.unionByName(hashed(reader.load(packed)))
    large = [r for r in large if not re.search(PACKED, r["path"])]
    if not large:
        return out
    digests = _digests_in_rounds(spark, path, {r["file"]: r["bytes"] for r in large}, whole, span)
    return out.unionByName(spark.createDataFrame([(r["path"], r["bytes"], digests[r["file"]]) for r in large], out.schema))


def _digests_in_rounds(spark, path: str, sizes: dict[str, int], whole: int, span: int) -> dict[str, str]:
    """Digest by path of the files with these sizes; the driver holds a path, a size and a state of 112 bytes for each, never content."""
    if not sha256.resumes():
        # no state to hand on: one task reads all pieces of a file
        span = max(sizes.values()) + 1
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                         F.col("value").cast("binary").alias("line"), F.col("_metadata.file_size").alias("size"))
    lines = lines.where((F.col("size") > whole) & ~F.col("file").rlike(PACKED)).drop("size")
    pieces = lines.mapInArrow(_pieces, "file string, start long, number int, data binary")
    pieces = materialise(pieces.withColumn("round", F.floor(F.col("start") / span)), by=["round"])
    read = {r["file"]: r["n"] for r in pieces.groupBy("file").agg(F.sum(F.length("data")).alias("n")).collect()}
    # the reader drops a byte order mark, and each line here ends in a line feed, the last one of a file perhaps wrongly
    marks = {f: b"\xef\xbb\xbf" if read.get(f, 0) in (n - 3, n - 2) else b"" for f, n in sizes.items()}
    if bad := [f for f, n in sizes.items() if n - read.get(f, 0) - len(marks[f]) not in (0, -1)]:
        raise OSError(f"not read byte by byte: {bad[:3]}")
    done, digests = {}, {}
    for at in range(max(sizes.values()) // span + 1):
        rows = pieces.where(F.col("round") == at).repartition("file").sortWithinPartitions("file", "start", "number").drop("round")
        for r in rows.mapInArrow(_hasher(done, sizes, marks), "file string, seen long, state binary, sha256 string").collect():
            done[r["file"]], digests[r["file"]] = (r["seen"], bytes(r["state"])), r["sha256"]
    if short := [f for f, n in sizes.items() if done[f][0] != n]:
        raise OSError(f"not read to the end: {short[:3]}")
    return digests


def _pieces(batches):
    """Lines of a split, each with a line feed, in pieces of PIECE bytes or the line that goes beyond."""
    held, size, key, number, names = [], 0, None, 0, ["file", "start", "number", "data"]
    full = []

    def cut():
        nonlocal held, size, number
        full.append((*key, number, b"\n".join([*held, b""])))
        held, size, number = [], 0, number + 1

    def out():
        columns = [pa.array(c, t) for c, t in zip(zip(*full), (pa.string(), pa.int64(), pa.int32(), pa.binary()))]
        full.clear()
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        for k, group in itertools.groupby(zip(*(c.to_pylist() for c in batch.columns)), lambda r: r[:2]):
            if k != key:
                if held:
                    cut()
                key, number = k, 0
            for *_, line in group:
                held.append(line)
                size += len(line) + 1
                if size >= PIECE:
                    cut()
        if full:
            yield out()
    if held:
        cut()
        yield out()


def _hasher(done: dict, sizes: dict, marks: dict):
    """Task that goes on from what is done with its rows, which are sorted by file and place."""

    def run(batches):
        file, seen, digest = None, 0, None

        def end():
            row = {"file": file, "seen": seen, "state": digest.state() if sha256.resumes() else b"", "sha256": digest.hexdigest()}
            return pa.RecordBatch.from_pylist([row])

        for batch in batches:
            for name, _, _, data in zip(*(c.to_pylist() for c in batch.columns)):
                if name != file:
                    if file is not None:
                        yield end()
                    file, (seen, state) = name, done.get(name, (0, None))
                    digest = sha256.Resumable(state) if sha256.resumes() else hashlib.sha256()
                    data = data if seen else marks[name] + data
                # the line feed after the last line may not be in the file
                data = data[: sizes[name] - seen]
                digest.update(data)
                seen += len(data)
        if file is not None:
            yield end()

    return run


def fingerprint(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Row count and an order-insensitive digest of all columns, taken by name.

    The digest sums two 32-bit halves of a 64-bit row hash, so repeated rows count and the
    sum does not depend on the order in which partitions finish. Each value is written with its
    length before it, a null as a dash, so that different rows are different texts.
    """
    text = lambda c: F.col(c).cast("string")
    row = F.md5(F.concat(*[F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in sorted(df.columns)]))
    half = lambda i: F.conv(F.substring(row, i, 8), 16, 10).cast("decimal(20,0)")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(half(1)).cast("string").alias("digest_a"),
        F.sum(half(9)).cast("string").alias("digest_b"),
    )


def intraday_completeness(df: DataFrame, keys, day: str, ts: str, value: str, expected: int) -> DataFrame:
    """Bars per day, zero-volume bars, last value, and whether the day is complete."""
    out = df.groupBy(*keys, day).agg(
        F.count(F.lit(1)).alias("bars"),
        F.count_if(F.col("volume") == 0).alias("zero_volume"),
        F.max_by(value, ts).alias("last_value"),
    )
    return out.withColumn("complete", F.col("bars") == expected)


def payload_flags(text: str) -> dict[str, Column]:
    """Signs that a page is a challenge or an error and not data."""
    c = F.lower(F.col(text))
    return {
        "challenge": c.rlike(r"verify you are human|enable javascript|captcha|access denied|cf-chl"),
        "script_only": c.contains("<script") & ~c.contains("<p"),
        "empty": F.length(F.trim(c)) == 0,
    }


def override_values(df: DataFrame, overrides: DataFrame, on: Sequence[str], x: str) -> DataFrame:
    """Substitute single observations; all others keep their value."""
    o = overrides.select(*on, F.col(x).alias("__o"))
    return df.join(o, list(on), "left").withColumn(x, F.coalesce("__o", x)).drop("__o")


def override_and_diff(df: DataFrame, overrides: DataFrame, on, x: str, fn: Callable[[DataFrame], DataFrame],
                      keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Recompute fn with some observations replaced and report how its metrics moved."""
    before = fn(df).select(*keys, *metrics)
    after = fn(override_values(df, overrides, on, x)).select(*keys, *[F.col(m).alias(f"{m}_after") for m in metrics])
    out = before.join(after, list(keys))
    return out.withColumns({f"{m}_change": F.col(f"{m}_after") - F.col(m) for m in metrics})

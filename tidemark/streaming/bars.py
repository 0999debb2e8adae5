"""Streaming forms: completed bars from ticks, and keyed overwrite across micro-batches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.align import newest_per_key
from tidemark.session import shared_folder


def read_tick_stream(spark: SparkSession, path: str) -> DataFrame:
    """Stream a Parquet file or folder. The last letter is given as a pattern, which lets the
    file source accept a single file as well as a folder."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def to_instant(ts: str) -> Column:
    """Naive UTC time to an instant, whatever the session zone; watermarks need instants."""
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})"))


def to_naive(ts: str) -> Column:
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(ts).cast("timestamp_ntz"))


def bars(ticks: DataFrame, keys: list[str], ts: str, price: str, tie: str, every: str) -> DataFrame:
    """OHLC bars per window; works on a batch and on a stream alike."""
    position = F.struct(ts, tie)
    out = ticks.groupBy(*keys, F.window(ts, every).alias("w")).agg(
        F.min_by(price, position).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, position).alias("close"), F.count(F.lit(1)).alias("ticks"))
    return out.select(*keys, F.col("w.start").alias("bar_start"), F.col("w.end").alias("bar_end"), "open", "high", "low", "close", "ticks")


def completed_bars(ticks: DataFrame, keys: list[str], ts: str, price: str, tie: str, every: str, lateness: str) -> DataFrame:
    """In append mode a bar appears once, when the watermark has passed its end; the bar still
    open is never emitted and ticks later than the watermark are dropped."""
    return bars(ticks.withWatermark(ts, lateness), keys, ts, price, tie, every)


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Process everything available now into Parquet in the shared folder and read it back."""
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    query = (stream.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out")
             .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def upsert_log(stream: DataFrame, name: str, root: str | None = None) -> tuple[str, object]:
    """Append each micro-batch to a log partitioned by batch id; with the root of an earlier log, go on with it.

    A batch that is run again after a failure replaces its own partition, so the log is
    exactly once; which version of a key is current is decided when the log is read.
    """
    root = root or f"{shared_folder(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/log/batch={batch_id}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    return f"{root}/log", query


def _folders(spark: SparkSession, path: str) -> dict[int, object]:
    """Paths of the numbered partitions of a folder, by number."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath() for x in fs.listStatus(at)] if fs.exists(at) else []
    return {int(x.getName().rpartition("=")[2]): x for x in found if "=" in x.getName()}


def _parts(spark: SparkSession, log: str) -> tuple[DataFrame, int]:
    """Rows of the newest compacted generation and of the batches after it, and the last batch."""
    bases, batches = _folders(spark, f"{log}-compacted"), _folders(spark, log)
    upto = max(bases, default=-1)
    later = [k for k in batches if k > upto]
    frames = [spark.read.option("basePath", log).parquet(*[batches[k].toString() for k in later])] if later else []
    frames += [spark.read.parquet(bases[upto].toString())] if upto >= 0 else []
    rows = frames[0]
    for x in frames[1:]:
        rows = rows.unionByName(x)
    return rows, max([upto, *later])


def current_rows(spark: SparkSession, log: str, key: str, version: str) -> DataFrame:
    """The newest row of each key: later batches win, then the higher version."""
    return newest_per_key(_parts(spark, log)[0], [key], ["batch", version]).drop("batch")


def compact(spark: SparkSession, log: str, key: str, version: str) -> int:
    """Write the current rows as a generation of their own and delete the batches and generations it replaces; the last batch in it.

    Run it between runs of the stream, every so many batches: a read then costs the current rows and the batches since.
    """
    rows, last = _parts(spark, log)
    old = [p for folder, k in ((log, last), (f"{log}-compacted", last - 1)) for n, p in _folders(spark, folder).items() if n <= k]
    newest_per_key(rows, [key], ["batch", version]).write.mode("overwrite").parquet(f"{log}-compacted/upto={last}")
    for path in old:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return last

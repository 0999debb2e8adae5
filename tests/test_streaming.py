import datetime as dt

import pytest

from pyspark.sql import functions as F

from tidemark.streaming import bars as stm

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "series_id string, ts timestamp, event_id long, value double"


def ticks(spark, minutes, first_id=0):
    rows = [("a", T0 + dt.timedelta(minutes=m), first_id + i, float(m)) for i, m in enumerate(minutes)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def test_open_bar_is_held_back_and_too_late_ticks_are_dropped(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ticks(spark, [1, 30, 59, 61]).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    out = stm.completed_bars(stream, ["series_id"], "ts", "value", "event_id", "1 hour", "30 minutes")

    def run():
        q = (out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
        q.awaitTermination()
        return {(r["bar_start"].hour, r["ticks"], r["open"], r["close"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    assert run() == set()  # the first hour is not past the watermark yet
    ticks(spark, [200], 10).write.mode("append").parquet(path)
    assert run() == {(0, 3, 1.0, 59.0), (1, 1, 61.0, 61.0)}
    ticks(spark, [45, 400], 20).write.mode("append").parquet(path)  # minute 45 is far too late
    assert run() == {(0, 3, 1.0, 59.0), (1, 1, 61.0, 61.0), (3, 1, 200.0, 200.0)}


def test_stream_equals_batch_on_closed_bars(spark, tmp_path):
    path = str(tmp_path / "in")
    df = ticks(spark, list(range(0, 3000, 7)))
    df.write.parquet(path)
    got = stm.run_to_end(stm.completed_bars(stm.read_tick_stream(spark, path), ["series_id"], "ts", "value", "event_id", "1 hour", "1 hour"), "t")
    limit = T0 + dt.timedelta(minutes=max(range(0, 3000, 7)) - 60)
    want = stm.bars(df, ["series_id"], "ts", "value", "event_id", "1 hour").filter(F.col("bar_end") <= F.lit(limit))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("compacted", [False, True])
def test_later_batches_overwrite_keys(spark, tmp_path, compacted):
    """The first file is read to the end before the second one lands, so it is certain which batch is later."""
    path, schema, root, got = str(tmp_path / "in"), "id int, v string, version int", str(tmp_path / "u"), []
    for rows in [[(1, "a", 9), (2, "b", 1)], [(1, "c", 1), (3, "d", 1), (3, "e", 2)], [(2, "f", 0)]]:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        log, query = stm.upsert_log(spark.readStream.schema(schema).parquet(path), "u", root)
        query.awaitTermination()
        got.append({r["id"]: r["v"] for r in stm.current_rows(spark, log, "id", "version").collect()})
        if compacted:
            stm.compact(spark, log, "id", "version")
            assert {r["id"]: r["v"] for r in stm.current_rows(spark, log, "id", "version").collect()} == got[-1]
            assert not [x for x in (tmp_path / "u" / "log").iterdir() if x.name.startswith("batch=")]
    assert got == [{1: "a", 2: "b"}, {1: "c", 2: "b", 3: "e"}, {1: "c", 2: "f", 3: "e"}]

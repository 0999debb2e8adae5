import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import landed, sinks


def one(spark, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols))


def test_a_date_that_occurs_twice_is_an_error(spark, tmp_path):
    (tmp_path / "ok.csv").write_text("date,p\n2024-01-02,1.5\n2024-01-03,.\n")
    (tmp_path / "bad.csv").write_text("date,p\n2024-01-02,1.5\n2024-01-02,2\n")
    got = landed.read_series(spark, str(tmp_path / "ok.csv"), "p").orderBy("date").collect()
    assert [r["value"] for r in got] == [1.5, None]
    with pytest.raises(ValueError):
        landed.read_series(spark, str(tmp_path / "bad.csv"), "p")


def test_bundle_names_missing_series_and_takes_either_date_header(spark):
    df = spark.createDataFrame([("2024-01-01", "", "1.0", "."), ("", "2024-02-01", "", "2.5")], "DATE string, observation_date string, A string, B string")
    out = landed.unpivot_bundle(df, ["DATE", "observation_date"], {"a": "A", "b": "B"})
    assert {(r["series"], str(r["date"]), r["value"]) for r in out.collect()} == {("a", "2024-01-01", 1.0), ("b", "2024-01-01", None), ("a", "2024-02-01", None), ("b", "2024-02-01", 2.5)}
    with pytest.raises(ValueError):
        landed.unpivot_bundle(df, ["DATE"], {"c": "C"})


def quote(stamps, closes, zone="Europe/London", adj=None):
    ind = {"quote": [dict(open=closes, high=closes, low=closes, close=closes, volume=closes)]}
    if adj is not None:
        ind["adjclose"] = [{"adjclose": adj}]
    return json.dumps({"chart": {"result": [{"meta": {"exchangeTimezoneName": zone}, "timestamp": stamps, "indicators": ind}]}})


def test_quotes_pad_short_adjusted_closes_and_allow_none(spark):
    stamps = [1704067200, 1704153600, 1704240000]
    for adj, want in (([1.0], [1.0, None, None]), (None, [None, None, None])):
        out = landed.explode_quotes(one(spark, p=quote(stamps, [1.0, None, 3.0], adj=adj)), "p").orderBy("date").collect()
        assert [r["adj_close"] for r in out] == want and [r["close"] for r in out] == [1.0, None, 3.0]


@pytest.mark.parametrize("session_zone", ["UTC", "Asia/Tokyo"])
def test_only_local_midnight_bars_count(spark, session_zone):
    summer = dt.datetime(2024, 7, 1, 23, tzinfo=dt.timezone.utc)  # midnight of July 2 in London
    stamps = [int(summer.timestamp()), int(summer.timestamp()) + 86400, int(summer.timestamp()) + 86400 + 3723]
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        out = landed.session_closes(one(spark, p=quote(stamps, [1.0, None, 9.0])), "p").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [(r["date"], r["close"]) for r in out] == [(dt.date(2024, 7, 2), 1.0)]


def test_the_first_table_with_the_required_columns_is_read(spark):
    html = ("<table><tr><th>Name</th></tr><tr><td>x</td></tr></table><table><tr><th>Date</th><th><b>Price</b></th></tr>"
            "<tr><td>7. May 2031</td><td>1,234.50</td></tr><tr><td>Date</td><td>Price</td></tr><tr><td>8. May 2031</td><td>-</td></tr></table>")
    out = landed.price_table(one(spark, h=html), "h", "Date", ["Price"], ["d. MMMM yyyy"]).collect()
    assert [(r["date"], r["price"]) for r in out] == [(dt.date(2031, 5, 7), 1234.5)]


def test_a_page_without_the_table_gives_no_rows(spark):
    assert landed.html_tables(one(spark, h="<p>verify you are human</p>"), "h", ["Date"]).count() == 0


def test_text_after_a_marker(spark):
    df = one(spark, h="<p>Gold <b>up</b></p>\n<i>Add to Watchlist</i> market is <u>Closed</u> now")
    got = df.select(landed.visible_text("h", "Add to Watchlist", 250).alias("t")).first()["t"]
    assert got == " market is Closed now"


def test_both_feed_dialects(spark):
    rss = ("<rss><channel><title>feed</title><item><title> Gold &amp; rates </title><link>http://a</link><pubDate>Mon, 02 Nov 2026 10:00:00 +0200</pubDate></item>"
           "<item><title></title><link>http://b</link></item><item><title>No time</title><link>http://c</link><pubDate>later</pubDate></item></channel></rss>")
    atom = "<a:feed xmlns:a='http://www.w3.org/2005/Atom'><a:entry><a:title>黄金</a:title><a:link href='http://d'/><a:updated>2026-11-02T10:00:00Z</a:updated></a:entry></a:feed>"
    df = spark.createDataFrame([(rss, "s", 1, "official"), (atom, "s", 1, "official"), ("not xml", "s", 1, "official")], "xml string, src string, tier int, kind string")
    out = {r["url"]: r for r in landed.parse_feed(df, "xml", "src", "tier", "kind").collect()}
    assert set(out) == {"http://a", "http://c", "http://d"}
    assert out["http://a"]["title"] == "Gold & rates" and out["http://a"]["published_at_utc"] == dt.datetime(2026, 11, 2, 8)
    assert out["http://c"]["published_at_utc"] is None and out["http://c"]["published_raw"] == "later"
    assert out["http://d"]["language"] == "zh" and out["http://d"]["published_at_utc"] == dt.datetime(2026, 11, 2, 10)


def test_release_lines_become_utc(spark):
    lines = ["Monday, February 03, 2031 09:15 AM Harbour Traffic for January 2031", "Thursday, August 07, 2031 09:15 AM Timber Orders for July 2031", "Thursday, August 07, 2031 02:00 PM Open Day"]
    df = spark.createDataFrame([(x,) for x in lines], "l string")
    out = landed.parse_release_calendar(df, "l").collect()
    assert [r["release_utc"] for r in out] == [dt.datetime(2031, 2, 3, 14, 15), dt.datetime(2031, 8, 7, 13, 15), dt.datetime(2031, 8, 7, 18, 0)]
    assert [(r["release"], r["period"]) for r in out] == [("Harbour Traffic", "January 2031"), ("Timber Orders", "July 2031"), ("Open Day", None)]


def test_snapshot_needs_the_registered_manifest(spark, tmp_path):
    root = str(tmp_path / "snap")
    sinks.write_snapshot(spark.range(5), root, "v1")
    assert landed.read_verified_snapshot(spark, root).count() == 5
    manifest = landed.current_pointer(spark, root)["manifest"]
    sinks._write_line(spark, json.dumps({"data": "v1/daily", "tampered": True}), f"{root}/{manifest}")
    with pytest.raises(ValueError):
        landed.read_verified_snapshot(spark, root)


def test_a_writer_that_breaks_off_leaves_the_last_snapshot(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "snap")
    sinks.write_snapshot(spark.range(5), root, "v1")
    for step in ("_write_line", "commit"):  # data written; data and manifest written
        with monkeypatch.context() as m:
            m.setattr(sinks, step, lambda *_: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                sinks.write_snapshot(spark.range(7), root, "v1")
        assert landed.read_verified_snapshot(spark, root).count() == 5
    # commits whose writer broke off before the first or the last byte
    for torn in ("", '{"manifest": "v1/x/MANI'):
        assert sinks._put_if_absent(spark, torn, f"{root}/commits/{len(sinks.commits(spark, root)) + 1:010d}.json")
        assert landed.read_verified_snapshot(spark, root).count() == 5
    sinks.write_snapshot(spark.range(9), root, "v1")
    assert landed.read_verified_snapshot(spark, root).count() == 9


def test_two_writers_take_two_numbers(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "snap")
    assert sinks.commit(spark, root, '{"manifest": "a", "sha256": "x"}') == 1
    # the second writer listed the folder before the first one's commit
    with monkeypatch.context() as m:
        m.setattr(sinks, "commits", lambda *_: [])
        assert sinks.commit(spark, root, '{"manifest": "b", "sha256": "y"}') == 2
    assert [n for n, _ in sinks.commits(spark, root)] == [2, 1]
    assert landed.current_pointer(spark, root)["manifest"] == "b"


def test_a_root_with_a_bare_pointer_is_read(spark, tmp_path):
    root = str(tmp_path / "snap")
    sinks.write_snapshot(spark.range(3), root, "v1")
    pointer = landed.current_pointer(spark, root)
    spark.range(3).write.parquet(f"{root}/old/v1/daily")
    sinks._write_line(spark, json.dumps({"data": "v1/daily"}), f"{root}/old/v1/MANIFEST.json")
    found = sinks.clean.file_hashes(spark, f"{root}/old/v1/MANIFEST.json").first()["sha256"]
    sinks._write_line(spark, json.dumps(pointer | {"manifest": "v1/MANIFEST.json", "sha256": found}), f"{root}/old/CURRENT.json")
    assert landed.read_verified_snapshot(spark, f"{root}/old").count() == 3


def test_last_good_snapshot_is_marked_stale(spark):
    rows = [("a", dt.date(2024, 1, 1), 1, True), ("a", dt.date(2024, 1, 2), 2, False), ("b", dt.date(2024, 1, 2), 3, True), ("a", dt.date(2024, 1, 9), 9, True)]
    df = spark.createDataFrame(rows, "k string, snap date, v int, ok boolean")
    out = {r["k"]: (r["v"], r["stale"]) for r in landed.last_good(df, ["k"], "snap", F.col("ok"), "2024-01-02").collect()}
    assert out == {"a": (1, True), "b": (3, False)}


def test_rerunning_a_date_replaces_only_that_date(spark, tmp_path):
    path = str(tmp_path / "asof")
    sinks.write_asof(spark.range(3), path, "2024-01-01")
    sinks.write_asof(spark.range(7), path, "2024-01-02")
    sinks.write_asof(spark.range(4), path, "2024-01-02")
    assert sinks.read_latest(spark, path).count() == 4
    assert spark.read.parquet(path).count() == 7


def test_archive_is_newest_first_with_unknown_times_last(spark, tmp_path):
    rows = [("1", None), ("2", dt.datetime(2024, 1, 1)), ("3", dt.datetime(2024, 5, 1))]
    df = spark.createDataFrame(rows, "id string, published_at_utc timestamp_ntz").coalesce(1)
    sinks.write_news_archive(df, str(tmp_path / "n"))
    lines = [x for f in sorted((tmp_path / "n").glob("part-*")) for x in f.read_text().splitlines()]
    assert [json.loads(x)["id"] for x in lines] == ["3", "2", "1"]

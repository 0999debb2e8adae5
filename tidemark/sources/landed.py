"""Landed files to typed rows. Fetching is someone else's job; these start from raw text.

All parsers are column expressions on a frame with one payload per row (a page, a feed or a
quote response), so Spark splits the work by payload and no Python touches a row.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import cjk_lang, stable_id, to_number, to_utc, try_date
from tidemark.operators import clean
from tidemark.operators.align import newest_per_key
from tidemark.sources import sinks

EPOCH = "1970-01-01 00:00:00"
QUOTE_SCHEMA = """chart struct<result: array<struct<
  meta: struct<symbol: string, exchangeTimezoneName: string>, timestamp: array<bigint>,
  indicators: struct<quote: array<struct<open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<double>>>,
                     adjclose: array<struct<adjclose: array<double>>>>>>>"""
NAV_SCHEMA = """Data struct<LSJZList: array<struct<FSRQ: string, DWJZ: string, LJJZ: string, JZZZL: string, SGZT: string, SHZT: string>>>, TotalCount bigint"""
FEED_SCHEMA = """channel struct<item: array<struct<title: string, link: string, pubDate: string, published: string, updated: string>>>,
  entry array<struct<title: string, link: array<struct<_href: string, _VALUE: string>>, pubDate: string, published: string, updated: string>>"""
NEWS_FIELDS = ["id", "published_at_utc", "published_raw", "source", "source_tier", "record_type", "title", "url", "language", "classification_status"]


def typed_series(df: DataFrame, value_col: str, keys: Sequence[str] = (), date_col: str = "date", missing: str = ".") -> DataFrame:
    """Text columns to (keys, date, value); the missing marker and blanks become null."""
    value = F.when(F.col(value_col) != missing, F.col(value_col)).try_cast("double")
    return df.select(*keys, F.col(date_col).try_cast("date").alias("date"), value.alias("value"))


def read_series(spark: SparkSession, path: str, value_col: str, missing: str = ".") -> DataFrame:
    """A series from CSV files. Fails when a date occurs twice."""
    raw = spark.read.option("header", True).csv(path)
    series = typed_series(raw, value_col, missing=missing)
    if not clean.duplicate_keys(series, ["date"]).isEmpty():
        raise ValueError(f"duplicate dates: {path}")
    return series


def unpivot_bundle(df: DataFrame, date_aliases: Sequence[str], series: dict[str, str], keep_blank: bool = True) -> DataFrame:
    """Wide text columns to (series, date, raw, value). An absent series is an error; blank
    and '.' values are kept unless asked otherwise, with a null value."""
    absent = [c for c in series.values() if c not in df.columns]
    if absent:
        raise ValueError(f"series missing from bundle: {absent}")
    date = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in date_aliases if c in df.columns])
    wide = df.select(date.try_cast("date").alias("date"), *[F.col(c).alias(n) for n, c in series.items()])
    long = wide.unpivot(["date"], list(series), "series", "raw")
    long = long.withColumn("value", F.when(~F.col("raw").isin("", "."), F.col("raw")).try_cast("double"))
    return long if keep_blank else long.filter(F.col("value").isNotNull())


def local_time(epoch: Column, zone: Column) -> Column:
    """Wall-clock time of an epoch second in a named zone, whatever the session zone is."""
    utc = F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(secs=epoch.cast("decimal(18,6)"))
    return F.convert_timezone(F.lit("UTC"), zone, utc)


def explode_quotes(df: DataFrame, payload: str, carry: Sequence[str] = (), zoned: bool = False) -> DataFrame:
    """Parallel arrays of a quote payload to bars.

    Short adjusted closes are padded with null. With `zoned` the date is the exchange's local
    date and `local_ts` its clock time; else it is the UTC date.
    """
    r = F.from_json(F.col(payload), QUOTE_SCHEMA)["chart"]["result"][0]
    q = r["indicators"]["quote"][0]
    # array by array: zipping pads shorter arrays with null
    zipped = F.arrays_zip(r["timestamp"].alias("ts"), q["open"].alias("open"), q["high"].alias("high"), q["low"].alias("low"),
                          q["close"].alias("close"), r["indicators"]["adjclose"][0]["adjclose"].alias("adj_close"), q["volume"].alias("volume"))
    no_adjusted = F.arrays_zip(r["timestamp"].alias("ts"), q["open"].alias("open"), q["high"].alias("high"), q["low"].alias("low"),
                               q["close"].alias("close"), F.array().cast("array<double>").alias("adj_close"), q["volume"].alias("volume"))
    named = "array<struct<ts: bigint, open: double, high: double, low: double, close: double, adj_close: double, volume: double>>"
    rows = F.coalesce(zipped.cast(named), no_adjusted.cast(named))
    out = df.select(*carry, r["meta"]["exchangeTimezoneName"].alias("zone"), F.inline(rows))
    if zoned:
        out = out.withColumn("local_ts", local_time(F.col("ts"), F.col("zone")))
        out = out.withColumn("date", F.col("local_ts").cast("date"))
    else:
        out = out.withColumn("date", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ts") / 86400).cast("int")))
    return out


def session_closes(df: DataFrame, payload: str, carry: Sequence[str] = (), cutoff: str | None = None) -> DataFrame:
    """Local-session closes: only bars stamped at local midnight, nulls dropped."""
    out = explode_quotes(df, payload, carry, zoned=True)
    midnight = (F.hour("local_ts") == 0) & (F.minute("local_ts") == 0) & (F.second("local_ts") == 0)
    out = out.filter(midnight & F.col("close").isNotNull())
    if cutoff:
        out = out.filter(F.col("date") <= F.lit(cutoff).cast("date"))
    return out.select(*carry, "date", "close")


def explode_nav_pages(df: DataFrame, payload: str, carry: Sequence[str] = (), open_sub: str | None = None, open_red: str | None = None) -> DataFrame:
    """Fund pages to rows; with the status texts given, also the buy and sell flags."""
    out = df.select(*carry, F.inline(F.from_json(F.col(payload), NAV_SCHEMA)["Data"]["LSJZList"]))
    cols = [F.col("FSRQ").try_cast("date").alias("date"), F.col("DWJZ").try_cast("double").alias("nav"), F.col("LJJZ").try_cast("double").alias("acc_nav"),
            F.col("JZZZL").try_cast("double").alias("daily_return_pct"), F.col("SGZT").alias("subscription_status"), F.col("SHZT").alias("redemption_status")]
    out = out.select(*carry, *cols)
    if open_sub is not None:
        out = out.withColumns({"fund_buy": F.col("subscription_status") == open_sub, "fund_sell": F.col("redemption_status") == open_red})
    return out


def _strip(html: Column) -> Column:
    text = F.regexp_replace(html, "(?s)<[^>]*>", "")
    for entity, char in {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&amp;": "&"}.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def html_tables(df: DataFrame, html: str, required: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Body rows of the first table whose header has all required columns, as text columns."""
    cells = lambda row: F.transform(F.regexp_extract_all(row, F.lit("(?is)<t[hd][^>]*>(.*?)</t[hd]>"), 1), _strip)
    rows_of = lambda t: F.transform(F.regexp_extract_all(t, F.lit("(?is)<tr[^>]*>(.*?)</tr>"), 1), cells)
    tables = F.transform(F.regexp_extract_all(F.col(html), F.lit("(?is)<table[^>]*>(.*?)</table>"), 1), rows_of)
    needed = F.array(*[F.lit(c) for c in required])
    fits = F.filter(tables, lambda t: (F.size(t) > 0) & (F.size(F.array_intersect(F.get(t, F.lit(0)), needed)) == len(required)))
    df = df.select(*carry, F.get(fits, F.lit(0)).alias("__t"))
    df = df.select(*carry, F.get("__t", F.lit(0)).alias("__h"), F.explode("__t").alias("__r"))
    value = lambda c: F.get("__r", (F.array_position("__h", c) - 1).cast("int")).alias(c)
    return df.filter(F.col("__r") != F.col("__h")).select(*carry, *[value(c) for c in required])


def price_table(df: DataFrame, html: str, date_col: str, price_cols: Sequence[str], formats: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """An HTML price table with dates and numbers parsed; unparseable dates or prices drop the row."""
    rows = html_tables(df, html, [date_col, *price_cols], carry)
    out = rows.select(*carry, try_date(date_col, *formats).alias("date"), *[to_number(c).alias(c.lower()) for c in price_cols])
    return out.dropna(subset=["date", *[c.lower() for c in price_cols]])


def visible_text(html: str, marker: str | None = None, length: int | None = None) -> Column:
    """Text without tags, whitespace collapsed, optionally only what follows a marker."""
    text = F.regexp_replace(F.regexp_replace(F.col(html), "(?s)<[^>]+>", " "), r"\s+", " ")
    if marker:
        at = F.instr(text, marker)
        text = F.when(at > 0, F.substring(text, at + F.length(F.lit(marker)), F.length(text))).otherwise(text)
    return F.substring(text, 1, length) if length else text


def parse_feed(df: DataFrame, xml: str, source: str, tier: str, kind: str, carry: Sequence[str] = ()) -> DataFrame:
    """RSS and Atom payloads to news records. Items without title or link are dropped; a time
    that cannot be read stays as text in published_raw."""
    doc = F.from_xml(F.col(xml), FEED_SCHEMA, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    base = df.select(*[F.col(c) for c in dict.fromkeys([*carry, source, tier, kind])], doc.alias("__d"))
    item = "array<struct<title: string, url: string, published: string>>"
    rss = F.transform(F.col("__d.channel.item"), lambda i: F.struct(
        i["title"].alias("title"), i["link"].alias("url"), F.coalesce(i["pubDate"], i["published"], i["updated"]).alias("published")))
    atom = F.transform(F.col("__d.entry"), lambda e: F.struct(
        e["title"].alias("title"),
        F.coalesce(F.get(F.filter(F.transform(e["link"], lambda x: x["_VALUE"]), lambda v: F.length(F.trim(v)) > 0), F.lit(0)),
                   F.get(F.filter(F.transform(e["link"], lambda x: x["_href"]), lambda v: v.isNotNull()), F.lit(0))).alias("url"),
        F.coalesce(e["published"], e["updated"], e["pubDate"]).alias("published")))
    none = F.array().cast(item)
    items = F.concat(F.coalesce(rss.cast(item), none), F.coalesce(atom.cast(item), none))
    out = base.withColumn("__i", F.explode(items)).select(*carry, F.col(source).alias("source"), F.col(tier).alias("source_tier"), F.col(kind).alias("record_type"), "__i.*")
    out = out.withColumns({c: F.trim(c) for c in ("title", "url", "published")})
    out = out.filter((F.length("title") > 0) & (F.length("url") > 0))
    return out.withColumns({
        "id": stable_id("source", "url"), "published_at_utc": to_utc("published"), "published_raw": F.col("published"),
        "language": cjk_lang("title"), "classification_status": F.lit("unreviewed"),
    }).select(*carry, *NEWS_FIELDS)


def read_news_archive(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{c} {'int' if c == 'source_tier' else 'timestamp_ntz' if c == 'published_at_utc' else 'string'}" for c in NEWS_FIELDS)
    return spark.read.schema(schema).json(path)


def current_pointer(spark: SparkSession, root: str) -> dict:
    """The newest whole commit of `sinks.write_snapshot`; CURRENT.json where a root has no commits.

    A commit whose writer broke off before its end is not whole and is passed over.
    """
    for _, path in sinks.commits(spark, root):
        try:
            pointer = json.loads(_text(spark, path))
        except ValueError:
            continue
        if isinstance(pointer, dict) and {"manifest", "sha256"} <= pointer.keys():
            return pointer
    return json.loads(_text(spark, f"{root}/CURRENT.json"))


def _text(spark: SparkSession, path: str) -> str:
    return "".join(r["value"] for r in spark.read.text(path).collect())


def read_verified_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """Pointer to manifest to Parquet; the manifest's SHA-256 must be the pointer's.

    Only the small control files are read on the driver.
    """
    pointer = current_pointer(spark, root)
    found = clean.file_hashes(spark, f"{root}/{pointer['manifest']}").select("sha256").first()["sha256"]
    if found != pointer["sha256"]:
        raise ValueError(f"manifest of {root} does not match its pointer")
    manifest = json.loads(_text(spark, f"{root}/{pointer['manifest']}"))
    return spark.read.parquet(f"{root}/{manifest['data']}")


def snapshot_asof(df: DataFrame, keys: Sequence[str], snapshot: str, asof: str) -> DataFrame:
    """Rows of snapshots up to `asof`, the newest snapshot winning per key."""
    return newest_per_key(df.filter(F.col(snapshot) <= F.lit(asof).cast("date")), keys, [snapshot])


def last_good(df: DataFrame, keys: Sequence[str], snapshot: str, ok: Column, asof: str) -> DataFrame:
    """Per key the newest usable snapshot up to `asof`; `stale` when it is older than asof."""
    day = F.lit(asof).cast("date")
    good = newest_per_key(df.filter((F.col(snapshot) <= day) & ok), keys, [snapshot])
    return good.withColumn("stale", F.col(snapshot) < day)


def explode_daily_detail(df: DataFrame, payload: str, carry: Sequence[str] = ()) -> DataFrame:
    """Table-oriented JSON of daily equity and weights to typed rows."""
    schema = "data array<struct<date: string, equity: double, weight: double, fee: double, traded: boolean>>"
    out = df.select(*carry, F.inline(F.from_json(F.col(payload), schema)["data"]))
    return out.withColumn("date", F.substring("date", 1, 10).try_cast("date"))


def parse_release_calendar(df: DataFrame, line: str, zone: str = "America/New_York", carry: Sequence[str] = ()) -> DataFrame:
    """'Friday, January 10, 2020 08:30 AM Title for Period' to UTC time, release and period."""
    pattern = r"^\w+, (\w+ \d{1,2}, \d{4} \d{2}:\d{2} [AP]M) (.+?)(?: for (.+))?$"
    when = F.regexp_extract(line, pattern, 1)
    local = F.call_function("try_to_timestamp", F.nullif(when, F.lit("")), F.lit("MMMM d, yyyy hh:mm a")).cast("timestamp_ntz")
    return df.select(
        *carry, F.convert_timezone(F.lit(zone), F.lit("UTC"), local).alias("release_utc"),
        F.regexp_extract(line, pattern, 2).alias("release"), F.nullif(F.regexp_extract(line, pattern, 3), F.lit("")).alias("period"))

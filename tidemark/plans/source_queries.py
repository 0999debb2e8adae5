"""SRC and SNK: payloads are rendered from the tables, then read back by the parsers."""

from pyspark.sql import functions as F

from tidemark.operators import clean
from tidemark.plans.registry import query
from tidemark.plans.views import BARS, CAL, NEWS, RAW, index_bars, news, product_calendar, raw_bars, table
from tidemark.session import shared_folder
from tidemark.sources import landed, sinks

K = ["series_id"]


def _fresh(spark, name):
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("src1_typed_series", f"WITH {RAW} SELECT series_id, date, CASE WHEN n > 1 THEN close END AS value FROM raw")
def typed_series(spark, sf):
    text = raw_bars(spark, sf).select("series_id", F.date_format("date", "yyyy-MM-dd").alias("date"),
                                      F.when(F.col("n") > 1, F.col("close").cast("string")).otherwise(".").alias("price"))
    return landed.typed_series(text, "price", K)


def _wide(spark, sf):
    """Monthly totals by order status as text columns, the date under one of two headers."""
    month = F.trunc(F.col("o_orderdate").cast("date"), "MM")
    wide = table(spark, sf, "orders").groupBy(month.alias("m")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    old = F.year("m") < 1998
    value = lambda c: F.when(F.month("m") == 2, ".").when(F.month("m") == 5, "").otherwise(F.col(c).cast("string"))
    text = F.date_format("m", "yyyy-MM-dd")
    return wide.select(F.when(old, text).otherwise("").alias("DATE"), F.when(~old, text).alias("observation_date"),
                       value("F").alias("FIN"), value("O").alias("OPN"), value("P").alias("PND"))


WIDE = """lg AS (SELECT o_orderstatus AS s, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1, 2),
un AS (SELECT CASE s WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'pending' END AS series, m.date, CASE month(m.date) WHEN 2 THEN '.' WHEN 5 THEN '' ELSE CAST(n AS VARCHAR) END AS raw,
  CASE WHEN month(m.date) NOT IN (2, 5) THEN CAST(n AS DOUBLE) END AS value FROM (SELECT DISTINCT date FROM lg) m CROSS JOIN (VALUES ('F'), ('O'), ('P')) v(s) LEFT JOIN lg USING (date, s))"""
SERIES = {"finished": "FIN", "open": "OPN", "pending": "PND"}


@query("src2_wide_bundle", f"WITH {WIDE} SELECT * FROM un")
def wide_bundle(spark, sf):
    return landed.unpivot_bundle(_wide(spark, sf), ["DATE", "observation_date"], SERIES)


@query("src3_single_macro_series", f"WITH {WIDE} SELECT date, value FROM un WHERE series = 'open' AND value IS NOT NULL")
def single_macro_series(spark, sf):
    return landed.unpivot_bundle(_wide(spark, sf), ["DATE", "observation_date"], {"open": "OPN"}, keep_blank=False).select("date", "value")


def quote_payloads(spark, sf):
    """One JSON response per series and year; the adjusted closes stop early and some closes are null."""
    b = index_bars(spark, sf)
    zone = F.when(F.col("series_id") == "AF", "Europe/London").when(F.col("series_id") == "AO", "Asia/Shanghai").otherwise("UTC")
    midnight = F.convert_timezone(zone, F.lit("UTC"), F.col("date").cast("timestamp_ntz"))
    b = b.withColumns({"zone": zone, "__m": midnight})
    b = b.withColumn("ts", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', __m)"))
    b = b.withColumn("close", F.when(F.col("high") > F.col("close") * 1.004, F.col("close")))
    # at most 366 bars per payload
    rows = b.groupBy("series_id", F.year("date").alias("year"), "zone").agg(
        F.array_sort(F.collect_list(F.struct("ts", "open", "high", "low", "close", "volume"))).alias("r"))

    def field(c):
        return F.transform("r", lambda x: x[c]).alias(c)

    quote = F.struct(*[field(c) for c in ("open", "high", "low", "close", "volume")])
    adj = F.transform(F.slice("r", 1, F.size("r") - 2), lambda x: x["close"])
    result = F.struct(F.struct(F.col("series_id").alias("symbol"), F.col("zone").alias("exchangeTimezoneName")).alias("meta"),
                      F.transform("r", lambda x: x["ts"]).alias("timestamp"),
                      F.struct(F.array(quote).alias("quote"), F.array(F.struct(adj.alias("adjclose"))).alias("adjclose")).alias("indicators"))
    payload = F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")), {"ignoreNullFields": "false"})
    return rows.select("series_id", "year", payload.alias("payload"))


QUOTES = f"""{BARS}, qb AS (SELECT series_id, date, open, volume, CASE WHEN high > close * 1.004::DOUBLE THEN close END AS close, year(date) AS y,
  row_number() OVER (PARTITION BY series_id, year(date) ORDER BY date DESC) AS back FROM bars)"""


@query("src4_quote_payload", f"""WITH {QUOTES}
SELECT series_id, CASE WHEN series_id = 'AO' OR (series_id = 'AF' AND timezone('Europe/London', CAST(date AS TIMESTAMP)) AT TIME ZONE 'UTC' < CAST(date AS TIMESTAMP)) THEN date - 1 ELSE date END AS date,
 open, close, CASE WHEN back > 2 THEN close END AS adj_close, volume FROM qb""")
def quote_payload(spark, sf):
    return landed.explode_quotes(quote_payloads(spark, sf), "payload", K).select("series_id", "date", "open", "close", "adj_close", "volume")


@query("src5_local_session_closes", f"WITH {QUOTES} SELECT series_id, date, close FROM qb WHERE close IS NOT NULL AND date <= DATE '2000-06-30'")
def local_session_closes(spark, sf):
    return landed.session_closes(quote_payloads(spark, sf), "payload", K, cutoff="2000-06-30")


def nav_pages(spark, sf):
    """Pages of one month each, newest first, all values as text."""
    c = product_calendar(spark, sf)
    row = F.struct(F.date_format("date", "yyyy-MM-dd").alias("FSRQ"), F.col("nav").cast("string").alias("DWJZ"), F.col("nav").cast("string").alias("LJJZ"),
                   F.lit("").alias("JZZZL"), F.col("sub_status").alias("SGZT"), F.col("red_status").alias("SHZT"))
    pages = c.groupBy("product_id", F.trunc("date", "MM").alias("page")).agg(F.reverse(F.array_sort(F.collect_list(row))).alias("LSJZList"))
    payload = F.to_json(F.struct(F.struct("LSJZList").alias("Data"), F.size("LSJZList").alias("TotalCount")))
    return pages.select("product_id", payload.alias("payload"))


@query("src6_fund_pages", f"WITH {CAL} SELECT product_id, date, round(nav, 6) AS nav, sub_status AS subscription_status, red_status AS redemption_status FROM cal")
def fund_pages(spark, sf):
    out = landed.explode_nav_pages(nav_pages(spark, sf), "payload", ["product_id"])
    return out.select("product_id", "date", F.round("nav", 6).alias("nav"), "subscription_status", "redemption_status")


@query("src7_fund_status_flags", f"WITH {CAL} SELECT product_id, date, sub_status = 'open' AS fund_buy, red_status = 'open' AS fund_sell, true AS nav_is_accumulated FROM cal")
def fund_status_flags(spark, sf):
    out = landed.explode_nav_pages(nav_pages(spark, sf), "payload", ["product_id"], "open", "open")
    return out.select("product_id", "date", "fund_buy", "fund_sell", (F.col("nav") == F.col("acc_nav")).alias("nav_is_accumulated"))


def price_pages(spark, sf):
    """A page per series and month with a decoy table before the price table."""
    b = raw_bars(spark, sf)
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    price = lambda c: F.format_number(c, 2)
    day = F.when(F.col("series_id") < "3", F.date_format("date", "dd. MMMM yyyy")).otherwise(F.date_format("date", "MMM dd, yyyy"))
    line = F.concat(F.lit("<tr>"), cell(day), *[cell(price(c)) for c in ("close", "open", "high", "low")], F.lit("</tr>\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date", line.alias("line")))), lambda x: x["line"]), "")
    html = F.concat(F.lit("<html><p>x</p><table><tr><th>Menu</th></tr><tr><td>1</td></tr></table><TABLE class='h'><tr>"
                          "<th>Date</th><th> Price </th><th>Open</th><th>High</th><th>Low</th></tr><tr><th>Date</th><th>Price</th><th>Open</th><th>High</th><th>Low</th></tr>"), body,
                    F.lit("<tr><td>bad date</td><td>1</td><td>1</td><td>1</td><td>1</td></tr></TABLE></html>"))
    return b.groupBy("series_id", F.trunc("date", "MM").alias("month")).agg(html.alias("html"))


@query("src8_html_price_table", f"WITH {RAW} SELECT series_id, date, close AS price, open, high, low FROM raw")
def html_price_table(spark, sf):
    return landed.price_table(price_pages(spark, sf), "html", "Date", ["Price", "Open", "High", "Low"], ["d. MMMM yyyy", "MMM d, yyyy"], K)


@query("src9_visible_text", r"""WITH v AS (SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'gs'), '[ \t\n\x0B\f\r]+', ' ', 'g') AS t FROM pages),
m AS (SELECT page_id, CASE WHEN contains(t, ' track(') THEN substr(t, instr(t, ' track(') + 7) ELSE t END AS t, length(t) AS n FROM v)
SELECT page_id, length(t) AS rest, n AS chars, md5(t) AS digest, regexp_matches(substr(t, 1, 250), '\bthe\b') AS flag FROM m""")
def visible_text(spark, sf):
    p = table(spark, sf, "pages")
    p = p.select("page_id", landed.visible_text("html").alias("all"), landed.visible_text("html", " track(").alias("t"))
    return p.select("page_id", F.length("t").cast("long").alias("rest"), F.length("all").cast("long").alias("chars"), F.md5("t").alias("digest"),
                    F.substring("t", 1, 250).rlike(r"\bthe\b").alias("flag"))


def feed_pages(spark, sf):
    """Feeds of up to 50 headlines: RSS for most sources, Atom for the others."""
    n = news(spark, sf).withColumn("title", F.regexp_replace("title", r"[\x00-\x1f]", ""))
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    atom = F.col("source") >= "src5"
    rss_item = F.concat(F.lit("<item><title>"), esc(F.col("title")), F.lit("</title><link>"), F.col("link"), F.lit("</link><pubDate>"),
                        F.date_format("published", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item>"))
    atom_item = F.concat(F.lit("<entry><title>"), esc(F.col("title")), F.lit("</title><link href='"), F.col("link"), F.lit("'/><updated>"),
                         F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z</updated></entry>"))
    items = n.select("source", F.floor(F.col("doc_id") / 50).alias("page"), "doc_id", atom.alias("atom"), F.when(atom, atom_item).otherwise(rss_item).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "x"))), lambda r: r["x"]), "")
    pages = items.groupBy("source", "page", "atom").agg(body.alias("b"))
    xml = F.when(F.col("atom"), F.concat(F.lit("<feed xmlns='http://www.w3.org/2005/Atom'>"), F.col("b"), F.lit("</feed>"))).otherwise(
        F.concat(F.lit("<rss><channel><title>c</title>"), F.col("b"), F.lit("</channel></rss>")))
    return pages.select("source", F.lit(2).alias("tier"), F.lit("official").alias("kind"), xml.alias("xml"))


FEED_SQL = f"""WITH {NEWS}, t AS (SELECT *, trim(regexp_replace(title, '[\\x00-\\x1f]', '', 'g')) AS tt FROM news)
SELECT substr(sha256(source || '|' || link), 1, 20) AS id, published AS published_at_utc, source, 2 AS source_tier, 'official' AS record_type, md5(tt) AS title_digest, link AS url,
 CASE WHEN regexp_matches(tt, '[一-鿿]') THEN 'zh' ELSE 'en' END AS language, 'unreviewed' AS classification_status FROM t WHERE tt <> ''"""


def feed_records(spark, sf):
    return landed.parse_feed(feed_pages(spark, sf), "xml", "source", "tier", "kind")


@query("src10_news_feeds", FEED_SQL)
def news_feeds(spark, sf):
    return feed_records(spark, sf).withColumn("title_digest", F.md5("title")).drop("title", "published_raw")


@query("src11_jsonl_archive", f"WITH {NEWS} SELECT substr(sha256(source || '|' || link), 1, 20) AS id, source, link AS url FROM news")
def jsonl_archive(spark, sf):
    n = news(spark, sf).select(landed.stable_id("source", "link").alias("id"), "source", F.col("link").alias("url"), F.lit(2).alias("source_tier"))
    path = _fresh(spark, "archive")
    n.write.json(path)
    return landed.read_news_archive(spark, path).select("id", "source", "url")


@query("src12_verified_snapshot", f"WITH {BARS} SELECT series_id, date, close FROM bars")
def verified_snapshot(spark, sf):
    root = _fresh(spark, "snapshots")
    sinks.write_snapshot(index_bars(spark, sf).select("series_id", "date", "close"), root, "s1")
    return landed.read_verified_snapshot(spark, root)


SNAPSHOTS = """sn AS (SELECT o_custkey AS id, CAST(o_orderdate AS DATE) AS snapshot, max(o_totalprice) AS price, count(*) FILTER (o_orderstatus = 'P') = 0 AS ok FROM orders GROUP BY 1, 2)"""


def _snapshots(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id"), F.col("o_orderdate").cast("date").alias("snapshot")).agg(
        F.max("o_totalprice").alias("price"), (F.count_if(F.col("o_orderstatus") == "P") == 0).alias("ok"))


@query("src13_snapshots_as_of", f"WITH {SNAPSHOTS} SELECT id, max(snapshot) AS snapshot, arg_max(price, snapshot) AS price FROM sn WHERE snapshot <= DATE '1998-12-31' GROUP BY 1")
def snapshots_as_of(spark, sf):
    return landed.snapshot_asof(_snapshots(spark, sf).drop("ok"), ["id"], "snapshot", "1998-12-31")


@query("src14_last_good_snapshot", f"WITH {SNAPSHOTS} SELECT id, max(snapshot) AS snapshot, arg_max(price, snapshot) AS price, max(snapshot) < DATE '1998-12-31' AS stale FROM sn WHERE ok AND snapshot <= DATE '1998-12-31' GROUP BY 1")
def last_good_snapshot(spark, sf):
    return landed.last_good(_snapshots(spark, sf), ["id"], "snapshot", F.col("ok"), "1998-12-31").drop("ok")


@query("src15_daily_detail", f"WITH {BARS} SELECT series_id, date, close AS equity, open / (open + close) AS weight, volume AS fee, close > open AS traded FROM bars")
def daily_detail(spark, sf):
    b = index_bars(spark, sf)
    row = F.struct(F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit("T00:00:00.000Z")).alias("date"), F.col("close").alias("equity"),
                   (F.col("open") / (F.col("open") + F.col("close"))).alias("weight"), F.col("volume").alias("fee"), (F.col("close") > F.col("open")).alias("traded"))
    doc = b.groupBy("series_id", F.year("date").alias("y")).agg(F.to_json(F.struct(F.collect_list(row).alias("data"))).alias("payload"))
    return landed.explode_daily_detail(doc, "payload", K)


@query("src16_release_calendar", """SELECT o_orderkey, timezone('America/New_York', o_orderdate + INTERVAL '8 hours 30 minutes') AT TIME ZONE 'UTC' AS release_utc, 'Report ' || o_custkey AS release,
 CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%B %Y') END AS period FROM orders""")
def release_calendar(spark, sf):
    o = table(spark, sf, "orders")
    period = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit(" for "), F.date_format("o_orderdate", "MMMM yyyy"))).otherwise("")
    line = F.concat(F.date_format("o_orderdate", "EEEE, MMMM dd, yyyy"), F.lit(" 08:30 AM Report "), F.col("o_custkey").cast("string"), period)
    return landed.parse_release_calendar(o.select("o_orderkey", line.alias("line")), "line", carry=["o_orderkey"])


# sinks


@query("snk1_csv_round_trip", f"WITH {RAW} SELECT series_id, date, close FROM raw")
def csv_round_trip(spark, sf):
    path = _fresh(spark, "csv")
    sinks.write_csv(raw_bars(spark, sf), path, ["series_id", "date", "close"])
    return spark.read.option("header", True).schema("series_id string, date date, close double").csv(path)


@query("snk2_ordered_news_archive", FEED_SQL.replace("source, 2 AS source_tier, 'official' AS record_type, md5(tt) AS title_digest, link AS url,", "link AS url,").replace(", 'unreviewed' AS classification_status", ""))
def ordered_news_archive(spark, sf):
    path = _fresh(spark, "news")
    sinks.write_news_archive(feed_records(spark, sf), path)
    return landed.read_news_archive(spark, path).select("id", "published_at_utc", "url", "language")


@query("snk3_as_of_output_and_latest", f"WITH {BARS} SELECT series_id, date, close, DATE '1999-06-30' AS asof FROM bars WHERE date < DATE '1999-06-30'")
def as_of_output_and_latest(spark, sf):
    path = _fresh(spark, "asof")
    bars = index_bars(spark, sf).select("series_id", "date", "close")
    for day in ("1998-06-30", "1999-06-30", "1999-06-30"):
        sinks.write_asof(bars.filter(F.col("date") < F.lit(day).cast("date")), path, day)
    return sinks.read_latest(spark, path)


@query("snk4_daily_and_trade_tables", f"WITH {BARS} SELECT series_id, count(*) AS daily_rows, count(*) FILTER (close > open) AS trade_rows FROM bars GROUP BY 1")
def daily_and_trade_tables(spark, sf):
    path = _fresh(spark, "detail")
    bars = index_bars(spark, sf).select("series_id", "date", "open", "close")
    bars.write.parquet(f"{path}/daily")
    daily = spark.read.parquet(f"{path}/daily")
    daily.filter("close > open").write.json(f"{path}/trades")
    trades = spark.read.schema("series_id string, date date, close double").json(f"{path}/trades")
    n = trades.groupBy("series_id").agg(F.count(F.lit(1)).alias("trade_rows"))
    return daily.groupBy("series_id").agg(F.count(F.lit(1)).alias("daily_rows")).join(n, "series_id", "left").select("series_id", "daily_rows", F.coalesce("trade_rows", F.lit(0)).alias("trade_rows"))


@query("snk5_collection_report", f"""WITH {RAW}, v AS (SELECT *, CASE WHEN n > 1 THEN close END AS v, CASE WHEN n > 7 THEN 'crowded' WHEN n = 1 THEN 'thin' END AS e FROM raw)
SELECT series_id, count(v) AS rows, min(CASE WHEN v IS NOT NULL THEN date END) AS first, max(CASE WHEN v IS NOT NULL THEN date END) AS last, coalesce(string_agg(DISTINCT e, ',' ORDER BY e), '') AS errors FROM v GROUP BY 1""")
def collection_report(spark, sf):
    df = raw_bars(spark, sf).withColumns({"v": F.when(F.col("n") > 1, F.col("close")), "e": F.when(F.col("n") > 7, "crowded").when(F.col("n") == 1, "thin")})
    return sinks.collection_report(df, K, "date", "v", "e")


@query("dq10_file_hashes")
def file_hashes(spark, sf):
    """Size and digest of the landed table files themselves."""
    files = clean.file_hashes(spark, f"{sf}/*.parquet")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "sha256")

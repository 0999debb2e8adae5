"""EVT, NWS, STA and STR."""

from pyspark.sql import functions as F

from tidemark.operators import events as evt
from tidemark.operators import news as nws
from tidemark.operators import stats as sta
from tidemark.plans.registry import query
from tidemark.plans.source_queries import feed_records
from tidemark.plans.views import BARS, NEWS, index_bars, kept_bars, news, table
from tidemark.operators.align import upsert
from tidemark.session import materialise
from tidemark.streaming import bars as stm

K = ["series_id"]


def bars_of(spark, sf, keep=False):
    return (kept_bars if keep else index_bars)(spark, sf).select("series_id", "date", "close")


def event_cases(spark, sf):
    """Every line item's ship day as a dated event on its series."""
    return table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("series_id"), F.col("l_shipdate").cast("date").alias("date"),
                     F.when(F.col("l_tax") >= 0.04, "policy").otherwise("data").alias("category"), F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("case_line"))


CASES = """cases AS (SELECT l_returnflag || l_linestatus AS series_id, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_tax >= 0.04 THEN 'policy' ELSE 'data' END AS category, l_orderkey AS case_id, l_linenumber AS case_line FROM lineitem)"""
FWD = """fw AS (SELECT series_id, date, close, lead(close, 5) OVER w / close - 1 AS f5, lead(close, 20) OVER w / close - 1 AS f20, lead(date, 5) OVER w AS k5 FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY date)),
ab AS (SELECT *, f5 - (sum(f5) OVER d - f5) / nullif(count(f5) OVER d - 1, 0) AS a5, f20 - (sum(f20) OVER d - f20) / nullif(count(f20) OVER d - 1, 0) AS a20 FROM fw WINDOW d AS (PARTITION BY date)),
er AS (SELECT c.*, b.date AS session, b.f5, b.f20, b.a5, b.a20, b.k5 FROM cases c ASOF LEFT JOIN ab b ON c.series_id = b.series_id AND c.date >= b.date)"""


def _returns(spark, sf):
    return evt.event_returns(event_cases(spark, sf), bars_of(spark, sf, keep=True), K, "date", "close", (5, 20))


@query("evt1_event_returns", f"WITH {BARS}, {CASES}, {FWD} SELECT series_id, date, category, case_id, case_line, session, round(f5, 8) AS fwd_5, round(a5, 8) AS abn_5, round(f20, 8) AS fwd_20, round(a20, 8) AS abn_20 FROM er")
def event_returns(spark, sf):
    r = _returns(spark, sf)
    return r.select("series_id", "date", "category", "case_id", "case_line", "session", *[F.round(c, 8).alias(c) for c in ("fwd_5", "abn_5", "fwd_20", "abn_20")])


@query("evt1_earlier_analogs", f"""WITH {BARS}, {CASES}, {FWD},
kn AS (SELECT series_id, category, k5 AS date, sum(a5) AS s, count(*) AS n FROM er WHERE a5 IS NOT NULL GROUP BY 1, 2, 3),
kt AS (SELECT series_id, category, date, sum(s) OVER w AS s, CAST(sum(n) OVER w AS BIGINT) AS n FROM kn WINDOW w AS (PARTITION BY series_id, category ORDER BY date ROWS UNBOUNDED PRECEDING))
SELECT e.series_id, e.date, e.category, e.case_id, e.case_line, coalesce(k.n, 0) AS analogs, round(k.s / k.n, 8) AS analog_mean
FROM er e ASOF LEFT JOIN kt k ON e.series_id = k.series_id AND e.category = k.category AND e.date > k.date""")
def earlier_analogs(spark, sf):
    out = evt.earlier_analogs(materialise(_returns(spark, sf)), K, "date", "category", 5)
    return out.select("series_id", "date", "category", "case_id", "case_line", "analogs", F.round("analog_mean", 8).alias("analog_mean"))


@query("evt2_post_event_minimum", f"""WITH {BARS}, {CASES}, m AS (SELECT *, min({{'v': close, 'd': date}}) OVER (PARTITION BY series_id ORDER BY date RANGE BETWEEN CURRENT ROW AND INTERVAL 365 DAY FOLLOWING) AS lowest FROM bars)
SELECT c.series_id, c.date, c.case_id, c.case_line, m.lowest.d AS min_date, m.lowest.v AS min_value, CAST(m.lowest.d - c.date AS INTEGER) AS days_to_min, round((m.lowest.v / m.close - 1) * 100, 6) AS min_pct
FROM cases c ASOF LEFT JOIN m ON c.series_id = m.series_id AND c.date >= m.date""")
def post_event_minimum(spark, sf):
    out = evt.post_event_min(event_cases(spark, sf), bars_of(spark, sf), K, "date", "close")
    return out.select("series_id", "date", "case_id", "case_line", "min_date", "min_value", "days_to_min", F.round("min_pct", 6).alias("min_pct"))


@query("evt3_peak_before_event", f"""WITH {BARS}, {CASES}, m AS (SELECT *, max({{'v': close, 'd': date}}) OVER (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS top FROM bars)
SELECT c.series_id, c.date, c.case_id, c.case_line, m.top.d AS peak_date, m.top.v AS peak_value, CAST(c.date - m.top.d AS INTEGER) AS days_since_peak, round((m.close / m.top.v - 1) * 100, 6) AS drawdown_pct
FROM cases c ASOF LEFT JOIN m ON c.series_id = m.series_id AND c.date >= m.date""")
def peak_before_event(spark, sf):
    out = evt.pre_event_peak(event_cases(spark, sf), bars_of(spark, sf), K, "date", "close")
    return out.select("series_id", "date", "case_id", "case_line", "peak_date", "peak_value", "days_since_peak", F.round("drawdown_pct", 6).alias("drawdown_pct"))


def stages(spark, sf):
    """Stage table per customer: order dates with a price and a rate."""
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("case_id"), F.col("o_orderdate").cast("date").alias("date")).agg(
        F.max("o_totalprice").alias("price"), (F.max("o_orderkey") % 977 / 128.0).alias("rate"))


STAGES = "stages AS (SELECT o_custkey AS case_id, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS price, max(o_orderkey) % 977 / 128.0::DOUBLE AS rate FROM orders GROUP BY 1, 2)"


@query("evt4_adjacent_stage_deltas", f"""WITH {STAGES} SELECT case_id, date, round((price / lag(price) OVER w - 1) * 100, 6) AS price_delta_pct, round((rate - lag(rate) OVER w) * 100, 6) AS rate_delta_bp
FROM stages WINDOW w AS (PARTITION BY case_id ORDER BY date)""")
def adjacent_stage_deltas(spark, sf):
    out = evt.event_deltas(stages(spark, sf), ["case_id"], "date", ["price"], ["rate"])
    return out.select("case_id", "date", F.round("price_delta_pct", 6).alias("price_delta_pct"), F.round("rate_delta_bp", 6).alias("rate_delta_bp"))


@query("evt5_case_endpoints", f"""WITH {STAGES} SELECT case_id, min(date) AS start_date, max(date) AS end_date, count(*) AS stages, arg_min(price, date) AS start_price, arg_max(price, date) AS end_price,
 round((arg_max(price, date) / arg_min(price, date) - 1) * 100, 6) AS price_change_pct, CAST(max(date) - min(date) AS INTEGER) AS days FROM stages GROUP BY 1""")
def case_endpoints(spark, sf):
    return evt.case_endpoints(stages(spark, sf), ["case_id"], "date", ["price"]).withColumn("price_change_pct", F.round("price_change_pct", 6))


@query("evt6_case_counts", """SELECT o_orderpriority AS category, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'P') AS pending FROM orders GROUP BY 1""")
def case_counts(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("category"), "o_orderstatus")
    wide = o.groupBy("category").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return wide.select("category", F.coalesce("F", F.lit(0)).alias("done"), F.coalesce("O", F.lit(0)).alias("open"), F.coalesce("P", F.lit(0)).alias("pending"))


POINTS = ["1996-03-15", "1997-10-27", "1998-08-31", "2000-03-10", "2001-04-04"]


@query("evt7_segment_returns", f"""WITH {BARS}, p(point) AS (VALUES {', '.join(f"(DATE '{p}')" for p in POINTS)}), v AS (SELECT s.series_id, p.point, arg_max(b.close, b.date) AS v, max(b.date) AS q FROM (SELECT DISTINCT series_id FROM bars) s, p JOIN bars b ON b.date <= p.point WHERE b.series_id = s.series_id GROUP BY 1, 2),
g AS (SELECT series_id, lag(point) OVER w AS start, point AS "end", q AS quote_date, (v / lag(v) OVER w - 1) * 100 AS r FROM v WINDOW w AS (PARTITION BY series_id ORDER BY point)) SELECT series_id, start, "end", quote_date, round(r, 6) AS return_pct FROM g WHERE start IS NOT NULL""")
def segment_returns(spark, sf):
    return evt.segment_returns(bars_of(spark, sf), K, "date", "close", POINTS).withColumn("return_pct", F.round("return_pct", 6))


# news

REC = """rec AS (SELECT substr(sha256(source || '|' || link), 1, 20) AS id, * FROM news)"""


@query("nws1_canonical_records", f"""WITH {NEWS}, t AS (SELECT *, trim(regexp_replace(title, '[\\x00-\\x1f]', '', 'g')) AS tt FROM news)
SELECT source, language, 2 AS source_tier, 'official' AS record_type, 'unreviewed' AS classification_status, count(*) AS records, min(published) AS first_published, max(published) AS last_published
FROM (SELECT *, CASE WHEN regexp_matches(tt, '[一-鿿]') THEN 'zh' ELSE 'en' END AS language FROM t WHERE tt <> '') GROUP BY ALL""")
def canonical_records(spark, sf):
    return feed_records(spark, sf).groupBy("source", "language", "source_tier", "record_type", "classification_status").agg(
        F.count(F.lit(1)).alias("records"), F.min("published_at_utc").alias("first_published"), F.max("published_at_utc").alias("last_published"))


@query("nws2_archive_upsert", f"""WITH {NEWS}, {REC}, a AS (SELECT id, published, 0 AS n_chars FROM rec WHERE source < 'src3'), n AS (SELECT id, published + INTERVAL 1 HOUR AS published, length(title) AS n_chars FROM rec WHERE lang <> 'fr')
SELECT id, coalesce(n.published, a.published) AS published, CAST(coalesce(n.n_chars, a.n_chars) AS INTEGER) AS n_chars FROM a FULL JOIN n USING (id)""")
def archive_upsert(spark, sf):
    from tidemark.functions.scalars import stable_id

    n = news(spark, sf).withColumn("id", stable_id("source", "link"))
    archive = n.filter(F.col("source") < "src3").select("id", "published", F.lit(0).alias("n_chars"))
    new = n.filter(F.col("lang") != "fr").select("id", (F.col("published") + F.make_dt_interval(hours=F.lit(1))).alias("published"), F.length("title").alias("n_chars"))
    return upsert(archive, new, "id", "published")


STORY = f"""{NEWS}, hd AS (SELECT doc_id, source, published, lang, md5(trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) AS key FROM news),
ph AS (SELECT key, date_trunc('hour', published) AS hour, count(*) AS articles FROM hd GROUP BY 1, 2),
gp AS (SELECT *, CASE WHEN date_diff('hour', lag(hour) OVER (PARTITION BY key ORDER BY hour), hour) <= 72 THEN 0 ELSE 1 END AS fresh FROM ph),
st AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY key ORDER BY hour ROWS UNBOUNDED PRECEDING) AS BIGINT) AS story FROM gp)"""


def stories(spark, sf):
    n = news(spark, sf).withColumn("key", nws.title_key("title"))
    return n, nws.cluster_events(n, "key", "published", "source", gap_hours=72)


@query("nws3_story_clusters", f"""WITH {STORY}, s AS (SELECT key, story, min(hour) AS first_hour, max(hour) AS last_hour, CAST(sum(articles) AS BIGINT) AS articles FROM st GROUP BY 1, 2),
v AS (SELECT st.key, story, count(DISTINCT source) AS sources FROM hd JOIN st ON hd.key = st.key AND date_trunc('hour', published) = hour GROUP BY 1, 2)
SELECT * FROM s JOIN v USING (key, story)""")
def story_clusters(spark, sf):
    return stories(spark, sf)[1]


@query("nws3_reprints_by_title", r"""WITH t AS (SELECT doc_id, source, trim(regexp_replace(lower(string_split(text, chr(10))[1]), '[^\p{L}\p{N}]+', ' ', 'g')) AS k FROM documents)
SELECT md5(k) AS key, count(*) AS articles, count(DISTINCT source) AS sources FROM t GROUP BY 1 HAVING count(*) > 1""")
def reprints_by_title(spark, sf):
    n = news(spark, sf).withColumn("key", nws.title_key("title"))
    return n.groupBy("key").agg(F.count(F.lit(1)).alias("articles"), F.count_distinct("source").alias("sources")).filter("articles > 1")


def near_copies_sql():
    """Groups of documents that links of 80 % equal 5-word shingles reach, by a join on shingles and a walk along links."""
    return r"""
pl AS (SELECT doc_id, source, published, list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: length(x) > 0) AS ws FROM news),
sh AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda i: array_to_string(ws[i:i + 4], ' '))) AS s FROM pl WHERE len(ws) > 0),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
cm AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
ln AS MATERIALIZED (SELECT a, b FROM cm JOIN sz p ON p.doc_id = a JOIN sz q ON q.doc_id = b WHERE 180 * common >= 80 * (p.n + q.n)),
rc(doc_id, other) AS (SELECT doc_id, doc_id FROM news UNION SELECT rc.doc_id, ln.b FROM rc JOIN ln ON ln.a = rc.other),
gr AS (SELECT doc_id, min(other) AS key FROM rc GROUP BY 1)"""


@query("nws3_near_copy_stories", f"""WITH RECURSIVE {NEWS}, {near_copies_sql()},
hd AS (SELECT key, source, published FROM news JOIN gr USING (doc_id)),
ph AS (SELECT key, date_trunc('hour', published) AS hour, count(*) AS articles FROM hd GROUP BY 1, 2),
gp AS (SELECT *, CASE WHEN date_diff('hour', lag(hour) OVER (PARTITION BY key ORDER BY hour), hour) <= 72 THEN 0 ELSE 1 END AS fresh FROM ph),
st AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY key ORDER BY hour ROWS UNBOUNDED PRECEDING) AS BIGINT) AS story FROM gp),
s AS (SELECT key, story, min(hour) AS first_hour, max(hour) AS last_hour, CAST(sum(articles) AS BIGINT) AS articles FROM st GROUP BY 1, 2),
v AS (SELECT st.key, story, count(DISTINCT source) AS sources FROM hd JOIN st ON hd.key = st.key AND date_trunc('hour', published) = hour GROUP BY 1, 2)
SELECT * FROM s JOIN v USING (key, story)""")
def near_copy_stories(spark, sf):
    """Stories of edited reprints: groups of near-copy texts, cut where none appears for 72 hours."""
    n = news(spark, sf).select("doc_id", "source", "published", "text")
    return nws.cluster_events(n.join(nws.near_copies(n, "doc_id", "text"), "doc_id"), "group", "published", "source", gap_hours=72)


@query("nws4_agreement", """WITH v AS (SELECT o_custkey AS story, o_orderpriority AS source, CASE o_orderstatus WHEN 'F' THEN 'up' WHEN 'O' THEN 'down' END AS direction, CAST(o_orderpriority[1:1] AS INTEGER) AS tier FROM orders),
d AS (SELECT story, source, direction, min(tier) AS tier FROM v WHERE direction IS NOT NULL GROUP BY 1, 2, 3), p AS (SELECT story, direction, count(*) AS n, sum(1.0::DOUBLE / tier) AS w FROM d GROUP BY 1, 2)
SELECT story, CAST(sum(n) AS BIGINT) AS opinions, round(max(n) / sum(n), 6) AS agreement, round(max(w) / sum(w), 6) AS weighted_agreement FROM p GROUP BY 1""")
def agreement(spark, sf):
    direction = F.when(F.col("o_orderstatus") == "F", "up").when(F.col("o_orderstatus") == "O", "down")
    votes = table(spark, sf, "orders").select(F.col("o_custkey").alias("story"), F.col("o_orderpriority").alias("source"), direction.alias("direction"),
                                              F.substring("o_orderpriority", 1, 1).cast("int").alias("tier"))
    out = nws.agreement(votes, ["story"], "source", "direction", "tier")
    return out.withColumns({"agreement": F.round("agreement", 6), "weighted_agreement": F.round("weighted_agreement", 6)})


@query("nws5_novelty", rf"""WITH {NEWS},
w AS (SELECT doc_id, published, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \n\t\r]+'), lambda x: length(x) > 0)) AS ws FROM news),
e AS (SELECT doc_id, published, unnest(ws) AS word FROM w),
f AS (SELECT word, arg_min(doc_id, (published, doc_id)) AS doc_id FROM e GROUP BY 1),
n AS (SELECT doc_id, count(*) AS k FROM f GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS INTEGER) AS words, coalesce(k, 0) AS new_words, round(coalesce(k, 0) / len(ws), 6) AS novelty FROM w LEFT JOIN n USING (doc_id)""")
def novelty(spark, sf):
    """Earlier is by time of publication, then by id."""
    out = nws.novelty(news(spark, sf).select("doc_id", "published", "text"), "doc_id", ["published"], "text")
    return out.withColumn("novelty", F.round("novelty", 6))


@query("nws6_field_completeness", """WITH e AS (SELECT source, doc_id, CASE WHEN n_chars > 100 THEN string_split(text, chr(10))[1] END AS title, lang, CASE WHEN quality = 1 THEN 'ok' END AS quality FROM documents LEFT JOIN labels USING (doc_id)),
b AS (SELECT source, title IS NULL OR trim(title) = '' AS t, lang IS NULL OR trim(lang) = '' AS l, quality IS NULL AS q FROM e)
SELECT source, count(*) AS rows, count(*) FILTER (t) AS missing_title, count(*) FILTER (l) AS missing_lang, count(*) FILTER (q) AS missing_quality, round(count(*) FILTER (NOT (t OR l OR q)) / count(*), 6) AS complete_share FROM b GROUP BY 1""")
def field_completeness(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    d = d.select("source", F.when(F.col("n_chars") > 100, F.split("text", "\n").getItem(0)).alias("title"), "lang", F.when(F.col("quality") == 1, "ok").alias("quality"))
    return nws.field_completeness(d, ["source"], ["title", "lang", "quality"]).withColumn("complete_share", F.round("complete_share", 6))


# statistics


def weekly_positions(spark, sf):
    """Weekly long and short quantity per class."""
    li = table(spark, sf, "lineitem")
    size = F.col("l_quantity").cast("decimal(18,2)")
    return li.groupBy(F.col("l_returnflag").alias("class"), F.date_trunc("week", F.col("l_shipdate").cast("date")).cast("date").alias("week")).agg(
        F.coalesce(F.sum(F.when(F.col("l_linestatus") == "O", size)), F.lit(0)).cast("double").alias("long"), F.coalesce(F.sum(F.when(F.col("l_linestatus") == "F", size)), F.lit(0)).cast("double").alias("short"))


POS = """pos AS (SELECT l_returnflag AS class, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0) AS long, coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 0) AS short FROM lineitem GROUP BY 1, 2),
net AS (SELECT *, long - short AS net, long - short - lag(long - short) OVER (PARTITION BY class ORDER BY week) AS net_change FROM pos)"""


@query("sta1_principal_components")
def principal_components(spark, sf):
    net = sta.net_positions(weekly_positions(spark, sf), ["class"], "week", "long", "short")
    wide = net.groupBy("week").pivot("class", ["A", "N", "R"]).agg(F.first("net_change")).withColumn("market", F.lit("all"))
    out = sta.pca_shares(wide, ["market"], ["A", "N", "R"])
    r = lambda c: F.transform(c, lambda v: F.round(v, 6))
    return out.select("market", "n", r("shares").alias("shares"), r("loadings").alias("loadings"))


@query("sta2_unwind_weeks", f"WITH {POS} SELECT class, round(avg(long) FILTER (net_change < -100), 6) AS mean_if, round(avg(long) FILTER (NOT net_change < -100), 6) AS mean_else, count(*) FILTER (net_change < -100) AS rows_if FROM net GROUP BY 1")
def unwind_weeks(spark, sf):
    net = sta.net_positions(weekly_positions(spark, sf), ["class"], "week", "long", "short")
    out = sta.conditional_means(net, ["class"], "long", F.col("net_change") < -100)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_if", "mean_else")})


@query("sta3_net_positions", f"WITH {POS} SELECT class, week, long, short, net, net_change FROM net")
def net_positions(spark, sf):
    return sta.net_positions(weekly_positions(spark, sf), ["class"], "week", "long", "short")


@query("sta3_long_short_balance", f"WITH {POS} SELECT week, sum(long) AS long, sum(short) AS short, sum(long) - sum(short) AS gap FROM pos GROUP BY 1")
def long_short_balance(spark, sf):
    return sta.balance_check(weekly_positions(spark, sf), "week", "long", "short")


RATIO = "ra AS (SELECT a.date, a.close / b.close AS ratio FROM bars a JOIN bars b USING (date) WHERE a.series_id = 'AF' AND b.series_id = 'NO')"


@query("sta4_ratio_and_risk_targets", f"""WITH {BARS}, {RATIO}, l AS (SELECT *, ln(ratio / lag(ratio) OVER (ORDER BY date)) AS r FROM ra), q AS (SELECT *, sum(r * r) OVER w5 AS s5, count(r) OVER w5 AS c5, lead(r) OVER (ORDER BY date) AS n1 FROM l WINDOW w5 AS (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))
SELECT date, round(ratio, 8) AS ratio, round(r, 8) AS log_return, round(abs(n1), 8) AS risk_1, round(CASE WHEN c5 = 5 THEN sqrt(s5) END, 8) AS risk_5 FROM q""")
def ratio_and_risk_targets(spark, sf):
    c = bars_of(spark, sf, keep=True)
    r = sta.ratio(c.filter("series_id = 'AF'"), c.filter("series_id = 'NO'"), ["date"], "close").withColumn("pair", F.lit("AF/NO"))
    out = sta.forward_targets(r, ["pair"], "date", "ratio")
    return out.select("date", *[F.round(x, 8).alias(x) for x in ("ratio", "log_return", "risk_1", "risk_5")])


@query("sta5_expanding_forecasts", f"""WITH {BARS}, y AS (SELECT series_id, date, i, close / lag(close) OVER w - 1 AS y FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY date)), z AS (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY date) AS z FROM y),
e AS (SELECT *, count(z) OVER p AS n, avg(y) OVER p AS m, regr_slope(y, z) OVER p AS b, regr_intercept(y, z) OVER p AS a FROM z WINDOW p AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT series_id, count(*) AS forecasts, round(avg(y * y) * 1e4, 6) AS mse_zero, round(avg((y - m) * (y - m)) * 1e4, 6) AS mse_mean, round(avg((y - a - b * z) * (y - a - b * z)) * 1e4, 6) AS mse_line FROM e WHERE n >= 60 AND y IS NOT NULL GROUP BY 1""")
def expanding_forecasts(spark, sf):
    out = sta.expanding_eval(bars_of(spark, sf), K, "date", "close")
    return out.select("series_id", "forecasts", *[F.round(F.col(c) * 1e4, 6).alias(c) for c in ("mse_zero", "mse_mean", "mse_line")])


@query("sta6_hourly_lead_lag", """WITH h AS (SELECT date_trunc('hour', ts) AS hour, CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type = 'click') AS DOUBLE) AS a, CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type = 'view') AS DOUBLE) AS b FROM events GROUP BY 1),
l AS (SELECT *, lag(b, 1) OVER w AS b1, lag(b, 2) OVER w AS b2, lead(b, 1) OVER w AS bm FROM h WINDOW w AS (ORDER BY hour))
SELECT 'click/view' AS pair, k, round(c, 6) AS correlation FROM (SELECT corr(a, bm) AS x, corr(a, b) AS y, corr(a, b1) AS z, corr(a, b2) AS u FROM l), LATERAL (VALUES (-1, x), (0, y), (1, z), (2, u)) v(k, c)""")
def hourly_lead_lag(spark, sf):
    size = F.col("value").cast("decimal(18,2)")
    pick = lambda e: F.sum(F.when(F.col("event_type") == e, size)).cast("double")
    hourly = table(spark, sf, "events").groupBy(F.date_trunc("hour", F.col("ts")).alias("hour")).agg(pick("click").alias("a"), pick("view").alias("b")).withColumn("pair", F.lit("click/view"))
    return sta.lead_lag(hourly, "hour", "a", "b", (-1, 0, 1, 2), ["pair"]).withColumn("correlation", F.round("correlation", 6))


@query("sta7_block_bootstrap", f"""WITH {BARS}, x AS (SELECT series_id, date, close / open - 1 AS v, volume > 100 AS g FROM bars), bl AS (SELECT series_id, date_trunc('month', date) AS m, sum(v) FILTER (g) AS sa, count(*) FILTER (g) AS na, sum(v) FILTER (NOT g) AS sb, count(*) FILTER (NOT g) AS nb FROM x GROUP BY 1, 2),
s AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY m) - 1 AS slot, count(*) OVER (PARTITION BY series_id) AS size FROM bl),
d AS (SELECT series_id, rep, CAST('0x' || md5('boot-' || series_id || '-' || rep || '-' || slot)[1:8] AS BIGINT) % size AS slot FROM s, range(1, 201) r(rep)),
p AS (SELECT series_id, rep, sum(sa) / nullif(sum(na), 0) - sum(sb) / nullif(sum(nb), 0) AS diff FROM d JOIN s USING (series_id, slot) GROUP BY 1, 2)
SELECT series_id, count(diff) AS reps, round(avg(diff) * 100, 6) AS mean_diff, round(quantile_cont(diff, 0.025) * 100, 6) AS low, round(quantile_cont(diff, 0.975) * 100, 6) AS high FROM p GROUP BY 1""")
def block_bootstrap(spark, sf):
    b = index_bars(spark, sf).select("series_id", "date", (F.col("close") / F.col("open") - 1).alias("v"), (F.col("volume") > 100).alias("g"))
    out = sta.block_bootstrap(b, K, F.trunc("date", "MM"), "v", "g")
    return out.select("series_id", "reps", *[F.round(F.col(c) * 100, 6).alias(c) for c in ("mean_diff", "low", "high")])


# streaming


@query("str1_completed_bars", """WITH b AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS bar_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS bar_end, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
 arg_max(value, (ts, event_id)) AS close, count(*) AS ticks FROM events GROUP BY 1, 2, 3) SELECT * FROM b WHERE bar_end <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""")
def completed_bars(spark, sf):
    ticks = stm.read_tick_stream(spark, f"{sf}/events.parquet").withColumns({"series_id": F.col("event_type"), "ts": stm.to_instant("ts")})
    out = stm.run_to_end(stm.completed_bars(ticks, K, "ts", "value", "event_id", "1 hour", "2 hours"), "bars")
    return out.withColumns({c: stm.to_naive(c) for c in ("bar_start", "bar_end")})


@query("str2_upsert_stream", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def upsert_stream(spark, sf):
    ticks = stm.read_tick_stream(spark, f"{sf}/events.parquet").select("user_id", "event_id", "event_type", "value")
    log, running = stm.upsert_log(ticks, "upsert")
    running.awaitTermination()
    return stm.current_rows(spark, log, "user_id", "event_id")

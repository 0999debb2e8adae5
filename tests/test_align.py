import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import align


def frame(spark, rows, names):
    return spark.createDataFrame([(dt.date.fromisoformat(r[0]), *r[1:]) for r in rows], f"date date, {names}")


def values(df, c):
    return [r[c] for r in df.orderBy("date").collect()]


def test_exact_fill_ignores_right_rows_off_the_calendar_but_asof_does_not(spark):
    left = frame(spark, [("2024-01-02", "a"), ("2024-01-04", "a"), ("2024-01-05", "a")], "k string")
    right = frame(spark, [("2024-01-02", "a", 1.0), ("2024-01-03", "a", 2.0)], "k string, v double")
    assert values(align.align_exact_ffill(left, right, ["k"], "date", ["v"]), "v") == [1.0, 1.0, 1.0]
    assert values(align.asof_join(left, right, ["k"], "date", ["v"]), "v") == [1.0, 2.0, 2.0]
    assert values(align.asof_join(left, right, ["k"], "date", ["v"], strict=True, default=0.0), "v") == [0.0, 2.0, 2.0]


def test_shared_asof_reports_the_matched_date(spark):
    left = frame(spark, [("2024-01-01", "a"), ("2024-01-04", "b")], "k string")
    right = frame(spark, [("2024-01-02", 7.0)], "v double")
    out = align.asof_shared(left, right, "date", ["v"], match_time="seen").orderBy("date").collect()
    assert (out[0]["v"], out[0]["seen"]) == (None, None)
    assert (out[1]["v"], out[1]["seen"]) == (7.0, dt.date(2024, 1, 2))


def test_later_source_wins_unless_it_is_null(spark):
    a = frame(spark, [("2024-01-01", 1.0), ("2024-01-02", 2.0)], "v double")
    b = frame(spark, [("2024-01-01", 9.0), ("2024-01-02", None), ("2024-01-03", 3.0)], "v double")
    assert values(align.merge_precedence([a, b], ["date"], "v"), "v") == [9.0, 2.0, 3.0]


def test_append_only_after_the_frozen_cutoff(spark):
    a = frame(spark, [("2024-01-01", 1.0), ("2024-01-05", 2.0)], "v double")
    b = frame(spark, [("2024-01-05", 9.0), ("2024-01-06", 3.0)], "v double")
    assert values(align.append_after(a, b, "date"), "v") == [1.0, 2.0, 3.0]


def test_upsert_overwrites_and_keeps_everything_else(spark):
    a = spark.createDataFrame([(1, "old", 5), (2, "old", 5)], "id int, x string, version int")
    b = spark.createDataFrame([(2, "new", 1), (3, "new", 1), (3, "newer", 2)], "id int, x string, version int")
    out = {r["id"]: r["x"] for r in align.upsert(a, b, "id", "version").collect()}
    assert out == {1: "old", 2: "new", 3: "newer"}


def test_two_way_difference_counts_copies(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (3,)], "x int")
    out = {(r["x"], r["side"], r["copies"]) for r in align.two_way_difference(a, b).collect()}
    assert out == {(1, "first", 1), (2, "first", 1), (3, "second", 1)}


def test_reports_count_from_their_release_and_hide_in_blackouts(spark):
    days = frame(spark, [("2024-01-01", "a"), ("2024-01-09", "a"), ("2024-01-20", "a")], "k string")
    rep = spark.createDataFrame([("a", dt.date(2024, 1, 8), 4.0)], "k string, release date, v double")
    out = align.asof_release(days, rep, ["k"], "date", "release", ["v"], [("2024-01-15", "2024-01-25")])
    assert values(out, "v") == [None, 4.0, None]


def test_specs_are_expanded_without_a_join(spark):
    df = spark.range(3).withColumn("date", F.current_date())
    out = align.with_specs(df, [dict(spec_id=1, cap=0.5, name="x"), dict(spec_id=2, cap=0.7, name="y")])
    assert out.count() == 6
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_interval_join_equals_all_pairs(spark):
    import datetime as dt
    import random

    rng, base = random.Random(4), dt.date(1969, 6, 1)
    day = lambda n: base + dt.timedelta(days=n)
    points = [(k, rng.randint(0, 2), day(rng.randint(0, 900))) for k in range(150)] + [(900, 1, None)]
    spans = []
    for k in range(200):
        a = rng.randint(0, 900)
        spans.append((k, rng.randint(0, 2), day(a), day(a + rng.choice([-3, 0, 1, 7, 8, 31, 32, 33, 127, 128, 500, 20_000]))))
    spans += [(900, 1, None, day(5)), (901, 1, day(5), None)]
    p, s = spark.createDataFrame(points, "p int, k int, t date"), spark.createDataFrame(spans, "i int, k int, a date, b date")
    inside = lambda t, a, b: None not in (t, a, b) and a <= t <= b
    keyed = align.interval_join(p, s, "t", "a", "b", on=["k"])
    assert sorted((r.p, r.i) for r in keyed.collect()) == sorted((x[0], y[0]) for x in points for y in spans if x[1] == y[1] and inside(x[2], y[2], y[3]))
    free = align.interval_join(p, s.drop("k"), "t", "a", "b")
    assert sorted((r.p, r.i) for r in free.collect()) == sorted((x[0], y[0]) for x in points for y in spans if inside(x[2], y[2], y[3]))
    assert align.interval_join(p, s.limit(0), "t", "a", "b", on=["k"]).count() == 0
    plan = keyed._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

from collections import Counter, defaultdict

from tidemark.llm import line_dedup


def brute(rows, ratio=0.05, least=5):
    pages, counts = Counter(h for _, h in rows), defaultdict(Counter)
    for text, host in rows:
        counts[host].update({x.strip(" ") for x in (text or "").split("\n")} - {""})
    out = []
    for text, host in rows:
        lines = None if text is None else text.split("\n")
        kept = None if text is None else [x for x in lines if not ((n := counts[host][x.strip(" ")]) >= least and n > ratio * pages[host])]
        out.append((host, None if text is None else "\n".join(kept), 0 if text is None else len(lines) - len(kept)))
    return sorted(out, key=repr)


def found(df, **options):
    return sorted(((r.source, r.text, r.n) for r in line_dedup.drop_boilerplate(df, dropped_column="n", **options).collect()), key=repr)


def test_awkward_rows(awkward, empty):
    assert found(awkward, least_pages=1, ratio=0.2) == brute([(r.text, r.source) for r in awkward.collect()], 0.2, 1)
    assert found(empty) == []


def test_hosts_are_judged_alone(spark):
    rows = [(f"menu\nbody {k}\n\n menu ", "a") for k in range(20)] + [(f"menu\nx{k}", "b") for k in range(3)] + [("menu\nmenu", None), ("", "a"), ("\n", "a")] + [(f"rare\n{k}", "c") for k in range(5)] + [(f"{k}", "c") for k in range(100)]
    df = spark.createDataFrame(rows, "text string, source string")
    assert found(df) == brute(rows)
    assert ("b", "menu\nx0", 0) in found(df) and ("a", "body 3\n", 2) in found(df)


def test_a_share_equal_to_the_ratio_stays(spark):
    rows = [("same" if k < 5 else f"l{k}", "a") for k in range(100)]
    assert found(spark.createDataFrame(rows, "text string, source string")) == brute(rows)
    assert sum(n for _, _, n in brute(rows)) == 0


def test_no_python_in_the_plan(spark, awkward, capsys):
    line_dedup.drop_boilerplate(awkward).explain()
    assert "Python" not in capsys.readouterr().out and "Arrow" not in capsys.readouterr().out

"""Manifests against trees built with plain lists, for several arities."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, columns=COLUMNS):
    return h(*["-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in columns])


def tree(digests, arity):
    """The root and each leaf's siblings as (digests before, digests after)."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        runs = [level[i : i + arity] for i in range(0, len(level), arity)]
        for k in range(len(paths)):
            run = runs[at[k] // arity]
            paths[k].append((run[: at[k] % arity], run[at[k] % arity + 1 :]))
            at[k] //= arity
        level = [h(*run) for run in runs]
    return level[0], paths


def brute(rows, arity, group="lang"):
    groups = {}
    for r in rows:
        groups.setdefault(r[group], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {}
    for g in names:
        members = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        subs[g] = (members, *tree([leaf(r) for r in members], arity))
    root, tops = tree([subs[g][1] for g in names], arity)
    out = []
    for g, top in zip(names, tops):
        for r, path in zip(subs[g][0], subs[g][2]):
            out.append((leaf(r), subs[g][1], "".join(x for before, after in path + top for x in before + after)))
    return root, sorted(out)


def check(rows, df, arity):
    made = merkle.manifest(df, COLUMNS, "lang", "doc_id", arity, carry={"doc_id": F.col("doc_id")})
    got = made.rows.select("*", merkle.hex_of("digest").alias("leaf"), merkle.hex_of("subroot").alias("sub"), F.array_join(merkle.siblings(), "").alias("proof"))
    got = got.withColumn("root", merkle.folded(F.col("leaf"))).collect()
    root, want = brute(rows, arity)
    assert made.root == root
    assert sorted((r["leaf"], r["sub"], r["proof"]) for r in got) == want
    assert all(r["root"] == root for r in got)


@pytest.mark.parametrize("arity", [2, 4])
def test_manifest_equals_plain_trees(spark, arity):
    rng = random.Random(arity)
    langs = [None, "", "de", "en", "en", "en", "ü", "zz"]
    rows = [dict(doc_id=i if i % 9 else None, source=rng.choice(["a", None, "é"]), lang=rng.choice(langs), n_chars=rng.choice([None, 1, -5]), text=rng.choice(["", None, "text ü\n", "-", "2:ab"]))
            for i in range(41)]
    rows += [rows[7], rows[7], dict(doc_id=1, source=None, lang="once", n_chars=None, text=None)]
    check(rows, spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], "doc_id long, source string, lang string, n_chars long, text string"), arity)


def test_groups_of_each_size(spark):
    rows = [dict(doc_id=i, source="s", lang=f"l{n}", n_chars=i, text=f"t{i}") for n in (1, 2, 3, 4, 7, 8, 9, 17) for i in range(n)]
    check(rows, spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], "doc_id long, source string, lang string, n_chars long, text string"), 2)


def test_awkward_rows_and_clashing_columns(spark, awkward, empty):
    df = awkward.withColumns({"idx": F.lit("mine"), "digest": F.lit(3), "path": F.lit(None), "level": F.lit(1), "group": F.lit("g"), "others": F.lit(0)})
    check([r.asDict() for r in df.collect()], df, 2)
    made = merkle.manifest(empty, COLUMNS, "lang", "doc_id")
    assert made.root is None and made.rows.count() == 0


def test_a_changed_row_does_not_fold_to_the_root(spark, awkward):
    made = merkle.manifest(awkward, COLUMNS, "lang", "doc_id")
    bad = made.rows.select(merkle.folded(F.sha2(F.hex("digest"), 256)).alias("root")).collect()
    assert made.root not in {r.root for r in bad}


def test_no_text_is_shuffled(spark, awkward):
    plan = merkle.manifest(awkward, COLUMNS, "lang", "doc_id").rows._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan

"""News: one voice per independent source, same-story clusters, agreement and novelty.

One headline may be copied by a third of all rows, so stories are reduced to counts per hour
before anything is ordered, novelty counts first uses of words instead of comparing
documents with each other, and edited reprints meet one other text of their bucket, not all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import ordered
from tidemark.operators.groups import connected
from tidemark.session import materialise

#: Edited reprints share at least this percentage of their shingles of so many words.
SHINGLE_WORDS, REPRINT_PERCENT = 5, 80
#: The highest bits of a shingle's hash name its bin, the first of them its band: 16 bands of 4 bins. Texts that share 80 % agree in
#: all bins of a band with a chance of at least 0.8 ** 4, so they miss each other in all bands once in 5,000 times.
BIN_SHIFT, BAND_SHIFT = 58, 60
BANDS = range(-8, 8)


def plain(text: str) -> Column:
    """Lower case with everything but letters and digits squeezed out."""
    return F.trim(F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", " "))


def title_key(title: str) -> Column:
    """Hash of the plain title."""
    return F.md5(plain(title))


def cluster_events(df: DataFrame, key: str, ts: str, source: str, gap_hours: int = 72) -> DataFrame:
    """Stories: same key, no silence longer than `gap_hours`; reprints and sources counted.

    Returns (key, story, first_hour, last_hour, articles, sources).
    """
    hour = F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz")
    per_source = df.groupBy(F.col(key).alias("key"), hour.alias("hour"), F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("articles"))
    hours = per_source.groupBy("key", "hour").agg(F.sum("articles").alias("articles"))
    w = ordered(["key"], "hour")
    silence = F.expr(f"timestampdiff(HOUR, __last, hour) > {gap_hours}")
    hours = hours.withColumn("__last", F.lag("hour").over(w))
    new = F.coalesce(silence, F.lit(True)).cast("int")
    hours = hours.withColumn("story", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__last")
    voices = per_source.join(hours.select("key", "hour", "story"), ["key", "hour"]).groupBy("key", "story").agg(F.count_distinct("source").alias("sources"))
    span = hours.groupBy("key", "story").agg(F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"), F.sum("articles").alias("articles"))
    return span.join(voices, ["key", "story"])


def shingle_sets(df: DataFrame, doc: str, text: str, n: int = SHINGLE_WORDS) -> DataFrame:
    """(doc, class, set): sorted hashes of the plain text's runs of n words, and one hash of them all.

    A text of fewer words is one run; both columns are null where a text is null or without words.
    """
    words_of = df.select(doc, F.filter(F.split(plain(text), " "), lambda w: F.length(w) > 0).alias("__w"))
    first = F.sequence(F.lit(1), F.greatest(F.size("__w") - (n - 1), F.lit(1)))
    runs = F.transform(first, lambda i: F.xxhash64(F.array_join(F.slice("__w", i, n), " ")))
    sets = words_of.select(doc, F.when(F.size("__w") > 0, F.sort_array(F.array_distinct(runs))).alias("set"))
    return sets.select(doc, F.when(F.col("set").isNotNull(), F.xxhash64("set")).alias("class"), "set")


def bands(classes: DataFrame) -> DataFrame:
    """(class, bucket): one row per band with shingles; the bucket holds the least hash of each bin of the band.

    The set is sorted, so a bin's least hash is where the highest bits change. Bins that are empty in both texts agree.
    """
    top = lambda x: F.shiftright(x, BIN_SHIFT)
    least = F.filter("set", lambda x, i: F.coalesce(top(x) != top(F.get("set", i - 1)), F.lit(True)))
    of_band = lambda b: F.filter("__least", lambda x: F.shiftright(x, BAND_SHIFT) == b)
    rows = classes.select("class", least.alias("__least")).select("class", F.explode(F.filter(
        F.transform(F.array(*[F.lit(b) for b in BANDS]), lambda b: F.struct(b.alias("band"), of_band(b).alias("bins"))), lambda x: F.size(x["bins"]) > 0)).alias("__b"))
    return rows.select("class", F.xxhash64("__b.band", "__b.bins").alias("bucket"))


def near_copies(df: DataFrame, doc: str, text: str, percent: int = REPRINT_PERCENT, n: int = SHINGLE_WORDS) -> DataFrame:
    """(doc, group): the least id of the texts that links of at least `percent` shared shingles reach.

    Equal sets are one class. In each bucket every class meets one other, chosen anew by each bucket, so a hot bucket makes no
    pairs; each candidate is counted exactly, so nothing is linked wrongly. Links are found with a chance (see BIN_SHIFT), which for
    groups is higher, as members have several ways to one another. Null texts and texts without words are alone. Ids are unique.
    """
    sets = materialise(shingle_sets(df, doc, text, n))
    classes = materialise(sets.where(F.col("class").isNotNull()).groupBy("class").agg(F.first("set").alias("set"), F.min(doc).alias("least")))
    buckets = bands(classes)
    heads = buckets.groupBy("bucket").agg(F.min_by("class", F.xxhash64("class", "bucket")).alias("head"), F.count(F.lit(1)).alias("members"))
    met = buckets.join(heads.where("members > 1").drop("members"), "bucket").where("class <> head")
    pairs = met.select(F.least("class", "head").alias("a"), F.greatest("class", "head").alias("b")).distinct()
    side = lambda c: classes.select(F.col("class").alias(c), F.col("set").alias(f"set_{c}"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", common.alias("common"), (F.size("set_a") + F.size("set_b")).alias("total"))
    links = both.where(F.lit(100 + percent) * F.col("common") >= F.lit(percent) * F.col("total"))
    roots = connected(links, "a", "b").select(F.col("node").alias("class"), "root")
    rooted = classes.select("class", "least").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    group = rooted.groupBy("root").agg(F.min("least").alias("group"))
    found = sets.select(doc, "class").join(rooted.join(group, "root").select("class", "group"), "class", "left")
    return found.select(doc, F.coalesce("group", F.col(doc)).alias("group"))


def agreement(votes: DataFrame, story: Sequence[str], source: str, direction: str, tier: str) -> DataFrame:
    """Largest share of one direction among the valid opinions of a story.

    A source counts once per direction and story however often it prints. Weights are
    1/tier; official facts (tier 1) state no direction and should carry a null one.
    """
    valid = votes.filter(F.col(direction).isNotNull())
    voices = valid.groupBy(*story, source, direction).agg(F.min(tier).alias("__tier"))
    per = voices.groupBy(*story, direction).agg(F.count(F.lit(1)).alias("n"), F.sum(1.0 / F.col("__tier")).alias("w"))
    return per.groupBy(*story).agg(
        F.sum("n").alias("opinions"), (F.max("n") / F.sum("n")).alias("agreement"), (F.max("w") / F.sum("w")).alias("weighted_agreement"))


def words(text: str) -> Column:
    """Distinct lower-case words of the whole text."""
    return F.array_distinct(F.filter(F.split(F.lower(F.col(text)), r"[ \n\t\r]+"), lambda w: F.length(w) > 0))


def novelty(df: DataFrame, doc: str, position: Sequence[str], text: str) -> DataFrame:
    """Share of a document's distinct words that no earlier document had used.

    Null and empty texts have no words and a null share. A word is owned by the first document using it, so no two documents are ever paired. One
    marker row per document, owned by itself, carries its word count through the same
    aggregation: each text is split once and nothing is joined back.
    """
    mark = "\x00"
    df = df.withColumn("__w", F.coalesce(words(text), F.array().cast("array<string>")))
    marker = F.concat(F.lit(mark), F.col(doc).cast("string"), F.lit(mark), F.size("__w").cast("string"))
    # without a position the bare id is aggregated, which stays hash based
    order = F.struct(*position, F.col(doc)) if position else F.col(doc)
    rows = df.select(order.alias("__o"), F.explode(F.concat(F.array(marker), "__w")).alias("word"))
    owned = rows.groupBy("word").agg(F.min("__o").alias("__o"))
    owner = F.col(f"__o.{doc}") if position else F.col("__o")
    is_mark = F.col("word").startswith(mark)
    out = owned.groupBy(owner.alias(doc)).agg(
        F.max(F.when(is_mark, F.substring_index("word", mark, -1).cast("int"))).alias("words"), F.count_if(~is_mark).alias("new_words"))
    return out.withColumn("novelty", F.try_divide("new_words", "words"))


def field_completeness(df: DataFrame, by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Missing or blank values per required field and the share of complete rows."""
    blank = {f: F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == "") for f in fields}
    complete = ~F.greatest(*[b.cast("int") for b in blank.values()]).cast("boolean")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(b).alias(f"missing_{f}") for f, b in blank.items()], (F.count_if(complete) / F.count(F.lit(1))).alias("complete_share"))

"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (decontamination, jaccard, language, line_dedup, merkle, mixing, packing, period_runs, quality, sharding, site_tree,
                          token_counts, token_output)
from tidemark.llm.registry import query
from tidemark.llm.shared import fresh

#: Folder of the public tokenizers' files, where their package is not installed.
TOKENIZERS = "/opt/tokenizers"

#: Production shards; two of them take double turns.
SHARDS = {f"shard-{i:03d}": 2 if i < 2 else 1 for i in range(64)}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_quality_trees")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    """Base rules and boosted trees, fitted on the labelled documents."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return quality.score(docs, quality.train(docs, table(spark, sf, "labels")), drop=("text",))


OP2_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
items AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
starts AS (SELECT *, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS words FROM starts),
doc_starts AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
hits AS (
  SELECT d.doc_id, d.k, d.n, x.item_id FROM (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS words FROM doc_starts) d
  JOIN windows x ON d.n = x.n AND d.words = x.words),
hit_words AS (
  SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS i FROM (SELECT DISTINCT doc_id, k, n FROM hits))
  GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items i USING (doc_id)
"""


@query("op2_fm_decontamination", OP2_SQL)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    """Words and items of the benchmark in each document."""
    marked = decontamination.mark(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"), drop=("text",))
    hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["first"])
    return marked.select("doc_id", F.col("__n_words").alias("n_words"), hit.alias("n_hit"), F.size("__items").cast("long").alias("n_items"),
                         F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


@query("op3_site_style_tree")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of each page."""
    return site_tree.extract(table(spark, sf, "pages").select("page_id", "url", "html"), drop=("html",))


@query("op4_metric_jaccard_join")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    """Components of documents linked at a Jaccard similarity of 0.9 of 3-word shingles."""
    found = jaccard.linked_components(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


OP5_SQL = """
WITH lines AS (
  SELECT doc_id, source, text, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS line
  FROM documents WHERE text IS NOT NULL),
counts AS (
  SELECT source, trim(line, ' ') AS line, count(DISTINCT doc_id) AS n
  FROM lines WHERE trim(line, ' ') <> '' GROUP BY ALL),
totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
bad AS (
  SELECT c.source, c.line FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.n >= 5 AND c.n > 0.05::DOUBLE * t.pages),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(b.line) AS n_dropped,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.k) FILTER (WHERE b.line IS NULL), '') AS text
  FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND trim(l.line, ' ') = b.line
  GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped,
       coalesce(length(k.text), 0) AS n_chars_left, md5(k.text) AS text_md5
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


@query("op5_site_line_dedup", OP5_SQL)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a document on more than 5 % of its source's documents go; the digest of what is left."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    docs = docs.withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long"))
    docs = docs.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")))
    out = line_dedup.drop_boilerplate(docs, dropped_column="n_dropped")
    return out.select("doc_id", "n_lines", "n_dropped", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars_left"), F.md5("text").alias("text_md5"))


@query("op6_language_mixture")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """The language of each document, learned from the documents that are not held out."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang").withColumn("held_out", language.held_out(F.col("doc_id")))
    model = language.learn(docs.where(~F.col("held_out")))
    found = language.identify(docs.select("doc_id", "held_out", "text"), model, drop=("text",))
    shares = F.transform(F.map_entries("lang_shares"), lambda x: F.concat_ws("=", x["key"], F.round(x["value"], 4).cast("string")))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.array_join(shares, ",").alias("lang_shares"))


@query("op7_token_files")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    """Write all documents' token ids and read them back."""
    path = fresh(spark, "token-ids")
    with open(tokenizer_file("byte_bpe_50k.json"), encoding="utf-8") as f:
        token_output.write_ids(table(spark, sf, "documents").select("doc_id", "text"), path, f.read())
    return token_output.digests(spark, path)


@query("op8_entropy_mix")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    """What the mix takes of each document."""
    mixed = mixing.with_copies(table(spark, sf, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", F.col("__size").alias("size"), F.col("__total").alias("source_size"), F.col("__target").alias("target"),
                        (F.col("__copies") * F.col("__size")).alias("taken"), F.col("__copies").alias("copies"))


@query("op9_lookup_sharding")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """Slot and shard of each document."""
    docs = table(spark, sf, "documents").select("doc_id")
    return sharding.place(docs, SHARDS, slot_column="slot").select("doc_id", "slot", "shard")


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return f"{TOKENIZERS}/{name}"
    return str(public_tokenizers.path(name))


@query("op10_viterbi_counts")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of each document by a unigram tokenizer."""
    vocabulary = token_counts.from_sentencepiece(tokenizer_file("piece_bpe_32k.model"))
    docs = table(spark, sf, "documents").select("doc_id", "text").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return token_counts.count_tokens(docs, vocabulary, drop=("text",))


WORD = r"[^\x20\x09-\x0D]+"

#: crc32 of a decimal id: list_reduce over its bytes (each followed by eight shifts, written as -1).
CRC_SQL = """
crc AS (
  SELECT DISTINCT doc_id, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
         lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
         lambda h, x: CASE WHEN x >= 0 THEN xor(h, x) ELSE xor(h >> 1, 3988292384 * (h & 1)) END)) AS h
  FROM documents WHERE doc_id IS NOT NULL)"""

OP11_SQL = f"""
WITH {CRC_SQL},
raw AS (SELECT doc_id, h, coalesce(regexp_extract_all(text, '{WORD}'), []) AS w FROM documents LEFT JOIN crc USING (doc_id)),
plan AS (SELECT *, len(w) AS n, h // 10 AS g, h % 10 = 0 AND len(w) > 0 AS planted FROM raw),
places AS (SELECT *, CASE WHEN planted THEN g % n END AS a, CASE WHEN planted THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM plan),
texts AS (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM places),
-- the words of a run that have a copy one period on are 6 or more
grams AS (SELECT doc_id, array_to_string(w[i + 1 : i + 6], ' ') AS gram, i FROM (SELECT *, unnest(range(0, n - 5)) AS i FROM texts WHERE n >= 12)),
again AS (SELECT * FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM again x JOIN again y ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i < y.i),
islands AS (SELECT doc_id, q, min(i) AS start, count(*) + 5 AS same FROM
  (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, start, same + q AS length, min(q) AS period FROM islands WHERE same >= q AND same + q >= 12 GROUP BY ALL),
-- one period and length have one run only: a longer stretch of a multiple of the period is the same stretch
longest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
dropped AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(start + period, start + length)) AS i FROM runs) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM
  (SELECT doc_id, unnest(range(0, n)) AS i, unnest(w) AS word FROM texts WHERE n > 0) LEFT JOIN (SELECT doc_id, unnest(gone) AS i, true AS gone FROM dropped) USING (doc_id, i)
  WHERE gone IS NULL GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, l.start, l.length, l.period, 1000 * l.length // l.period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM texts t LEFT JOIN longest l USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents of which one in ten repeats a stretch of its words up to its end, chosen by the checksum of the id."""
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = docs.withColumns({"__g": F.floor(h / 10), "__w": F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))})
    n = F.size("__w").cast("long")
    a = F.pmod(F.col("__g"), n)
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.col("__g") % 8))
    whole = F.flatten(F.array_repeat(F.slice("__w", (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    repeated = F.slice(F.concat(F.slice("__w", F.lit(1), a.cast("int")), whole), F.lit(1), n.cast("int"))
    return docs.withColumn("text", F.when(F.size("__w") > 0, F.array_join(repeated, " ")).otherwise(F.col("text"))).drop("__g", "__w")


@query("op11_suffix_tree_runs", OP11_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    """Periodic runs of words in each document."""
    return period_runs.digests(with_planted_runs(table(spark, sf, "documents").select("doc_id", "text")), drop=("text",))


_LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def _leaf_sql(n_chars: str) -> str:
    part = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    return "sha256(" + " || ".join(part(c if c != "n_chars" else f"({n_chars})") for c in _LEAF) + ")"


OP12_SQL = f"""
WITH RECURSIVE {CRC_SQL},
leaves AS (
  SELECT d.doc_id, lang, {_leaf_sql("n_chars")} AS leaf, CASE WHEN h % 7 = 0 THEN {_leaf_sql("n_chars + 1")} ELSE {_leaf_sql("n_chars")} END AS changed
  FROM documents d LEFT JOIN crc USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
up AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY i) AS nodes FROM placed GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(0, len(nodes), 2), lambda k: sha256(nodes[k + 1] || coalesce(nodes[k + 2], ''))) FROM up WHERE len(nodes) > 1),
subs AS (SELECT lang, level AS height, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS j FROM up WHERE len(nodes) = 1),
top AS (
  SELECT 0 AS level, list(subroot ORDER BY j) AS nodes FROM subs HAVING count(*) > 0
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(nodes), 2), lambda k: sha256(nodes[k + 1] || coalesce(nodes[k + 2], ''))) FROM top WHERE len(nodes) > 1),
all_root AS (SELECT nodes[1] AS root FROM top WHERE len(nodes) = 1),
steps AS (
  SELECT p.doc_id, p.leaf, u.level, p.i >> u.level AS place, u.nodes[xor(p.i >> u.level, 1) + 1] AS sibling
  FROM placed p JOIN up u ON p.lang IS NOT DISTINCT FROM u.lang AND len(u.nodes) > 1
  UNION ALL
  SELECT p.doc_id, p.leaf, s.height + t.level, s.j >> t.level, t.nodes[xor(s.j >> t.level, 1) + 1]
  FROM placed p JOIN subs s ON p.lang IS NOT DISTINCT FROM s.lang JOIN top t ON len(t.nodes) > 1),
proofs AS (SELECT doc_id, leaf, coalesce(string_agg(sibling, '' ORDER BY level), '') AS proof, max(level) AS last FROM steps GROUP BY doc_id, leaf),
fold AS (
  SELECT doc_id, leaf, -1 AS level, changed AS digest FROM placed
  UNION ALL
  SELECT f.doc_id, f.leaf, s.level, sha256(CASE WHEN s.sibling IS NULL THEN f.digest WHEN s.place % 2 = 0 THEN f.digest || s.sibling ELSE s.sibling || f.digest END)
  FROM fold f JOIN steps s ON f.doc_id IS NOT DISTINCT FROM s.doc_id AND f.leaf = s.leaf AND s.level = f.level + 1),
ends AS (SELECT doc_id, leaf, arg_max(digest, level) AS folded_root FROM fold GROUP BY doc_id, leaf)
SELECT p.doc_id, p.leaf, s.subroot, r.root, sha256(coalesce(proof, '')) AS proof_sha256, e.folded_root, e.folded_root = r.root AS verified
FROM placed p JOIN subs s ON p.lang IS NOT DISTINCT FROM s.lang CROSS JOIN all_root r
LEFT JOIN proofs q ON p.doc_id IS NOT DISTINCT FROM q.doc_id AND p.leaf = q.leaf
JOIN ends e ON p.doc_id IS NOT DISTINCT FROM e.doc_id AND p.leaf = e.leaf
"""


@query("op12_merkle_manifest", OP12_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest of all documents by language, with a proof of each and what a changed row's proof gives."""
    docs = table(spark, sf, "documents").select(_LEAF)
    changed = merkle.leaf_digest([F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in _LEAF])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.unhex(changed))
    made = merkle.manifest(docs, _LEAF, "lang", "doc_id", carry={"doc_id": F.col("doc_id"), "tampered": tampered})
    leaf = merkle.hex_of("digest")
    out = made.rows.select("doc_id", leaf.alias("leaf"), merkle.hex_of("subroot").alias("subroot"), F.lit(made.root).cast("string").alias("root"),
                           F.sha2(F.array_join(merkle.siblings(), ""), 256).alias("proof_sha256"),
                           merkle.folded(F.coalesce(merkle.hex_of("tampered"), leaf)).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op13_online_packing")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    """All documents packed into sequences of 2,048 ids."""
    with open(tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
        return packing.pack(table(spark, sf, "documents"), f.read(), with_ids=False).drop("ids")

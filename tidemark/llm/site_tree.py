"""HTML extraction by site style trees.

The DOMs of a host's pages are merged: nodes are paths of element styles (tag, class, id). A node has the
styles in which pages present its children, and content features (its texts and links) with the number of pages that
hold each. In logarithms to the base of the pages with the node, presentation importance is the entropy
of its styles, content importance 1 less the mean entropy of its features, so that what all pages repeat is 0 and what
one page has is 1. The composite importance of a branch is the mean over its nodes, falling with their depth. Each page
loses its maximal branches of low importance, or of roles that are never main text.

Importance is counted over pages of different text, so that copies of a page are no template, and neither html and body nor
all text of a page are ever of low importance.

A page with an article (or main) element keeps branches of that element only, unless its host was judged and more text of
importance stands outside: then the element is a branch like others.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.dom import INLINE, RAW, Node, parse
from tidemark.llm.shared import added, written

THRESHOLD = 0.2
LEAST_PAGES = 5
FALL = 0.9
#: Counts that a task holds before it passes them on.
HELD = 200_000

#: Roles without main text: elements, and words of class, id and role.
NEVER = frozenset("nav footer aside form menu dialog button input".split())
NEVER_NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation "
    "newsletter notice popup promo related share sharing sidebar social sponsored subscribe widget complementary contentinfo search".split())
ROOTS = ("article", "main")
#: These hold the whole page.
WHOLE = ("html", "body")
#: What has no text of its own; the rest of a page is compared to find copies.
MARKUP = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|\s+"
#: In an article, only groups can be of low importance, not its own headings and paragraphs.
GROUPS = frozenset("div section ul ol dl table figure".split())


def excluded(node: Node, in_root: bool) -> bool:
    return node.tag in RAW or node.tag in NEVER or node.tag == "header" and not in_root or bool(node.names & NEVER_NAMES) and node.tag not in WHOLE


def roots_of(nodes: list[Node]) -> tuple[list[int], list[bool]]:
    """For each element the path of the article or main element it is in (0: none), and whether a role excludes it."""
    root, out = [0] * len(nodes), [False] * len(nodes)
    for i, node in enumerate(nodes[1:], 1):
        root[i] = root[node.parent]
        out[i] = out[node.parent] or excluded(node, root[i] != 0)
        if not root[i] and not out[i] and (node.tag in ROOTS or "main" in node.names and node.tag == "div"):
            root[i] = node.path
    return root, out


def _digest(x: str) -> int:
    return xxhash.xxh64_intdigest(x) - (1 << 63)


PAGE, STYLE, FEATURE = 0, 1, 2


def _facts(page: str) -> set[tuple]:
    """(node, kind, value, above, root, tag) of a page, each once."""
    nodes, runs = parse(page)
    root, out = roots_of(nodes)
    facts = set()
    for i, node in enumerate(nodes[1:], 1):
        if out[i] or node.tag in INLINE:
            continue
        facts.add((node.path, PAGE, 0, node.above[1:], root[i], node.tag))
        if node.children:
            style = [x for k, x in enumerate(node.children) if k == 0 or x != node.children[k - 1]]
            facts.add((node.path, STYLE, _digest(" ".join(style)), None, 0, ""))
        if node.href:
            facts.add((node.path, FEATURE, _digest(node.href), None, 0, ""))
    texts: dict[int, list[str]] = {}
    for i, text in runs:
        while i and nodes[i].tag in INLINE:
            i = nodes[i].parent
        if text and not out[i]:
            texts.setdefault(i, []).append(text)
    for i, parts in texts.items():
        text = " ".join("".join(parts).split())
        if text and i:
            facts.add((nodes[i].path, FEATURE, _digest(text), None, 0, ""))
    return facts


SCHEMA = "host string, node long, kind int, value long, n long, above array<long>, root long, tag string"


def node_counts(pages: DataFrame, host: str, html: str) -> DataFrame:
    """The merged trees: (host, node, kind, value) and on how many pages of different text, summed in each task before the shuffle."""
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.string()]

    def run(batches):
        held: Counter = Counter()

        def out():
            rows = [(h, *f[:3], n, *f[3:]) for (h, f), n in held.items()]
            columns = list(zip(*rows)) if rows else [[]] * 8
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], SCHEMA.replace(",", "").split()[::2])

        for batch in batches:
            for h, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                held.update((h, f) for f in _facts(page))
                if len(held) > HELD:
                    yield out()
        yield out()

    rows = pages.select(F.col(host).alias("host"), F.col(html).alias("html")).where("html IS NOT NULL")
    # of pages of equal text one, the same in each run
    rows = rows.groupBy("host", F.xxhash64(F.regexp_replace("html", MARKUP, " ")).alias("same")).agg(F.min("html").alias("html"))
    counted = rows.mapInArrow(run, SCHEMA).groupBy("host", "node", "kind", "value")
    return counted.agg(F.sum("n").alias("n"), F.max("above").alias("above"), F.max("root").alias("root"), F.max("tag").alias("tag"))


def importance(counts: DataFrame) -> DataFrame:
    """(host, node, pages, own, composite, root, tag) of every node of every host's tree."""
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x).otherwise(0.0))
    log_n = F.col("n") * F.log("n")
    nodes = counts.groupBy("host", "node").agg(
        F.sum(F.when(F.col("kind") == PAGE, F.col("n")).otherwise(0)).alias("pages"), F.max("above").alias("above"),
        F.max(F.when(F.col("kind") == PAGE, F.col("root"))).alias("root"), F.max("tag").alias("tag"),
        of(STYLE, F.col("n")).alias("styled"), of(STYLE, log_n).alias("style_log"), of(FEATURE, F.log("n")).alias("feature_log"), of(FEATURE, F.lit(1.0)).alias("features"))
    base = F.log(F.col("pages"))
    style = (F.log("styled") - F.col("style_log") / F.col("styled")) / base
    content = 1 - F.col("feature_log") / F.col("features") / base
    own = F.when(F.col("pages") <= 1, 1.0).when(F.col("features") > 0, content).when(F.col("styled") > 0, style).otherwise(0.0)
    nodes = nodes.withColumn("own", F.least(F.greatest(own, F.lit(0.0)), F.lit(1.0)))
    # each node counts for itself and for all nodes above it
    line = F.concat(F.coalesce("above", F.array().cast("array<long>")), F.array("node"))
    spread = nodes.select("host", "own", "pages", F.posexplode(F.reverse(line)).alias("up", "at"))
    weight = F.pow(F.lit(FALL), F.col("up")) * F.col("pages")
    composite = spread.groupBy("host", F.col("at").alias("node")).agg((F.sum(weight * F.col("own")) / F.sum(weight)).alias("composite"))
    both = nodes.join(composite.withColumnRenamed("host", "h2").withColumnRenamed("node", "n2"), F.col("host").eqNullSafe(F.col("h2")) & (F.col("node") == F.col("n2")))
    return both.select("host", "node", "pages", "own", "composite", "root", "tag")


def noisy(importances: DataFrame, threshold: float = THRESHOLD, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, nodes): the nodes of low composite importance on at least `least_pages` pages, for hosts with so many pages.

    Inside an article a node must be a group of elements and the article itself important, so that a host full of copies
    of one page keeps its text. Articles count as nodes where they do not decide.
    """
    low = importances.where(F.col("pages") >= least_pages)
    roots = importances.select(F.col("host").alias("h2"), F.col("node").alias("n2"), F.col("composite").alias("root_importance"))
    low = low.join(roots, F.col("host").eqNullSafe(F.col("h2")) & (F.col("root") == F.col("n2")), "left")
    inside = (F.col("root") != F.col("node")) & F.col("tag").isin(*GROUPS) & (F.col("root_importance") >= threshold)
    noise = (F.col("composite") < threshold) & ~F.col("tag").isin(*WHOLE) & ((F.col("root") == 0) | (F.col("root") == F.col("node")) | inside)
    return low.groupBy("host").agg(F.sort_array(F.collect_set(F.when(noise, F.col("node")))).alias("nodes"))


def main_text(page: str | None, low: frozenset[int] | None = None) -> str:
    """Text of a page without excluded and low-importance branches: white space within a block becomes one space, blocks are joined by one.

    low is None if the page's host was not judged.
    """
    if not page:
        return ""
    nodes, runs = parse(page)
    root, never = roots_of(nodes)
    rooted = any(root[i] and not never[i] for i in range(len(nodes)))

    def left_out(rooted: bool) -> list[bool]:
        out = list(never)
        for i, node in enumerate(nodes[1:], 1):
            # where articles decide, they stay whatever stands above them
            top = rooted and root[i] == node.path
            out[i] = never[i] or not top and (out[node.parent] or node.path in (low or ()))
        return out

    def length(out: list[bool], within: bool) -> int:
        return sum(len("".join(text.split())) for i, text in runs if text and not out[i] and bool(root[i]) == within)

    out = left_out(rooted)
    if rooted and low is not None and length(out, False) > length(out, True):
        rooted, out = False, left_out(False)
    if low and not length(out, True) + (0 if rooted else length(out, False)):
        out = never
    words: list[str] = []
    block: list[str] = []
    for i, text in [*runs, (0, None)]:
        if text is None:
            if block:
                words += "".join(block).split()
                block = []
        elif not out[i] and (root[i] or not rooted):
            block.append(text)
    return " ".join(words)


def extract(pages: DataFrame, url: str = "url", html: str = "html", threshold: float = THRESHOLD, least_pages: int = LEAST_PAGES, drop: tuple[str, ...] = ()) -> DataFrame:
    """pages with `text` and `n_chars`. Null and empty html gives an empty text; pages with a null url, or one without a host, form one host.

    One row per row of pages; columns of pages with the new names are replaced, columns named `__host` or `__nodes` are not kept.
    The list of a host's low nodes has at most as many entries as its pages have different styles of branches.
    """
    hosted = pages.withColumn("__host", F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)))
    low = written(noisy(importance(node_counts(hosted, "__host", html)), threshold, least_pages), "low-nodes")
    joined = hosted.join(low.select(F.col("host").alias("__h2"), F.col("nodes").alias("__nodes")), F.col("__host") == F.col("__h2"), "left").drop("__h2", "__host")

    def factory():
        def make(batch):
            texts = [main_text(page, None if low is None else frozenset(low)) for page, low in zip(batch.column(html).to_pylist(), batch.column("__nodes").to_pylist())]
            return {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())}

        return make

    return added(joined, factory, {"text": "string", "n_chars": "long"}, drop=("__nodes", *drop))

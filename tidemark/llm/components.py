"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import forget, written

LINKS_PER_TASK = 100_000
#: Links that one task joins by itself, in 16 bytes each; rounds would take longer to start than to run.
LINKS_ALONE = 500_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node of a link the least node that links reach from it.

    Large star hangs a node's larger neighbours on its least neighbour, small star its smaller ones; both are a grouped
    minimum and a join, so a hub is pre-aggregated. Rounds grow with the logarithm of the nodes; each is written
    to the shared folder. Loops and repeated links do no harm; links with a null end are no links. Once no more than LINKS_ALONE are left, one task joins them.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    edges, before = written(edges.distinct(), "edges"), None
    n = edges.count()
    while n > LINKS_ALONE:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # a round never has more links than the one before: as few tasks as their number needs
        last = edges
        edges = written(small if before is None else small.coalesce(math.ceil(n / LINKS_PER_TASK)), "edges")
        forget(last)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before, n = state, state[0]
    return edges.coalesce(1).mapInArrow(_joined, "node long, root long")


def _joined(batches):
    """(node, root) of links (u, v): every root hangs itself on the least root that a link of its tree leads to, until no link leads elsewhere."""
    parts = [np.stack([batch.column(c).to_numpy() for c in ("u", "v")]) for batch in batches if batch.num_rows]
    if not parts:
        return
    nodes, at = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    u, v = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while (root[u] != root[v]).any():
        x, y = root[u], root[v]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    for first in range(0, len(nodes), 100_000):
        k = slice(first, first + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[k]), pa.array(nodes[root[k]])], ["node", "root"])

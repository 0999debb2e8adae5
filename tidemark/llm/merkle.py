"""A Merkle manifest of a dataset: one digest for all rows, one for each group, and for each row the siblings that prove it.

Rows of a group are leaves in a given order. At each level every `arity` consecutive nodes (the last run may be shorter) become one
node, the digest of their digests; a group's last node is its subroot, and the subroots in order of their groups make a tree by the same rule.

Each level is an equi-join of the nodes with themselves: a node's sibling has a computed index (XOR with 1 in binary trees, else its own
plus an offset within the run), and the rows of slot zero, which then know all siblings, emit the next level. Proofs go down again: a
node's path is its own siblings followed by its parent's path, joined on the parent's index. No join key has more rows than the arity,
however large a group is. Levels are written to the shared folder, so a lost executor costs a re-read; tables shrink by the arity.

Digests are lower-case hex sha256 of the concatenated inputs; tables hold the 32 bytes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written
from tidemark.operators import scan

#: Own slot and the digests of the other nodes of the run, left to right.
STEP = "struct<slot: int, others: array<binary>>"
#: Levels that proofs go down within one plan.
PLAN_LEVELS = 4


def hex_of(digest) -> Column:
    return F.lower(F.hex(digest))


def leaf_digest(columns: Sequence[str | Column]) -> Column:
    """Hex digest of a row: per column `-` if null, else the byte count, a colon and the value as text."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """nodes (group, idx, digest, ...) with `others`, the digests of the run's other nodes from left to right."""
    slot = (F.col("idx") % arity).cast("int")
    out = nodes
    for k in range(1, arity):
        # the row whose sibling this one is, k slots further round
        of = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - slot + F.pmod(slot - k, F.lit(arity))
        shifted = nodes.select(F.col("group").alias("__g"), of.alias("__i"), F.struct(slot.alias("slot"), "digest").alias(f"__s{k}"))
        out = out.join(shifted, F.col("group").eqNullSafe(F.col("__g")) & (F.col("idx") == F.col("__i")), "left").drop("__g", "__i")
    shifted = [f"__s{k}" for k in range(1, arity)]
    others = F.array_sort(F.array_compact(F.array(*shifted)))
    return out.withColumn("others", F.transform(others, lambda x: x["digest"])).drop(*shifted)


def _is_root() -> Column:
    """A node that is alone on its level."""
    return (F.col("idx") == 0) & (F.size("others") == 0)


def _climb(leaves: DataFrame, arity: int) -> list[DataFrame]:
    """All levels of all groups' trees from the leaves (group, idx, digest, ...) up."""
    last = leaves.agg(F.max("idx")).first()[0]
    levels, nodes = [], leaves
    while last is not None:
        levels.append(written(_with_siblings(nodes, arity), "merkle-level"))
        if last == 0:
            break
        last //= arity
        whole = F.concat(hex_of("digest"), F.array_join(F.transform("others", hex_of), ""))
        nodes = levels[-1].where((F.col("idx") % arity == 0) & ~_is_root()).select(
            "group", F.expr(f"idx div {arity}").alias("idx"), F.unhex(F.sha2(whole, 256)).alias("digest"))
    return levels


def _roots(levels: list[DataFrame]) -> DataFrame:
    """(group, level, digest) of every tree's root."""
    out = None
    for k, level in enumerate(levels):
        found = level.where(_is_root()).select("group", F.lit(k).alias("level"), "digest")
        out = found if out is None else out.unionByName(found)
    return out


def _descend(levels: list[DataFrame], above: DataFrame, arity: int, carried: Sequence[str]) -> DataFrame:
    """Leaves with `path` and `subroot`; `above` has (group, level, subroot, path) of each tree's root."""
    heights = {r["level"] for r in above.select("level").distinct().collect()}
    above = above.select(F.col("group").alias("__g"), F.lit(0).cast("long").alias("__i"), "subroot", F.col("path").alias("__above"), "level")
    same = F.col("group").eqNullSafe(F.col("__g"))
    up = None
    for k in range(len(levels) - 1, -1, -1):
        names = ["group", "idx", *(["digest", *carried] if k == 0 else [])]
        parts = []
        if k in heights:
            tops = levels[k].where(_is_root()).join(above.where(F.col("level") == k), same)
            parts.append(tops.select(*names, "subroot", F.col("__above").alias("path")))
        if up is not None:
            parents = up.select(F.col("group").alias("__g"), F.col("idx").alias("__i"), "subroot", F.col("path").alias("__above"))
            step = F.struct((F.col("idx") % arity).cast("int").alias("slot"), "others")
            below = levels[k].where(~_is_root()).join(parents, same & (F.expr(f"idx div {arity}") == F.col("__i")))
            parts.append(below.select(*names, "subroot", F.concat(F.array(step), "__above").alias("path")))
        up = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        if k and k % PLAN_LEVELS == 0:
            # a plan of many nested joins is slow to make
            up = written(up, "merkle-paths")
    return up


@dataclass
class Manifest:
    """`rows`: one per leaf, (group, digest, path, subroot and the carried columns); `root`: hex digest of everything, None if there are no rows."""

    rows: DataFrame
    root: str | None


def manifest(docs: DataFrame, columns: Sequence[str], group: str, order: str, arity: int = 2, carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of docs: a leaf is the digest of `columns`, groups are by `group` (null is one, the first), leaves by rising `order`.

    Rows of equal group and order stand in order of their digests, so repeated rows have interchangeable leaves; null orders come first. Null
    and empty values have different digests. An empty table has no rows and no root. `carry` names further expressions over docs that
    rows of the result keep. Texts are read once, hashed where they lie and not shuffled.
    """
    carry = carry or {}
    values = [F.col(group).alias("group"), F.col(order).alias("__order"), F.unhex(leaf_digest(columns)).alias("digest")]
    leaves = written(docs.select(*values, *[c.alias(f"__c_{n}") for n, c in carry.items()]), "merkle-leaves")
    passing = [f"__c_{n}" for n in carry]
    cut = scan.ranged(leaves.withColumn("__one", F.lit(1).cast("long")), ["group"], ["__order", "digest"])
    placed = scan.running(cut, ["group"], ["__order", "digest"], {"idx": ("sum", "__one")}).select("group", (F.col("idx") - 1).alias("idx"), "digest", *passing)
    levels = _climb(written(placed, "merkle-places"), arity)
    if not levels:
        none = placed.select("group", "digest", F.lit(None).cast(f"array<{STEP}>").alias("path"), F.col("digest").alias("subroot"), *[F.col(f"__c_{n}").alias(n) for n in carry])
        return Manifest(none, None)
    roots = written(_roots(levels), "merkle-roots")
    cut = scan.ranged(roots.withColumn("__one", F.lit(1).cast("long")), [], ["group"])
    tops = scan.running(cut, [], ["group"], {"idx": ("sum", "__one")})
    tops = tops.select(F.lit(0).alias("group"), (F.col("idx") - 1).alias("idx"), "digest", F.col("group").alias("of"), "level")
    upper = _climb(written(tops, "merkle-tops"), arity)
    # one row: the root of everything
    root = _roots(upper).first()["digest"]
    start = _roots(upper).select("group", "level", F.col("digest").alias("subroot"), F.array().cast(f"array<{STEP}>").alias("path"))
    top = _descend(upper, start, arity, ["of", "level"])
    above = written(top.select(F.col("of").alias("group"), "level", F.col("digest").alias("subroot"), "path"), "merkle-tops")
    rows = _descend(levels, above, arity, passing)
    return Manifest(rows.select("group", "digest", "path", "subroot", *[F.col(f"__c_{n}").alias(n) for n in carry]), bytes(root).hex())


def siblings(path: str = "path") -> Column:
    """Hex digests of a path's siblings, level by level, left to right."""
    return F.transform(F.flatten(F.transform(path, lambda s: s["others"])), hex_of)


def folded(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf's hex digest gives with the siblings of a path."""

    def step(below, s):
        others = F.transform(s["others"], hex_of)
        before = F.array_join(F.slice(others, F.lit(1), s["slot"]), "")
        after = F.array_join(F.slice(others, s["slot"] + 1, F.size(others)), "")
        return F.sha2(F.concat(before, below, after), 256)

    return F.aggregate(path, leaf, step)

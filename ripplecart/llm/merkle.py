"""Merkle manifest of a table with checkpointed levels: proofs recompute what was not stored.

Every row is a leaf. The leaves of a tree lie in key order; runs of `FAN` neighbours are hashed into a node until one
node, the subroot, remains; the subroots in key order form the upper tree, whose last node is the root.

Only every `EVERY`-th level is written: one row per *aligned subtree* of at most FAN ** EVERY neighbouring nodes of a
stored level. The levels between are never stored. Building hashes a subtree up to its summit, which is a node
of the next stored level; extracting proofs walks the stored levels from the top, regenerates the interior
nodes of each subtree from the stored nodes under it, hands every node its siblings followed by the path of its subtree,
and forgets the interior nodes with the row.

Positions come from a range sort by (tree, key) with counts per (tree, partition), so a tree that holds a third of
all rows is spread over many tasks like any other. A task holds one subtree at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplecart.llm.common import saved, tasks

#: Children of a node.
FAN = 8
#: Levels from one stored level to the next.
EVERY = 2
DIGITS = 64

PATH = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("siblings", T.StringType())]))


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of the values end to end, each `-` if null, else its UTF-8 byte count, `:` and itself as text."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf digest and its path of siblings lead to."""
    cut = lambda level: level["at"] * DIGITS
    up = lambda digest, level: F.concat(
        F.substring(level["siblings"], F.lit(1), cut(level)), digest, F.substring(level["siblings"], cut(level) + 1, F.length(level["siblings"]))
    )
    return F.aggregate(path, leaf, lambda digest, level: F.sha2(up(digest, level).cast("binary"), 256))


def _height(n: int, fan: int, every: int) -> int:
    """Levels above a stored level in one of its subtrees; `n` nodes stand on that level of the tree."""
    height = 0
    while n > 1 and height < every:
        n, height = -(-n // fan), height + 1
    return height


def regenerate(nodes: list[str], height: int, fan: int = FAN) -> list[list[str]]:
    """The levels of a subtree from its stored nodes up."""
    levels = [nodes]
    for _ in range(height):
        nodes = [_hash("".join(nodes[i : i + fan])) for i in range(0, len(nodes), fan)]
        levels.append(nodes)
    return levels


def _placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Columns pos (0-based in its tree by `order`) and n (nodes of the tree)."""
    at = F.monotonically_increasing_id()
    ordered = saved(nodes.repartitionByRange(tasks(nodes), "tree", *order).sortWithinPartitions("tree", *order).withColumn("_at", at), "ordered")
    part = F.shiftright("_at", 33).alias("_part")
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ordered.groupBy("tree", part).agg(F.count(F.lit(1)).alias("c"), F.min("_at").alias("first"))
    shifts = counts.select(
        "tree", "_part", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("_shift"), F.sum("c").over(Window.partitionBy("tree")).alias("n")
    )
    return ordered.withColumn("_part", part).join(shifts.hint("merge"), ["tree", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _summits(fan: int, every: int):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_pylist()
            tops = []
            for i, size in enumerate(n):
                digests = batch.column("nodes")[i].values.field("digest").to_pylist()
                tops.append(regenerate(digests, _height(size, fan, every), fan)[-1][0])
            yield pa.RecordBatch.from_arrays(
                [batch.column("tree"), batch.column("block"), pa.array(n, pa.int64()), pa.array(tops, pa.string())], names=["tree", "block", "n", "digest"]
            )

    return hashed


def _layers(nodes: DataFrame, carry: list[str], fan: int, every: int) -> tuple[list[DataFrame], DataFrame]:
    """The stored levels, bottom up, as rows (tree, n, block, nodes), and the last node of every tree (tree, digest)."""
    width = fan**every
    block = F.floor(F.col("pos") / width).alias("block")
    layers, tops = [], []
    while True:
        held = F.array_sort(F.collect_list(F.struct("pos", "digest", *carry))).alias("nodes")  # at most `width` of them
        layer = saved(nodes.groupBy("tree", "n", block).agg(held), f"level{len(layers) * every}")
        layers.append(layer)
        summits = saved(layer.mapInArrow(_summits(fan, every), "tree string, block long, n long, digest string"), "summits")
        tops.append(summits.where(F.col("n") <= width).select("tree", "digest"))
        higher = summits.where(F.col("n") > width)
        if higher.isEmpty():
            break
        nodes = higher.select("tree", F.ceil(F.col("n") / width).alias("n"), F.col("block").alias("pos"), "digest")
        carry = []
    last = tops[0]
    for more in tops[1:]:
        last = last.unionByName(more)
    return layers, last


def _siblings(fan: int, every: int):
    """Every node of a subtree with its path: its siblings on the regenerated levels, then the path of the subtree."""

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, trees, roots = (batch.column(c).to_pylist() for c in ("n", "tree", "roots"))
            for i, size in enumerate(sizes):
                nodes, above = batch.column("nodes")[i].values, batch.column("path")[i].as_py()
                levels = regenerate(nodes.field("digest").to_pylist(), _height(size, fan, every), fan)
                at, siblings = [], []
                for k in range(len(nodes)):
                    for level in levels[:-1]:
                        first = k - k % fan
                        at.append(k - first)
                        siblings.append("".join(level[first:k] + level[k + 1 : first + fan]))
                        k //= fan
                    at += [x["at"] for x in above]
                    siblings += [x["siblings"] for x in above]
                deep = len(levels) - 1 + len(above)
                steps = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(siblings, pa.string())], ["at", "siblings"])
                path = pa.ListArray.from_arrays(pa.array([j * deep for j in range(len(nodes) + 1)], pa.int32()), steps)
                same = lambda value, kind: pa.array([value] * len(nodes), kind)
                yield pa.RecordBatch.from_arrays(
                    [same(trees[i], pa.string()), nodes, path, same(roots[i], pa.list_(pa.string()))], names=["tree", "node", "path", "roots"]
                )

    return walked


def _paths(layers: list[DataFrame], tops: DataFrame, fan: int, every: int) -> DataFrame:
    """Rows (tree, node, path, roots) for the nodes of the lowest level; `tops` has tree, path and roots of each last node."""
    width, above = fan**every, None
    for depth, layer in reversed(list(enumerate(layers))):
        under = layer.where(F.col("n") <= width).join(tops.hint("merge"), "tree")
        if above is not None:
            under = under.unionByName(layer.where(F.col("n") > width).join(above.hint("merge"), ["tree", "block"]))
        node = layer.schema["nodes"].dataType.elementType
        out = T.StructType(
            [T.StructField("tree", T.StringType()), T.StructField("node", node), T.StructField("path", PATH), T.StructField("roots", T.ArrayType(T.StringType()))]
        )
        found = under.select("tree", "n", "nodes", "path", "roots").mapInArrow(_siblings(fan, every), out)
        above = saved(found.select("tree", F.col("node.pos").alias("block"), "path", "roots"), "paths") if depth else found
    return above


@dataclass(frozen=True)
class Manifest:
    """Stored levels of the lower trees and of the upper tree, bottom up; `root` has one row, none for an empty table."""

    lower: list[DataFrame]
    upper: list[DataFrame]
    root: DataFrame
    fan: int
    every: int

    def proofs(self) -> DataFrame:
        """One row per leaf: key, leaf, the carried columns, subroot, root, path (at, siblings end to end) from leaf to root."""
        nothing = F.array().cast(PATH)
        top = self.root.select("tree", nothing.alias("path"), F.array("digest").alias("roots"))
        subroots = _paths(self.upper, top, self.fan, self.every)
        tops = subroots.select(F.col("node.key").alias("tree"), "path", F.concat(F.array("node.digest"), "roots").alias("roots"))
        leaves = _paths(self.lower, saved(tops, "subroots"), self.fan, self.every)
        carried = [f.name for f in self.lower[0].schema["nodes"].dataType.elementType.fields if f.name not in ("pos", "digest", "_row")]
        return leaves.select(
            *[F.col(f"node.{c}").alias(c) for c in carried], F.col("node.digest").alias("leaf"),
            F.col("roots")[0].alias("subroot"), F.col("roots")[1].alias("root"), "path",
        )


def manifest(
    docs: DataFrame, columns: list[str], tree: str = "lang", key: str = "doc_id", carry: dict[str, Column] | None = None, *, fan: int = FAN, every: int = EVERY
) -> Manifest:
    """Manifest of all rows of `docs` over `columns`, one tree per value of `tree`, leaves by ascending `key`.

    Nulls: a null tree value is a tree of its own and comes first, a null key comes first in its tree, a null value
    is hashed as `-`, unlike the empty text. Ties: rows with the same key follow by leaf digest; repeated rows
    are a leaf each. Long texts are hashed whole inside the JVM. Columns that are not named are not read, so extra ones
    with any name do no harm; `carry` adds values to the rows of the proofs, computed in the same scan. An empty
    table has no root and no proofs.
    """
    carry = carry or {}
    name = F.coalesce(F.concat(F.lit("1"), F.col(tree).cast("string")), F.lit("0"))  # null first, then bytewise
    leaves = docs.select(
        name.alias("tree"), F.col(key).alias("key"), leaf_digest(*[F.col(c) for c in columns]).alias("digest"),
        *[c.alias(n) for n, c in carry.items()], F.monotonically_increasing_id().alias("_row"),
    )
    lower, subroots = _layers(_placed(saved(leaves, "leaves"), ["key", "digest", "_row"]), ["key", *carry], fan, every)
    heads = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest")
    upper, root = _layers(_placed(heads, ["key"]), ["key"], fan, every)
    return Manifest(lower, upper, root, fan, every)


def with_folded(proofs: DataFrame, altered: Column) -> DataFrame:
    """Proofs with folded_root, recomputed from an altered leaf digest (null: the leaf itself), and verified."""
    back = folded(F.coalesce(altered, "leaf"), F.col("path"))
    return proofs.withColumn("folded_root", back).withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(path["siblings"], "").cast("binary"), 256)

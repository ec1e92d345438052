"""Range joins of boxes through a packed R-tree kept as tables.

The tree is packed by sort-tile-recursive: centres are dealt to vertical slices by
quantiles of x, each slice is cut into nodes along y, and nodes are packed again
until a handful is left. A level is a table of (node, parent, box), so a join with
the tree is one equi-join a level on the node reached, with the box test inside it;
no pair that does not meet leaves a level. Entries are joined by the node above their
leaf, since where boxes overlap a probe reaches more leaves than any other rows there
are. Only the top level is broadcast, whose size is at most FANOUT rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Children of a node.
FANOUT = 64
#: Boundaries between slices are quantiles with this much error in rank.
QUANTILE_ERROR = 1e-3
BOX = ("min_x", "max_x", "min_y", "max_y")


def meets(a: str, b: str) -> Column:
    """Whether the boxes of two aliases have a point in common; edges count."""
    c = lambda t, n: F.col(f"{t}.{n}")
    return (c(a, "min_x") <= c(b, "max_x")) & (c(a, "max_x") >= c(b, "min_x")) & (c(a, "min_y") <= c(b, "max_y")) & (c(a, "max_y") >= c(b, "min_y"))


def whole(boxes: DataFrame) -> DataFrame:
    """Boxes without null, nan or crossed sides."""
    good = F.lit(True)
    for n in BOX:
        good &= F.col(n).isNotNull() & ~F.isnan(n)
    return boxes.where(good & (F.col("min_x") <= F.col("max_x")) & (F.col("min_y") <= F.col("max_y")))


def _packed(rows: DataFrame, n: int, fanout: int) -> DataFrame:
    """Adds ``parent``: the node that each of n boxes is packed into."""
    middle = lambda a, b: (F.col(a) / 2 + F.col(b) / 2)
    slices = math.ceil(math.sqrt(n / fanout))
    placed = rows.withColumns({"_x": middle("min_x", "max_x"), "_y": middle("min_y", "max_y")})
    if slices > 1:
        bounds = np.unique(placed.approxQuantile("_x", [k / slices for k in range(1, slices)], min(QUANTILE_ERROR, 0.1 / slices)))
        placed = placed.withColumn("_slice", F.arrow_udf(lambda x: pa.array(np.searchsorted(bounds, x.to_numpy(zero_copy_only=False), side="right"), pa.int64()), "long")("_x"))
    else:
        placed = placed.withColumn("_slice", F.lit(0).cast("long"))
    along = F.row_number().over(Window.partitionBy("_slice").orderBy("_y", "_x", "node")) - 1
    return placed.withColumn("parent", F.shiftleft("_slice", 32) + F.floor(along / fanout).cast("long")).drop("_x", "_y", "_slice")


@dataclass
class Tree:
    """``entries``: the boxes with their columns, ``node`` numbers and leaf ``parent``; ``levels``: (node, parent, box) from the leaves up."""

    entries: DataFrame
    levels: list[DataFrame]


def pack(boxes: DataFrame, keep, fanout: int = FANOUT) -> Tree:
    """An R-tree over boxes (min_x, max_x, min_y, max_y and any other columns).

    ``keep`` writes a table and reads it back: each level is used twice, and node numbers must not change.
    Boxes with a null, nan or crossed side take no part. Equal boxes are entries of their own.
    """
    rows = whole(boxes).withColumn("node", F.monotonically_increasing_id())
    rows = keep(rows)
    n = rows.count()
    levels: list[DataFrame] = []
    entries = keep(_packed(rows, max(n, 1), fanout))
    below = entries
    while True:
        nodes = below.groupBy("parent").agg(*(getattr(F, x[:3])(x).alias(x) for x in BOX)).withColumnRenamed("parent", "node")
        nodes = keep(nodes)
        n = nodes.count()
        if n <= fanout:
            levels.append(nodes.withColumn("parent", F.lit(0).cast("long")))
            return Tree(entries, levels)
        below = keep(_packed(nodes, n, fanout))
        levels.append(below)


def box_join(probes: DataFrame, tree: Tree, probe: list[str], entry: list[str]) -> DataFrame:
    """All pairs of a probe and an entry whose boxes meet: the columns ``probe`` of one and ``entry`` of the other.

    Boxes with a null, nan or crossed side meet nothing. Repeated rows pair each on its own.
    """
    held = [F.col(c).alias(f"_p{k}") for k, c in enumerate(probe)]
    at = whole(probes).select(*held, *BOX)
    top = tree.levels[-1].select("node", *BOX)
    reached = at.alias("p").join(F.broadcast(top).alias("t"), meets("p", "t")).select("p.*", F.col("t.node").alias("_at"))
    levels, entries = tree.levels, tree.entries
    if len(levels) > 2:  # entries by the node above their leaf: a probe travels once a node of fanout^2 entries, not once a leaf
        leaf = levels[0].select(F.col("node").alias("_leaf"), F.col("parent").alias("_above"))
        entries = entries.join(leaf, F.col("parent") == F.col("_leaf")).drop("parent", "_leaf").withColumnRenamed("_above", "parent")
        levels = levels[1:]
    for level in reversed(levels[:-1]):
        reached = reached.alias("p").join(level.alias("t"), (F.col("p._at") == F.col("t.parent")) & meets("p", "t")).select(*(f"p._p{k}" for k in range(len(probe))), *(f"p.{n}" for n in BOX), F.col("t.node").alias("_at"))
    found = reached.alias("p").join(entries.alias("t"), (F.col("p._at") == F.col("t.parent")) & meets("p", "t"))
    return found.select(*(F.col(f"p._p{k}").alias(c) for k, c in enumerate(probe)), *(F.col(f"t.{c}") for c in entry))

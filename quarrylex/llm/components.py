"""Connected components of a links table: in one task up to a checked number of links, else by star steps on DataFrames.

The steps alternate large and small stars. Each hooks every node to the smallest node it sees; the number of rounds is logarithmic in the longest path. Minima are
pre-aggregated before the shuffle, the joins are on the node and can be split where one node is hot, and each round's links
are written to the shared folder, so that lineage stays short and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylex.llm.base import materialise


def _star(directed: DataFrame, everyone: bool) -> DataFrame:
    """Link the neighbours v of each u to the smallest node that u sees: the larger neighbours, or (small star) all."""
    least = directed.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    joined = directed.join(least, "u")
    if everyone:
        rows = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    else:
        rows = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rows.where("u <> v").distinct()


def _one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest-id components of all links of the task, by hooking and pointer jumping on arrays."""
    parts = list(batches)
    if not parts:
        return
    a, b = (np.concatenate([p.column(k).to_numpy() for p in parts]) for k in (0, 1))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for side in (x, y):
            np.minimum.at(new, side, low)
            np.minimum.at(new, root[side], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    for lo in range(0, len(ids), 65_536):
        yield pa.record_batch([pa.array(ids[lo : lo + 65_536]), pa.array(ids[root[lo : lo + 65_536]])], names=["node", "root"])


def components(links: DataFrame, limit: int = 60, small: int = 500_000) -> DataFrame:
    """(node, root) for every node of written links (a, b): root is the smallest node that it can reach.

    small: number of links up to which one task has them all (16 bytes each).
    """
    if links.count() <= small:
        return materialise(links.select("a", "b").coalesce(1).mapInArrow(_one_task, "node bigint, root bigint"), "components")
    return star_components(links, limit)


def star_components(links: DataFrame, limit: int = 60) -> DataFrame:
    """The same for any number of links."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, mark = materialise(edges, "edges"), None
    for _ in range(limit):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = materialise(_star(_star(both, False), True), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = now
    raise RuntimeError(f"components: no fixed point in {limit} rounds")

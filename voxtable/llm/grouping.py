"""Groups of linked documents: union-find inside partitions, star rounds across them where there are several."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..graph import connected

LINKS = 1 << 19  # links that one task joins in memory


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one partition; gives each node its root, so at most one link per node is left."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            r, s = find(x), find(y)
            if r != s:
                parent[max(r, s)] = min(r, s)
    pairs = [(find(x), x) for x in list(parent)]
    pairs = [p for p in pairs if p[0] != p[1]]
    if pairs:
        a, b = zip(*pairs)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), a written table; root is the smallest id reachable.

    A task takes up to LINKS links.  Where one task sees them all its forest is the answer; several forests, of at most
    one link per node each, are joined by star rounds.
    """
    parts = 1 + links.count() // LINKS
    forest = links.select("a", "b").coalesce(parts).mapInArrow(_forest, "a long, b long")
    if parts > 1:
        return connected(forest, [])
    return forest.select(F.explode(F.array("a", "b")).alias("node"), F.col("a").alias("root")).distinct()

"""Connected components of a distributed edge table, by alternating star contraction.

Each round links the neighbours of every node to the smallest node nearby (first the larger ones,
then the smaller ones), until every node hangs on the smallest node of its component. Minima are
aggregated and joined back, so the edges of one node are never gathered in one task; rounds grow
with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrade.llm.shared import cut
from sitegrade.operators.keyed import attach


def _with_least(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) with ``m``, the smallest of ``a`` and its neighbours ``b``."""
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return attach(edges, least, ["a"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; ``edges`` has two bigint columns ``a``, ``b``.

    ``root`` is the smallest node that can be reached. Loops and repeated edges do no harm.
    """
    edges = cut(edges.filter("a <> b").selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct(), "edges")
    known = None
    while True:
        both = edges.unionAll(edges.selectExpr("b as a", "a as b"))
        # Every larger neighbour to the smallest node around.
        large = _with_least(both).filter("b > a").selectExpr("b as a", "m as b").filter("a <> b")
        large = cut(large.distinct(), "large")
        # Every smaller neighbour, and the node itself, to the smallest of them.
        near = _with_least(large)
        small = near.selectExpr("explode(array(a, b)) as a", "m as b").filter("a <> b")
        edges = cut(small.distinct(), "small")
        state = edges.agg(
            F.count("*"), F.sum(F.expr("cast(xxhash64(a, b) as decimal(38, 0))"))
        ).first()
        if state == known:
            break
        known = state
    nodes = edges.selectExpr("a as node", "b as root")
    return nodes.unionAll(nodes.select("root").distinct().selectExpr("root as node", "root"))

"""Connected components of an edge table, with nothing on the driver but a short rest of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.shared import checkpointed

MAX_ROUNDS = 60
#: Rounds in the order of the nodes themselves, of which the smallest of a component always stays.
PLAIN_ROUNDS = 2
#: Edges between what the rounds have left of the components that are few enough to end on the driver, like a small table to broadcast.
REST = 10_000


def connected_components(edges: DataFrame, rest: int = REST) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: bigint, not null); component is the smallest node reachable.

    Each round maps every node to the first of itself and its neighbours, and edges to edges between those; the maps of
    all rounds, one after the other, give the components. Rounds end when at most ``rest`` edges are left, whatever the size of the table; those are followed
    on the driver. A star is gone after two rounds of one order, so two follow the nodes' own order, and then each two another hash of them, which
    no path can be sorted by: the number of rounds grows with the logarithm of the nodes. The first neighbour is a pre-aggregated
    groupBy, joined back, so a node with very many neighbours is a skewed join side, which Spark splits.
    """
    now, found = checkpointed(_oriented(edges)), None
    for k in range(MAX_ROUNDS):
        order = (lambda x: F.col(x)) if k < PLAIN_ROUNDS else (lambda x: F.xxhash64(x, F.lit(k // 2)))  # noqa: B023
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        first = both.groupBy("u").agg(F.min("v").alias("m") if k < PLAIN_ROUNDS else F.min_by("v", order("v")).alias("m"))
        first = checkpointed(first.select("u", F.when(order("m") < order("u"), F.col("m")).otherwise(F.col("u")).alias("m")))
        now = now.join(first.select(F.col("u").alias("a"), F.col("m").alias("am")), "a").join(first.select(F.col("u").alias("b"), F.col("m").alias("bm")), "b")
        now = checkpointed(_oriented(now.select(F.col("am").alias("a"), F.col("bm").alias("b"))))
        found = _after(found, first) if k else first.select(F.col("u").alias("node"), F.col("m").alias("component"))
        left = now.take(rest + 1)
        if len(left) <= rest:
            break
    else:
        raise RuntimeError(f"the components did not settle in {MAX_ROUNDS} rounds")
    if left:
        found = _after(found, now.sparkSession.createDataFrame(_followed(left), "u long, m long"))
    if k >= PLAIN_ROUNDS:
        found = checkpointed(found)
        found = found.join(found.groupBy("component").agg(F.min("node").alias("m")), "component").select("node", F.col("m").alias("component"))
    return found


def _after(found: DataFrame, names: DataFrame) -> DataFrame:
    """``found`` with the component u of ``names`` called m."""
    return found.join(names.withColumnRenamed("u", "component"), "component", "left").select("node", F.coalesce("m", "component").alias("component"))


def _followed(edges: list) -> list[tuple[int, int]]:
    """Every node of a few edges with the smallest one in reach."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in root]


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()

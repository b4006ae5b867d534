"""Connected components of a graph given as edges, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.session import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the component's least node.

    Large star and small star in turn (Kiveris et al., Connected Components in MapReduce and Beyond, 2014):
    each node's neighbours are hung on the least of them until nothing changes, in a number of rounds that grows
    with the logarithm of a component's size. A round has a row per edge, never the pairs of a group; minima are
    summed up before the shuffle, and as they are stored, adaptive execution can split a hub's edges
    in the join. Each round is a table in the shared folder, so a lost executor costs one round; the one before it goes.

    Loops, repeated edges and edges with a null end are ignored; no edges give no rows.
    """
    a, b = F.col("a"), F.col("b")
    edges = stored(edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        hubs = stored(both.groupBy("a").agg(F.least(F.min("b"), a).alias("least")), "least")
        # Large star: all greater neighbours of a node go below its least one.
        large = both.filter(b > a).join(hubs, "a").select(b.alias("a"), F.col("least").alias("b")).distinct()
        large = stored(large, "edges")
        # Small star: all smaller neighbours and the node itself do.
        least = stored(large.groupBy("a").agg(F.min("b").alias("least")), "least")
        moved = large.join(least, "a")
        small = moved.select(b.alias("a"), F.col("least").alias("b")).filter(a != b).unionByName(least.select("a", F.col("least").alias("b")))
        before, edges = edges, stored(small.distinct(), "edges")
        discard(before, hubs, large, least)
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (row[0], row[1]) == state or not row[0]:
            break
        state = (row[0], row[1])
    # Now each node other than a root has one edge, to its root.
    return edges.select(a.alias("node"), b.alias("root")).unionByName(edges.select(b.alias("node"), b.alias("root")).distinct())

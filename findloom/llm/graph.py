"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


#: Edges that one file of an edge table holds.
EDGES_A_FILE = 250_000


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def _minimum(both: DataFrame, files: int) -> DataFrame:
    """The least of each node and its neighbours. Written as a table, so that
    the join with it can split the edges of a hub over several tasks."""
    return materialize(
        both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")),
        "star",
        files,
    )


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node that has an edge to another node.

    ``component`` is the smallest node of the component. Edges with a null end
    and self-loops are ignored; repeated edges do no harm; an empty table gives
    an empty table. Each round writes its edges to the shared folder, and the
    number of edges never grows, so no component is held in one task. Files
    are as many as the edges need, so the last small rounds stay small jobs.
    """
    edges = materialize(
        edges.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    state = _state(edges)
    while state[0]:
        files = 1 + state[0] // EDGES_A_FILE
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_minimum(both, files), "u")
            .filter("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = materialize(large, "large", files)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "star", files)
        small = (
            large.join(least, "u")
            .filter("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges = materialize(small, "edges", files)
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

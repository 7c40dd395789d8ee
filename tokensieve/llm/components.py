"""Connected components of an edge table, without collecting anything.

Each round every node hooks onto its least smaller neighbour, the trees that this makes are flattened by pointer
jumping, and edges are contracted to the roots. At least every second node with an edge goes away, so the rounds are
logarithmic in the number of nodes. All steps are aggregations that combine before their shuffle and equi-joins,
which adaptive execution splits where one root is hot; every step is stored, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokensieve.llm import common


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """(id, component) for each node of edges (a, b): component is the least id that links reach.

    Loops and repeated edges don't matter; edges with a null end are ignored. No edges give an empty table. With
    `files`, a stored step has that many files at most.
    """

    def stored(df: DataFrame, name: str) -> DataFrame:
        return common.stored(df if files is None else df.coalesce(files), name)

    pairs = edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = stored(pairs, "edges")
    labels = None
    while not pairs.isEmpty():
        parents = stored(pairs.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root")), "hooks")
        while True:
            up = parents.select(F.col("id").alias("root"), F.col("root").alias("above"))
            jumped = parents.join(up, "root", "left").select("id", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
            jumped = stored(jumped, "jump")
            parents = jumped.select("id", "root")
            if jumped.filter("moved").isEmpty():
                break
        of_a = parents.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        of_b = parents.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        pairs = pairs.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
        pairs = pairs.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        pairs = stored(pairs, "edges")
        if labels is None:
            labels = parents
        else:
            now = parents.select(F.col("id").alias("root"), F.col("root").alias("top"))
            moved = labels.join(now, "root", "left").select("id", F.coalesce("top", "root").alias("root"))
            labels = moved.unionByName(parents.join(labels.select("id"), "id", "left_anti"))
        labels = stored(labels, "labels")
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0)
    roots = labels.select(F.col("root").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return labels.select("id", F.col("root").alias("component")).unionByName(roots)

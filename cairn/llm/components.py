"""Connected components of an edge table by alternating large and small stars, on executors only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import staged


def components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """Rows (v, root) for each vertex of edges (a, b); root is the least vertex of its component.

    Every round writes its edges to the shared folder; the loop ends when the edges are stars. Least neighbours are
    pre-aggregated before the shuffle; the join that brings them back can't be split, so all edges of a vertex pass one task, as a sorted stream.
    """
    now = staged(_directed(edges.select("a", "b")), "edges")
    for _ in range(rounds):
        now = staged(_directed(_small_star(_large_star(now))).distinct(), "edges")
        if _are_stars(now):
            break
    else:
        raise RuntimeError("the components did not settle")
    stars = now.select(F.col("b").alias("v"), F.col("a").alias("root"))
    return stars.unionByName(now.select(F.col("a").alias("v"), F.col("a").alias("root")).distinct())


def neighbour_labels(edges: DataFrame, *, hops: int = 2) -> DataFrame:
    """Rows (v, root) for each vertex of edges (a, b); vertices of equal root share a component, the converse needn't hold.

    One hop takes the least of a vertex and its neighbours, a further one the least of their labels: two give all leaves
    of a star the same label, at much lower cost than whole components.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("root"))
    for _ in range(hops - 1):
        seen = both.join(labels.withColumnRenamed("v", "b").hint("merge"), "b").select(F.col("a").alias("v"), "root")
        labels = seen.unionByName(labels).groupBy("v").agg(F.min("root").alias("root"))
    return labels


def _directed(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with a < b."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b")


def _are_stars(edges: DataFrame) -> bool:
    """Whether each vertex is either a centre or the leaf of one centre; the edges must be distinct."""
    ends = edges.select(F.col("a").alias("v"), F.lit(0).alias("leaf")).unionByName(edges.select(F.col("b").alias("v"), F.lit(1).alias("leaf")))
    kinds = ends.groupBy("v").agg(F.min("leaf").alias("least"), F.sum("leaf").alias("centres"))
    return kinds.filter("centres > 1 or (centres = 1 and least = 0)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex ties its larger neighbours to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least.hint("merge"), "a").select(F.col("m").alias("a"), "b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex ties its smaller neighbours and itself to the least of them."""
    edges = _directed(edges)
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    tied = edges.join(least.hint("merge"), "b")
    return tied.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(least.select(F.col("m").alias("a"), "b"))

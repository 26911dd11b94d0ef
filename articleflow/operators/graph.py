"""Connected components of a link table by star contraction (V3).

A link is kept as (hi, lo) with hi > lo. A round has two steps, which only ever replace a neighbour by a smaller one:

* large star: the smaller end of every link gives way to its own smallest neighbour;
* small star: every smaller neighbour of a node, and the node itself, is linked to the smallest of them.

Neither step adds links (equal ones are merged), components stay as they are, and links to many different neighbours shrink to one per
node, so rounds get cheaper where propagation over all links would read every one of them again. The rounds end when a
round changes nothing: then every node is linked to its component's smallest node alone. They number O(log² n).

Each step is written to the shared folder: lineage stays one step long, and only the number of changes reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.session import materialize


def oriented(links: DataFrame, src: str = "id_a", dst: str = "id_b") -> DataFrame:
    """(hi, lo), different links only; a node's link to itself says nothing."""
    a, b = F.col(src), F.col(dst)
    return links.filter(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least"))


def _stored(step: DataFrame, name: str) -> DataFrame:
    """The different links of a step, written; ``moved`` says whether the step changed one that led to it."""
    return materialize(step.groupBy("hi", "lo").agg(F.max("moved").alias("moved")), name)


def _moved(edges: DataFrame) -> int:
    return edges.agg(F.count_if("moved")).first()[0]


def large_star(edges: DataFrame) -> DataFrame:
    below = _smallest(edges)
    step = edges.join(below, edges["lo"] == below["node"], "left").select(
        "hi", F.coalesce("least", "lo").alias("lo"), F.col("least").isNotNull().alias("moved"))
    return _stored(step, "large-star")


def small_star(edges: DataFrame) -> DataFrame:
    joined = edges.join(_smallest(edges), F.col("hi") == F.col("node"))
    # of a link's two new ones the second is for the smaller end, unless that is the smallest itself
    step = joined.select(F.explode(F.array(F.struct("hi", F.col("least").alias("lo"), F.lit(False).alias("moved")),
                                           F.struct(F.col("lo").alias("hi"), F.col("least").alias("lo"),
                                                    (F.col("lo") != F.col("least")).alias("moved")))).alias("e")).select("e.*")
    return _stored(step.filter(F.col("hi") != F.col("lo")), "small-star")


def star_components(links: DataFrame, src: str = "id_a", dst: str = "id_b", max_rounds: int = 100,
                    sizes: list[int] | None = None) -> DataFrame:
    """(node, root) for every node of ``links`` that has a smaller one in its component; ``root`` is the component's smallest node.
    Roots themselves have no row. The rows of the link table after each round are appended to ``sizes``, if given. Raises if
    ``max_rounds`` is not enough (never a partial answer). Nodes of any ordered type; links hold no nulls."""
    edges = materialize(oriented(links, src, dst), "links")
    for _ in range(max_rounds):
        large = large_star(edges)
        edges = small_star(large.select("hi", "lo"))
        if sizes is not None:
            sizes.append(edges.count())
        if not _moved(edges) and not _moved(large):
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

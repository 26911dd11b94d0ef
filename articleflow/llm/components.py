"""Connected components of a link table, by the star contraction of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.operators.graph import star_components
from articleflow.session import materialize


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); ``root`` is the smallest node of the node's component.

    Every step is written to the shared folder: lineage stays one step long and nothing but the number of changed links
    reaches the driver. A step never adds links, and its joins read the links once each, so their rows are bounded by the links
    given; a group in which everything is linked to everything should come contracted (``simhash.links``)."""
    found = materialize(star_components(links, "a", "b", max_rounds), "components")
    roots = found.select("root").distinct().select(F.col("root").alias("node"), "root")
    return found.unionByName(roots)

"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long), undirected -> (node long, root long), root = smallest node of the component.

    Each round every node takes the smallest label among its neighbours, then the label of that label.
    Both inputs of each join are stored tables, so a hub's rows can be split by the skew-join rule, and
    only minima are aggregated (never lists of neighbours). Loops and repeated edges are harmless; an
    empty table gives no rows.
    """
    pairs = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = stored(pairs, "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).select(both["a"].alias("node"), "root")
        low = stored(seen.unionByName(labels.select("node", "root")).groupBy("node").agg(F.min("root").alias("root")), "low")
        up = low.select(F.col("node").alias("via"), F.col("root").alias("top"))
        new = stored(low.join(up, low["root"] == up["via"]).select("node", F.least("root", "top").alias("root")), "labels")
        was, now = (x.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0] for x in (labels, new))
        discard(labels)
        discard(low)
        labels = new
        if was == now:  # labels only ever fall, so an equal sum means that none did
            return labels

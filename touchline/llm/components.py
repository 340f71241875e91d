"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.session import stage


def connect(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b), label being the smallest node of its component.

    In each turn a node takes the smallest of its own label, its neighbours' labels and its label's label. Labels are a
    written table, so adaptive execution can split the joins at a node with very many links, and minima combine before
    they are shuffled. It ends when no label changes; labels of labels halve the way, so a chain of n nodes takes about log n turns.
    """
    both = stage(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))), "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        least = F.least("label", "near", F.coalesce("above", "label"))
        moved = labels.join(near, "node").join(above, "label", "left").select("node", least.alias("label"), (least != F.col("label")).alias("changed"))
        moved = stage(moved, "labels")
        labels = moved.select("node", "label")
        if moved.where("changed").isEmpty():
            return labels

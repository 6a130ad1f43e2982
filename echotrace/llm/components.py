"""Connected components of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrace.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the least node of its component.

    Every round gives a node the least label among its own and its neighbours', then that label's own label, until nothing changes:
    long chains shorten as their labels meet, so rounds grow with the logarithm of a chain.  Each round is written to the shared folder
    and takes the place of the one before."""
    both = scratch.save(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-links")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), f"{name}-labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("least"))
        met = labels.join(near, labels["node"] == near["a"]).select("node", F.least("root", "least").alias("next"), F.col("root").alias("last"))
        jump = labels.select(F.col("node").alias("at"), F.col("root").alias("far"))
        new = met.join(jump, met["next"] == jump["at"], "left").select("node", F.least("next", "far").alias("root"), "last")
        new = scratch.save(new, f"{name}-labels")
        scratch.drop(f"{name}-labels", but_last=True)
        if new.filter("root <> last").isEmpty():
            scratch.drop(f"{name}-links")
            return new.select("node", "root")
        labels = new.select("node", "root")

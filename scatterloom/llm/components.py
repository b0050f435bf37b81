"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import write_and_reread


def components(links: DataFrame) -> DataFrame:
    """``node, label``: every node of ``links`` (columns ``u, v``) with the smallest node that it reaches.

    Each round hooks every node to its smallest neighbour, follows hooks to their roots by doubling, and goes on with links between roots, so
    rounds and doublings grow with the logarithm of the longest path. Tables stay on the cluster and are written to the scratch folder; the driver
    only learns whether a table has rows.
    """
    edges = write_and_reread(links.where("u <> v").select("u", "v").distinct(), "edges")
    label = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = write_and_reread(both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("root")), "hooks")
        if hooks.isEmpty():
            break
        while True:
            above = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            further = hooks.join(above, "root")
            if further.where("root <> next").isEmpty():
                break
            hooks = write_and_reread(further.select("node", F.col("next").alias("root")), "hooks")
        if label is None:
            label = hooks.withColumnRenamed("root", "label")
        else:
            onward = hooks.select(F.col("node").alias("label"), "root")
            label = label.join(onward, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
        to = lambda c: hooks.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        edges = edges.join(to("u"), "u").join(to("v"), "v").select(F.col("u_root").alias("u"), F.col("v_root").alias("v"))
        edges = write_and_reread(edges.where("u <> v").distinct(), "edges")
    return hooks.withColumnRenamed("root", "label") if label is None else write_and_reread(label, "labels")

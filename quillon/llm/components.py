"""Connected components of an edge table, with DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize, workspace


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): label is the smallest node of its component.

    Each round hooks every node to its smallest neighbour, if that is smaller, follows hooks to their
    roots by doubling, and replaces the links by those between different roots; at least half of the
    nodes that still have links become part of another. Every step is written to the shared folder.
    Nodes with many links are reduced by partial aggregation. Self-links and repeated links do no
    harm; an empty table gives no rows.
    """
    spark = links.sparkSession
    at = workspace(spark, "components")
    pairs = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = materialize(pairs.distinct(), f"{at}/edges")
    labels, turn = None, 0
    while labels is None or edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        roots = materialize(hooks.select("node", F.least("node", "near").alias("root")), f"{at}/{turn}/hooks")
        step = 0
        while True:
            step += 1
            above = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
            roots = materialize(roots.join(above, "root").select("node", F.col("above").alias("root"), (F.col("above") < F.col("root")).alias("moved")), f"{at}/{turn}/{step}")
            still = roots.filter("moved").limit(1).count()
            roots = roots.select("node", "root")
            if not still:
                break
        if labels is None:
            labels = roots.select("node", F.col("root").alias("label"))
        else:
            onward = roots.select(F.col("node").alias("label"), F.col("root").alias("next"))
            labels = labels.join(onward, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
        labels = materialize(labels, f"{at}/{turn}/labels")
        of = lambda c, roots=roots: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        lifted = edges.join(of("a"), "a").join(of("b"), "b").filter("a_root <> b_root")
        lifted = lifted.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
        edges = materialize(lifted.distinct(), f"{at}/{turn}/edges")
        turn += 1
    return labels

"""Connected components by minimum-label propagation with contraction.

Every round each node takes the smallest label among itself and its
neighbours, then the label of that label.  The graph is then contracted: edges
are rewritten to labels, and those within one label drop out, so each round
works on what is still undecided only.  Labels are combined on the map side, so
a node with very many edges costs one partial minimum per task.  Each round is
staged; nothing but whether edges are left reaches the driver.  The smallest
node of a component keeps its label in every round, so it names the component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.runtime import drop, stage


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns ``a``, ``b``), label being the smallest node of its component."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a IS NOT NULL AND b IS NOT NULL")
    left, steps = stage(both.distinct()), []
    for _ in range(max_rounds):
        near = stage(left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("near")))
        over = near.select(F.col("node").alias("near"), F.col("near").alias("label"))
        moved = stage(near.join(over, "near").select("node", "label"))
        steps.append(moved)
        at = moved.select(F.col("node").alias("a"), F.col("label").alias("x"))
        to = moved.select(F.col("node").alias("b"), F.col("label").alias("y"))
        rest = stage(left.where("a < b").join(at, "a").join(to, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        drop(left, near)
        if rest.isEmpty():
            drop(rest)
            break
        left = stage(rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        drop(rest)
    else:
        raise RuntimeError(f"labels still move after {max_rounds} rounds")
    out = steps[0]
    for step in steps[1:]:
        out = out.join(step.select(F.col("node").alias("label"), F.col("label").alias("up")), "label", "left").select("node", F.coalesce("up", "label").alias("label"))
    return out

"""Connected components on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolake.session import stored


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)``: the smallest node reachable from each node of ``edges``.

    Every round a node hears the smallest label of its neighbours' labels. It takes that
    or its own label's label, and passes what it heard on to its label, so a whole tree is
    hooked to another at once and long chains of trees shrink geometrically.
    Messages are pre-aggregated with ``min`` before the shuffle and the hub of a star
    is only ever a join key, which AQE splits. Each round is written as Parquet: a
    checkpoint keeps its plan's size, a product of those joined, whose digits double
    each round until the driver has no room for them. Self loops and repeated edges are
    harmless; null end points are ignored. It raises if ``max_rounds`` did not reach the
    fixpoint rather than return partial labels.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    both = stored(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    for _ in range(max_rounds):
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        jumped = labels.join(up, "component").select("node", "component", "above")
        heard = both.join(jumped, both.b == jumped.node).groupBy("a").agg(F.min("above").alias("heard"))
        told = jumped.join(heard, jumped.node == heard.a)
        own = F.struct("node", F.least("above", "heard").alias("label"), F.col("component").alias("was"))
        hook = F.struct(F.col("component").alias("node"), F.col("heard").alias("label"), F.when(F.lit(False), F.col("component")).alias("was"))
        said = told.select(F.inline(F.array(own, hook)))
        lowered = stored(said.groupBy("node").agg(F.min("label").alias("component"), F.max("was").alias("was")), "labels")
        changed = not lowered.where("component <> was").isEmpty()
        labels = lowered.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"labels still change after {max_rounds} rounds")

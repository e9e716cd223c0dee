"""Connected components by contraction, in logarithmically many rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import stored


def components(edges: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """``node, component`` (the smallest node of its component) for every node
    of ``edges`` (``a``, ``b``: long). Loops and repeated edges do no harm.

    Each round hooks every node to its smallest neighbour if that is smaller,
    shortens the resulting forest to its roots by pointer doubling and
    contracts the edges; a node that is no local minimum vanishes, so at least
    half of what is left goes each round. Every round is written to the shared
    folder, so lost executors repeat one round at most; the result reads one
    of the tables named in ``scratch``."""
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges", scratch)
    known = stored(edges.select("a").union(edges.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("component")), "cc-nodes", scratch)
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        hook = stored(hook, "cc-hook", scratch)
        while True:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
            next_hook = stored(hook.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") < F.col("root")).alias("moved")), "cc-hook", scratch)
            hook = next_hook.select("node", "root")
            if next_hook.where("moved").isEmpty():
                break
        to = lambda name: hook.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
        known = stored(
            known.join(to("component"), "component", "left").select("node", F.coalesce("component_root", "component").alias("component")),
            "cc-nodes",
            scratch,
        )
        edges = stored(
            edges.join(to("a"), "a").join(to("b"), "b").where("a_root <> b_root")
            .select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(),
            "cc-edges",
            scratch,
        )
    return known

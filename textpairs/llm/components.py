"""Connected components of an undirected graph, by large-star / small-star rounds.

Every round maps the edge table to an edge table of the same node set whose
edges point closer to each component's smallest node, until nothing changes;
the number of rounds is logarithmic in practice and is not limited. Neighbour
minima are map-side combined aggregates and the way back is a shuffle join, so
a node with very many edges is never collected into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpairs.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
    far = both.filter("dst > src")
    return far.join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("m"))
    rest = (down.join(least, "src").filter("dst <> m")
            .select(F.col("dst").alias("src"), F.col("m").alias("dst")))
    own = least.select("src", F.col("m").alias("dst"))
    return rest.union(own).distinct()


def forget(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files and checkpoints of rounds that nothing refers to any more: it
    acts on the driver's garbage collection, which a loop of small jobs may not cause for a long time."""
    spark.sparkContext._jvm.System.gc()


def connected_components(edges: DataFrame, rounds: int = 1, tidy: bool = False) -> DataFrame:
    """(node, root) for every node that has an edge to another node; root is the
    smallest node of its component. ``edges`` has columns src and dst (orderable,
    no nulls); self-loops and repeats are allowed. ``rounds`` rounds are made
    between two looks at whether the table still changes; ``tidy`` removes the files of each before the next."""
    now = cut_lineage(edges.filter("src <> dst")
                      .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    state = None
    while True:
        new_state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
        if new_state == state or new_state[0] == 0:
            break
        state = new_state
        for _ in range(rounds):
            now = _small_star(_large_star(now))
        now = cut_lineage(now)
        if tidy:
            forget(now.sparkSession)
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(roots)

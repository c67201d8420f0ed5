"""Graph operators on edge tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 40, shrink: int = 1) -> DataFrame:
    """Undirected components: (node, component), component being the smallest node of each.

    Large-star and small-star steps alternate until no edge changes; the number
    of rounds grows with the logarithm of the longest path. Each step is one
    minimum by node and one join with the edges, whose hot keys adaptive
    execution splits. Edges with a null end are left out; a loop makes its node
    a component of its own. shrink divides the partitions of the edges kept
    between rounds, for graphs that are small beside the tables around them.
    """
    parts = max(8, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shrink)
    keep = (lambda x: durable(x.coalesce(parts))) if shrink > 1 else durable
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    loops = e.where("u = v").select("u").distinct()
    e = keep(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def state(x):
        return x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    last = state(e)
    for _ in range(max_rounds):
        if not last[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = keep(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = state(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = loops.join(found.union(roots), F.col("u") == F.col("node"), "left_anti")
    return found.union(roots).union(alone.select(F.col("u").alias("node"), F.col("u").alias("component")))


def label_communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, community) by weighted label propagation on undirected edges (src, dst, weight).

    In each round the half of the nodes that a hash picks takes the heaviest
    label among their neighbours, ties to the smallest; halves alternate, so
    two nodes do not swap labels for ever. A valid partition, with no claim to
    the best modularity. Nodes without edges do not occur.
    """
    both = edges.select("src", "dst", "weight").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    both = durable(both.where("src <> dst").groupBy("src", "dst").agg(F.max("weight").alias("weight")))
    labels = durable(both.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node")))
    for r in range(rounds):
        votes = both.join(labels, both["dst"] == labels["node"]).groupBy("src", "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("src").agg(F.max(F.struct(F.round("w", 9).alias("w"), (-F.col("community")).alias("c"))).alias("b"))
        best = best.select(F.col("src").alias("node"), (-F.col("b.c")).alias("new"))
        turn = F.pmod(F.xxhash64("node", F.lit(r // 2)), F.lit(2)) == r % 2
        moved = labels.join(best, "node", "left").withColumn("new", F.when(turn, F.coalesce("new", "community")).otherwise(F.col("community")))
        moved = durable(moved)
        changed = moved.where("new <> community").limit(1).count()
        labels = moved.select("node", F.col("new").alias("community"))
        if not changed and r % 2:
            break
    return labels


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Modularity of a partition (node, community) of undirected edges (src, dst, weight), each given once."""
    c = labels
    e = edges.join(c.select(F.col("node").alias("src"), F.col("community").alias("cs")), "src").join(c.select(F.col("node").alias("dst"), F.col("community").alias("cd")), "dst")
    total = e.agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("cs") == F.col("cd"), F.col("weight")).otherwise(0.0)).alias("inside"))
    ends = e.select(F.col("cs").alias("c"), "weight").union(e.select(F.col("cd").alias("c"), "weight")).groupBy("c").agg(F.sum("weight").alias("k"))
    squares = ends.agg(F.sum(F.col("k") * F.col("k")).alias("kk"))
    return total.join(F.broadcast(squares)).select((F.col("inside") / F.col("m") - F.col("kk") / (4 * F.col("m") * F.col("m"))).alias("modularity"))

"""Communities of weighted graphs by modularity with a resolution, several runs at a time."""

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import durable, release


def _by_run(values: dict[int, float]) -> Column:
    """The value of each row's run; runs are few."""
    out = F.lit(0.0)
    for run, v in values.items():
        out = F.when(F.col("run") == run, F.lit(float(v))).otherwise(out)
    return out


def _start(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of edges (run, src, dst, weight) given both ways: these with the weight k of src, and (run, node, k, community) of nodes alone."""
    degree = edges.groupBy("run", "src").agg(F.sum("weight").alias("k"))
    e = durable(edges.join(degree, ["run", "src"]))
    nodes = e.where("src = dst").select("run", F.col("src").alias("node"), "k")
    return e, durable(nodes.withColumn("community", F.col("node")))


def _moves(e: DataFrame, labels: DataFrame, factor: Column, rounds: int, graph: dict) -> tuple[DataFrame, set]:
    """Local moves: labels after them, and the runs in which a node moved.

    A node weighs its own community and those of its neighbours; the part of
    the nodes that a hash picks moves at once, ties stay, then go to the
    smaller community. Only edges of nodes that may move are read. They get the
    community of dst with its total in one join, and all that a node weighs
    then meets in one shuffle by node. factor is resolution over total weight by run;
    runs of a graph end together after two rounds without a move.
    """
    ever, still = set(), dict.fromkeys(graph.values(), 0)
    for r in range(rounds):
        runs = [run for run in sorted(graph) if still[graph[run]] < 2]
        if not runs:
            break
        turn = lambda node: F.col("run").isin(runs) & (F.pmod(F.xxhash64(node, F.lit(r // 2)), F.lit(2)) == r % 2)
        total = labels.groupBy("run", "community").agg(F.sum("k").alias("total"))
        there = labels.where(F.col("run").isin(runs)).join(total, ["run", "community"]).select("run", F.col("node").alias("dst"), "community", "total")
        own = F.col("src") == F.col("dst")
        near = e.where(turn("src")).join(there, ["run", "dst"])
        near = near.select("run", F.col("src").alias("node"), "community", F.when(own, 0.0).otherwise(F.col("weight")).alias("w"), "k", "total", own.alias("own"))
        options = near.repartition("run", "node").groupBy("run", "node", "community").agg(F.sum("w").alias("w"), F.max("k").alias("k"), F.max("total").alias("total"), F.max("own").alias("own"))
        rest = F.col("total") - F.when(F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - factor * F.col("k") * rest, 9)
        choice = F.struct(gain.alias("g"), "own", (-F.col("community")).alias("c"))
        best = options.groupBy("run", "node").agg(F.max(choice).alias("b"), F.max("k").alias("k"), F.max(F.when(F.col("own"), F.col("community"))).alias("old"))
        best = best.select("run", "node", "k", (-F.col("b.c")).alias("community"), "old")
        moved, seen = best.unionByName(labels.where(~turn("node")).withColumn("old", F.col("community"))), Observation()
        moved = moved.observe(seen, *[F.max((F.col("run") == run) & (F.col("community") != F.col("old"))).alias(str(run)) for run in runs]).drop("old")
        labels = durable(moved, replaces=(labels,))
        changed = {run for run in runs if seen.get[str(run)]}
        ever |= changed
        for g in {graph[run] for run in runs}:
            still[g] = 0 if any(graph[run] == g for run in changed) else still[g] + 1
    return labels, ever


def _quality(e: DataFrame, resolutions: dict) -> dict[int, float]:
    inside = F.sum(F.when(F.col("src") == F.col("dst"), F.col("weight")).otherwise(0.0))
    by = e.groupBy("run", "src").agg(F.sum("weight").alias("k"), inside.alias("i"))
    by = by.groupBy("run").agg(F.sum("k").alias("m"), F.sum("i").alias("i"), F.sum(F.col("k") * F.col("k")).alias("kk")).collect()
    return {r["run"]: r["i"] / r["m"] - resolutions[r["run"]] * r["kk"] / r["m"] ** 2 for r in by if r["m"]}


def louvain_runs(edges: DataFrame, resolutions: dict[int, float], rounds: int = 16, levels: int = 10, graph: dict[int, int] | None = None) -> DataFrame:
    """(run, node, community) by moves that raise modularity, then contraction, level by level.

    Edges (run, src, dst, weight) are undirected, each given once; nodes are
    integers; each run has a resolution, and all runs advance in the same
    jobs. A level that does not raise a run's modularity is dropped and ends it,
    so the result is a valid partition, though not that of a serial order
    of moves. graph numbers the graph of each run (one, if not given): what it
    gives for a graph is the same, whichever others advance beside it. A round
    is a join of the edges of half the nodes, and a sum by node.
    """
    graph = graph or dict.fromkeys(resolutions, 0)
    e = edges.where("src is not null and dst is not null").select("run", "src", "dst", F.col("weight").cast("double").alias("weight"))
    e = e.unionByName(e.select("run", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    e = e.unionByName(e.select("run", "src", F.col("src").alias("dst"), F.lit(0.0).alias("weight")))  # each node meets itself
    e, labels = _start(e.groupBy("run", "src", "dst").agg(F.sum("weight").alias("weight")))
    part = durable(labels.select("run", "node", "community"))
    weight = {r["run"]: r["m"] for r in e.groupBy("run").agg(F.sum("weight").alias("m")).collect()}
    factor = _by_run({run: resolutions[run] / m if m else 0.0 for run, m in weight.items()})
    last = _quality(e, resolutions)
    for _ in range(levels if last else 0):
        labels, moved = _moves(e, labels, factor, rounds, {run: graph[run] for run in last})
        if not moved:
            break
        to = [labels.select("run", F.col("node").alias(end), F.col("community").alias(f"c{end}")) for end in ("src", "dst")]
        smaller = e.join(to[0], ["run", "src"]).join(to[1], ["run", "dst"])
        smaller = durable(smaller.groupBy("run", F.col("csrc").alias("src"), F.col("cdst").alias("dst")).agg(F.sum("weight").alias("weight")))
        now = _quality(smaller, resolutions)
        better = [run for run in sorted(moved) if now[run] > last[run] + 1e-9]
        if not better:
            break
        up = labels.where(F.col("run").isin(better)).select("run", F.col("node").alias("community"), F.col("community").alias("above"))
        part = durable(part.join(up, ["run", "community"], "left").select("run", "node", F.coalesce("above", "community").alias("community")), replaces=(part,))
        release(e, labels)
        last = {run: now[run] for run in better}
        e, labels = _start(smaller.where(F.col("run").isin(better)))
        release(smaller)
    return part


def louvain_communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 16, levels: int = 10) -> DataFrame:
    """(node, community) of one graph of edges (src, dst, weight) at one resolution; see louvain_runs."""
    return louvain_runs(edges.withColumn("run", F.lit(0)), {0: resolution}, rounds, levels).select("node", "community")


def communities_at(edges: DataFrame, resolutions: tuple) -> DataFrame:
    """(run, node, community) of one graph at several resolutions, run being the place of the resolution."""
    return communities_of((edges,), resolutions).drop("graph")


def communities_of(graphs: tuple, resolutions: tuple) -> DataFrame:
    """(graph, run, node, community) of several graphs at several resolutions, all in the same jobs; both are counted from 0."""
    n, edges = len(resolutions), None
    for number, e in enumerate(graphs):
        first = n * number
        e = e.select("src", "dst", "weight", F.explode(F.sequence(F.lit(first), F.lit(first + n - 1))).alias("run"))
        edges = e if edges is None else edges.unionByName(e)
    runs = range(n * len(graphs))
    part = louvain_runs(edges, {run: resolutions[run % n] for run in runs}, graph={run: run // n for run in runs})
    return part.select(F.floor(F.col("run") / n).cast("int").alias("graph"), (F.col("run") % n).alias("run"), "node", "community")

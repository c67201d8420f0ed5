"""Statistics of the spatial graph of each well, on edges (plate_id, well_id, src, dst, dist)."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import durable
from . import permutations, tiles
from .joins import K
from .permutations import code_rows, pair_counts


def degree(nodes: DataFrame, edges: DataFrame, key=K, id_col: str = "label") -> DataFrame:
    """(key, id, degree) with 0 for nodes without edges."""
    n = edges.groupBy(*key, F.col("src").alias(id_col)).agg(F.count("*").alias("degree"))
    return nodes.select(*key, id_col).join(n, [*key, id_col], "left").na.fill(0, ["degree"])


def degree_stats(nodes: DataFrame, edges: DataFrame, group: str | None = None, key=K, id_col: str = "label") -> DataFrame:
    """Mean and population deviation of the degree by well, or by well and group."""
    d = degree(nodes, edges, key, id_col)
    if group:
        d = d.join(nodes.select(*key, id_col, group), [*key, id_col])
    return d.groupBy(*key, *([group] if group else [])).agg(F.avg("degree").alias("mean_degree"), F.stddev_pop("degree").alias("std_degree"))


def with_groups(edges: DataFrame, nodes: DataFrame, group: str, key=K, id_col: str = "label") -> DataFrame:
    """Edges with the groups of both ends as src_group and dst_group."""
    g = nodes.select(*key, id_col, group)
    for end in ("src", "dst"):
        edges = edges.join(g.select(*key, F.col(id_col).alias(end), F.col(group).alias(f"{end}_group")), [*key, end])
    return edges


def interaction_matrix(edges: DataFrame, nodes: DataFrame, group: str = "leiden", normalized: bool = False, key=K, id_col: str = "label") -> DataFrame:
    """Edge counts between groups by well, and their share of the row if normalized."""
    n = with_groups(edges, nodes, group, key, id_col).groupBy(*key, "src_group", "dst_group").agg(F.count("*").alias("n"))
    if normalized:
        n = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*key, "src_group")))
    return n


def message_passing(nodes: DataFrame, edges: DataFrame, features: list[str], key=K, id_col: str = "label") -> DataFrame:
    """Mean of each feature over a node and its neighbours; a node alone keeps its own values."""
    own = nodes.select(*key, id_col, *features)
    near = edges.select(*key, F.col("src").alias("_to"), F.col("dst").alias(id_col)).join(own, [*key, id_col]).drop(id_col)
    both = near.withColumnRenamed("_to", id_col).unionByName(own)
    return both.groupBy(*key, id_col).agg(*[F.avg(f).alias(f"{f}_msg") for f in features])


def group_degree_centrality(nodes: DataFrame, edges: DataFrame, group: str = "leiden", key=K, id_col: str = "label") -> DataFrame:
    """Share of the nodes outside a group that touch it; null if none is outside."""
    touched = with_groups(edges, nodes, group, key, id_col).where("src_group <> dst_group")
    touched = touched.groupBy(*key, F.col("src_group").alias(group)).agg(F.countDistinct("dst").alias("touched"))
    sizes = nodes.groupBy(*key, group).agg(F.count("*").alias("n"))
    outside = F.sum("n").over(Window.partitionBy(*key)) - F.col("n")
    out = sizes.withColumn("outside", outside).join(touched, [*key, group], "left").na.fill(0, ["touched"])
    return out.select(*key, group, F.when(F.col("outside") > 0, F.col("touched") / F.col("outside")).alias("centrality"))


def average_clustering(nodes: DataFrame, edges: DataFrame, group: str = "leiden", key=K, id_col: str = "label") -> DataFrame:
    """Mean local clustering coefficient by group; nodes of degree under 2 count 0."""
    e = edges.select(*key, "src", "dst")
    wedge = e.alias("a").join(e.select(*key, F.col("src").alias("s2"), F.col("dst").alias("d2")).alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key] + [F.col("a.src") == F.col("b.s2"), F.col("a.dst") < F.col("b.d2")])
    wedge = wedge.select(*[F.col(f"a.{k}").alias(k) for k in key], F.col("a.src").alias(id_col), F.col("a.dst").alias("src"), F.col("d2").alias("dst"))
    closed = wedge.join(e, [*key, "src", "dst"]).groupBy(*key, id_col).agg(F.count("*").alias("t"))
    d = degree(nodes, edges, key, id_col).join(closed, [*key, id_col], "left").na.fill(0, ["t"])
    c = F.when(F.col("degree") > 1, 2.0 * F.col("t") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0)
    return d.withColumn("c", c).join(nodes.select(*key, id_col, group), [*key, id_col]).groupBy(*key, group).agg(F.avg("c").alias("clustering"))


def morans_i(nodes: DataFrame, edges: DataFrame, feature: str, key=K, id_col: str = "label") -> DataFrame:
    """Moran's I of a feature with weights that sum to 1 by row; 0 without edges or variance."""
    mean = nodes.groupBy(*key).agg(F.avg(feature).alias("m"), F.count("*").alias("n"))
    z = nodes.select(*key, id_col, feature).join(mean, list(key)).withColumn("z", F.col(feature) - F.col("m"))
    ss = z.groupBy(*key, "n").agg(F.sum(F.col("z") * F.col("z")).alias("ss"))
    near = edges.join(z.select(*key, F.col(id_col).alias("dst"), F.col("z").alias("zd")), [*key, "dst"])
    lag = near.groupBy(*key, "src").agg(F.avg("zd").alias("lag"))
    cross = lag.join(z.select(*key, F.col(id_col).alias("src"), "z"), [*key, "src"]).groupBy(*key).agg(F.sum(F.col("z") * F.col("lag")).alias("num"), F.count("*").alias("w"))
    i = F.when((F.col("ss") > 0) & F.col("w").isNotNull(), F.col("n") / F.col("w") * F.col("num") / F.col("ss")).otherwise(0.0)
    return ss.join(cross, list(key), "left").select(*key, i.alias("moran_i"))


def morans_i_groups(nodes: DataFrame, edges: DataFrame, group: str = "leiden", key=K, id_col: str = "label") -> DataFrame:
    """(key, group, moran_i) of the membership of every group of a well; weights sum to 1 by row; 0 without edges or variance.

    Memberships are 0 or 1, so sums over nodes need only counts: of nodes by
    group, and of edges by the groups of both ends. No node is spelled out for each group.
    """
    key = list(key)
    n = nodes.groupBy(*key, group).agg(F.count("*").alias("ng")).withColumn("n", F.sum("ng").over(Window.partitionBy(*key)))
    p = F.col("ng") / F.col("n")
    deg = edges.groupBy(*key, "src").agg(F.count("*").alias("deg"))
    e = with_groups(edges.select(*key, "src", "dst"), nodes, group, key, id_col).join(deg, [*key, "src"])
    lag = e.groupBy(*key, F.col("dst_group").alias(group)).agg(F.sum(1 / F.col("deg")).alias("lag"), F.sum(F.when(F.col("src_group") == F.col("dst_group"), 1 / F.col("deg"))).alias("both"))
    own = deg.join(nodes.select(*key, F.col(id_col).alias("src"), group), [*key, "src"])
    w = own.groupBy(*key, group).agg(F.count("*").alias("wg")).withColumn("w", F.sum("wg").over(Window.partitionBy(*key)))
    w = n.select(*key).distinct().join(w, key).groupBy(*key).agg(F.max("w").alias("w")), w.drop("w")
    j = n.join(lag, [*key, group], "left").join(w[1], [*key, group], "left").join(w[0], key, "left").na.fill(0, ["lag", "both", "wg"])
    num = F.col("both") - p * F.col("lag") - p * F.col("wg") + p * p * F.col("w")
    ss = F.col("ng") * (1 - p)
    return j.select(*key, group, F.when((ss > 0) & F.col("w").isNotNull(), F.col("n") / F.col("w") * num / ss).otherwise(0.0).alias("moran_i"))


def _pairs(names, found: dict, size: int, schema: pa.Schema):
    """Batches (names.., rank, a, b, counts) of counts by name as pair_counts gives them, without pairs that never meet."""
    for name, counts in found.items():
        r, pair = np.nonzero(counts.any(axis=2))
        if len(r):
            columns = [pa.array([v] * len(r), f.type) for v, f in zip(name, schema)]
            columns += [pa.array(r + 1, pa.int32()), pa.array(pair // size, pa.int32()), pa.array(pair % size, pa.int32()), pa.array(list(counts[r, pair]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _edge_pairs(labelled: DataFrame, edges: DataFrame, key: list, id_col: str, size: int, ranks: int) -> DataFrame:
    """(key, part, rank, a, b, counts) of edges (key, src, dst, rank) under the codes of each permutation, one partial row a task."""
    names = [*key, "part"]
    ends = [labelled.select(*names, F.col(id_col).alias(end), F.col("codes").alias(c)) for end, c in (("src", "ca"), ("dst", "cb"))]
    both = edges.join(ends[0], [*key, "src"]).join(ends[1], [*names, "dst"]).select(*names, "rank", "ca", "cb")
    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in both.select(*names).schema], "rank int, a int, b int, counts array<long>"])
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {}
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            spot, heads = np.zeros(len(rows), dtype=np.int64), rows.select(names)
            for c in names:
                at = heads.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
                spot = spot * len(at.dictionary) + at.indices.to_numpy()
            _, first, spot = np.unique(spot, return_index=True, return_inverse=True)
            for g, head in enumerate(first.tolist()):
                label, some = tuple(heads.slice(head, 1).to_pylist()[0].values()), rows.take(pa.array(np.flatnonzero(spot == g)))
                n = pair_counts(code_rows(some.column("ca"), size), code_rows(some.column("cb"), size), size, some.column("rank").to_numpy() - 1, ranks)
                found[label] = n + found[label] if label in found else n
        yield from _pairs(names, found, size, schema)

    return both.mapInArrow(run, ddl)


def _tile_pairs(labelled: DataFrame, points: DataFrame, radii: tuple, cols, key: list, id_col: str, size: int) -> DataFrame:
    """The same of neighbours within radii, which are the ranks; a tile counts where it finds them."""
    names, limits = [*key, "part"], np.array(radii, dtype=float) ** 2
    rows = labelled.join(points.select(*key, id_col, *cols), [*key, id_col])

    def work(tile, schema):
        codes, found = code_rows(tile.rows.column("s_codes"), size), 0
        gather, held = [], 0
        for rows, near, d2, hit in tile.blocks():
            i, j = np.nonzero(hit)
            gather.append((rows[i], near[j], np.searchsorted(limits, d2[i, j])))
            held += len(i)
            if held > 1 << 16:
                i, j, r = (np.concatenate(x) for x in zip(*gather))
                found, gather, held = found + pair_counts(codes[i], codes[j], size, r, len(limits)), [], 0
        if held:
            i, j, r = (np.concatenate(x) for x in zip(*gather))
            found = found + pair_counts(codes[i], codes[j], size, r, len(limits))
        if isinstance(found, np.ndarray):
            yield from _pairs(names, {tuple(tile.rows.column(c)[0].as_py() for c in names): found}, size, schema)

    dealt = tiles._dealt(rows, None, float(max(radii)), cols, names, id_col, shared=["codes"])
    return tiles._run(dealt, tiles._kinds(rows, *names), "rank int, a int, b int, counts array<long>", work, float(max(radii)), len(cols))


def _enrichment(nodes: DataFrame, group: str, n_perms: int, seed: int, key: list, id_col: str, batch: int | None, rows: int, ranks: int, count) -> DataFrame:
    """(key, src_group, dst_group, k, n, z) from count(labelled, size), which gives pairs by rank for nodes with permuted codes."""
    groups = durable(nodes.select(*[F.col(c).alias(c) for c in (*key, group)]).distinct())
    codes = durable(groups.select(group).distinct().where(F.col(group).isNotNull()).select(group, (F.row_number().over(Window.orderBy(group)) - 1).alias("code")))  # one row a group
    size = codes.count() + 1  # the last is null
    nodes = nodes.select(*[F.col(c).alias(c) for c in (*key, id_col, group)]).join(codes, group, "left")
    nodes = durable(nodes.select(*key, id_col, F.coalesce("code", F.lit(size - 1)).alias("code")))
    wells = nodes.select(*key).distinct().count()
    batch = batch or min(n_perms, max(100, LABELS // max(rows, 1)))
    parts = min(-(-batch // TOGETHER), max(1, TASKS // max(wells, 1)))
    pair, sums = [*key, "a", "b", "k"], None
    for lo in range(1, n_perms + 1, batch):
        found = count(permutations.permuted(nodes, key, id_col, seed, lo, min(lo + batch - 1, n_perms), parts, size), size)
        found = found.select(*key, "a", "b", "rank", "part", F.posexplode("counts").alias("p", "n"))
        found = found.where((F.col("p") > 0) | (F.col("part") == 0)) if lo == 1 else found.where("p > 0")
        found = found.groupBy(*key, "a", "b", "rank", "part", "p").agg(F.sum("n").alias("n"))
        found = found.withColumn("k", F.explode(F.sequence(F.col("rank"), F.lit(ranks)))).groupBy(*pair, "part", "p").agg(F.sum("n").alias("n"))
        n, real = F.col("n").cast("double"), F.col("p") > 0
        part = found.groupBy(*pair).agg(F.sum(F.when(~real, F.col("n"))).alias("n"), F.sum(F.when(real, n)).alias("total"), F.sum(F.when(real, n * n)).alias("squares"))
        if sums is not None:
            part = part.unionByName(sums).groupBy(*pair).agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])
        sums = durable(part, replaces=() if sums is None else (sums,))
    for end, c in (("src_group", "a"), ("dst_group", "b")):
        sums = sums.join(codes.select(F.col(group).alias(end), F.col("code").alias(c)), c).drop(c)
    grid = groups.withColumnRenamed(group, "src_group").join(groups.withColumnRenamed(group, "dst_group"), key).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(ranks))))
    out = grid.join(sums, [*key, "src_group", "dst_group", "k"], "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    mean, sq = none(F.col("total")) / n_perms, none(F.col("squares")) / n_perms
    sd = F.sqrt(F.greatest(sq - mean * mean, F.lit(0.0)))
    return out.select(*key, "src_group", "dst_group", "k", none(F.col("n")).alias("n"), F.when(sd > 0, (none(F.col("n")) - mean) / sd).alias("z"))


#: Labels of a batch of permutations, over all nodes or edges, where 100 permutations are fewer; tasks that they are dealt over, and permutations of one.
LABELS, TASKS, TOGETHER = 200_000_000, 24, 25


def nhood_enrichment(
    nodes: DataFrame, edges: DataFrame, group: str = "leiden", n_perms: int = 1000, seed: int = 0, key=K, id_col: str = "label", batch: int | None = None, nested: int | None = None
) -> DataFrame:
    """z-scores of edge counts between groups against labels permuted within the well.

    Every ordered pair of groups of a well gets a row, with n = 0 where no edge
    joins them: that is the strongest avoidance. Permutations order nodes by a
    hash of (seed, permutation, id), so results do not depend on partitioning.
    They run batch by batch: a node carries its labels under all permutations of
    a batch as one value, an edge is joined once, and only counts by pair leave a
    task. z is null where all permutations agree.

    nested = m takes edges with a rank and gives the scores of m nested graphs,
    k = 1..m, of the edges up to rank k, from the same permutations.
    """
    key, ranks = list(key), nested or 1
    e = durable(edges.where(F.col("rank") <= nested).select(*key, "src", "dst", F.col("rank").cast("int").alias("rank")) if nested else edges.select(*key, "src", "dst", F.lit(1).alias("rank")))
    out = _enrichment(nodes, group, n_perms, seed, key, id_col, batch, e.count(), ranks, lambda labelled, size: _edge_pairs(labelled, e, key, id_col, size, ranks))
    return out if nested else out.drop("k")


def nhood_enrichment_within(
    points: DataFrame, radii: tuple, group: str = "leiden", n_perms: int = 1000, seed: int = 0, cols=("x", "y", "z"), key=K, id_col: str = "label", batch: int | None = None
) -> DataFrame:
    """(key, src_group, dst_group, k, n, z): nhood_enrichment of the neighbours within each of the ascending radii, k being its place from 1; no edge is stored."""
    key = list(key)
    points = durable(points.select(*[F.col(c).alias(c) for c in dict.fromkeys((*key, id_col, group, *cols))]))
    return _enrichment(points, group, n_perms, seed, key, id_col, batch, points.count(), len(radii), lambda labelled, size: _tile_pairs(labelled, points, radii, cols, key, id_col, size))


def group_closeness(nodes: DataFrame, edges: DataFrame, group: str = "leiden", key=K, id_col: str = "label") -> DataFrame:
    """Nodes outside a group over the sum of their hops to it; only reachable nodes add hops."""
    e = edges.select(*key, "src", "dst")
    seen = durable(nodes.select(*key, F.col(group), F.col(id_col).alias("node"), F.lit(0).alias("hops")))
    frontier, hop = seen, 0
    while True:
        hop += 1
        step = frontier.withColumnRenamed("node", "src").drop("hops").join(e, [*key, "src"]).select(*key, group, F.col("dst").alias("node")).distinct()
        frontier = durable(step.join(seen, [*key, group, "node"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = durable(seen.unionByName(frontier))
    far = seen.groupBy(*key, group).agg(F.sum("hops").alias("hops"))
    sizes = nodes.groupBy(*key, group).agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("outside", F.sum("n").over(Window.partitionBy(*key)) - F.col("n"))
    return far.join(sizes, [*key, group]).select(*key, group, F.when(F.col("hops") > 0, F.col("outside") / F.col("hops")).alias("closeness"))


def edge_angle():
    """Angle in degrees from the columns src_x, src_y, dst_x, dst_y."""
    return F.degrees(F.atan2(F.col("dst_y") - F.col("src_y"), F.col("dst_x") - F.col("src_x")))


def edge_angles(edges: DataFrame, nodes: DataFrame, key=K, id_col: str = "label") -> DataFrame:
    """Angle of each edge in degrees."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(*key, F.col(id_col).alias(end), F.col("x").alias(f"x_{end}"), F.col("y").alias(f"y_{end}")), [*key, end])
    edges = edges.withColumnsRenamed({f"{c}_{end}": f"{end}_{c}" for c in "xy" for end in ("src", "dst")})
    return edges.select(*key, "src", "dst", edge_angle().alias("angle"))


def kernel_distance(nodes: DataFrame, passed: DataFrame, features: list[str], metric: str = "euclidean", key=K, id_col: str = "label") -> DataFrame:
    """Distance of each node's own vector from its message-passed one; cosine is null for a zero vector."""
    return vector_distance(nodes.select(*key, id_col, *features).join(passed, [*key, id_col]), features, metric, key, id_col)


def vector_distance(j: DataFrame, features: list[str], metric: str = "euclidean", key=K, id_col: str = "label") -> DataFrame:
    """Distance of features from {f}_msg of the same row; cosine is null for a zero vector."""
    own, msg = [F.col(f).cast("double") for f in features], [F.col(f"{f}_msg") for f in features]
    add = lambda xs: sum(xs[1:], xs[0])
    if metric == "euclidean":
        d = F.sqrt(add([(a - b) * (a - b) for a, b in zip(own, msg)]))
    else:
        norms = F.sqrt(add([a * a for a in own])) * F.sqrt(add([b * b for b in msg]))
        d = F.when(norms > 0, 1 - add([a * b for a, b in zip(own, msg)]) / norms)
    return j.select(*key, id_col, d.alias("distance"))

"""All spatial statistics of a well as one table of features."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from . import spatial, tiles
from .geometry import convex_hulls
from .joins import K


def well_features(
    nodes: DataFrame, edges: DataFrame | None, radii: tuple = (25, 50, 100, 150), features: tuple = (), modality: str = "cells", hull_radius: float = 100.0, hull_degree: int = 5,
    n_perms: int = 100, group: str = "leiden", key=K, id_col: str = "label", enrichment: bool = True,
) -> DataFrame:
    """(key, feature, value) of every well of two groups or more; what a well lacks is 0.

    edges (key, src, dst, dist) reach to the largest radius and are read again
    for each smaller one, not joined anew. Without edges neighbours are asked for
    tile by tile, and none are stored. At each radius: edges between
    groups, degree overall and by group, centrality, closeness and clustering by
    group, Moran's I of features and of groups, and enrichment. The hull is that of
    points of more than hull_degree neighbours within hull_radius, zero if
    under four remain or they are flat. Names are {modality}_stat_{name}_{radius};
    counts are {modality}_{group}, and cell_count.
    """
    key = list(key)
    sizes = nodes.groupBy(*key, group).agg(F.count("*").alias("n"))
    wells = durable(sizes.groupBy(*key).agg(F.count("*").alias("groups"), F.sum("n").alias("n")).where("groups > 1"))
    nodes = durable(nodes.join(wells.select(*key), key, "left_semi").select(*{c: 0 for c in (*key, id_col, group, "x", "y", "z", *features)}))
    edges = edges.join(wells.select(*key), key, "left_semi") if edges is not None else None
    scores = durable(spatial.nhood_enrichment_within(nodes, tuple(sorted(radii)), group, n_perms, key=key, id_col=id_col)) if edges is None and enrichment else None

    def named(df, value, *parts, radius=None):
        name = F.concat_ws("_", F.lit(f"{modality}_stat"), *parts, *([F.lit(str(radius))] if radius is not None else []))
        return df.select(*key, name.alias("feature"), F.col(value).cast("double").alias("value"))

    out = [
        wells.select(*key, F.lit("cell_count").alias("feature"), F.col("n").cast("double").alias("value")),
        sizes.join(wells.select(*key), key, "left_semi").select(*key, F.concat_ws("_", F.lit(modality), group).alias("feature"), F.col("n").cast("double").alias("value")),
    ]
    for r in radii:
        pair, one = ("src_group", "dst_group"), (group,)
        if edges is None:
            near = lambda fn, *more, **names: getattr(tiles, fn)(nodes, float(r), *more, key=key, **names)  # noqa: E731, B023
        else:
            e = durable(edges.where(F.col("dist") <= r).select(*key, "src", "dst"))
            first = lambda fn: (e, nodes) if fn == "interaction_matrix" else (nodes, e)  # noqa: E731, B023
            near = lambda fn, *more, **names: getattr(spatial, fn)(*first(fn), *more, key=key, id_col=id_col)  # noqa: E731, B023
        if enrichment:  # its counts hold all pairs, also those without edges
            z = scores.where(F.col("k") == sorted(radii).index(r) + 1) if edges is None else durable(spatial.nhood_enrichment(nodes, e, group, n_perms, key=key, id_col=id_col))
            out += [named(z, "n", F.lit("interaction"), *pair, radius=r), named(z, "z", F.lit("enrichment"), *pair, radius=r)]
        else:
            out.append(named(near("interaction_matrix", group), "n", F.lit("interaction"), *pair, radius=r))
        whole = near("degree_stats", None)
        by = near("degree_stats", group)
        for c in ("mean_degree", "std_degree"):
            out += [named(whole, c, F.lit(c), radius=r), named(by, c, F.lit(c), *one, radius=r)]
        out.append(named(near("group_degree_centrality", group), "centrality", F.lit("centrality"), *one, radius=r))
        out.append(named(near("group_closeness", group, id_col=id_col), "closeness", F.lit("closeness"), *one, radius=r))
        out.append(named(near("average_clustering", group, id_col=id_col), "clustering", F.lit("clustering"), *one, radius=r))
        out.append(named(near("morans_i_groups", group), "moran_i", F.lit("morans_i"), *one, radius=r))
        out += [named(near("morans_i", f, id_col=id_col), "moran_i", F.lit(f"morans_i_{f}"), radius=r) for f in features]
    if edges is None:
        core = tiles.crowded(nodes, hull_radius, hull_degree + 1, key=key, id_col=id_col)
    else:
        core = spatial.degree(nodes, edges.where(F.col("dist") <= hull_radius), key, id_col).where(F.col("degree") > hull_degree)
        core = nodes.join(core.select(*key, id_col), [*key, id_col], "left_semi")
    hull = convex_hulls(core, key)
    hull = hull.withColumn("density", F.when(F.col("volume") > 0, F.col("n_points") / F.col("volume")))
    out += [named(hull, c, F.lit(f"hull_{c}")) for c in ("volume", "area", "density")]
    found = durable(reduce(lambda a, b: a.unionByName(b), out))
    names = sorted(r["feature"] for r in found.select("feature").distinct().collect())
    grid = wells.select(*key, F.explode(F.array(*map(F.lit, names))).alias("feature"))
    return grid.join(found, [*key, "feature"], "left").select(*key, "feature", F.coalesce("value", F.lit(0.0)).alias("value"))

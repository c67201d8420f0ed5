"""Shape of wells: hulls, planes, lines, drift."""

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..session import durable
from . import tiles
from .tiles import K

PIXEL_MM = 0.322 / 1000


#: Directions, spread evenly over the sphere by the golden angle, whose farthest points make a first, inner hull.
_STEPS = np.arange(48) + 0.5
_HEIGHT, _TURN = 1 - 2 * _STEPS / 48, np.pi * (1 + 5**0.5) * _STEPS
DIRECTIONS = np.stack([np.sqrt(1 - _HEIGHT**2) * np.cos(_TURN), np.sqrt(1 - _HEIGHT**2) * np.sin(_TURN), _HEIGHT], axis=1)


def hull_faces(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Corners [m, 3, 3] of the faces of the convex hull of 3-D points, their outward unit normals, and an inner point; None for flat sets.

    Built from a tetrahedron: the farthest point outside replaces the faces that it sees.
    """
    p = np.unique(np.asarray(p, dtype=float), axis=0)
    if len(p) < 4:
        return None
    middle = p.mean(axis=0)
    p = p - middle
    eps = 1e-9 * max(np.abs(p).max(), 1e-300)
    i = int(p[:, 0].argmin())
    j = int(((p - p[i]) ** 2).sum(axis=1).argmax())
    d = p[j] - p[i]
    far = np.linalg.norm(np.cross(p - p[i], d), axis=1) / max(np.linalg.norm(d), 1e-300)
    k = int(far.argmax())
    if far[k] <= eps:
        return None
    n = np.cross(d, p[k] - p[i])
    h = (p - p[i]) @ n / np.linalg.norm(n)
    m = int(np.abs(h).argmax())
    if abs(h[m]) <= eps:
        return None
    inner = p[[i, j, k, m]].mean(axis=0)

    def face(a, b, c):
        n = np.cross(p[b] - p[a], p[c] - p[a])
        if n @ (p[a] - inner) < 0:
            b, c, n = c, b, -n
        return (a, b, c), n / max(np.linalg.norm(n), 1e-300)

    faces = dict(face(*t) for t in itertools.combinations((i, j, k, m), 3))
    rest = p
    while True:
        tri, normals = np.array(list(faces)), np.array(list(faces.values()))
        level = (normals * p[tri[:, 0]]).sum(axis=1)
        over = (rest @ normals.T - level).max(axis=1)
        rest = rest[over > eps]
        if not len(rest):
            break
        top = rest[over[over > eps].argmax()]
        q = int(np.flatnonzero((p == top).all(axis=1))[0])
        seen = [tuple(f) for f in tri[normals @ top - level > eps].tolist()]
        edges = {(f[x], f[(x + 1) % 3]) for f in seen for x in range(3)}
        for f in seen:
            del faces[f]
        for x, y in edges:
            if (y, x) not in edges:
                f, normal = face(x, y, q)
                faces[f] = normal
    return p[tri] + middle, normals, inner + middle


def hull_volume_area(p: np.ndarray) -> tuple[float, float]:
    """Volume and surface of the convex hull of 3-D points; zeros for flat sets."""
    found = hull_faces(p)
    if found is None:
        return 0.0, 0.0
    corners, _, inner = found
    a, b, c = corners[:, 0], corners[:, 1], corners[:, 2]
    cross = np.cross(b - a, c - a)
    return float(np.abs(((a - inner) * cross).sum(axis=1)).sum() / 6), float(np.linalg.norm(cross, axis=1).sum() / 2)


@F.pandas_udf(ArrayType(ArrayType(DoubleType())))
def _planes(ends: pd.Series) -> pd.Series:
    """Planes (normal, level) of the hull of a group's far points, a little inside it; null if these are flat."""
    out = []
    for e in ends:
        p = np.array([[v["x"], v["y"], v["z"]] for v in e if v is not None], dtype=float).reshape(-1, 3)
        found = hull_faces(p)
        if found is None:
            out.append(None)
            continue
        corners, normals, _ = found
        level = (normals * corners[:, 0]).sum(axis=1) - 1e-9 * np.ptp(p, axis=0).max()
        out.append(np.column_stack([normals, level]).tolist())
    return pd.Series(out, dtype=object)


def extreme_points(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points of each group that can lie on its hull.

    The farthest point along each of 48 directions comes from one partial
    aggregate. What is strictly inside the hull of these is inside the group's
    hull and goes; of the rest only the ends in z of every (x, y) stay.
    """
    at = F.struct(*[F.col(c).cast("double").alias(c) for c in "xyz"])
    ends = [F.max_by(at, F.col("x") * u + F.col("y") * v + F.col("z") * w) for u, v, w in DIRECTIONS.tolist()]
    planes = points.groupBy(*keys).agg(F.array(*ends).alias("e")).select(*keys, _planes("e").alias("planes"))
    outside = F.exists("planes", lambda n: F.col("x") * n[0] + F.col("y") * n[1] + F.col("z") * n[2] > n[3])
    near = points.select(*keys, "x", "y", "z").join(planes, keys).where(F.col("planes").isNull() | outside)
    return near.groupBy(*keys, "x", "y").agg(F.array_distinct(F.array(F.min("z"), F.max("z"))).alias("zs")).select(*keys, "x", "y", F.explode("zs").alias("z"))


def convex_hulls(points: DataFrame, keys: list[str], scale: float = PIXEL_MM) -> DataFrame:
    """(keys, volume, area, n_points) of each group's hull, scaled from pixels; zero for flat or tiny groups.

    A task gets the points of a group that lie outside the hull of its
    extremes, a small shell of it.
    """
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}

    def run(key, pdf):
        v, a = hull_volume_area(pdf[["x", "y", "z"]].to_numpy())
        return pd.DataFrame([(*key, v * scale**3, a * scale**2)])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", volume double, area double"
    out = extreme_points(points.dropna(subset=["x", "y", "z"]), keys).groupBy(*keys).applyInPandas(run, schema)
    return points.groupBy(*keys).agg(F.count("*").alias("n_points")).join(out, keys, "left").na.fill(0.0, ["volume", "area"])


def component_stats(
    nuclei: DataFrame, clusters: list, radius: float = 100.0, min_degree: int = 3, min_nodes: int = 10, group: str = "leiden", key=K, id_col: str = "label"
) -> DataFrame:
    """Connected components of the points of some clusters of each well: size, centroid, hull, in millimetres.

    Points with fewer than min_degree neighbours within radius go, once; a well
    with min_nodes or fewer left has no rows. Components of min_nodes or more
    count, but for those that are flat. center_distance is from the mean of all
    the well's points.
    """
    key = list(key)
    points = nuclei.where(F.col(group).isin(clusters)).select(*key, id_col, *"xyz")
    core = tiles.crowded(points, radius, min_degree, key=key, id_col=id_col)
    enough = core.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > min_nodes).select(*key)
    core = durable(core.join(enough, key, "left_semi"))
    part = tiles.components(core, radius, key=key, id_col=id_col)
    p = core.join(part, [*key, id_col])
    by = [*key, "component"]
    sizes = p.groupBy(*by).agg(F.count("*").alias("n_pts"), *[(F.avg(c) * PIXEL_MM).alias(f"c{c}") for c in "xyz"]).where(F.col("n_pts") >= min_nodes)
    center = nuclei.groupBy(*key).agg(*[(F.avg(c) * PIXEL_MM).alias(f"m{c}") for c in "xyz"])
    gap = [F.col(f"c{c}") - F.col(f"m{c}") for c in "xyz"]
    out = sizes.join(center, key).withColumn("center_distance", F.sqrt(sum((g * g for g in gap), F.lit(0.0)))).drop("mx", "my", "mz")
    hull = convex_hulls(p.join(sizes.select(*by), by, "left_semi"), by).drop("n_points")
    return out.join(hull, by).where("volume > 0").withColumn("volume_per_point", F.col("volume") / F.col("n_pts"))


def drift(df: DataFrame, keys: list[str], step: str, limit: float = 100.0) -> DataFrame:
    """By step: mean, deviation, least and most distance of labels from their place at step 1, under limit."""
    first = df.where(F.col(step) == 1).select(*keys, *[F.col(c).alias(f"{c}0") for c in "xyz"])
    d = [F.col(c) - F.col(f"{c}0") for c in "xyz"]
    far = df.join(first, keys).withColumn("dist", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).where(F.col("dist") < limit)
    return far.groupBy(step).agg(F.avg("dist").alias("mean"), F.stddev_samp("dist").alias("std"), F.min("dist").alias("min"), F.max("dist").alias("max"), F.count("*").alias("n"))


def line_fit_distance(points: DataFrame, key=K) -> DataFrame:
    """Mean distance of a group's points to their best line, 0 for under two points.

    The line runs along the main axis of the covariance, a 3 x 3 matrix for each group.
    """
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    m = points.groupBy(*key).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyz"], *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs])

    @F.pandas_udf(ArrayType(DoubleType()))
    def axis(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.Series:
        out = []
        for a, b, c, d, e, f in zip(xx, xy, xz, yy, yz, zz):
            out.append(np.linalg.eigh(np.array([[a, b, c], [b, d, e], [c, e, f]]))[1][:, -1].tolist())
        return pd.Series(out)

    m = m.withColumn("axis", axis(*[f"c{a}{b}" for a, b in pairs])).select(*key, "n", "mx", "my", "mz", "axis")
    d = [F.col(c) - F.col(f"m{c}") for c in "xyz"]
    along = sum((d[i] * F.col("axis")[i] for i in range(3)), F.lit(0.0))
    off = F.sqrt(F.greatest(d[0] * d[0] + d[1] * d[1] + d[2] * d[2] - along * along, F.lit(0.0)))
    return points.join(m, list(key)).groupBy(*key).agg(F.when(F.max("n") >= 2, F.avg(off)).otherwise(0.0).alias("distance"))


def plane_detected(points: DataFrame, key=K) -> DataFrame:
    """True if a coordinate has one value in the whole group."""
    return points.groupBy(*key).agg(F.least(*[F.count_distinct(c) for c in "xyz"]).alias("_n")).select(*key, (F.col("_n") == 1).alias("plane_detected"))


def registration_qc(links: DataFrame, source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Matched labels, labels of both cycles and (c1 + c3) / (2 matched); null without matches."""
    n = links.groupBy(*keys).agg(F.count("*").alias("matched"))
    a = source.groupBy(*keys).agg(F.countDistinct("label").alias("c1"))
    b = target.groupBy(*keys).agg(F.countDistinct("label").alias("c3"))
    out = a.join(b, keys, "full_outer").join(n, keys, "left").na.fill(0, ["matched", "c1", "c3"])
    return out.withColumn("score", F.when(F.col("matched") > 0, (F.col("c1") + F.col("c3")) / (2 * F.col("matched"))))

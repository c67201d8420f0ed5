"""Spatial joins within a well: radius, k nearest, nearest link."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from . import tiles

K = ("plate_id", "well_id")


def _distance(cols, left: str, right: str) -> Column:
    parts = [(F.col(f"{left}.{c}") - F.col(f"{right}.{c}")) * (F.col(f"{left}.{c}") - F.col(f"{right}.{c}")) for c in cols]
    return reduce(lambda a, b: a + b, parts)


#: Points that a task hashes at most, on average; more points take more partitions.
BUILD_ROWS = 2_000_000


def _meet(a: DataFrame, b: DataFrame, names: list[str], rows: int | None) -> DataFrame:
    """Inner join of a and b (named so) on all of names.

    The key is one 64-bit hash and names are compared where it agrees; b is hashed
    by partition, which spares the sort of both sides. Partitions are as many as
    hold BUILD_ROWS rows of b each (rows of it, counted where not given).
    """
    rows = b.count() if rows is None else rows
    parts = -(-rows // BUILD_ROWS)
    a, b = (x.withColumn("spot", F.xxhash64(*names)) for x in (a, b))
    if parts > int(b.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        a, b = a.repartition(parts, "spot"), b.repartition(parts, "spot")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in names])
    return a.alias("a").join(b.hint("shuffle_hash").alias("b"), F.col("a.spot") == F.col("b.spot")).where(same)


def radius_join(
    left: DataFrame, right: DataFrame, radius: float, cols=("x", "y", "z"), key=K, id_col: str = "label", strict: bool = False, rows: int | None = None
) -> DataFrame:
    """Pairs of rows of left and right of one group within radius: (key, src, dst, dist).

    Space is cut into cells as wide as the radius; each left row looks into its
    own and the neighbouring cells by an equi join, so no group is compared
    with itself whole. Rows with a null coordinate pair with nothing. rows is
    the number of rows of right, counted if not given.
    """
    cells = [F.floor(F.col(c) / radius).alias(f"cell_{c}") for c in cols]
    base = [*key, id_col, *cols]
    a = left.select(*base, *cells)
    for c in cols:
        around = F.array(*[F.col(f"cell_{c}") + d for d in (-1, 0, 1)])
        a = a.withColumn(f"cell_{c}", F.explode(around))
    names = [*key, *[f"cell_{c}" for c in cols]]
    d2 = _distance(cols, "a", "b")
    joined = _meet(a, right.select(*base, *cells), names, rows).where(d2 < radius * radius if strict else d2 <= radius * radius)
    return joined.select(*[F.col(f"a.{k}").alias(k) for k in key], F.col(f"a.{id_col}").alias("src"), F.col(f"b.{id_col}").alias("dst"), F.sqrt(d2).alias("dist"))


def radius_neighbors(points: DataFrame, radius: float, cols=("x", "y", "z"), key=K, id_col: str = "label") -> DataFrame:
    """All ordered pairs of different points of a group within radius: (key, src, dst, dist)."""
    return tiles.edges(points, radius, cols, key, id_col)


def knn(edges: DataFrame, k: int, key=K) -> DataFrame:
    """The k nearest of each src among candidate edges, ranked from 1; ties go to the smaller dst."""
    w = Window.partitionBy(*key, "src").orderBy("dist", "dst")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_points(points: DataFrame, k: int, radius: float, cols=("x", "y", "z"), key=K, id_col: str = "label") -> DataFrame:
    """The k nearest other points of each point in its group: (key, src, dst, dist, rank); ties go to the smaller dst.

    Points with k neighbours within radius are done, since these are the nearest;
    the others look again within twice the radius, until they have k or have met
    their whole group. A group of k points or fewer gives what it has. The radius
    given should hold a few points. Points with a null coordinate take no part.
    """
    points = durable(points.select(*key, id_col, *cols).dropna(subset=list(cols)))
    sizes = points.groupBy(*key).agg(F.count("*").alias("_n"))
    todo, found = points.join(sizes, list(key)).where("_n > 1"), None
    while not todo.isEmpty():
        near = durable(tiles.nearest(todo, points, k, radius, cols, key, id_col, apart=True))
        have = near.groupBy(*key, F.col("src").alias(id_col)).agg(F.count("*").alias("_have"))
        done = todo.join(have, [*key, id_col]).where(F.col("_have") >= F.least(F.lit(k), F.col("_n") - 1)).select(*key, id_col)
        near = durable(near.join(done.withColumnRenamed(id_col, "src"), [*key, "src"], "left_semi"))
        found = near if found is None else found.unionByName(near)
        todo = durable(todo.join(near.select(*key, F.col("src").alias(id_col)).distinct(), [*key, id_col], "left_anti"))
        radius *= 2
    empty = points.select(*key, F.col(id_col).alias("src"), F.col(id_col).alias("dst"), F.lit(0.0).alias("dist"), F.lit(1).alias("rank")).limit(0)
    return empty if found is None else found


def nearest_link(source: DataFrame, target: DataFrame, max_distance: float, cols=("x", "y", "z"), key=("well_id",), id_col: str = "label") -> DataFrame:
    """For each row of the smaller side of a group the nearest of the other within max_distance, exclusive.

    Returns distinct (key, source, target, dist). Several rows may share a partner.
    """
    n = source.groupBy(*key).agg(F.count("*").alias("n_source")).join(target.groupBy(*key).agg(F.count("*").alias("n_target")), list(key))
    n = durable(n.select(*key, (F.col("n_source") <= F.col("n_target")).alias("by_source")))
    a, b = (df.select(*key, id_col, *cols).join(n, list(key)) for df in (source, target))
    me, other = a.where("by_source").unionByName(b.where("not by_source")), b.where("by_source").unionByName(a.where("not by_source"))
    best = tiles.nearest(me, other, 1, max_distance, cols, [*key, "by_source"], id_col, strict=True)
    ends = (F.when(F.col("by_source"), F.col(x)).otherwise(F.col(y)).alias(name) for x, y, name in (("src", "dst", "source"), ("dst", "src", "target")))
    return best.select(*key, *ends, "dist").distinct()


def fold_left_joins(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Left joins of all frames on keys; value columns that clash get the suffix of their place."""
    out = frames[0]
    for i, f in enumerate(frames[1:], 1):
        clash = [c for c in f.columns if c in out.columns and c not in keys]
        out = out.join(f.withColumnsRenamed({c: f"{c}_{i}" for c in clash}), keys, "left")
    return out


def matrix_product(left: DataFrame, right: DataFrame, inner: str, value: str = "value") -> DataFrame:
    """Product of two matrices in long form (row.., inner, value) and (inner, column.., value)."""
    names = [c for c in left.columns if c not in (inner, value)] + [c for c in right.columns if c not in (inner, value)]
    joined = left.withColumnRenamed(value, "_a").join(right.withColumnRenamed(value, "_b"), inner)
    return joined.groupBy(*names).agg(F.sum(F.col("_a") * F.col("_b")).alias(value))

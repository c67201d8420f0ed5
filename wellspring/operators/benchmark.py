"""Scores of a latent space: against positions, labels and batches."""

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..session import durable
from .embedding import clustering_agreement, vector_knn
from .communities import communities_at, communities_of
from .mixing import lisi
from .spatial import nhood_enrichment


def graph_similarities(a: DataFrame, b: DataFrame, max_k: int, n: int) -> DataFrame:
    """(k, gcs) for k = 1..max_k from two neighbour tables (src, dst, rank) of n rows, joined once."""
    j = a.select("src", "dst", F.col("rank").alias("ra")).join(b.select("src", "dst", F.col("rank").alias("rb")), ["src", "dst"], "full_outer")
    far = F.lit(max_k + 1)
    j = j.select(F.coalesce("ra", far).alias("ra"), F.coalesce("rb", far).alias("rb"))
    one = j.groupBy("ra", "rb").agg(F.count("*").alias("n")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(max_k))))
    differ = F.when((F.col("ra") <= F.col("k")) != (F.col("rb") <= F.col("k")), F.col("n")).otherwise(0)
    return one.groupBy("k").agg(F.sum(differ).alias("d")).select("k", (1 - F.col("d") / (2.0 * F.col("k") * n)).alias("gcs"))


def enrichment_similarity(latent: DataFrame, spatial: DataFrame) -> DataFrame:
    """1 - atan(|difference| / pairs) / (pi / 2) of two tables (src_group, dst_group, z); pairs without a z in either are left out."""
    j = latent.select("src_group", "dst_group", F.col("z").alias("a")).join(spatial.select("src_group", "dst_group", F.col("z").alias("b")), ["src_group", "dst_group"])
    d = j.where("a is not null and b is not null").agg(F.sqrt(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")))).alias("d"), F.count("*").alias("n"))
    return d.select((1 - F.atan(F.col("d") / F.col("n")) / (math.pi / 2)).alias("cas"))


def mean_enrichment_similarity(latent: DataFrame, spatial: DataFrame) -> DataFrame:
    """Mean over k of enrichment_similarity of two tables (k, src_group, dst_group, z)."""
    j = latent.select("k", "src_group", "dst_group", F.col("z").alias("a")).join(spatial.select("k", "src_group", "dst_group", F.col("z").alias("b")), ["k", "src_group", "dst_group"])
    by = j.where("a is not null and b is not null").groupBy("k").agg(F.sqrt(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")))).alias("d"), F.count("*").alias("n"))
    return by.agg(F.avg(1 - F.atan(F.col("d") / F.col("n")) / (math.pi / 2)).alias("avg_cas"))


_SMALL = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 256)))))


def log_factorial(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of x! for whole numbers: a table below 256, Stirling's series above."""
    x = np.asarray(x, dtype=float)
    y = np.maximum(x, 256)
    series = y * np.log(y) - y + 0.5 * np.log(2 * np.pi * y) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return np.where(x < 256, _SMALL[np.minimum(x, 255).astype(int)], series)


#: Tasks that pairs of cluster sizes are dealt over, and counts that a task holds at a time.
PAIR_TASKS, PAIR_COUNTS = 48, 1 << 19


def expected_information(x: np.ndarray, y: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The share of each pair of cluster sizes in the expected mutual information of random clusterings of t things.

    Counts are hypergeometric; those so far from the mode that they weigh
    nothing in a double are left out, so the work follows the root of the sizes.
    """
    x, y, t = (np.asarray(v, dtype=float) for v in (x, y, t))
    mode = np.floor((x + 1) * (y + 1) / (t + 2))
    wide = np.ceil(10 * np.sqrt(x * y * (t - x) * (t - y) / (t * t * np.maximum(t - 1, 1)))) + 60
    low = np.maximum(np.maximum(1, x + y - t), mode - wide)
    size = np.maximum(np.minimum(np.minimum(x, y), mode + wide) - low + 1, 0).astype(np.int64)
    fixed = sum(log_factorial(v) for v in (x, y, t - x, t - y)) - log_factorial(t)
    out, ends, lo = np.zeros(len(x)), np.cumsum(size), 0
    while lo < len(x):
        hi = max(int(np.searchsorted(ends, ends[lo] - size[lo] + PAIR_COUNTS, "right")), lo + 1)
        own = np.repeat(np.arange(lo, hi), size[lo:hi])
        n = low[own] + np.arange(len(own)) - (ends[own] - size[own] - (ends[lo] - size[lo]))
        a, b, all_ = x[own], y[own], t[own]
        p = np.exp(fixed[own] - log_factorial(n) - log_factorial(a - n) - log_factorial(b - n) - log_factorial(all_ - a - b + n))
        out[lo:hi] = np.bincount(own - lo, weights=n / all_ * np.log(all_ * n / (a * b)) * p, minlength=hi - lo)
        lo = hi
    return out


@F.pandas_udf(DoubleType())
def _expected_information(a: pd.Series, b: pd.Series, total: pd.Series) -> pd.Series:
    return pd.Series(expected_information(a, b, total), dtype=float)


def adjusted_mutual_information(df: DataFrame, a: str, b: str, key: tuple = ()) -> DataFrame:
    """(key, ami): mutual information less its expectation, over the mean entropy less that expectation; 1 if both have one cluster.

    The expectation needs the sizes of clusters only; pairs of equal sizes are
    computed once, at most about sqrt(2 n) sizes a side and key.
    """
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    key = [*key] or ["_all"]
    c = (known if key != ["_all"] else known.withColumn("_all", F.lit(0))).groupBy(*key, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    c = durable(c)
    total = c.groupBy(*key).agg(F.sum("n").alias("t"))
    sides = {x: c.groupBy(*key, x).agg(F.sum("n").alias(f"n{x}")).join(total, key) for x in "ab"}
    t = F.col("t").cast("double")
    mi = c.join(sides["a"], [*key, "a"]).join(sides["b"].drop("t"), [*key, "b"])
    mi = mi.groupBy(*key).agg(F.sum(F.col("n") / t * F.log(F.col("n") * t / (F.col("na") * F.col("nb")))).alias("mi"))
    h = [s.groupBy(*key).agg((-F.sum(F.col(f"n{x}") / t * F.log(F.col(f"n{x}") / t))).alias(f"h{x}")) for x, s in sides.items()]
    sizes = [s.groupBy(*key, "t", f"n{x}").agg(F.count("*").alias(f"k{x}")) for x, s in sides.items()]
    pairs = sizes[0].join(sizes[1].drop("t"), key).repartition(PAIR_TASKS, *key, "na", "nb")  # few bytes, much work
    e = pairs.groupBy(*key).agg(F.sum(F.col("ka") * F.col("kb") * _expected_information("na", "nb", "t")).alias("e"))
    mean = (F.col("ha") + F.col("hb")) / 2
    value = F.when(F.abs(mean - F.col("e")) > 1e-12, (F.col("mi") - F.col("e")) / (mean - F.col("e"))).otherwise(1.0)
    return mi.join(h[0], key).join(h[1], key).join(e, key).select(*key, value.alias("ami")).drop("_all")


def silhouettes(df: DataFrame, id_col: str, vector: str, label: str, key: tuple = ()) -> DataFrame:
    """(key, id, label, silhouette) by squared Euclidean distance, within key.

    Sums over a cluster come from its size, vector sum and sum of squares, so the
    work is rows times clusters and no rows are paired. 0 for clusters of one and
    where there is no other cluster; rows with a null vector or label are left out.
    """
    rows = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(*key, id_col, F.col(label).alias("own"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.withColumn("sq", F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    size = rows.groupBy(*key, "own").agg(F.count("*").alias("n"), F.sum("sq").alias("q"))
    sums = rows.select(*key, "own", F.posexplode("v").alias("i", "x")).groupBy(*key, "own", "i").agg(F.sum("x").alias("s"))
    sums = sums.groupBy(*key, "own").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("s"))
    one = size.join(sums, [*key, "own"]).withColumnRenamed("own", "other")
    each = one.groupBy(*key).agg(F.collect_list(F.struct("other", "n", "q", "s")).alias("clusters"))
    j = rows.join(each, list(key)) if key else rows.crossJoin(each)  # one row a key
    dot = lambda c: F.aggregate(F.zip_with("v", c["s"], lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    far = lambda c: F.greatest(c["n"] * F.col("sq") - 2 * dot(c) + c["q"], F.lit(0.0))
    j = j.select(*key, id_col, "own", F.transform("clusters", lambda c: F.struct(c["other"].alias("other"), c["n"].alias("n"), far(c).alias("d"))).alias("c"))
    mine = F.filter("c", lambda c: c["other"] == F.col("own"))[0]
    b = F.array_min(F.transform(F.filter("c", lambda c: c["other"] != F.col("own")), lambda c: c["d"] / c["n"]))
    a = F.when(mine["n"] > 1, mine["d"] / (mine["n"] - 1))
    s = F.when(F.greatest(a, b) > 0, (b - a) / F.greatest(a, b))
    return j.select(*key, id_col, F.col("own").alias(label), F.coalesce(F.when(a.isNotNull() & b.isNotNull(), s), F.lit(0.0)).alias("silhouette"))


def label_silhouette(df: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """Mean silhouette of labels, scaled to 0..1."""
    return silhouettes(df, id_col, vector, label).agg(((F.avg("silhouette") + 1) / 2).alias("casw"))


def batch_silhouette(df: DataFrame, id_col: str, vector: str, label: str, batch: str) -> DataFrame:
    """Mean over labels of 1 - |silhouette of batches within the label|; labels of one batch are left out."""
    s = silhouettes(df, id_col, vector, batch, (label,))
    by = s.groupBy(label).agg(F.avg(1 - F.abs("silhouette")).alias("m"), F.countDistinct(batch).alias("b")).where("b > 1")
    return by.agg(F.avg("m").alias("basw"))


def rescaled_lisi(lisi: DataFrame, n: int, integration: bool) -> DataFrame:
    """Median LISI of n labels in 0..1: high where batches mix (integration), or where labels stay apart."""
    m = F.expr("percentile(lisi, 0.5)")
    span = max(n - 1, 1)
    return lisi.agg(((m - 1) / span if integration else (n - m) / span).alias("score"))


def variance_explained(df: DataFrame, vector: str, batch: str) -> DataFrame:
    """Share of a vector's variance between batches.

    This is the mean of R squared over all principal components weighted by their
    variances, which does not depend on the rotation, so none is computed.
    """
    long = df.where(F.col(batch).isNotNull()).select(F.col(batch).alias("b"), F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    g = long.groupBy("i", "b").agg(F.count("*").alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("*")).alias("ss"))
    t = g.groupBy("i").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"), F.sum("ss").alias("within"))
    s = g.join(t, "i").groupBy("i").agg(F.sum(F.col("n") * (F.col("m") - F.col("gm")) * (F.col("m") - F.col("gm"))).alias("between"), F.any_value("within").alias("within"))
    total = F.sum(F.col("between") + F.col("within"))
    return s.agg(F.when(total > 0, F.sum("between") / total).otherwise(0.0).alias("explained"))


def pc_regression(df: DataFrame, before: str, after: str, batch: str) -> DataFrame:
    """1 less the ratio of variance explained by batch after and before, at least 0."""
    pre, post = variance_explained(df, before, batch), variance_explained(df, after, batch).withColumnRenamed("explained", "post")
    r = F.when(F.col("explained") > 0, F.greatest((F.col("explained") - F.col("post")) / F.col("explained"), F.lit(0.0))).otherwise(0.0)
    return pre.crossJoin(post).select(r.alias("pcr"))  # one row each


def kmeans_agreement(df: DataFrame, vector: str, label: str, k: int, seed: int = 0) -> DataFrame:
    """Agreement (nmi, ari) of k-means clusters of the vectors with labels."""
    v = df.select(F.col(label).alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    return clustering_agreement(KMeans(k=k, seed=seed, featuresCol="v", predictionCol="cluster").fit(v).transform(v).select("label", "cluster"), "cluster", "label")


def benchmark_samples(df: DataFrame, sample: str, id_col: str, position: str, latent: str, label: str, batch: str, max_k: int = 14, n_perms: int = 200, perplexity: float = 10.0) -> DataFrame:
    """(sample, metric, value) for every sample and metric; null where a sample is too small or uniform for it.

    Each sample is scored by itself, all in the same jobs: one stored table of
    neighbours by sample for the latent vectors and one for positions, of which
    metrics take the ranks that they need. Samples are given as text.
    """
    rows = durable(df.select(F.col(sample).cast("string").alias("sample"), F.col(id_col).cast("long").alias("id"), F.col(position).alias("pos"), F.col(latent).alias("latent"), F.col(label).alias("label"), F.col(batch).alias("batch")).where("sample is not null"))
    near = {c: durable(vector_knn(rows, rows, 3 * int(perplexity), "id", c, group="sample")) for c in ("pos", "latent")}
    size = rows.groupBy("sample").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"), F.count_distinct("batch").alias("batches"))
    a, b = (near[c].where(F.col("rank") <= max_k).select("sample", "src", "dst", F.col("rank").alias(f"r_{c}")) for c in ("latent", "pos"))
    far = F.lit(max_k + 1)
    j = a.join(b, ["sample", "src", "dst"], "full_outer").select("sample", F.coalesce("r_latent", far).alias("ra"), F.coalesce("r_pos", far).alias("rb"))
    one = j.groupBy("sample", "ra", "rb").agg(F.count("*").alias("m")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(max_k))))
    differ = F.when((F.col("ra") <= F.col("k")) != (F.col("rb") <= F.col("k")), F.col("m")).otherwise(0)
    gcs = one.groupBy("sample", "k").agg(F.sum(differ).alias("d")).join(size.where(F.col("n") > max_k), "sample").select("sample", "k", (1 - F.col("d") / (2.0 * F.col("k") * F.col("n"))).alias("g"))
    z = {c: nhood_enrichment(rows, near[c].where(F.col("rank") <= max_k), "label", n_perms, key=("sample",), id_col="id", nested=max_k) for c in near}
    pair = ["sample", "k", "src_group", "dst_group"]
    both = z["latent"].select(*pair, F.col("z").alias("a")).join(z["pos"].select(*pair, F.col("z").alias("b")), pair).where("a is not null and b is not null")
    both = both.groupBy("sample", "k").agg(F.sqrt(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")))).alias("d"), F.count("*").alias("m"))
    cas = durable(both.select("sample", "k", (1 - F.atan(F.col("d") / F.col("m")) / (math.pi / 2)).alias("c")))
    own = silhouettes(rows, "id", "latent", "label", ("sample",)).groupBy("sample").agg(((F.avg("silhouette") + 1) / 2).alias("v"))
    mixed = silhouettes(rows, "id", "latent", "batch", ("sample", "label"))
    mixed = mixed.groupBy("sample", "label").agg(F.avg(1 - F.abs("silhouette")).alias("m"), F.count_distinct("batch").alias("b")).where("b > 1").groupBy("sample").agg(F.avg("m").alias("v"))

    def rescaled(column, count, integration):
        x = lisi(near["latent"], rows, "id", column, perplexity).join(rows.select("id", "sample"), "id").groupBy("sample").agg(F.expr("percentile(lisi, 0.5)").alias("m"))
        x, m, n = x.join(size, "sample"), F.col("m"), F.col(count)
        return x.select("sample", F.when(n > 1, (m - 1) / (n - 1) if integration else (n - m) / (n - 1)).alias("v"))

    parts = {
        "gcs": gcs.where(F.col("k") == max_k).select("sample", F.col("g").alias("v")), "avg_gcs": gcs.groupBy("sample").agg(F.avg("g").alias("v")),
        "cas": cas.where(F.col("k") == max_k).select("sample", F.col("c").alias("v")), "avg_cas": cas.groupBy("sample").agg(F.avg("c").alias("v")),
        "casw": own.join(size.where("labels > 1").select("sample"), "sample", "left_semi"), "basw": mixed, "clisi": rescaled("label", "labels", False), "blisi": rescaled("batch", "batches", True),
    }
    found = None
    for name, part in parts.items():
        part = part.select("sample", F.lit(name).alias("metric"), F.col("v").cast("double").alias("value"))
        found = part if found is None else found.unionByName(part)
    grid = size.select("sample", F.explode(F.array(*map(F.lit, parts))).alias("metric"))
    return grid.join(found, ["sample", "metric"], "left")


@F.pandas_udf(ArrayType(DoubleType()))
def _fuzzy_weights(dist: pd.Series) -> pd.Series:
    """Weights exp(-(d - rho) / sigma) of sorted distances, sigma such that they sum to log2 of their number."""
    out = []
    for row in dist:
        d = np.asarray(row, dtype=float)
        rho, target = (d[d > 0].min() if (d > 0).any() else 0.0), math.log2(max(len(d), 2))
        low, high, sigma = 0.0, math.inf, 1.0
        for _ in range(64):
            total = np.exp(-np.maximum(d - rho, 0) / sigma).sum()
            if abs(total - target) < 1e-5:
                break
            if total > target:
                high, sigma = sigma, (low + sigma) / 2
            else:
                low, sigma = sigma, sigma * 2 if math.isinf(high) else (sigma + high) / 2
        sigma = max(sigma, 1e-3 * (d.mean() or 1.0))
        out.append(np.exp(-np.maximum(d - rho, 0) / sigma))
    return pd.Series(out)


def fuzzy_connectivities(knn: DataFrame) -> DataFrame:
    """(src, dst, weight) from neighbours (src, dst, dist): local weights w, made symmetric by w + w' - w w'."""
    near = knn.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dist", "dst"))).alias("near"))
    near = near.select("src", "near", _fuzzy_weights(F.transform("near", lambda x: x["dist"])).alias("w"))
    w = near.select("src", F.explode(F.arrays_zip(F.transform("near", lambda x: x["dst"]).alias("dst"), "w")).alias("e")).select("src", F.col("e.dst").alias("dst"), F.col("e.w").alias("w"))
    both = w.unionByName(w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    miss = F.coalesce(F.product(1 - F.col("w")), F.lit(1.0))
    return both.groupBy("src", "dst").agg((1 - miss).alias("weight"))


def community_silhouette(df: DataFrame, id_col: str, vector: str, edges: DataFrame, resolutions: tuple) -> DataFrame:
    """Mean over resolutions of the label silhouette of communities of edges (src, dst, weight), found in the same jobs."""
    part = communities_at(edges, resolutions).withColumnRenamed("node", id_col)
    s = silhouettes(df.join(part, id_col), id_col, vector, "community", ("run",))
    return s.groupBy("run").agg(((F.avg("silhouette") + 1) / 2).alias("casw")).agg(F.avg("casw").alias("nasw"))


def community_information(latent: DataFrame, spatial: DataFrame, resolutions: tuple) -> DataFrame:
    """Largest adjusted mutual information of communities of two graphs over all pairs of resolutions."""
    part = communities_of((latent, spatial), resolutions)
    a, b = (part.where(F.col("graph") == number).select("node", F.col("run").alias(f"r{x}"), F.col("community").alias(x)) for number, x in enumerate("ab"))
    return adjusted_mutual_information(a.join(b, "node"), "a", "b", ("ra", "rb")).agg(F.max("ami").alias("mlami"))

"""How well labels and batches mix among nearest neighbours, and linear discriminants."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import cdf
from .embedding import vector_knn


def inverse_simpsons(dist: np.ndarray, label: np.ndarray, perplexity: float, steps: int = 60) -> np.ndarray:
    """Effective number of labels among the neighbours of each row, weighted to a given perplexity; both are [rows, neighbours]."""
    target = np.log(min(perplexity, dist.shape[1]))
    near = dist - dist.min(axis=1, keepdims=True)
    low, high, beta = np.zeros(len(near)), np.full(len(near), np.inf), np.ones(len(near))
    p, todo = np.empty_like(near), np.arange(len(near))
    for _ in range(steps):
        w = np.exp(-near[todo] * beta[todo, None])
        p[todo] = w = w / w.sum(axis=1, keepdims=True)
        h = -(w * np.log(np.where(w > 0, w, 1.0))).sum(axis=1)
        off = ~(np.abs(h - target) < 1e-6)
        todo, wide = todo[off], h[off] > target
        up, down = todo[wide], todo[~wide]
        low[up], high[down] = beta[up], beta[down]
        beta[up] = np.where(np.isinf(high[up]), beta[up] * 2, (beta[up] + high[up]) / 2)
        beta[down] = (beta[down] + low[down]) / 2
        if not len(todo):
            break
    same = sum(np.where(label == label[:, [i]], p, 0.0).sum(axis=1) * p[:, i] for i in range(p.shape[1]))
    return 1 / same


def lisi(knn: DataFrame, labels: DataFrame, id_col: str, label: str, perplexity: float = 30.0) -> DataFrame:
    """(id, lisi) from neighbours (src, dst, dist); each row gathers its k neighbours only."""

    @F.pandas_udf(DoubleType())
    def score(dist: pd.Series, label: pd.Series) -> pd.Series:
        out, size = np.empty(len(dist)), dist.map(len).to_numpy()
        for k in np.unique(size):  # rows of one number of neighbours at a time
            at = np.flatnonzero(size == k)
            names = pd.factorize(np.concatenate(label.iloc[at].to_numpy()), use_na_sentinel=False)[0]
            out[at] = inverse_simpsons(np.stack(dist.iloc[at].to_numpy()), names.reshape(-1, k), perplexity)
        return pd.Series(out)

    near = knn.join(labels.select(F.col(id_col).alias("dst"), F.col(label).cast("string").alias("label")), "dst")
    sets = near.groupBy(F.col("src").alias(id_col)).agg(F.sort_array(F.collect_list(F.struct("dist", "label"))).alias("near"))
    return sets.select(id_col, score("near.dist", "near.label").alias("lisi"))


def clisis(latent: DataFrame, spatial: DataFrame, id_col: str, n_types: int) -> DataFrame:
    """1 less the median of |log2 ratio| of two LISI tables over log2 of the number of types."""
    r = latent.join(spatial.withColumnRenamed("lisi", "other"), id_col)
    d = F.abs(F.log2(F.col("lisi") / F.col("other")) / float(np.log2(max(n_types, 2))))
    return r.select(d.alias("d")).agg((1 - F.expr("percentile(d, 0.5)")).alias("clisis"))


def kbet(knn: DataFrame, batches: DataFrame, id_col: str, batch: str) -> DataFrame:
    """(id, chi2, p): batch counts among neighbours against the shares of all rows."""
    share = batches.groupBy(F.col(batch).alias("b")).agg(F.count("*").alias("n"))
    total = batches.count()
    seen = knn.join(batches.select(F.col(id_col).alias("dst"), F.col(batch).alias("b")), "dst").groupBy("src", "b").agg(F.count("*").alias("o"))
    k = seen.groupBy("src").agg(F.sum("o").alias("k"))
    grid = k.join(F.broadcast(share.withColumn("share", F.col("n") / total)))
    e = F.col("k") * F.col("share")
    o = F.coalesce("o", F.lit(0))
    out = grid.join(seen, ["src", "b"], "left").groupBy(F.col("src").alias(id_col)).agg(F.sum((o - e) * (o - e) / e).alias("chi2"), (F.count("*") - 1).cast("double").alias("df"))
    return out.withColumn("p", cdf.chi2_sf("chi2", "df"))


def kbet_by_label(df: DataFrame, id_col: str, vector: str, label: str, batch: str, k: int = 15, alpha: float = 0.05) -> DataFrame:
    """(label, chi2, accepted): within each label, the mean statistic of its rows' k nearest and the share of rows whose batches pass the test.

    Neighbours and expected shares are of the label alone; labels are given as
    text; a label of one batch or one row has no row.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"), F.col(label).cast("string").alias("label"), F.col(batch).alias("b")).where("label is not null and b is not null")
    near = vector_knn(rows, rows, k, "id", "v", group="label")
    share = rows.groupBy("label", "b").agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy("label")))
    share = share.withColumn("batches", F.count("*").over(Window.partitionBy("label"))).where("batches > 1").select("label", "b", (F.col("n") / F.col("all")).alias("share"))
    seen = near.join(rows.select(F.col("id").alias("dst"), "b"), "dst").groupBy("label", "src", "b").agg(F.count("*").alias("o"))
    grid = seen.groupBy("label", "src").agg(F.sum("o").alias("k")).join(share, "label")
    e, o = F.col("k") * F.col("share"), F.coalesce("o", F.lit(0))
    out = grid.join(seen, ["label", "src", "b"], "left").groupBy("label", "src").agg(F.sum((o - e) * (o - e) / e).alias("chi2"), (F.count("*") - 1).cast("double").alias("df"))
    out = out.withColumn("p", cdf.chi2_sf("chi2", "df"))
    return out.groupBy("label").agg(F.avg("chi2").alias("chi2"), F.avg((F.col("p") >= alpha).cast("double")).alias("accepted"))


def lda_scores(df: DataFrame, id_col: str, features: list[str], group: str, positive: str, negative: str) -> DataFrame:
    """Scores of all rows on Fisher's discriminant between two groups, 0 halfway between their means.

    The driver gets means and second moments of both groups only.
    """
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    rows = {r[group]: r for r in df.where(F.col(group).isin(positive, negative)).groupBy(group).agg(F.count("*").alias("n"), *[F.avg(f).alias(f"m_{f}") for f in features], *[F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in pairs]).collect()}
    mean, within = {}, np.zeros((len(features), len(features)))
    for g in (positive, negative):
        mean[g] = np.array([rows[g][f"m_{f}"] for f in features])
        for a, b in pairs:
            i, j = features.index(a), features.index(b)
            within[i, j] += rows[g]["n"] * rows[g][f"c_{a}_{b}"]
            within[j, i] = within[i, j]
    w = np.linalg.pinv(within / (rows[positive]["n"] + rows[negative]["n"] - 2)) @ (mean[positive] - mean[negative])
    mid = float(w @ (mean[positive] + mean[negative]) / 2)
    return df.select(id_col, group, (sum((F.col(f) * float(v) for f, v in zip(features, w)), F.lit(0.0)) - mid).alias("score"))


def ridge_regress_out(df: DataFrame, batch: list[str], y: str, ridge: float = 1.0) -> DataFrame:
    """Adds explained (what one-hot batch columns explain of y by ridge regression) and residual.

    The normal equations need sums by combination of batches only; these go to the driver.
    """
    cells = [r.asDict() for r in df.groupBy(*batch).agg(F.count(y).alias("n"), F.sum(y).alias("s")).collect()]
    columns = [(b, v) for b in batch for v in sorted({c[b] for c in cells if c[b] is not None})]
    x = np.array([[float(c[b] == v) for b, v in columns] for c in cells])
    n, s = np.array([c["n"] for c in cells], dtype=float), np.array([c["s"] or 0.0 for c in cells])
    center = s.sum() / max(n.sum(), 1)
    beta = np.linalg.solve((x * n[:, None]).T @ x + ridge * np.eye(len(columns)), x.T @ (s - center * n))
    explained = F.lit(0.0)
    for (b, v), value in zip(columns, beta):
        explained = explained + F.when(F.col(b) == v, float(value)).otherwise(0.0)
    return df.withColumn("explained", explained).withColumn("residual", F.col(y) - explained)

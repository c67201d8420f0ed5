"""Statistics of a screen on long tables (feature, group, value)."""

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cdf
from .aggregates import average_rank, average_ranks


def _finite(df: DataFrame, value: str = "value") -> DataFrame:
    return df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))


def effect_sizes(long: DataFrame, group: str, by: tuple = ("feature",)) -> DataFrame:
    """eta squared, omega squared and Cohen's f of a group by feature; null under 3 values, 2 groups, or without variance."""
    g = _finite(long).groupBy(*by, group).agg(F.count("*").alias("n"), F.avg("value").alias("m"), (F.var_pop("value") * F.count("*")).alias("ss"))
    t = g.groupBy(*by).agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("ss").alias("ssw"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"))
    b = g.join(t.select(*by, "gm"), list(by)).groupBy(*by).agg(F.sum(F.col("n") * (F.col("m") - F.col("gm")) * (F.col("m") - F.col("gm"))).alias("ssb"))
    j = t.join(b, list(by))
    sst, msw = F.col("ssb") + F.col("ssw"), F.col("ssw") / (F.col("n") - F.col("k"))
    ok = (F.col("n") >= 3) & (F.col("k") >= 2) & (sst > 0)
    eta = F.when(ok, F.col("ssb") / sst)
    omega = F.when(ok & (F.col("n") > F.col("k")), (F.col("ssb") - (F.col("k") - 1) * msw) / (sst + msw))
    return j.select(*by, "n", "k", eta.alias("eta2"), omega.alias("omega2"), F.when(eta < 1, F.sqrt(eta / (1 - eta))).alias("cohens_f"))


def eta2_against(long: DataFrame, group: str, control: str) -> DataFrame:
    """eta squared of each group against the control alone."""
    g = _finite(long).groupBy("feature", group).agg(F.count("*").alias("n"), F.avg("value").alias("m"), (F.var_pop("value") * F.count("*")).alias("ss"))
    c = g.where(F.col(group) == control).select("feature", F.col("n").alias("n0"), F.col("m").alias("m0"), F.col("ss").alias("ss0"))
    j = g.where(F.col(group) != control).join(c, "feature")
    ssb = F.col("n") * F.col("n0") / (F.col("n") + F.col("n0")) * (F.col("m") - F.col("m0")) * (F.col("m") - F.col("m0"))
    return j.select("feature", group, (ssb / (ssb + F.col("ss") + F.col("ss0") + 1e-10)).alias("eta2"))


def cohens_d(long: DataFrame, group: str, control: str) -> DataFrame:
    """Difference from the control over the pooled deviation; null under 2 values or without deviation."""
    g = _finite(long).groupBy("feature", group).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    c = g.where(F.col(group) == control).select("feature", F.col("n").alias("n0"), F.col("m").alias("m0"), F.col("v").alias("v0"))
    j = g.where(F.col(group) != control).join(c, "feature")
    pooled = F.sqrt(((F.col("n") - 1) * F.col("v") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n") + F.col("n0") - 2))
    return j.select("feature", group, F.when((F.col("n") > 1) & (F.col("n0") > 1) & (pooled > 0), (F.col("m") - F.col("m0")) / pooled).alias("d"))


def welch_t(long: DataFrame, group: str, control: str) -> DataFrame:
    """t, degrees of freedom and two-sided p of each group against the control."""
    g = _finite(long).groupBy("feature", group).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    c = g.where(F.col(group) == control).select("feature", F.col("n").alias("n0"), F.col("m").alias("m0"), F.col("v").alias("v0"))
    j = g.where(F.col(group) != control).join(c, "feature")
    a, b = F.col("v") / F.col("n"), F.col("v0") / F.col("n0")
    df = (a + b) * (a + b) / (a * a / (F.col("n") - 1) + b * b / (F.col("n0") - 1))
    out = j.where((F.col("n") > 1) & (F.col("n0") > 1)).select("feature", group, ((F.col("m") - F.col("m0")) / F.sqrt(a + b)).alias("t"), df.alias("df"))
    return out.withColumn("p", cdf.t_sf2("t", "df"))


def rank_sum(long: DataFrame, group: str, control: str) -> DataFrame:
    """Mann-Whitney U of each group against the control, z with tie and continuity correction, and p."""
    x = _finite(long)
    c = x.where(F.col(group) == control).select("feature", "value", F.lit(0).alias("is_x"))
    names = x.where(F.col(group) != control).select("feature", group).distinct()
    both = names.join(c, "feature").select("feature", group, "value", "is_x").unionByName(x.where(F.col(group) != control).select("feature", group, "value", F.lit(1).alias("is_x")))
    r = both.join(average_ranks(both, ["feature", group], "value"), ["feature", group, "value"])
    s = r.groupBy("feature", group).agg(F.sum(F.col("r") * F.col("is_x")).alias("rx"), F.sum("is_x").alias("n1"), F.count("*").alias("n"), F.sum(F.col("t") * F.col("t") - 1).cast("double").alias("tie"))
    n1, n2, n = F.col("n1"), F.col("n") - F.col("n1"), F.col("n")
    u = F.col("rx") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("tie") / (n * (n - 1))))
    d = u - n1 * n2 / 2.0
    out = s.select("feature", group, u.alias("u"), (u / (n1 * n2)).alias("auc"), F.when(sd > 0, (d - F.signum(d) * 0.5) / sd).alias("z"))
    return out.withColumn("p", cdf.normal_sf2("z"))


def kruskal_wallis(long: DataFrame, group: str) -> DataFrame:
    """H with tie correction, degrees of freedom and p by feature."""
    x = _finite(long)
    r = x.withColumn("r", average_rank("value", ["feature"])).withColumn("t", F.count("*").over(Window.partitionBy("feature", "value")))
    g = r.groupBy("feature", group).agg(F.sum("r").alias("s"), F.count("*").alias("n"), F.sum(F.col("t") * F.col("t") - 1).cast("double").alias("tie"))
    h = g.groupBy("feature").agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"), F.sum("n").cast("double").alias("n"), F.sum("tie").alias("tie"), (F.count("*") - 1).alias("df"))
    n = F.col("n")
    stat = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("tie") / (n * n * n - n))
    return h.select("feature", stat.alias("h"), "df").withColumn("p", cdf.chi2_sf("h", F.col("df").cast("double")))


def one_versus_rest(long: DataFrame, group: str) -> DataFrame:
    """(feature, group, u, auc, log_fc, z, p) of each group against all other rows; log_fc is the difference of means.

    Values are ranked once by feature, since all groups share the ranks.
    """
    x = _finite(long).select("feature", group, "value")
    x = x.join(average_ranks(x, ["feature"], "value"), ["feature", "value"])
    s = x.groupBy("feature", group).agg(F.sum("r").alias("rx"), F.count("*").alias("n1"), F.sum("value").alias("s1"), F.sum(F.col("t") * F.col("t") - 1).cast("double").alias("t1"))
    a = s.groupBy("feature").agg(F.sum("n1").alias("n"), F.sum("s1").alias("s"), F.sum("t1").alias("tie"))
    n1, n = F.col("n1"), F.col("n")
    u, n2 = F.col("rx") - n1 * (n1 + 1) / 2, n - n1
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("tie") / (n * (n - 1))))
    d = u - n1 * n2 / 2.0
    fc = F.col("s1") / n1 - (F.col("s") - F.col("s1")) / n2
    out = s.join(a, "feature").where("n > n1").select("feature", group, u.alias("u"), (u / (n1 * n2)).alias("auc"), fc.alias("log_fc"), F.when(sd > 0, (d - F.signum(d) * 0.5) / sd).alias("z"))
    return out.withColumn("p", cdf.normal_sf2("z"))


def marker_features(long: DataFrame, group: str, least_fc: float = 1.0, most_p: float = 0.001) -> DataFrame:
    """Each group against the rest with p adjusted (BH) within the group, its rank there, and which features are markers."""
    m = p_adjust(one_versus_rest(long, group), "p", "BH", (group,))
    marker = (F.abs("log_fc") >= least_fc) & (F.col("p_adjusted") < most_p)
    return m.withColumn("rank_group", average_rank("p_adjusted", [group])).withColumn("is_marker", marker)


def p_adjust(df: DataFrame, p: str, method: str = "BH", by: tuple = ()) -> DataFrame:
    """Adds p_adjusted; null p are left out of the count."""
    n = F.count(p).over(Window.partitionBy(*by))
    if method == "bonferroni":
        return df.withColumn("p_adjusted", F.least(F.col(p) * n, F.lit(1.0)))
    rank = F.rank().over(Window.partitionBy(*by).orderBy(F.col(p).asc_nulls_last())) + F.count("*").over(Window.partitionBy(*by, p)) - 1
    raw = df.withColumn("_q", F.col(p) * n / rank)
    down = Window.partitionBy(*by).orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("p_adjusted", F.when(F.col(p).isNotNull(), F.least(F.min("_q").over(down), F.lit(1.0)))).drop("_q")


def anova_first_term(df: DataFrame, value: str, first: str, others: tuple = ()) -> DataFrame:
    """Sequential F of the first term of a main-effects model, from cell sums.

    The residual comes from the full one-hot model, solved from its normal equations,
    whose size is that of the numbers of levels; the driver gets one row for each cell.
    """
    cells = [r.asDict() for r in df.groupBy(first, *others).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q")).collect()]
    terms = [first, *others]
    levels = {t: sorted({c[t] for c in cells}) for t in terms}

    def rss(used):
        columns = [(t, v) for t in used for v in levels[t][1:]]
        x = np.array([[1.0] + [float(c[t] == v) for t, v in columns] for c in cells])
        n, s = np.array([c["n"] for c in cells], dtype=float), np.array([c["s"] for c in cells], dtype=float)
        b = np.linalg.lstsq((x * n[:, None]).T @ x, x.T @ s, rcond=None)[0]
        return sum(c["q"] for c in cells) - float(b @ (x.T @ s)), int(np.linalg.matrix_rank(x))

    total = sum(c["n"] for c in cells)
    (r0, k0), (r1, k1), (rf, kf) = rss([]), rss([first]), rss(terms)
    f = ((r0 - r1) / max(k1 - k0, 1)) / (rf / max(total - kf, 1)) if rf > 0 else None
    out = df.sparkSession.createDataFrame([(first, f, float(k1 - k0), float(total - kf))], "term string, f double, df1 double, df2 double")
    return out.withColumn("p", cdf.f_sf("f", "df1", "df2"))


def spearman_matrix(long: DataFrame, id_col: str) -> DataFrame:
    """Spearman correlation of all pairs of features, 0 without variance."""
    r = long.select(id_col, "feature", average_rank("value", ["feature"]).alias("r"))
    j = r.alias("a").join(r.alias("b"), F.col(f"a.{id_col}") == F.col(f"b.{id_col}"))
    c = j.groupBy(F.col("a.feature").alias("feature_a"), F.col("b.feature").alias("feature_b")).agg(F.corr("a.r", "b.r").alias("rho"))
    return c.withColumn("rho", F.when(F.isnan("rho") | F.col("rho").isNull(), 0.0).otherwise(F.col("rho")))


def correlation_graph(matrix: DataFrame, least: float) -> DataFrame:
    """Undirected edges between features with |rho| of least or more."""
    return matrix.where((F.col("feature_a") < F.col("feature_b")) & (F.abs("rho") >= least)).select("feature_a", "feature_b")


def pairwise_mahalanobis(df: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Squared distances between the means of groups, by the inverse correlation matrix of all rows.

    The driver gets the matrix of correlations and inverts it.
    """
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    row = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)]).first()
    c = np.eye(len(features))
    for i, (a, b) in enumerate(pairs):
        p, q = features.index(a), features.index(b)
        c[p, q] = c[q, p] = round(row[i], 5) if row[i] is not None else float(p == q)
    inv = np.linalg.pinv(c)
    m = df.groupBy(group).agg(*[F.avg(f).alias(f) for f in features])
    other = m.withColumnsRenamed({f: f"{f}_b" for f in features} | {group: f"{group}_b"})
    d = [F.col(f) - F.col(f"{f}_b") for f in features]
    dist = sum((float(inv[i, j]) * d[i] * d[j] for i in range(len(d)) for j in range(len(d))), F.lit(0.0))
    return m.join(F.broadcast(other)).select(group, f"{group}_b", dist.alias("distance"))


def z_prime(df: DataFrame, group: str, control: str, value: str) -> DataFrame:
    """1 - 3 (sd + sd of control) / |difference of means| and its category."""
    g = df.groupBy(group).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    c = g.where(F.col(group) == control).select(F.col("m").alias("m0"), F.col("s").alias("s0"))
    z = 1 - 3 * (F.col("s") + F.col("s0")) / F.abs(F.col("m") - F.col("m0"))
    out = g.where(F.col(group) != control).join(F.broadcast(c)).select(group, z.alias("z_prime"))
    return out.withColumn("category", F.when(F.col("z_prime") < 0, "bad").when(F.col("z_prime") <= 0.5, "fair").otherwise("good"))


def compound_order(shares: DataFrame, compound: str, group: str, value: str, control: str) -> DataFrame:
    """Distance of each compound's vector of shares to the control's, and its rank; a group that one of both lacks counts 0 there.

    With t the square sum of the control, groups without it add their own squares,
    and groups of the control alone are what is left of t. Ranks need one order
    over all compounds, one row each.
    """
    c = shares.where(F.col(compound) == control).select(group, F.col(value).alias("_c"))
    both = shares.join(c, group, "left").na.fill(0.0, ["_c"]).crossJoin(c.agg(F.coalesce(F.sum(F.col("_c") * F.col("_c")), F.lit(0.0)).alias("_t")))
    part = F.sum((F.col(value) - F.col("_c")) * (F.col(value) - F.col("_c"))) + F.greatest(F.any_value("_t") - F.sum(F.col("_c") * F.col("_c")), F.lit(0.0))
    d = both.groupBy(compound).agg(F.sqrt(part).alias("distance"))
    return d.withColumn("rank", F.rank().over(Window.orderBy("distance")))


def regress_out(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """Adds residual: y less its line on x within keys."""
    c = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"))
    return df.join(c, keys).withColumn("residual", F.col(y) - F.col("_a") - F.col("_b") * F.col(x)).drop("_a", "_b")


def min_max(value: Column, window) -> Column:
    """Value scaled to 0..1 in a window; null without range."""
    low, high = F.min(value).over(window), F.max(value).over(window)
    return F.when(high > low, (value - low) / (high - low))

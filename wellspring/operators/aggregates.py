"""Grouping, pivoting, windows and samples over nuclei and well tables."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable


def cluster_counts(df: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Counts of each group in every key, 0 where a group does not occur there."""
    n = df.groupBy(*keys, group).agg(F.count("*").alias("n"))
    grid = df.select(*keys).distinct().join(F.broadcast(df.select(group).distinct()))
    return grid.join(n, [*keys, group], "left").na.fill(0, ["n"])


def well_gate(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys in which every one of columns has more than one value."""
    seen = df.groupBy(*keys).agg(*[F.countDistinct(c).alias(c) for c in columns])
    return seen.where(reduce(lambda a, b: a & b, [F.col(c) > 1 for c in columns])).select(*keys)


def profile(df: DataFrame, group: list[str], features: list[str], how: str = "mean") -> DataFrame:
    """Mean or exact median of each feature by group."""
    put = (lambda c: F.avg(c)) if how == "mean" else (lambda c: F.expr(f"percentile({c}, 0.5)"))
    return df.groupBy(*group).agg(*[put(c).alias(c) for c in features])


def dot_plot(long: DataFrame, group: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """Mean, share above 0 and count by group and feature of a long table."""
    return long.groupBy(group, feature).agg(F.avg(value).alias("mean"), F.avg((F.col(value) > 0).cast("double")).alias("fraction"), F.count(value).alias("n"))


def multi_agg(df: DataFrame, keys: list[str], features: list[str], names=("mean", "sum")) -> DataFrame:
    """{feature}_{name} for each feature and aggregate."""
    known = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}
    return df.groupBy(*keys).agg(*[known[n](c).alias(f"{c}_{n}") for c in features for n in names])


def fractions(df: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Count and share of each group within keys."""
    n = df.groupBy(*keys, group).agg(F.count("*").alias("n"))
    return n.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def mean_proportions(df: DataFrame, well: list[str], condition: list[str], group: str) -> DataFrame:
    """Share of each group in each well, 0 included, averaged over the wells of a condition."""
    n = cluster_counts(df, [*condition, *well], group)
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*condition, *well))
    return n.withColumn("share", share).groupBy(*condition, group).agg(F.avg("share").alias("mean_share"))


def unpivot(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Long form (keys, feature, value)."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in features]).unpivot(keys, features, "feature", "value")


def cv_summary(long: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean, sample deviation and their ratio by keys; the ratio is null for a zero mean."""
    out = long.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return out.withColumn("cv", F.when(F.col("mean") != 0, F.col("sd") / F.col("mean")))


def cv_within_total(long: DataFrame, group: str) -> DataFrame:
    """By feature: deviation over |mean| overall, and the mean of the same within groups of two or more."""
    cv = F.when(F.avg("value") != 0, F.stddev_samp("value") / F.abs(F.avg("value")))
    total = long.groupBy("feature").agg(cv.alias("cv_total"))
    within = long.groupBy("feature", group).agg(cv.alias("cv"), F.count("value").alias("n")).where("n >= 2")
    return total.join(within.groupBy("feature").agg(F.avg("cv").alias("cv_within")), "feature", "left")


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of pairs and their share of the row."""
    n = df.groupBy(a, b).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(a)))


def robust_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, deviation, variance, median and 1.4826 times the median absolute deviation."""
    base = df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.var_samp(value).alias("var"), F.expr(f"percentile({value}, 0.5)").alias("median")
    )
    dev = df.join(base.select(*keys, "median"), keys).groupBy(*keys).agg((1.4826 * F.expr(f"percentile(abs({value} - median), 0.5)")).alias("mad"))
    return base.join(dev, keys)


def _at_shares(ranked: DataFrame, spans: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """spans (keys, skip, n, ..) with q: the interpolated quantiles of the n rows after the first skip of (keys, v, before, t).

    before counts the rows of smaller values, so each quantile is a maximum over
    the one or two values on its place; no group is held or sorted whole.
    """
    place = [(F.col("n") - 1) * F.lit(p) for p in shares]
    on = lambda at: F.max(F.when((F.col("before") <= F.col("skip") + at) & (F.col("before") + F.col("t") > F.col("skip") + at), F.col("v")))
    ends = ranked.join(spans.select(*keys, "skip", "n"), keys).groupBy(*keys)
    ends = ends.agg(*[on(side(p)).alias(f"_{name}{i}") for i, p in enumerate(place) for name, side in (("a", F.floor), ("b", F.ceil))])
    q = [
        F.when(F.col(f"_a{i}") == F.col(f"_b{i}"), F.col(f"_a{i}")).otherwise((F.ceil(p) - p) * F.col(f"_a{i}") + (p - F.floor(p)) * F.col(f"_b{i}"))
        for i, p in enumerate(place)
    ]
    return spans.join(ends, keys).select(*spans.columns, F.array(*q).alias("q"))


def _ranked(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, v, before, t): the distinct values within keys, how many rows are smaller and how many have each."""
    r = average_ranks(df, keys, value)
    return durable(r.select(*keys, F.col(value).cast("double").alias("v"), (F.col("r") - (F.col("t") + 1) / 2.0).cast("long").alias("before"), "t"))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, n, q): exact interpolated quantiles of the values that are not null, from ranks of distinct values over many tasks."""
    ranked = _ranked(df, keys, value)
    spans = ranked.groupBy(*keys).agg(F.lit(0).alias("skip"), F.sum("t").alias("n"))
    return _at_shares(ranked, spans, keys, shares).drop("skip")


def clipped_stats(df: DataFrame, keys: list[str], value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Statistics by keys of the values between two quantiles of their key."""
    ranked = _ranked(df, keys, value)
    spans = ranked.groupBy(*keys).agg(F.lit(0).alias("skip"), F.sum("t").alias("n"))
    cut = _at_shares(ranked, spans, keys, [low, high]).select(*keys, F.col("q")[0].alias("_low"), F.col("q")[1].alias("_high"))
    kept = ranked.join(cut, keys).where((F.col("v") >= F.col("_low")) & (F.col("v") <= F.col("_high")))
    spans = durable(kept.groupBy(*keys).agg(F.min("before").alias("skip"), F.sum("t").alias("n"), (F.sum(F.col("v") * F.col("t")) / F.sum("t")).alias("mean")))
    gap = F.col("v") - F.col("mean")
    std = kept.join(spans.select(*keys, "mean", "n"), keys).groupBy(*keys).agg(F.sqrt(F.sum(gap * gap * F.col("t")) / F.max("n")).alias("std"))
    q = lambda i: F.col("q")[i]
    out = _at_shares(ranked, spans, keys, [0.5, 0.25, 0.75, 0.01, 0.99]).join(std, keys)
    return out.select(*keys, "n", "mean", q(0).alias("median"), "std", q(1).alias("q25"), q(2).alias("q75"), q(3).alias("p1"), q(4).alias("p99"))


def undersample(df: DataFrame, keys: list[str], label: str, z: str, area: str, steps: int = 4) -> DataFrame:
    """By step k: number of labels and appearances when only every k-th slice is kept, and the share of step 1."""
    ranked = df.withColumn("r", F.dense_rank().over(Window.partitionBy(*keys).orderBy(z)))
    taken = ranked.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps)))).where((F.col("r") - 1) % F.col("step") == 0)
    cells = taken.groupBy("step", *keys, label).agg(F.count("*").alias("n"), F.sum(area).alias("area"))
    out = cells.groupBy("step").agg(F.count("*").alias("n_cells"), F.avg("n").alias("mean_seen"), F.avg("area").alias("mean_area"))
    return out.join(F.broadcast(out.where("step = 1").select(F.col("n_cells").alias("n_first")))).withColumn("fraction", F.col("n_cells") / F.col("n_first")).drop("n_first")


def average_rank(value: Column | str, keys: list[str]) -> Column:
    """Rank with ties averaged, within keys."""
    first = F.rank().over(Window.partitionBy(*keys).orderBy(value))
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    return first + (ties - 1) / 2.0


def average_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, r, t): the rank of each distinct value within keys, ties averaged, and how many rows have it.

    Distinct values are dealt by range, so the values of one key spread over many
    tasks; totals of the tasks give each its offset. Nulls have no rank.
    """
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("t"))
    n = durable(n.repartitionByRange(*keys, value).withColumn("_p", F.spark_partition_id()))
    part = n.groupBy(*keys, "_p").agg(F.sum("t").alias("_t"))
    part = part.withColumn("_off", F.sum("_t").over(Window.partitionBy(*keys).orderBy("_p")) - F.col("_t"))
    run = F.sum("t").over(Window.partitionBy(*keys, "_p").orderBy(value))
    r = n.withColumn("_run", run).join(part.drop("_t"), [*keys, "_p"])
    return r.select(*keys, value, (F.col("_off") + F.col("_run") - F.col("t") + (F.col("t") + 1) / 2.0).alias("r"), "t")


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, r): rank correlation of two columns within keys, over rows that have both."""
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, F.col(a).alias("_a"), F.col(b).alias("_b"))
    for c in ("_a", "_b"):
        x = x.join(average_ranks(x, keys, c).select(*keys, c, F.col("r").alias(f"r{c}")), [*keys, c])
    return x.groupBy(*keys).agg(F.corr("r_a", "r_b").alias("r"))


def zscore(df: DataFrame, keys: list[str], features: list[str], eps: float = 0.0, ddof: int = 1) -> DataFrame:
    """Centred and scaled features within keys; a feature without variance is only centred if eps is 0.

    The statistics, one row a key, go to the rows, so few keys do not bring the rows to few tasks.
    """
    dev = F.stddev_samp if ddof else F.stddev_pop
    stats = df.groupBy(*keys).agg(*[F.avg(c).alias(f"_m_{c}") for c in features], *[dev(c).alias(f"_s_{c}") for c in features])
    out = df.join(F.broadcast(stats), keys) if keys else df.join(F.broadcast(stats))
    for c in features:
        s = F.col(f"_s_{c}") + eps
        out = out.withColumn(c, (F.col(c) - F.col(f"_m_{c}")) / F.when(s > 0, s).otherwise(1.0))
    return out.drop(*[f"_{k}_{c}" for k in "ms" for c in features])


def iqr_outliers(df: DataFrame, keys: list[str], value: str, low: float | None = 1.5, high: float | None = 1.5) -> DataFrame:
    """Adds is_outlier: below Q1 - low IQR or above Q3 + high IQR of the group; None leaves a side open."""
    q = df.groupBy(*keys).agg(F.expr(f"percentile({value}, array(0.25, 0.75))").alias("_q"))
    iqr = F.col("_q")[1] - F.col("_q")[0]
    test = F.lit(False)
    if low is not None:
        test = test | (F.col(value) < F.col("_q")[0] - low * iqr)
    if high is not None:
        test = test | (F.col(value) > F.col("_q")[1] + high * iqr)
    return df.join(q, keys).withColumn("is_outlier", test).drop("_q")


def quantile_rescale(df: DataFrame, keys: list[str], value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Clips to two quantiles of the group and maps them to 0 and 1; null where they are equal."""
    q = df.groupBy(*keys).agg(F.expr(f"percentile({value}, array({low}, {high}))").alias("_q"))
    a, b = F.col("_q")[0], F.col("_q")[1]
    clipped = F.least(F.greatest(F.col(value).cast("double"), a), b)
    return df.join(q, keys).withColumn("scaled", F.when(b > a, (clipped - a) / (b - a))).drop("_q")


def seeded_order(seed: int, *ids: str) -> Column:
    """A random order that depends on seed and ids alone."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids]))


def stratified_sample(df: DataFrame, keys: list[str], n: int, seed: int, *ids: str) -> DataFrame:
    """n rows of each group, or all if fewer."""
    w = Window.partitionBy(*keys).orderBy(seeded_order(seed, *ids), *ids)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def fraction_sample(df: DataFrame, keys: list[str], fraction: float, seed: int, *ids: str) -> DataFrame:
    """Exactly floor(n * fraction) rows of each group."""
    w = Window.partitionBy(*keys).orderBy(seeded_order(seed, *ids), *ids)
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("_r", F.row_number().over(w)).withColumn("_n", n).where(F.col("_r") <= F.floor(F.col("_n") * fraction)).drop("_r", "_n")


def balanced_sample(df: DataFrame, value: str, bins: int, per_bin: int, seed: int, *ids: str) -> DataFrame:
    """At most per_bin rows of each of bins equal-width bins of value; the largest value falls in the last bin."""
    ends = df.agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    width = (F.col("_b") - F.col("_a")) / bins
    b = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_a")) / width), F.lit(bins - 1))).otherwise(0)
    binned = df.join(F.broadcast(ends)).withColumn("bin", b.cast("int")).drop("_a", "_b")
    return stratified_sample(binned, ["bin"], per_bin, seed, *ids)


def grouped_split(df: DataFrame, keys: list[str], share: float, seed: int) -> DataFrame:
    """Adds is_train: whole groups go to one side, floor(n * share) of them to training.

    The groups are counted by the first digits of their hash order, so only those
    of the one bin in which the border falls are ranked.
    """
    groups = df.select(*keys).distinct().withColumn("_o", seeded_order(seed, *keys)).withColumn("_b", F.substring("_o", 1, 3))
    sizes = groups.groupBy("_b").agg(F.count("*").alias("_n"))  # at most 4096 rows
    sizes = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy(F.lit(0))))
    placed = groups.join(sizes, "_b").withColumn("_take", F.floor(F.col("_all") * share))
    whole = placed.where(F.col("_before") + F.col("_n") <= F.col("_take")).select(*keys)
    edge = placed.where((F.col("_before") < F.col("_take")) & (F.col("_before") + F.col("_n") > F.col("_take")))
    edge = edge.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_o"))).where(F.col("_before") + F.col("_r") <= F.col("_take")).select(*keys)
    train = whole.unionByName(edge).withColumn("is_train", F.lit(True))
    return df.join(train, keys, "left").na.fill(False, ["is_train"])


def three_way_split(df: DataFrame, seed: int, *ids: str, train: int = 70, valid: int = 15) -> DataFrame:
    """Adds part: train, valid or test by a hash of seed and ids, in percent."""
    h = F.conv(F.substring(seeded_order(seed, *ids), 1, 6), 16, 10).cast("long") % 100
    return df.withColumn("part", F.when(h < train, "train").when(h < train + valid, "valid").otherwise("test"))

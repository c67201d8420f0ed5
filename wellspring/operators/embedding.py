"""Vectors of nuclei and wells: neighbours, votes, agreement of clusterings."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable


#: Queries are cut into this many parts, and more if the neighbours of one pass this many bytes; references are cut so that a part is of at most so many.
PARTS, HELD = 48, 384 << 20
#: Queries and references of one product.
ROWS, COLUMNS = 256, 4096


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    x = column.combine_chunks()
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1 if len(x) else 0)


def nearest_rows(q_ids: np.ndarray, q: np.ndarray, r_ids: np.ndarray, r: np.ndarray, k: int, exclude_self: bool):
    """(rows of q, rows of r, distances) of the k nearest rows of r for each of q, ties to the smaller id; in parts, r by ascending id.

    One product of single precision about the mean gives distances nearly; what
    is not farther than the k-th so far, but for rounding, is computed again
    from the differences.
    """
    middle = r.mean(axis=0, dtype=float)
    blocks = [slice(lo, lo + COLUMNS) for lo in range(0, len(r), COLUMNS)]  # doubles of a block only
    rr = np.concatenate([((r[b] - middle) ** 2).sum(axis=1) for b in blocks]) if blocks else np.empty(0)
    top = rr.max(initial=0.0)
    kind, unit = (np.float32, 2.0**-22) if top < 1e30 else (float, 2.0**-50)
    r2 = np.empty((len(r), r.shape[1] + 2), dtype=kind)
    for b in blocks:
        r2[b] = np.column_stack([-2 * (r[b] - middle), rr[b], np.ones(len(rr[b]))])
    for at in range(0, len(q), ROWS):
        x, ids = q[at : at + ROWS], q_ids[at : at + ROWS]
        near_x = x - middle
        qq = (near_x * near_x).sum(axis=1)
        far = qq < 1e30  # others are compared in whole
        slack = np.where(far | (kind is float), (x.shape[1] + 8) * unit * (qq + top) + 1e-12, np.inf)
        x2 = np.where(np.isinf(slack)[:, None], 0.0, np.column_stack([near_x, np.ones(len(x)), qq])).astype(kind)
        first, last = np.searchsorted(r_ids, ids), np.searchsorted(r_ids, ids, "right")
        row, col, d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        limit = np.full(len(x), np.inf)
        for lo in range(0, len(r), COLUMNS):
            near = x2 @ r2[lo : lo + COLUMNS].T
            if exclude_self:
                for own in range(int((last - first).max(initial=0))):
                    mine = first + own
                    mine = np.flatnonzero((mine < last) & (mine >= lo) & (mine < lo + near.shape[1]))
                    near[mine, first[mine] + own - lo] = np.inf
            bound = limit
            if k < near.shape[1] and np.isinf(limit).any():
                bound = np.minimum(limit, np.partition(near, k - 1, axis=1)[:, k - 1] + slack)
            bound = np.nextafter(bound.astype(kind), kind(np.inf))
            i, j = np.divmod(np.flatnonzero(near <= bound[:, None]), near.shape[1])
            if exclude_self:
                sound = np.isfinite(near[i, j])
                i, j = i[sound], j[sound]
            if not len(i):
                continue
            new = np.empty(len(i))
            for part in range(0, len(i), 1 << 15):
                p = slice(part, part + (1 << 15))
                new[p] = np.sqrt(((r[lo + j[p]] - x[i[p]].astype(float)) ** 2).sum(axis=1))
            row, col, d = np.concatenate([row, i]), np.concatenate([col, lo + j]), np.concatenate([d, new])
            order = np.lexsort((col, d, row))
            row, col, d = row[order], col[order], d[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, col, d, place = row[place < k], col[place < k], d[place < k], place[place < k]
            full = place == k - 1
            limit[row[full]] = d[full] ** 2 + slack[row[full]]
        yield row + at, col, d


def vector_knn(
    queries: DataFrame, reference: DataFrame, k: int, id_col: str, vector_col: str, block_rows: int = 512, exclude_self: bool = True, group: str | None = None
) -> DataFrame:
    """Exact k nearest reference rows of each query by Euclid: (src, dst, dist, rank); ties go to the smaller dst.

    With group, rows look among those of their own group only, which becomes the
    first column as text. Queries are dealt over some PARTS tasks (of block_rows
    at least, so that few rows are few tasks), each of which meets the references
    of its group in products and gives k rows a query. So what moves grows with
    the rows, not with their pairs; only the products are as many as the pairs.
    References beyond HELD bytes are cut, and the k nearest of each cut meet by
    query. Rows with a null vector or group, or a component that is null or not
    finite, take no part; vectors of a call have one width.
    """

    def rows(df):
        kind = "array<float>" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
        v, grp = F.col(vector_col).cast(kind), F.col(group).cast("string") if group else F.lit("")
        sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & grp.isNotNull()
        return df.where(sound).select(grp.alias("grp"), F.col(id_col).cast("long").alias("id"), v.alias("v"))

    q, r = rows(queries), rows(reference)
    sizes = r.groupBy("grp").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"))
    total = sizes.agg(F.max("n").alias("most"), F.max("width").alias("width")).crossJoin(q.agg(F.count("*").alias("n"))).first()  # one row each
    side = max(min(block_rows, total["n"]), min(-(-total["n"] // PARTS), HELD // (24 * k)), 1)
    held = max(HELD // (8 * ((total["width"] or 0) + 2)), 1)
    cuts = -(-(total["most"] or 0) // held)
    parts = q.groupBy("grp").agg(F.ceil(F.count("*") / side).cast("int").alias("parts"))
    sizes = sizes.join(parts, "grp").select("grp", "parts", F.ceil(F.col("n") / held).cast("int").alias("cuts"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one_of = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    q = q.join(sizes, "grp").select("grp", one_of("parts").alias("part"), every("cuts").alias("cut"), "id", "v")
    r = r.join(sizes, "grp").select("grp", every("parts").alias("part"), one_of("cuts").alias("cut"), "id", "v")
    key = ["grp", "part", "cut"]

    def meet(name, left, right):
        order = np.argsort(right.column("id").to_numpy(), kind="stable")
        q_ids, r_ids = left.column("id").to_numpy(), right.column("id").to_numpy()[order]
        found = list(nearest_rows(q_ids, _matrix(left.column("v")), r_ids, _matrix(right.column("v"))[order], k, exclude_self)) if len(q_ids) and len(r_ids) else []
        row, col, d = (np.concatenate(f) for f in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        src, dst = q_ids[row], r_ids[col]
        order = np.lexsort((dst, d, src))  # rows that share an id look as one
        src, dst, d = src[order], dst[order], d[order]
        place = np.arange(len(src)) - np.searchsorted(src, src) + 1
        keep = place <= k
        return pa.table({"grp": pa.array([name[0].as_py()] * int(keep.sum()), pa.string()), "src": src[keep], "dst": dst[keep], "dist": d[keep], "rank": pa.array(place[keep], pa.int32())})

    found = q.groupBy(*key).cogroup(r.groupBy(*key)).applyInArrow(meet, "grp string, src long, dst long, dist double, rank int")
    if cuts > 1:
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("grp", "src").orderBy("dist", "dst"))).where(F.col("rank") <= k)
    return found.withColumnRenamed("grp", group) if group else found.drop("grp")


def batch_knn(df: DataFrame, k: int, id_col: str, vector_col: str, batch: str) -> DataFrame:
    """The k nearest rows of each batch for every row: (src, dst, dist, rank, batch); batches are few and searched one by one.

    A null batch is a batch of its own.
    """
    out = None
    for value in [r[0] for r in df.select(batch).distinct().orderBy(batch).collect()]:
        near = vector_knn(df, df.where(F.col(batch).eqNullSafe(F.lit(value))), k, id_col, vector_col).withColumn("batch", F.lit(value))
        out = near if out is None else out.unionByName(near)
    return out if out is not None else vector_knn(df, df, k, id_col, vector_col).withColumn("batch", F.lit(None))


def gram(df: DataFrame, vector_col: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance (over n - 1) of vectors of one width.

    A task sends one partial row of sums for each component, so the driver gets
    width squared numbers however many rows there are. Sums are taken about the
    first vector of a task and moved to a common origin by exact formulas.
    """

    def run(batches):
        n, s, m = 0, None, None
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1) if b.num_rows else np.empty((0, 0))
            if not len(x):
                continue
            n, s, m = n + len(x), x.sum(axis=0) + (0 if s is None else s), x.T @ x + (0 if m is None else m)
        rows = [] if s is None else [(-1, [float(n), *s])] + [(i, [0.0, *r]) for i, r in enumerate(m)]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.list_(pa.float64()))], names=["i", "v"])

    part = df.where(F.col(vector_col).isNotNull()).select(F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "i int, v array<double>")
    sums = part.select("i", F.posexplode("v").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    width = max((r["j"] for r in sums), default=0)
    m = np.zeros((width + 1, width + 1))
    for r in sums:
        m[r["i"] + 1, r["j"]] = r["x"]
    n = int(m[0, 0])
    mean = m[0, 1:] / max(n, 1)
    return n, mean, (m[1:, 1:] - n * np.outer(mean, mean)) / max(n - 1, 1)


def principal_axes(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k axes [width, k] of largest variance and their variances; of each axis the largest loading is positive."""
    value, vector = np.linalg.eigh(cov)
    order = np.argsort(-value, kind="stable")[:k]
    axes = vector[:, order]
    top = np.abs(axes).argmax(axis=0)
    return axes * np.where(axes[top, np.arange(axes.shape[1])] < 0, -1.0, 1.0), value[order]


def pca(df: DataFrame, vector_col: str, k: int, out: str = "pcs") -> DataFrame:
    """Adds the scores of each vector on the first k principal axes; null where the vector is."""
    _, mean, cov = gram(df, vector_col)
    axes, _ = principal_axes(cov, k)
    shift = mean @ axes
    score = lambda c: F.aggregate(F.zip_with(F.col(vector_col).cast("array<double>"), F.array(*map(F.lit, axes[:, c].tolist())), lambda x, a: x * a), F.lit(-float(shift[c])), lambda acc, x: acc + x)
    return df.withColumn(out, F.when(F.col(vector_col).isNotNull(), F.array(*[score(c) for c in range(axes.shape[1])])))


def project_labels(knn: DataFrame, labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """Majority vote of the neighbours; ties go to the smallest label."""
    v = knn.join(labels.select(F.col(id_col).alias("dst"), label), "dst").groupBy("src", label).agg(F.count("*").alias("n"))
    best = v.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), label))).where("r = 1")
    return best.select(F.col("src").alias(id_col), F.col(label).alias("predicted"), "n")


def graph_similarity(a: DataFrame, b: DataFrame, k: int, n: int) -> DataFrame:
    """1 - |A - B|^2 / (2 k n) of two k-neighbour graphs as edges (src, dst)."""
    j = a.select("src", "dst", F.lit(1).alias("a")).join(b.select("src", "dst", F.lit(1).alias("b")), ["src", "dst"], "full_outer").na.fill(0, ["a", "b"])
    return j.agg((1 - F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))) / (2.0 * k * n)).alias("gcs"))


def clustering_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Normalised mutual information (arithmetic) and adjusted Rand index of two clusterings."""
    c = durable(df.groupBy(a, b).agg(F.count("*").cast("double").alias("n")))
    total = c.agg(F.sum("n").alias("t"))
    ra, rb = c.groupBy(a).agg(F.sum("n").alias("na")), c.groupBy(b).agg(F.sum("n").alias("nb"))
    t = F.col("t")
    j = c.join(ra, a).join(rb, b).join(F.broadcast(total))
    mi = j.agg(F.sum(F.col("n") / t * F.log(F.col("n") * t / (F.col("na") * F.col("nb")))).alias("mi"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("s"), F.any_value("t").alias("t"))
    side = lambda d, x: d.join(F.broadcast(total)).agg((-F.sum(F.col(x) / t * F.log(F.col(x) / t))).alias(f"h{x}"), F.sum(F.col(x) * (F.col(x) - 1) / 2).alias(f"s{x}"))
    out = mi.join(F.broadcast(side(ra, "na"))).join(F.broadcast(side(rb, "nb")))
    expected = F.col("sna") * F.col("snb") / (t * (t - 1) / 2)
    h = (F.col("hna") + F.col("hnb")) / 2
    top = (F.col("sna") + F.col("snb")) / 2
    return out.select(F.when(h > 0, F.col("mi") / h).otherwise(1.0).alias("nmi"), F.when(top != expected, (F.col("s") - expected) / (top - expected)).otherwise(1.0).alias("ari"))


def variable_features(long: DataFrame, bins: int = 20) -> DataFrame:
    """Dispersion of each feature and its z-score among features of about equal mean."""
    f = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("var"))
    f = f.withColumn("dispersion", F.when(F.col("mean") != 0, F.col("var") / F.col("mean"))).withColumn("bin", F.ntile(bins).over(Window.orderBy("mean", "feature")))
    w = Window.partitionBy("bin")
    sd = F.stddev_samp("dispersion").over(w)
    return f.withColumn("z", F.when(sd > 0, (F.col("dispersion") - F.avg("dispersion").over(w)) / sd).otherwise(0.0))

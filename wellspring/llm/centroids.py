"""Centroid clustering of integer vectors by progressive Walsh-Hadamard search.

The transform of a vector of whole numbers is made of whole numbers, and squared
distances between transforms are the width times those between vectors. So a
sum over some coefficients is a bound that no rounding touches: differences are
added coarse to fine (by number of sign changes), and a centroid whose partial
sum is above the whole distance of the most promising one is strictly worse and
goes. Those that stay are finished over all coefficients.
"""

from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..session import durable

WIDTH = 64
#: Coefficients that each step of the search adds; together the width.
STEPS = (4, 4, 8, 16, 32)
#: Scaled components up to this size keep all sums within 64 bits; larger ones are counted in Python's integers.
NARROW = 1 << 22
#: Scaled components are clipped here, so that sums fit 38 digits.
WIDEST = 1 << 62
_ROWS = 2048


def _butterflies(x: np.ndarray) -> np.ndarray:
    n, width = x.shape
    h = 1
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, width)
        h *= 2
    return x


_ROW_SIGNS = _butterflies(np.eye(WIDTH, dtype=np.int64))
#: Places of the coefficients by the number of sign changes of their row.
SEQUENCY = np.argsort((np.diff(_ROW_SIGNS, axis=1) != 0).sum(axis=1))


def walsh_hadamard(x: np.ndarray) -> np.ndarray:
    """Exact transforms of rows of whole numbers, coarse coefficients first."""
    return _butterflies(x)[:, SEQUENCY]


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest centroid of each row and their squared distance, from transforms of both; ties to the smaller place."""
    where, far = np.zeros(len(vectors), dtype=np.int64), np.zeros(len(vectors), dtype=vectors.dtype)
    for lo in range(0, len(vectors), _ROWS):
        v = vectors[lo : lo + _ROWS]
        d = v[:, None, : STEPS[0]] - centroids[None, :, : STEPS[0]]
        sums = (d * d).sum(axis=2)
        lead = v - centroids[sums.argmin(axis=1)]
        bound = (lead * lead).sum(axis=1)
        row, col = np.nonzero(sums <= bound[:, None])
        sums, at = sums[row, col], STEPS[0]
        for step in STEPS[1:]:
            d = v[row, at : at + step] - centroids[col, at : at + step]
            sums, at = sums + (d * d).sum(axis=1), at + step
            stay = np.flatnonzero(sums <= bound[row])
            row, col, sums = row[stay], col[stay], sums[stay]
        order = np.lexsort((col, sums, row))
        first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
        where[lo : lo + _ROWS], far[lo : lo + _ROWS] = col[first], sums[first] // WIDTH
    return where, far


def scaled(x: np.ndarray, factor: int) -> np.ndarray:
    """floor(factor * x) as whole numbers: of 64 bits where all are narrow, else Python's; clipped at WIDEST."""
    with np.errstate(over="ignore"):
        y = np.floor(factor * x.astype(np.float64))
    if not y.size or np.abs(y).max() <= NARROW:
        return y.astype(np.int64)
    whole = [max(-WIDEST, min(WIDEST, int(e))) if abs(e) < 2.0**63 else (WIDEST if e > 0 else -WIDEST) for e in y.ravel()]
    return np.array(whole, dtype=object).reshape(y.shape)


def _meet(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """nearest() on vectors, in whichever integers both sides need."""
    if x.dtype != centroids.dtype:
        x, centroids = x.astype(object), centroids.astype(object)
    return nearest(walsh_hadamard(x), walsh_hadamard(centroids))


def _matrix(column: pa.Array, factor: int) -> np.ndarray:
    return scaled(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH), factor)


def _packed(centroids: list[list[int]]) -> np.ndarray:
    small = all(abs(e) <= NARROW for c in centroids for e in c)
    return np.array(centroids, dtype=np.int64 if small else object)


def _moved(rows: DataFrame, centroids: list[list[int]], factor: int) -> list[list[int]]:
    """Componentwise floor of the mean of each centroid's vectors; a centroid without any stays.

    A task sends one sum for each centroid and component, so the driver gets
    no more than those however many rows there are.
    """
    shared = rows.sparkSession.sparkContext.broadcast(_packed(centroids))

    def run(batches):
        total: dict[int, list] = {}
        for b in batches:
            x = _matrix(b.column(0), factor)
            where, _ = _meet(x, shared.value)
            for c in np.unique(where).tolist():
                mine = x[where == c]
                sums = [len(mine), *(int(s) for s in mine.sum(axis=0))]
                total[c] = [p + q for p, q in zip(total[c], sums)] if c in total else sums
        flat = [(c, i, Decimal(s)) for c, sums in total.items() for i, s in enumerate(sums)]
        columns = zip(*flat) if flat else ((), (), ())
        kinds = (pa.int32(), pa.int32(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)], names=["cluster", "i", "total"])

    sums = rows.select("v").mapInArrow(run, "cluster int, i int, total decimal(38,0)").groupBy("cluster", "i").agg(F.sum("total").alias("total"))
    by = {(r["cluster"], r["i"]): int(r["total"]) for r in sums.collect()}
    shared.unpersist()
    return [[by[c, i + 1] // by[c, 0] for i in range(WIDTH)] if (c, 0) in by else old for c, old in enumerate(centroids)]


def cluster_vectors(
    df: DataFrame, clusters: int = 16, rounds: int = 3, factor: int = 64, salt: str = "1:", id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of 64 finite components.

    Vectors become floor(factor * x). The first centroids are the vectors with
    the smallest sha256 of salt and id, ties by id, then by components; where
    there are fewer vectors there are fewer centroids. Each round assigns all
    vectors to the nearest centroid (squared Euclid, ties to the smaller
    number) and moves it to the floor of their mean; a last assignment gives the
    result. Equal vectors share a cluster unless they are centroids of equal
    components, of which the first takes them all.

    Other vectors (null, of another width, with null or non-finite components)
    give no row; a null id counts as the empty text in the hash; repeated rows
    count each; an empty table gives no rows. Components beyond 2^62 after
    scaling are clipped there. A distance beyond 64 bits is null, and so are
    sums over it. Vectors are read once a round and never shuffled.
    """
    spark = df.sparkSession
    finite = F.forall(F.col(vector_col), lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where((F.size(vector_col) == WIDTH) & finite)
    drawn = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(drawn, "id", "v").limit(clusters).select("v").collect()
    centroids = [[int(e) for e in scaled(np.array([r["v"]], dtype=np.float64), factor)[0]] for r in first]
    for _ in range(rounds if centroids else 0):
        centroids = _moved(rows, centroids, factor)
    kind = rows.schema["id"].dataType
    schema = f"id {kind.simpleString()}, cluster int, distance long"
    if not centroids:
        centroids = [[0] * WIDTH]  # no row meets it
    shared = spark.sparkContext.broadcast(_packed(centroids))

    def assign(batches):
        for b in batches:
            where, far = _meet(_matrix(b.column(1), factor), shared.value)
            fits = [int(d) if d < 1 << 63 else None for d in far]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(where, pa.int32()), pa.array(fits, pa.int64())], names=["id", "cluster", "distance"])

    found = durable(rows.mapInArrow(assign, schema))
    whole = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")))
    inertia = {r["cluster"]: r["inertia"] for r in found.groupBy("cluster").agg(whole.alias("inertia")).collect()}
    fits = lambda s: int(s) if s is not None and s < 1 << 63 else None
    total = fits(None if None in inertia.values() else sum(inertia.values()))
    names = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    table = [Row(cluster=c, cluster_inertia=fits(inertia.get(c)), inertia=total, centroid_sha256=h) for c, h in enumerate(names)]
    table = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = found.join(F.broadcast(table), "cluster")  # one row a centroid
    return joined.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(clusters: int = 16, rounds: int = 3, factor: int = 64, salt: str = "1:") -> str:
    """The same clusters in DuckDB SQL, every distance computed in full; vec_id must be distinct."""
    parts = [
        f"""v as (select vec_id, list_transform(embedding, lambda e: floor({factor} * e::double)::bigint) x from embeddings
  where len(embedding) = {WIDTH} and len(list_filter(embedding, lambda e: e is null or not isfinite(e::double))) = 0)""",
        f"c0 as (select row_number() over (order by sha256('{salt}' || vec_id)) - 1 cluster, x from v order by sha256('{salt}' || vec_id) limit {clusters})",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} as (select vec_id, x, cluster, d from (select v.vec_id, v.x, c.cluster, d, row_number() over (partition by v.vec_id order by d, c.cluster) k
  from (select v.vec_id, c.cluster, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint d from v, c{r} c) p join v using (vec_id) join c{r} c using (cluster)) where k = 1)""")  # fmt: skip
        if r < rounds:
            parts.append(f"""c{r + 1} as (select c.cluster, coalesce(m.x, c.x) x from c{r} c left join (select cluster, list(m order by i) x from (
  select cluster, i, ((s - (((s % n) + n) % n)) // n)::bigint m from (select cluster, i, sum(e)::hugeint s, count(*)::hugeint n from (
  select cluster, unnest(x) e, unnest(range({WIDTH})) i from a{r}) group by cluster, i)) group by cluster) m using (cluster))""")  # fmt: skip
    return "with " + ",\n".join(parts) + f"""
select vec_id, cluster::int as "cluster", d as distance, (sum(d) over (partition by cluster))::bigint cluster_inertia, (sum(d) over ())::bigint inertia,
 sha256(array_to_string(c.x, ',')) centroid_sha256 from a{rounds} join c{rounds} c using (cluster)"""

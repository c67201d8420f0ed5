"""Exact inner-product search in buckets of vectors of about equal length.

Candidates are sorted by length and cut into buckets; queries into blocks. The
bucket of the longest vectors gives every query a first bound on its k-th
score. A block then visits only buckets whose length can reach a bound. In a
bucket, the bound over both lengths is a threshold on the cosine: where it is
high, vectors whose largest-query coordinates lie outside the feasible range
are dropped; where it is low, only those too short. What remains is verified
by integer products.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

#: Cosine threshold from which coordinates prune more than they cost, and how many are looked at.
COORDINATE_COSINE, COORDINATES = 0.55, 4
_BUCKET = "part int, chunk int, longest double, ids binary, data binary, width int"
_FOUND = "query_id long, vec_id long, score long"


def scale_vectors(df: DataFrame, id_col: str, vector_col: str, factor: float = 256.0) -> DataFrame:
    """(id, v array<long>, norm) of usable vectors: floor(factor * component).

    Rows with a null id or vector, or a null or non-finite component, take no part.
    """
    x = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    src = df.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull() & ~bad)
    src = src.select("id", F.transform("x", lambda e: F.floor(e * factor)).alias("v"))
    return src.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))))


def _pack(df: DataFrame, rows: int) -> DataFrame:
    """Runs of at most rows vectors of each partition, in its order, as packed matrices."""
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("longest", pa.float64()), ("ids", pa.binary()), ("data", pa.binary()), ("width", pa.int32())])

    def emit(part, chunk, ids, vectors):
        width = max(map(len, vectors))
        data = np.zeros((len(ids), width))
        for i, v in enumerate(vectors):
            data[i, : len(v)] = v
        longest = float(np.sqrt((data**2).sum(axis=1)).max())
        values = ([part], [chunk], [longest], [np.array(ids, dtype="<i8").tobytes()], [data.astype("<f8").tobytes()], [width])
        return pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(values, schema)], schema=schema)

    def run(batches):
        ids, vectors, part, chunk = [], [], 0, 0
        for b in batches:
            ids += b.column("id").to_pylist()
            vectors += b.column("v").to_pylist()
            part = b.column("part")[0].as_py() if b.num_rows else part
            while len(ids) >= rows:
                yield emit(part, chunk, ids[:rows], vectors[:rows])
                ids, vectors, chunk = ids[rows:], vectors[rows:], chunk + 1
        if ids:
            yield emit(part, chunk, ids, vectors)

    return df.withColumn("part", F.spark_partition_id()).select("part", "id", "v").mapInArrow(run, _BUCKET)


def _matrix(data: bytes, width: int, rows: int, pad: int) -> np.ndarray:
    out = np.zeros((rows, pad))
    out[:, :width] = np.frombuffer(data, "<f8").reshape(rows, width)
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of q and x; exact up to 63 bits."""
    bound = np.sqrt((q**2).sum(axis=1).max(initial=0.0)) * np.sqrt((x**2).sum(axis=1).max(initial=0.0))
    if bound < 2.0**52:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def feasible(q: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Range of each coordinate of unit vectors whose cosine with the unit vector q is t or more."""
    spread = np.sqrt(np.maximum((1 - q**2) * (1 - t * t), 0.0))
    return np.where(q <= -t, -1.0, q * t - spread), np.where(q >= t, 1.0, q * t + spread)


def search_bucket(q_ids, q, theta, x_ids, x, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and scores of at most k best of the bucket that reach theta.

    x is sorted by length, longest first.
    """
    q_norm, x_norm = np.sqrt((q**2).sum(axis=1)), np.sqrt((x**2).sum(axis=1))
    unit = x / np.maximum(x_norm, 1e-300)[:, None]
    reach = np.array([np.count_nonzero(qn * x_norm * (1 + 1e-9) >= t) if t > 0 else len(x) for qn, t in zip(q_norm, theta)])
    local = np.where(theta > 0, theta / np.maximum(q_norm * x_norm.max(initial=0.0), 1e-300), -1.0)
    whole = (local < COORDINATE_COSINE) & (reach > 0)
    out: list = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(q)

    def best(i, ids, scores):
        keep = (scores >= theta[i]) & (ids != q_ids[i])
        ids, scores = ids[keep], scores[keep]
        if len(ids) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            ids, scores = ids[scores >= least], scores[scores >= least]
        order = np.lexsort((ids, -scores))[:k]
        out[i] = ids[order], scores[order]

    at = np.flatnonzero(whole)
    if len(at):
        got = products(q[at], x[: reach[at].max()])
        for row, i in enumerate(at):
            best(i, x_ids[: reach[i]], got[row, : reach[i]])
    for i in np.flatnonzero(~whole & (reach > 0)):
        part = slice(0, reach[i])
        unit_q = q[i] / q_norm[i]
        low, high = feasible(unit_q, min(local[i], 1.0) - 1e-9)
        alive = np.arange(reach[i])
        for f in np.argsort(-np.abs(unit_q))[:COORDINATES]:
            c = unit[part][alive, f]
            alive = alive[(c >= low[f] - 1e-9) & (c <= high[f] + 1e-9)]
        if len(alive):
            best(i, x_ids[alive], products(q[i : i + 1], x[alive])[0])
    return out


def top_products(
    df: DataFrame, query_step: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", bucket_rows: int = 2048, block_rows: int = 512
) -> DataFrame:
    """The k best inner products of every query id divisible by query_step: (query_id, rank, vec_id, score).

    Candidates are all usable rows but those with the query's own id; ties go
    to the smaller id; fewer than k candidates are all returned. Vectors of
    different widths meet as if padded with zeros. Repeated rows count each.
    Blocks of queries meet buckets of candidates as packed matrices. The bucket
    of the longest vectors is broadcast (bucket_rows vectors) and sets each
    query's threshold; as buckets are in order of length, those that a block can
    still profit from are the first few, and only these meet it. The driver gets
    one length for each bucket.
    """
    base = durable(scale_vectors(df, id_col, vector_col))
    n = base.count()
    parts = max(1, -(-n // (bucket_rows * 4)))
    by_length = base.repartitionByRange(parts, F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id")
    buckets = durable(_pack(by_length, bucket_rows), blobs=True)
    query = base.where(F.pmod("id", F.lit(query_step)) == 0)
    blocks = _pack(query.repartition(max(1, -(-n // (query_step * block_rows))), "id"), block_rows)
    blocks = durable(blocks.select(F.struct("part", "chunk").alias("block"), F.col("ids").alias("q_ids"), F.col("data").alias("q"), F.col("width").alias("q_width"), F.col("longest").alias("q_longest")), blobs=True)
    spark = df.sparkSession
    heads = sorted((-r["longest"], r["part"], r["chunk"]) for r in buckets.select("part", "chunk", "longest").collect())
    if not heads:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = spark.createDataFrame([(p, c, i) for i, (_, p, c) in enumerate(heads)], "part int, chunk int, place int")
    _, part, chunk = heads[0]
    top = buckets.where((F.col("part") == part) & (F.col("chunk") == chunk)).select("ids", "data", "width").first()
    opening = spark.sparkContext.broadcast((bytes(top["ids"]), bytes(top["data"]), top["width"], np.array([-length for length, _, _ in heads])))
    buckets = buckets.drop("longest").join(order, ["part", "chunk"]).select("place", "ids", "data", "width")

    def sides(r):
        q_ids, x_ids = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["ids"], "<i8")
        pad = max(r["q_width"], r["width"])
        return q_ids, _matrix(r["q"], r["q_width"], len(q_ids), pad), x_ids, _matrix(r["data"], r["width"], len(x_ids), pad)

    def begin(batches):
        """Thresholds from the bucket of the longest vectors, and how many buckets by length a block then has to meet."""
        ids, data, width, lengths = opening.value
        for b in batches:
            for r in b.to_pylist():
                q_ids, q, x_ids, x = sides(r | {"ids": ids, "data": data, "width": width})
                found = search_bucket(q_ids, q, np.full(len(q_ids), -np.inf), x_ids, x, k)
                theta = np.array([float(s[-1]) if len(s) == k else -np.inf for _, s in found])
                reach = np.count_nonzero(lengths * r["q_longest"] * (1 + 1e-9) >= theta.min()) if theta.min() > 0 else len(lengths)
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]], b.schema.field("block").type), pa.array([theta.astype("<f8").tobytes()], pa.binary()), pa.array([reach], pa.int32())], names=["block", "theta", "reach"])

    def search(batches):
        for b in batches:
            for r in b.to_pylist():
                q_ids, q, x_ids, x = sides(r)
                found = search_bucket(q_ids, q, np.frombuffer(r["theta"], "<f8"), x_ids, x, k)
                sizes = [len(i) for i, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(q_ids, sizes), pa.int64()), pa.array(np.concatenate([i for i, _ in found]), pa.int64()), pa.array(np.concatenate([s for _, s in found]), pa.int64())],
                    names=["query_id", "vec_id", "score"],
                )

    theta = durable(blocks.mapInArrow(begin, "block struct<part:int,chunk:int>, theta binary, reach int"), blobs=True)
    pairs = theta.where("reach > 0").select("block", F.explode(F.sequence(F.lit(0), F.col("reach") - 1)).alias("place"))
    pairs = pairs.join(blocks.join(theta.drop("reach"), "block"), "block").join(buckets, "place")
    found = pairs.mapInArrow(search, _FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

"""Distances between intensity profiles of any length."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import durable

#: Ids whose pairs a task sums at once.
SLOTS = 1024


def resampled(profile: Column, points: int) -> Column:
    """A profile of any length at points equal steps from its first to its last value, by linear interpolation."""
    last = F.size(profile) - 1

    def at(i):
        x = i * last / F.lit(float(max(points - 1, 1)))
        low = F.least(F.floor(x).cast("int"), last)
        a, b = F.get(profile, low), F.get(profile, F.least(low + 1, last))
        return a + (b - a) * (x - low)

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)


def spectrum_matrix(points: int, sigma: float, coefficients: int) -> np.ndarray:
    """[2 coefficients, points]: real and imaginary parts of the first DFT coefficients of a profile smoothed along itself.

    Smoothing is by a Gaussian cut at 4 sigma, mirrored at the ends; both steps are linear.
    """
    smooth = np.eye(points)
    if sigma > 0:
        reach = int(4 * sigma + 0.5)
        w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
        w /= w.sum()
        smooth = np.zeros((points, points))
        for i in range(points):
            for o, x in zip(range(-reach, reach + 1), w):
                j = (i + o) % (2 * points)
                smooth[i, j if j < points else 2 * points - 1 - j] += x
    wave = np.exp(-2j * math.pi * np.outer(np.arange(coefficients), np.arange(points)) / points) @ smooth
    return np.concatenate([wave.real, wave.imag])


def profile_spectra(profiles: DataFrame, points: int = 16, sigma: float = 1.0, coefficients: int | None = None, value: str = "profile", log: bool = False) -> DataFrame:
    """Adds spectrum, the coefficients of each profile (array of numbers) as one vector; null for null or empty profiles."""
    coefficients = points // 2 + 1 if coefficients is None else coefficients
    x = F.transform(F.col(value).cast("array<double>"), lambda v: F.log1p(v) if log else v)
    rows = [F.array(*map(F.lit, r)) for r in spectrum_matrix(points, sigma, coefficients).tolist()]
    dot = lambda r: F.aggregate(F.zip_with("_x", r, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    out = profiles.withColumn("_x", F.when(F.size(value) > 0, resampled(x, points)))
    return out.withColumn("spectrum", F.when(F.col("_x").isNotNull(), F.array(*[dot(r) for r in rows]))).drop("_x")


def distance_between_profiles(profiles: DataFrame, key: list[str], id_col: str, points: int = 16, sigma: float = 1.0, coefficients: int | None = None, block_rows: int = 512) -> DataFrame:
    """(a, b, distance, n) for ids a < b: Euclidean distance of their spectra, a mean over the n groups that hold both.

    The result has a row for each pair by definition. Rows of a group are dealt
    into blocks, and pairs of blocks meet once each, so no group is gathered
    whole. A task sums over the groups that it meets before it gives pairs.
    """
    kinds = {f.name: f.dataType.simpleString() for f in profiles.schema}
    rows = profile_spectra(profiles, points, sigma, coefficients).where(F.col("spectrum").isNotNull()).select(*key, F.col(id_col).alias("id"), "spectrum")
    rows = durable(rows)
    sizes = rows.groupBy(*key).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_blocks"))
    rows = rows.join(sizes, key).withColumn("_mine", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.withColumn("_low", F.least("_mine", "_other")).withColumn("_second", F.col("_mine") > F.col("_other"))
    both = rows.groupBy(*key, "_low", F.greatest("_mine", "_other").alias("_high"))
    pairs = both.agg(F.sort_array(F.collect_list(F.struct("_second", "id", "spectrum"))).alias("rows"))
    pairs = pairs.select((F.col("_low") == F.col("_high")).alias("same"), "rows")

    id_type = to_arrow_type(profiles.schema[id_col].dataType)

    def run(batches):
        slot, sums = {}, None

        def told():
            i, j = np.nonzero(sums[1])
            names = pa.array(list(slot), id_type)
            for lo in range(0, len(i), 1 << 16):
                p, q = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
                columns = [names.take(pa.array(p)), names.take(pa.array(q)), pa.array(sums[0][p, q]), pa.array(sums[1][p, q].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "distance", "n"])

        for batch in batches:
            for k in range(batch.num_rows):
                rows = batch.column("rows")[k].values
                x = rows.field("spectrum").flatten().to_numpy().reshape(len(rows), -1)
                ids = rows.field("id").to_pylist()
                new = set(ids) - slot.keys()
                if sums is not None and len(slot) + len(new) > len(sums[0]):
                    yield from told()
                    slot, sums, new = {}, None, set(ids)
                if sums is None:
                    sums = np.zeros((2, max(SLOTS, len(new)), max(SLOTS, len(new))))
                for i in ids:
                    slot.setdefault(i, len(slot))
                at = np.array([slot[i] for i in ids])
                same = batch.column("same")[k].as_py()
                first = len(x) if same else len(x) - int(rows.field("_second").to_numpy(zero_copy_only=False).sum())
                for lo in range(0, first, 32):
                    mine = np.arange(lo, min(lo + 32, first))
                    others = np.arange(lo + 1 if same else first, len(x))
                    d = np.sqrt(((x[None, others] - x[mine, None]) ** 2).sum(axis=2))
                    i, j = np.nonzero(others[None, :] > mine[:, None])
                    p, q = at[mine[i]], at[others[j]]
                    np.add.at(sums[0], (p, q), d[i, j])
                    np.add.at(sums[1], (p, q), 1.0)
        if sums is not None:
            yield from told()

    kind = kinds[id_col]
    found = pairs.mapInArrow(run, f"a {kind}, b {kind}, distance double, n long")
    by = found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return by.agg((F.sum("distance") / F.sum("n")).alias("distance"), F.sum("n").alias("n"))

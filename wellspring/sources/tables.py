"""Reading and shaping of screen tables."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fields of an image file name, in order, and their pattern.
IMAGE_FIELDS = ("well_id", "time_point", "field_id", "time_line_id", "action_id", "z_stack_id", "channel_id")
IMAGE_PATTERN = r"_([A-Z]\d{2})_T(\d{4})F(\d{3})L(\d{2,3})A(\d{2})Z(\d{2,3})C(\d{2})\.tif$"
NUCLEI_DDL = "label int, cy double, cx double, area double, eccentricity double, intensity_mean_0 double, intensity_mean_1 double, intensity_mean_2 double, intensity_mean_3 double, major_axis_length double, minor_axis_length double"


def parse_image_names(files: DataFrame, file_col: str = "file") -> DataFrame:
    """Fields of image names as strings, and id = well and slice; other names are dropped."""
    found = files.where(F.col(file_col).rlike(IMAGE_PATTERN))
    for i, name in enumerate(IMAGE_FIELDS, 1):
        found = found.withColumn(name, F.regexp_extract(file_col, IMAGE_PATTERN, i))
    return found.withColumn("id", F.concat_ws("_", "well_id", "z_stack_id"))


def image_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog of the images under path; pixels are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").option("recursiveFileLookup", "true").load(path).drop("content")
    return parse_image_names(files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.regexp_replace("path", "/[^/]*$", "").alias("dir_images")))


def read_nuclei_features(spark: SparkSession, path: str, ddl: str = NUCLEI_DDL) -> DataFrame:
    """All {well}_{slice}.csv under path with well and slice from the file name; empty files give no rows."""
    df = spark.read.schema(ddl).option("header", "true").option("pathGlobFilter", "*.csv").csv(path)
    name = F.col("_metadata.file_name")
    return df.select("*", F.regexp_extract(name, r"([A-Z]\d{2})_(\d+)\.csv$", 1).alias("well_id"), F.regexp_extract(name, r"([A-Z]\d{2})_(\d+)\.csv$", 2).alias("z_stack_id"))


def join_features(neighbors: DataFrame, nuclei: DataFrame, keys=("plate_id", "well_id", "label", "z")) -> DataFrame:
    """Neighbour and nucleus features by label and slice: slices from 0, channels suffixed, intensities log1p."""
    a = neighbors.withColumnsRenamed({c: f"{c}_neighbors" for c in neighbors.columns if c.startswith("ch_0")})
    means = [c for c in nuclei.columns if c.startswith("intensity_mean_")]
    b = nuclei.withColumns({f"ch_0{int(c.rsplit('_', 1)[1]) + 1}_nuclei": F.log1p(c) for c in means}).drop(*means)
    return a.join(b, list(keys)).withColumn("z", F.col("z") - 1)


def centroids(df: DataFrame, z_step: float, pixel_size: float, min_area: float | None = None, keys=("plate_id", "well_id", "label")) -> DataFrame:
    """Means by label with z in pixels and the slice kept as z_init; small labels go if min_area is given."""
    values = [c for c in df.columns if c not in keys]
    df = df.withColumn("z_init", F.col("z")).withColumn("z", F.col("z") / F.lit(float(pixel_size)) * z_step)
    out = df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in [*values, "z_init"]])
    return out if min_area is None else out.where(F.col("area") > min_area)


def registered_view(df: DataFrame, side: str) -> DataFrame:
    """Columns of one side (source or target) of a registration without the prefix; z back to slices from 1."""
    names = {c: c[len(side) + 1 :] for c in df.columns if c.startswith(side + "_")}
    out = df.select(*[F.col(c).alias(n) for c, n in names.items()])
    return out.withColumn("z", (F.col("z") * 0.322 / 10).cast("int") + 1) if "z" in out.columns else out


def select_channels(df: DataFrame, channels: list[str]) -> DataFrame:
    """Drops columns of channels that are not asked for."""
    return df.select(*[c for c in df.columns if not c.startswith("ch_") or c.split("_")[1] in channels])


def plate_layout(df: DataFrame, row: str = "plateRow", column: str = "plateColumn") -> DataFrame:
    """Adds the row letter and the well id."""
    letter = F.char(F.col(row) + 64)
    return df.withColumn("row_letter", letter).withColumn("well_id", F.concat(letter, F.lpad(F.col(column).cast("string"), 2, "0"))).orderBy("well_id")


def wide_layout_to_long(df: DataFrame, row: str, kind: str = "double") -> DataFrame:
    """A plate map of rows by columns as (row, column, value, well_id)."""
    cols = [c for c in df.columns if c != row]
    out = df.select(row, *[F.col(f"`{c}`").cast(kind).alias(c) for c in cols]).unpivot(row, cols, "column", "value")
    out = out.withColumn("column", F.lpad("column", 2, "0"))
    return out.withColumn("well_id", F.concat(row, "column"))


def plate_metadata(layout: DataFrame, plates: DataFrame) -> DataFrame:
    """Every layout row for every plate, as strings; the layout of one plate is small."""
    out = plates.join(F.broadcast(layout))
    return out.select(*[F.col(c).cast("string").alias(c) for c in out.columns])


def plate_rows(df: DataFrame) -> DataFrame:
    """Rows of a plate's wells with id = label_well_plate."""
    return df.withColumn("id", F.concat_ws("_", F.col("label").cast("string"), "well_id", F.col("plate_id").cast("string")))


def load_plate(spark: SparkSession, path: str, plate: str, ddl: str) -> DataFrame:
    """All {well}_registration.csv of a plate as one table, with well_id from the file name; empty files give no rows."""
    df = spark.read.csv(f"{path}/*_registration.csv", schema=ddl, header=True)
    well = F.regexp_extract(F.input_file_name(), r"([^/]+)_registration\.csv$", 1)
    return plate_rows(df.withColumn("well_id", well).withColumn("plate_id", F.lit(plate)))


def multi_patient_layout(patients: DataFrame, drugs: DataFrame, lookup: DataFrame, meta: DataFrame, row: str = "row") -> DataFrame:
    """Wells of a map of patient and fibroblast pairs, with what is known of pair and patient, and the drug of the well."""
    p = wide_layout_to_long(patients, row, "string").withColumnRenamed("value", "cancer_x_caf")
    d = wide_layout_to_long(drugs, row, "string").withColumnRenamed("value", "drug").select("well_id", "drug")
    return p.join(lookup, "cancer_x_caf", "left").join(meta, "cancer", "left").join(d, "well_id", "left")


def transpose_wide(df: DataFrame, key: str, values: list) -> DataFrame:
    """Columns become rows: (name, one column for each of the key's values)."""
    cols = [c for c in df.columns if c != key]
    return df.unpivot(key, cols, "name", "value").groupBy("name").pivot(key, values).agg(F.first("value"))


def unprocessed(meta: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of meta that the ledger does not hold."""
    return meta.join(ledger.select(*keys).distinct(), keys, "left_anti")


def drop_bad(df: DataFrame, qc: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose well the quality table does not call bad."""
    return df.join(qc.where("decision = 'bad'").select(*keys), keys, "left_anti")


def write_features(df: DataFrame, path: str, by: list[str], mode: str = "append") -> None:
    """Feature tables as Parquet, one folder for each plate and modality."""
    df.write.mode(mode).partitionBy(*by).parquet(path)


def patch_in_bounds(df: DataFrame, size: int, width: int, height: int) -> DataFrame:
    """Positions whose patch lies inside the image."""
    h = size / 2
    return df.where((F.col("x") >= h) & (F.col("y") >= h) & (F.col("x") + h <= width) & (F.col("y") + h <= height))


def cut_open(df: DataFrame, keys: list[str]) -> DataFrame:
    """Drops the quadrant beyond the centre of each group."""
    w = Window.partitionBy(*keys)
    out = df.withColumn("_x", F.avg("x").over(w)).withColumn("_y", F.avg("y").over(w))
    return out.where(~((F.col("x") > F.col("_x")) & (F.col("y") > F.col("_y")))).drop("_x", "_y")


def control_relabel(df: DataFrame, control: str = "DMSO") -> DataFrame:
    """Concentration 0 is the control, and the control's concentration 0; adds the condition."""
    df = df.withColumn("compound", F.when(F.col("conc") == 0, control).otherwise(F.col("compound")))
    df = df.withColumn("conc", F.when(F.col("compound") == control, 0).otherwise(F.col("conc")))
    return df.withColumn("condition", F.concat_ws("_", "compound", "conc", "timepoint"))


def feature_taxonomy(df: DataFrame, name: str = "feature") -> DataFrame:
    """Type, kernel size and scope of a feature from its name."""
    c = F.col(name)
    kind = F.when(c.contains("interaction"), "interaction").when(c.contains("degree"), "degree").when(c.contains("moran"), "autocorrelation")
    kind = kind.when(c.contains("hull"), "morphology").otherwise("intensity")
    kernel = F.regexp_extract(c, "_(25|50|100|150)$", 1)
    return df.withColumn("type", kind).withColumn("kernel", F.when(kernel != "", kernel).cast("int")).withColumn("scope", F.when(kernel != "", "local").otherwise("whole"))


def significance_stars(p: Column) -> Column:
    return F.when(p <= 0.001, "***").when(p <= 0.01, "**").when(p <= 0.05, "*").otherwise("ns")


def prefix_to_suffix(name: Column, sep: str = "_") -> Column:
    """The first word goes last."""
    parts = F.split(name, sep)
    return F.concat_ws(sep, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.slice(parts, 1, 1))


def suffix_to_prefix(name: Column, sep: str = "_") -> Column:
    """The last word goes first."""
    parts = F.split(name, sep)
    return F.concat_ws(sep, F.slice(parts, -1, 1), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))


def distinct_features(long: DataFrame, id_col: str) -> DataFrame:
    """Of features with equal values everywhere the first by name; constant features go."""
    sums = long.groupBy("feature").agg(
        F.sum(F.xxhash64(id_col, "value").cast("decimal(38,0)")).alias("h"), F.count_distinct("value").alias("n")
    )
    keep = sums.where("n > 1").groupBy("h").agg(F.min("feature").alias("feature"))
    return keep.select("feature")


def merge_cycles(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both cycles by key, their values suffixed."""
    a = source.withColumnsRenamed({c: f"{c}_source" for c in source.columns if c not in keys})
    b = target.withColumnsRenamed({c: f"{c}_target" for c in target.columns if c not in keys})
    return a.join(b, keys)


def contrast_pairs(df: DataFrame, keys: list[str], group: str, control: str) -> DataFrame:
    """Every row that is no control beside its control of the same keys."""
    values = [c for c in df.columns if c not in (*keys, group)]
    c = df.where(F.col(group) == control).select(*keys, *[F.col(v).alias(f"{v}_control") for v in values])
    return df.where(F.col(group) != control).join(c, keys)


def explode_list(df: DataFrame, col: str, sep: str) -> DataFrame:
    """One row for each entry of a separated list."""
    return df.withColumn(col, F.explode(F.split(F.col(col), sep)))


def row_mean(*cols) -> Column:
    """Mean of the values that are not null."""
    cols = [F.col(c) if isinstance(c, str) else c for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols])
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.when(n > 0, total / n)


def gene_ranks(df: DataFrame) -> DataFrame:
    """Genes by their compounds' mean distance, largest first, with ranks; (genes array, distance) in."""
    g = df.select(F.explode("genes").alias("gene"), "distance").groupBy("gene").agg(F.sum("distance").alias("total"), F.count("*").alias("n"))
    score = F.col("total") / F.col("n")
    return g.withColumn("score", score).withColumn("rank", F.rank().over(Window.orderBy(F.desc("score"))))


KERNEL_DISTANCES = "well_id string, label string, distance double, plate_id string, radius int"


def write_kernel_distances(df: DataFrame, path: str, files: int = 16) -> None:
    """Distances (plate_id, well_id, radius, label, distance) as Parquet, one folder for each plate and radius.

    A run replaces the folders that it has rows for and leaves the others, so a
    plate can be computed again. Wells of a folder are dealt over at most files
    files and sorted, so a filter on wells skips row groups.
    """
    part = F.pmod(F.xxhash64("well_id"), F.lit(files))
    rows = df.select("plate_id", "well_id", F.col("radius").cast("int").alias("radius"), "label", F.col("distance").cast("double").alias("distance"))
    rows = rows.repartition("plate_id", "radius", part).sortWithinPartitions("plate_id", "radius", "well_id")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("plate_id", "radius").parquet(path)


def load_kernel_distances(spark: SparkSession, path: str, plates: list[str] | None = None, radii: list[int] | None = None) -> DataFrame:
    """What write_kernel_distances stored; plates and radii given are the only folders read. A missing path raises."""
    df = spark.read.schema(KERNEL_DISTANCES).parquet(path)
    if plates is not None:
        df = df.where(F.col("plate_id").isin(plates))
    return df if radii is None else df.where(F.col("radius").isin(radii))

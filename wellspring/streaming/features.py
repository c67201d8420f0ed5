"""Feature files as they arrive: counts and intensity means by plate and well, kept up to date."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a feature file holds of each nucleus.
SCHEMA = "plate_id string, well_id string, label long, intensity double"


def summarize(df: DataFrame) -> DataFrame:
    """Mergeable sums by plate and well; null intensities count as nuclei but not in the mean."""
    return df.groupBy("plate_id", "well_id").agg(F.count("*").alias("n"), F.count("intensity").alias("n_intensity"), F.sum("intensity").alias("total"))


def stream_plate_features(spark: SparkSession, source: str, state: str, checkpoint: str, schema: str = SCHEMA):
    """Start a query that adds each batch of new Parquet files under source to the table at state.

    A batch writes its sums to its own folder state/batch=N, replacing what an
    earlier attempt at the same batch left, so a restart counts no file twice. Reading
    with read_plate_features adds the batches up. The key is (plate, well), so no
    watermark is needed.
    """

    def put(batch: DataFrame, number: int) -> None:
        summarize(batch).write.mode("overwrite").parquet(f"{state}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_plate_features(spark: SparkSession, state: str) -> DataFrame:
    """(plate_id, well_id, n, mean_intensity) over all batches so far."""
    df = spark.read.parquet(state)
    out = df.groupBy("plate_id", "well_id").agg(F.sum("n").alias("n"), F.sum("n_intensity").alias("k"), F.sum("total").alias("total"))
    return out.select("plate_id", "well_id", "n", F.when(F.col("k") > 0, F.col("total") / F.col("k")).alias("mean_intensity"))

"""Session settings and lineage cuts that hold on a cluster and in tests."""

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DataType, MapType, NullType, StructType


def build_session(app: str = "wellspring", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution and UTC time; settings given win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**base, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: Shuffle files of a query go when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes that a task gathers of a Parquet row group before it writes.
ROW_GROUP = 32 << 20
#: Local folders made where spark.checkpoint.dir is unset, by application.
_LOCAL: dict[str, str] = {}


def run_folder(spark: SparkSession) -> str:
    """The folder of this application under spark.checkpoint.dir, which driver and executors share.

    Where that is unset and the master is local (tests, a laptop) it is a
    temporary folder.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return f"{named.rstrip('/')}/wellspring-{sc.applicationId}"
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="spark-wellspring-", dir="/tmp")
        atexit.register(_forget, spark, _LOCAL[sc.applicationId])
    return _LOCAL[sc.applicationId]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _forget(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:
        _delete(spark, folder)


def _storable(kind: DataType) -> bool:
    """Whether Parquet holds this type: no void, and no two fields of a struct whose names differ by case at most."""
    if isinstance(kind, StructType):
        return len({f.name.lower() for f in kind}) == len(kind) > 0 and all(_storable(f.dataType) for f in kind)
    if isinstance(kind, ArrayType):
        return _storable(kind.elementType)
    if isinstance(kind, MapType):
        return _storable(kind.keyType) and _storable(kind.valueType)
    return not isinstance(kind, NullType)


def durable(df: DataFrame, replaces: tuple = (), blobs: bool = False) -> DataFrame:
    """Cut the lineage of df: write it as Parquet into the shared run folder and read it back.

    The result survives lost executors, and Spark sees its true size: a
    checkpoint would keep the size estimate of the plan it came from, and in
    iterative jobs such estimates multiply. Once written, what df was shuffled
    from is not needed again and its files go; so do the tables in replaces
    (earlier results of durable that nothing reads any more). Other tables stay
    until release() or the end of the application's folder. Column names may be
    any. Types that Parquet does not hold are checkpointed, and so are rows of
    blobs, of which a columnar reader would hold thousands at a time.
    """
    spark, names = df.sparkSession, df.columns
    before = spark.conf.get(CLEAN)
    spark.conf.set(CLEAN, "true")
    try:
        plain = df.toDF(*[f"c{i}" for i in range(len(names))])
        if blobs or not names or not _storable(plain.schema):
            sc = spark.sparkContext
            if sc._jsc.sc().getCheckpointDir().isEmpty():
                sc.setCheckpointDir(run_folder(spark))
            out = df.select("*").checkpoint(eager=True)
        else:
            folder = f"{run_folder(spark)}/{uuid.uuid4().hex}"
            plain.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(folder)
            out = spark.read.schema(plain.schema).parquet(folder).toDF(*names)
            out._durable_folder = folder
    finally:
        spark.conf.set(CLEAN, before)
    release(*replaces)
    return out


def release(*frames: DataFrame) -> None:
    """Delete the tables behind results of durable; nothing that is still to run may read them."""
    for df in frames:
        folder = getattr(df, "_durable_folder", None)
        if folder:
            _delete(df.sparkSession, folder)

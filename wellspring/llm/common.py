"""Helpers that the text operators share."""

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
ASCII_SPACE = "\t\n\x0b\x0c\r "
#: Characters of text that a task holds in parsed form at a time.
CHUNK_CHARS = 1 << 20


@contextmanager
def arrow_bytes(spark: SparkSession, most: int):
    """Actions within get Arrow batches of about most bytes, for rows that are large blobs."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def id_bucket(col: str | Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo buckets; a null id counts as the empty text."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % buckets


def text_chunks(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about limit characters together; a longer text stands alone."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def batch_chunks(texts: pa.Array, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """The bounds that text_chunks gives, of a column of an Arrow batch, before any text of it is a Python object."""
    size = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).tolist()
    lo = held = 0
    for i, n in enumerate(size):
        if i > lo and held + n > limit:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(size):
        yield lo, len(size)


def map_text_chunks(df: DataFrame, fn: Callable, schema: str, text: str) -> DataFrame:
    """Apply fn to small runs of rows in each task.

    fn gets a dict of lists by column name (texts are str or None) and returns
    a dict of columns (lists or numpy arrays) named as in schema. Rows out need
    not match rows in.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    want = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for lo, hi in batch_chunks(batch.column(text)):
                out = fn({n: batch.column(n).slice(lo, hi - lo).to_pylist() for n in batch.schema.names})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type, from_pandas=True) for f in want], schema=want
                )
                out = None
                pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def beside(df: DataFrame, fn: Callable, schema: str, text: str) -> DataFrame:
    """Rows of df as struct column row, and beside it the columns of schema that fn gives for lists of whole texts.

    The row goes through as it is, so a verdict needs no key and no join, and
    names of df may be any. fn gets a list of str or None.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    fields = StructType.fromDDL(schema)
    want = to_arrow_schema(fields)
    at = df.columns.index(text)

    def run(batches):
        for batch in batches:
            row = batch.column(0)
            texts = row.field(at).to_pylist()
            for lo, hi in text_chunks(texts):
                out = fn(texts[lo:hi])
                columns = [pa.array(out[f.name], type=f.type, from_pandas=True) for f in want]
                yield pa.RecordBatch.from_arrays([row.slice(lo, hi - lo), *columns], names=["row", *want.names])

    return df.select(F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("row")).mapInArrow(run, StructType([StructField("row", df.schema), *fields]))

from pyspark.sql import functions as F

from wellspring.session import durable, release


def estimate(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_estimates_stay_bounded_over_rounds(spark):
    x = durable(spark.range(1000).select("id", (F.col("id") % 7).alias("g")))
    for _ in range(20):
        y = x.groupBy("g").agg(F.max("id").alias("m"))
        x = durable(x.join(y, "g").select("id", ((F.col("g") + F.col("m")) % 7).alias("g")), replaces=(x,))
    assert x.count() == 1000
    assert estimate(x) < 1 << 20


def test_any_names_and_types_go_through(spark):
    odd = spark.sql("select 1 as A, 2 as `a`, 3 as `x y`, null as nothing, named_struct('b', 1, 'B', 2) s, array(1, null) l")
    assert durable(odd).collect() == odd.collect()
    plain = spark.sql("select 1 as A, 2 as `a`, 3 as `x.y;`, named_struct('b', map('k', 1)) s")
    assert durable(plain).collect() == plain.collect() and durable(plain).columns == plain.columns
    assert durable(spark.sql("select 1 a where false")).collect() == []


def test_release_deletes_only_what_is_given(spark):
    a, b = durable(spark.range(5)), durable(spark.range(7))
    release(a)
    assert b.count() == 7
    assert durable(spark.range(3), blobs=True).count() == 3

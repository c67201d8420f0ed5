"""Views over the driver's star-schema tables that have the shape of screen tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K = ["plate_id", "well_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nuclei(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per nucleus, from lineitem; labels are unique from 60 000 rows on."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey) label",
        "concat('00', cast(case when l_linestatus = 'F' then 5 else 4 end as string)) plate_id",
        "concat(chr(65 + (l_orderkey % 8)), lpad(cast(1 + (l_orderkey % 6) as string), 2, '0')) well_id",
        "l_linenumber z_slice",
        "cast(l_linenumber as double) / cast(0.322 as double) * 10 z",
        "cast((l_partkey * 7919 + l_orderkey * 31) % 1000 as double) x",
        "cast((l_suppkey * 104729 + l_orderkey * 17) % 1000 as double) y",
        "cast((l_partkey + l_suppkey) % 5 as int) leiden",
        "l_quantity f1", "l_extendedprice f2", "l_discount f3", "l_tax f4",
    )


def wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per well with a compound, a concentration, a time point and four features."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "concat('W', o_orderkey) well_id", "o_orderstatus plate_id",
        "case when o_orderpriority like '1%' then 'DMSO' else o_orderpriority end compound",
        "o_orderkey % 3 conc", "month(o_orderdate) % 3 timepoint", "o_totalprice f1", "c_acctbal f2",
        "cast(o_custkey % 97 as double) f3", "cast((o_orderkey * 37) % 101 as double) f4",
    )


#: Rows of part whose pixels one task makes, on average.
PARTS = 4000


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intensity and label of every pixel of images of 50 by 25.

    A row of part takes a few bytes and makes 25 pixels, so the file's own splits
    would leave all pixels to few tasks: keys are dealt before pixels are made.
    """
    part, nation = table(spark, sf_dir, "part").select("p_partkey"), table(spark, sf_dir, "nation").select("n_nationkey")
    part = part.repartition(-(-part.count() // PARTS) or 1, F.expr("p_partkey div 50"))
    rows = F.broadcast(nation.groupBy().agg(F.sort_array(F.collect_list("n_nationkey")).alias("ys")))
    return part.select("p_partkey").join(rows).select("p_partkey", F.explode("ys").alias("n_nationkey")).selectExpr(
        "p_partkey div 50 img", "cast((p_partkey div 50) % 4 as int) z", "cast(((p_partkey div 50) div 4) % 2 as int) ch",
        "cast((p_partkey div 50) div 8 as int) well", "cast(p_partkey % 50 as int) x", "n_nationkey y",
        "cast((p_partkey * 131 + n_nationkey * 977) % 4096 as int) v",
        "cast(case when p_partkey % 50 % 7 = 6 or n_nationkey % 5 = 4 then 0 "
        "else (p_partkey % 50 div 7) * 5 + (n_nationkey div 5) + 1 end as int) label",
    )


#: The same views in DuckDB SQL, to stand before an oracle's select.
SQL = {
    "nuclei": """nuclei as (select concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey) label,
 concat('00', cast(case when l_linestatus = 'F' then 5 else 4 end as varchar)) plate_id,
 concat(chr(cast(65 + (l_orderkey % 8) as int)), lpad(cast(1 + (l_orderkey % 6) as varchar), 2, '0')) well_id,
 l_linenumber z_slice, cast(l_linenumber as double) / cast(0.322 as double) * 10 z,
 cast((l_partkey * 7919 + l_orderkey * 31) % 1000 as double) x, cast((l_suppkey * 104729 + l_orderkey * 17) % 1000 as double) y,
 cast((l_partkey + l_suppkey) % 5 as int) leiden, l_quantity f1, l_extendedprice f2, l_discount f3, l_tax f4 from lineitem)""",
    "wells": """wells as (select concat('W', o_orderkey) well_id, o_orderstatus plate_id,
 case when o_orderpriority like '1%' then 'DMSO' else o_orderpriority end compound,
 o_orderkey % 3 conc, month(o_orderdate) % 3 timepoint, o_totalprice f1, c_acctbal f2,
 cast(o_custkey % 97 as double) f3, cast((o_orderkey * 37) % 101 as double) f4 from orders join customer on o_custkey = c_custkey)""",
    "pixels": """pixels as (select p_partkey // 50 img, cast((p_partkey // 50) % 4 as int) z, cast(((p_partkey // 50) // 4) % 2 as int) ch,
 cast((p_partkey // 50) // 8 as int) well, cast(p_partkey % 50 as int) x, n_nationkey y,
 cast((p_partkey * 131 + n_nationkey * 977) % 4096 as int) v,
 cast(case when p_partkey % 50 % 7 = 6 or n_nationkey % 5 = 4 then 0
 else (p_partkey % 50 // 7) * 5 + (n_nationkey // 5) + 1 end as int) label from part cross join nation)""",
}
SQL["binned"] = SQL["nuclei"] + """,
 binned as (select *, floor(x / 25) gx, floor(y / 25) gy, floor(z / 25) gz from nuclei),
 near as (select *, unnest([gx - 1, gx, gx + 1]) cx from binned),
 near2 as (select *, unnest([gy - 1, gy, gy + 1]) cy from near),
 near3 as (select *, unnest([gz - 1, gz, gz + 1]) cz from near2),
 edges as (select a.plate_id, a.well_id, a.label src, b.label dst, a.leiden src_cl, b.leiden dst_cl, b.f1 dst_f1,
   sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) dist
   from near3 a join binned b on a.plate_id = b.plate_id and a.well_id = b.well_id and a.cx = b.gx and a.cy = b.gy and a.cz = b.gz
   and a.label <> b.label and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 625)"""

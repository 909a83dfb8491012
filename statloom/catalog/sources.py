"""Queries for reading, writing, loading and rebuilding tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.catalog.registry import query, rounded, scratch, table
from statloom.functions.numeric import decimals_to_double
from statloom.sources import files

_CUSTOMER = T.StructType(
    [
        T.StructField("c_custkey", T.LongType()),
        T.StructField("c_name", T.StringType()),
        T.StructField("c_nationkey", T.IntegerType()),
        T.StructField("c_acctbal", T.DoubleType()),
        T.StructField("c_mktsegment", T.StringType()),
    ]
)


@query(
    "s01_csv_scan",
    "SELECT cast(c_custkey AS varchar) AS c_custkey, c_name, cast(c_nationkey AS varchar) AS c_nationkey, c_mktsegment FROM customer",
)
def s01(spark, sf):
    path = scratch(spark, "customer.csv")
    files.write_table(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), path, fmt="csv")
    return files.read_table(spark, path)


@query("s02_read_source", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def s02(spark, sf):
    folder = scratch(spark, "raw")
    files.write_table(table(spark, sf, "supplier"), f"{folder}/supplier.parquet")
    return files.read_source(spark, folder, "supplier")


@query("s03_write_sorted", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def s03(spark, sf):
    path = scratch(spark, "orders")
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    files.write_table(df, path, ["o_orderkey"])
    return spark.read.parquet(path)


@query(
    "s04_load_declared",
    "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer",
)
def s04(spark, sf):
    path = scratch(spark, "customer.txt")
    # Columns in another order than declared, ';' as separator and '-' for a missing value.
    df = table(spark, sf, "customer").select(
        "c_mktsegment", "c_acctbal", "c_name", F.col("c_nationkey"), "c_custkey"
    ).withColumn("c_acctbal", F.when(F.col("c_acctbal") < 0, "-").otherwise(F.col("c_acctbal").cast("string")))
    df.write.option("header", True).option("sep", ";").csv(path)
    return files.load_declared(spark, path, _CUSTOMER, sep=";", null_token="-")


@query(
    "s05_restore_integers",
    "SELECT l_orderkey, cast(l_quantity AS bigint) AS l_quantity, l_discount FROM lineitem",
)
def s05(spark, sf):
    return files.restore_integers(table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_discount"))


@query(
    "s06_ordered_load",
    """SELECT 'customer' AS "table", count(*) AS "rows", 'loaded' AS status FROM customer
    UNION ALL SELECT 'orders', 0, 'missing'""",
)
def s06(spark, sf):
    folder = scratch(spark, "load")
    files.write_table(table(spark, sf, "customer"), f"{folder}/customer.csv", fmt="csv")
    _, report = files.load_all(spark, folder, {"customer": _CUSTOMER}, ["customer", "orders"])
    return report


@query(
    "s07_layered_rebuild",
    """SELECT n_name, n_customers, balance FROM (SELECT n_name, count(*) AS n_customers, round(sum(c_acctbal), 2) AS balance
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name) WHERE n_customers > 0""",
)
def s07(spark, sf):
    base = {n: table(spark, sf, n) for n in ("customer", "nation")}
    steps = [
        ("named", lambda t: t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))),
        (
            "by_nation",
            lambda t: t["named"].groupBy("n_name").agg(F.count(F.lit(1)).alias("n_customers"), F.round(F.sum("c_acctbal"), 2).alias("balance")),
        ),
    ]
    return files.rebuild(spark, scratch(spark, "layer"), steps, base, protected=[sf])["by_nation"]


@query(
    "s09_parameter_query",
    """SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
    WHERE o_totalprice BETWEEN 1000 AND 200000 AND o_orderstatus = 'F' GROUP BY 1""",
)
def s09(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("s09_orders")
    return files.run_query(
        spark,
        """SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM s09_orders
        WHERE o_totalprice BETWEEN :low AND :high AND o_orderstatus = :status GROUP BY o_orderpriority""",
        {"low": 1000, "high": 200000, "status": "F"},
    )


@query("s10_execute_ddl", "SELECT p_brand, count(*) AS n FROM part WHERE p_size >= 25 GROUP BY p_brand")
def s10(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("s10_part")
    files.execute_ddl(spark, "CREATE OR REPLACE TEMP VIEW s10_large AS SELECT * FROM s10_part WHERE p_size >= 25")
    return spark.sql("SELECT p_brand, count(*) AS n FROM s10_large GROUP BY p_brand")


@query("s11_decimals_to_double", "SELECT s_suppkey, round(cast(s_acctbal AS decimal(12,1))::double, 6) AS s_acctbal FROM supplier")
def s11(spark, sf):
    df = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").cast("decimal(12,1)"))
    return rounded(decimals_to_double(df))

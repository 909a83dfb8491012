"""Queries for the relational operators of the analyses (Q1-Q30)."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.catalog.registry import longs, query, rounded, table
from statloom.functions.numeric import safe_ratio
from statloom.operators import relational as R
from statloom.operators.compare import compare_groups, per_group
from statloom.operators.ranks import smallest_gap


@query(
    "q01_coverage_report",
    """SELECT 'orders' AS relation, count(*) AS n_rows, min(year(o_orderdate)) AS first_period, max(year(o_orderdate)) AS last_period, count(DISTINCT o_custkey) AS n_entities FROM orders
    UNION ALL SELECT 'lineitem', count(*), min(year(l_shipdate)), max(year(l_shipdate)), count(DISTINCT l_suppkey) FROM lineitem
    UNION ALL SELECT 'customer', count(*), NULL, NULL, count(DISTINCT c_custkey) FROM customer
    UNION ALL SELECT 'region', count(*), NULL, NULL, NULL FROM region""",
)
def q01(spark, sf):
    orders = table(spark, sf, "orders").withColumn("season", F.year("o_orderdate"))
    lines = table(spark, sf, "lineitem").withColumn("season", F.year("l_shipdate"))
    return R.coverage_report(
        {
            "orders": (orders, "season", "o_custkey"),
            "lineitem": (lines, "season", "l_suppkey"),
            "customer": (table(spark, sf, "customer"), None, "c_custkey"),
            "region": (table(spark, sf, "region"), None, None),
        }
    )


@query(
    "q02_distinct_rows",
    "SELECT count(*) AS n_pairs FROM (SELECT DISTINCT d.lang, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)",
)
def q02(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return df.agg(R.count_distinct_rows("lang", "quality").alias("n_pairs"))


@query(
    "q03_filtered_aggregates",
    """SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 200000) AS n_large, count(DISTINCT o_custkey) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent_customers,
    round(avg(o_totalprice) FILTER (WHERE o_orderpriority <> '5-LOW'), 4) AS mean_price FROM orders GROUP BY 1""",
)
def q03(spark, sf):
    c = F.col
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.count_if(c("o_totalprice") > 200000).alias("n_large"),
        F.countDistinct(F.when(c("o_orderpriority") == "1-URGENT", c("o_custkey"))).alias("n_urgent_customers"),
        F.round(F.avg(F.when(c("o_orderpriority") != "5-LOW", c("o_totalprice"))), 4).alias("mean_price"),
    )


@query(
    "q04_missing_report",
    """SELECT lang, count(*) AS n_rows, count(quality) AS n_known, count(*) - count(quality) AS n_missing, round(100.0::double * (count(*) - count(quality)) / count(*), 1) AS pct_missing
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""",
)
def q04(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return R.missing_report(df, "lang", "quality")


@query(
    "q05_between_or",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 AND (o_orderpriority = '1-URGENT' OR o_totalprice >= 300000)",
)
def q05(spark, sf):
    c = F.col
    years = c("o_orderdate").between("1996-01-01", "1998-12-31 23:59:59.999999")
    return table(spark, sf, "orders").filter(years & ((c("o_orderpriority") == "1-URGENT") | (c("o_totalprice") >= 300000))).select("o_orderkey", "o_totalprice")


@query("q06_top_by_stored_rank", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber <= 2")
def q06(spark, sf):
    return longs(table(spark, sf, "lineitem").filter("l_linenumber <= 2").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).withColumn(
        "l_linenumber", F.col("l_linenumber").cast("int")
    )


@query(
    "q07_points_rank",
    """SELECT o_orderkey, year(o_orderdate) AS season, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) AS points_rank FROM orders""",
)
def q07(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("season"), "o_totalprice")
    return R.rank_within(df, ["season"], "o_totalprice", ["o_orderkey"]).select("o_orderkey", "season", "points_rank")


@query(
    "q08_prededuplicated_join",
    "SELECT c_custkey, c_name, last_year FROM customer JOIN (SELECT o_custkey, max(year(o_orderdate)) AS last_year FROM orders GROUP BY 1) ON o_custkey = c_custkey",
)
def q08(spark, sf):
    last = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.year("o_orderdate")).cast("long").alias("last_year"))
    customer = table(spark, sf, "customer")
    return customer.join(last, customer.c_custkey == last.o_custkey).select("c_custkey", "c_name", "last_year")


_SPEND = "spend AS (SELECT o_custkey, sum(o_totalprice) AS total, bool_or(o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1)"


def _spend(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.sum("o_totalprice").alias("total"), F.max(F.col("o_orderpriority") == "1-URGENT").alias("urgent")
    )


@query(
    "q09_overlapping_populations",
    f"""WITH {_SPEND} SELECT population, count(*) AS n, round(avg(total), 2) AS mean_total FROM (
    SELECT 'big spender' AS population, total FROM spend WHERE total > 2500000 UNION ALL SELECT 'urgent', total FROM spend WHERE urgent) GROUP BY 1""",
)
def q09(spark, sf):
    labelled = R.label_populations(_spend(spark, sf), {"big spender": F.col("total") > 2500000, "urgent": F.col("urgent")})
    return labelled.groupBy("population").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("total"), 2).alias("mean_total"))


@query(
    "q10_multi_join",
    """WITH recent AS (SELECT o_custkey, max(o_orderdate) AS last_date FROM orders WHERE year(o_orderdate) BETWEEN 1997 AND 2000 GROUP BY 1)
    SELECT c_custkey, n_name, r_name, last_date FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN recent ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""",
)
def q10(spark, sf):
    customer, nation, region = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    orders = table(spark, sf, "orders").filter(F.col("o_orderdate").between("1997-01-01", "2000-12-31 23:59:59.999999"))
    recent = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_date"))
    df = customer.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    df = df.join(nation, df.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    return df.join(recent, df.c_custkey == recent.o_custkey, "left").select("c_custkey", "n_name", "r_name", "last_date")


@query(
    "q11_semi_join",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)",
)
def q11(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    chosen = orders.filter("o_totalprice > 480000").select("o_custkey")
    return orders.join(chosen, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query(
    "q12_set_composition",
    """WITH f AS (SELECT o_custkey, o_totalprice > 300000 AS a, o_orderpriority = '1-URGENT' AS b FROM orders)
    SELECT 'A' AS part, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_entities FROM f WHERE a
    UNION ALL SELECT 'B', count(*), count(DISTINCT o_custkey) FROM f WHERE b
    UNION ALL SELECT 'A and B', count(*), count(DISTINCT o_custkey) FROM f WHERE a AND b
    UNION ALL SELECT 'A only', count(*), count(DISTINCT o_custkey) FROM f WHERE a AND NOT b""",
)
def q12(spark, sf):
    return R.set_composition(table(spark, sf, "orders"), "o_custkey", F.col("o_totalprice") > 300000, F.col("o_orderpriority") == "1-URGENT")


@query("q13_group_sizes", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2 ORDER BY n DESC, 1, 2")
def q13(spark, sf):
    counted = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.col("n").desc(), "l_returnflag", "l_linestatus")


@query(
    "q14_named_aggregation",
    """SELECT l_returnflag, count(*) AS size, round(avg(l_extendedprice), 4) AS mean, min(l_extendedprice) AS lowest, max(l_extendedprice) AS highest,
    round(sum(l_extendedprice), 2) AS total, count(l_discount) AS n_discount, count(DISTINCT l_suppkey) AS n_suppliers,
    count(*) FILTER (WHERE l_quantity >= 45) AS n_bulk FROM lineitem GROUP BY 1""",
)
def q14(spark, sf):
    c = F.col
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("size"), F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.min("l_extendedprice").alias("lowest"),
        F.max("l_extendedprice").alias("highest"), F.round(F.sum("l_extendedprice"), 2).alias("total"), F.count("l_discount").alias("n_discount"),
        F.countDistinct("l_suppkey").alias("n_suppliers"), F.count_if(c("l_quantity") >= 45).alias("n_bulk"),
    )


@query(
    "q15_composite_ranking",
    """SELECT row_number() OVER (ORDER BY appearances DESC, mean_rank, entity) AS place, * FROM (
    SELECT l_suppkey AS entity, count(*) AS appearances, round(avg(l_linenumber), 6) AS mean_rank, min(l_linenumber)::bigint AS best_rank
    FROM lineitem GROUP BY 1) ORDER BY place LIMIT 20""",
)
def q15(spark, sf):
    return longs(rounded(R.composite_ranking(table(spark, sf, "lineitem"), "l_suppkey", "l_linenumber", 20)))


@query(
    "q16_right_closed_bins",
    "SELECT p_partkey, CASE WHEN p_size <= 24 AND p_size > 0 THEN 'young' WHEN p_size <= 29 AND p_size > 24 THEN 'prime' WHEN p_size <= 40 AND p_size > 29 THEN 'late' END AS band FROM part",
)
def q16(spark, sf):
    return table(spark, sf, "part").select("p_partkey", R.cut(F.col("p_size"), [0, 24, 29, 40], ["young", "prime", "late"]).alias("band"))


@query(
    "q17_two_readings",
    """SELECT o_custkey, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_first, count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS n_second
    FROM orders GROUP BY 1 HAVING n_first <> n_second""",
)
def q17(spark, sf):
    p = F.col("o_orderpriority")
    return R.disagreement(table(spark, sf, "orders"), "o_custkey", p == "1-URGENT", p.isin("1-URGENT", "2-HIGH"))


@query(
    "q18_reconcile_sources",
    """SELECT l_returnflag, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS comparable, count(*) FILTER (WHERE a = b) AS agree,
    count(*) FILTER (WHERE a <> b) AS mismatch, count(*) FILTER (WHERE a IS NULL) AS missing_a, count(*) FILTER (WHERE b IS NULL) AS missing_b, count(*) AS n_rows
    FROM (SELECT l_returnflag, nullif(l_discount, 0) AS a, nullif(l_tax, 0) AS b FROM lineitem) GROUP BY 1""",
)
def q18(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", F.nullif("l_discount", F.lit(0.0)).alias("a"), F.nullif("l_tax", F.lit(0.0)).alias("b"))
    return R.reconcile(df, "a", "b", ["l_returnflag"])


@query(
    "q19_align_to_keys",
    "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)",
)
def q19(spark, sf):
    return R.align(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query(
    "q20_pivot_table",
    """SELECT * FROM (SELECT l_suppkey, round(avg(l_quantity) FILTER (WHERE l_returnflag = 'A'), 6) AS A_mean, count(*) FILTER (WHERE l_returnflag = 'A') AS A_n,
    round(avg(l_quantity) FILTER (WHERE l_returnflag = 'R'), 6) AS R_mean, count(*) FILTER (WHERE l_returnflag = 'R') AS R_n
    FROM lineitem GROUP BY 1) WHERE A_n > 0 AND R_n > 0""",
)
def q20(spark, sf):
    df = table(spark, sf, "lineitem")
    aggs = {"mean": F.avg("l_quantity"), "n": F.count("l_quantity")}
    return rounded(R.pivot_table(df, "l_suppkey", "l_returnflag", ["A", "R"], aggs, thresh=4)).filter("A_n > 0 AND R_n > 0")


@query(
    "q21_standardised_gap",
    """WITH s AS (SELECT l_linenumber AS k, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS ma, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS mb,
    count(*) FILTER (WHERE l_returnflag = 'A') AS na, count(*) FILTER (WHERE l_returnflag = 'R') AS nb FROM lineitem GROUP BY 1),
    t AS (SELECT sum(ma * na) / sum(na) AS mean_a, sum(mb * nb) / sum(nb) AS mean_b,
    sum(ma * nb) FILTER (WHERE ma IS NOT NULL AND mb IS NOT NULL) / sum(nb) FILTER (WHERE ma IS NOT NULL AND mb IS NOT NULL) AS sa,
    sum(mb * nb) FILTER (WHERE ma IS NOT NULL AND mb IS NOT NULL) / sum(nb) FILTER (WHERE ma IS NOT NULL AND mb IS NOT NULL) AS sb FROM s)
    SELECT round(mean_a, 4) AS mean_a, round(mean_b, 4) AS mean_b, round(mean_a - mean_b, 4) AS gap, round(sa - sb, 4) AS within_gap,
    round(mean_a - mean_b - (sa - sb), 4) AS mix_gap FROM t""",
)
def q21(spark, sf):
    return rounded(R.standardised_gap(table(spark, sf, "lineitem"), "l_returnflag", "l_linenumber", "l_extendedprice", "A", "R"), 4)


@query(
    "q22_entity_overlap",
    """WITH p AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2),
    k AS (SELECT o_custkey, count(*) AS g FROM p GROUP BY 1)
    SELECT o_orderpriority AS "group", sum(n)::bigint AS n_rows, coalesce(sum(n) FILTER (WHERE g > 1), 0)::bigint AS n_shared_rows,
    round(coalesce(sum(n) FILTER (WHERE g > 1), 0) / sum(n) * 100, 6) AS pct_shared FROM p JOIN k USING (o_custkey) GROUP BY 1""",
)
def q22(spark, sf):
    return rounded(R.overlap(table(spark, sf, "orders"), "o_custkey", "o_orderpriority"))


@query(
    "q23_entity_constancy",
    "SELECT l_orderkey, count(DISTINCT l_returnflag) AS n_values FROM lineitem GROUP BY 1 HAVING n_values > 1",
)
def q23(spark, sf):
    return R.inconstant_entities(table(spark, sf, "lineitem"), "l_orderkey", "l_returnflag")


@query(
    "q24_grid_step",
    """SELECT count(*) AS n_distinct, round(min(gap), 6) AS min_gap FROM (SELECT p_retailprice - lag(p_retailprice) OVER (ORDER BY p_retailprice) AS gap
    FROM (SELECT DISTINCT p_retailprice FROM part))""",
)
def q24(spark, sf):
    return rounded(smallest_gap(table(spark, sf, "part"), "p_retailprice"))


@query(
    "q25_relabel",
    "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'top ' || o_orderstatus ELSE o_orderstatus || '-' || o_orderpriority END AS label FROM orders",
)
def q25(spark, sf):
    label = F.when(F.col("o_totalprice") > 300000, F.concat(F.lit("top "), "o_orderstatus")).otherwise(F.concat_ws("-", "o_orderstatus", "o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", label.alias("label"))


@query(
    "q26_ratio_and_difference",
    "SELECT p_partkey, round(p_size / p_retailprice * 1.000000000001, 6) AS ratio, round(p_retailprice - p_size, 6) AS difference FROM part",
)
def q26(spark, sf):
    c = F.col
    return rounded(
        table(spark, sf, "part").select(
            "p_partkey", safe_ratio(c("p_size"), c("p_retailprice"), 6).alias("ratio"), (c("p_retailprice") - c("p_size")).alias("difference")
        )
    )


@query(
    "q27_period_labels",
    """SELECT CASE WHEN year(o_orderdate) IN (1995, 1996) THEN 'early' WHEN year(o_orderdate) IN (1999, 2000) THEN 'late' END AS period, count(*) AS n
    FROM orders GROUP BY 1""",
)
def q27(spark, sf):
    year = F.year("o_orderdate")
    period = F.when(year.isin(1995, 1996), "early").when(year.isin(1999, 2000), "late")
    df = table(spark, sf, "orders").withColumn("period", period)
    return df.groupBy("period").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q28_threshold_share",
    """SELECT l_returnflag AS "group", count(*) AS n_rows, count(*) FILTER (WHERE l_quantity >= 40) AS n_at_least,
    round(count(*) FILTER (WHERE l_quantity >= 40) / count(*), 6) AS share, count(DISTINCT CASE WHEN l_quantity >= 40 THEN l_orderkey END) AS n_entities FROM lineitem GROUP BY 1""",
)
def q28(spark, sf):
    return rounded(R.threshold_share(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", 40, "l_orderkey"))


@query(
    "q29_missing_cells",
    "SELECT sum((nullif(l_discount, 0) IS NULL)::int + (nullif(l_tax, 0) IS NULL)::int)::bigint AS n_missing_cells FROM lineitem",
)
def q29(spark, sf):
    df = table(spark, sf, "lineitem").select(F.nullif("l_discount", F.lit(0.0)).alias("a"), F.nullif("l_tax", F.lit(0.0)).alias("b"))
    return R.missing_cells(df, ["a", "b"])


_WELCH = """SELECT '{m}' AS metric, l_returnflag, n_a + n_b AS n, round((ma - mb) / sqrt(va / n_a + vb / n_b), 6) AS statistic, round(ma - mb, 6) AS estimate FROM (
    SELECT l_returnflag, avg({m}) FILTER (WHERE l_linestatus = 'F') AS ma, avg({m}) FILTER (WHERE l_linestatus = 'O') AS mb,
    var_samp({m}) FILTER (WHERE l_linestatus = 'F') AS va, var_samp({m}) FILTER (WHERE l_linestatus = 'O') AS vb,
    count(*) FILTER (WHERE l_linestatus = 'F') AS n_a, count(*) FILTER (WHERE l_linestatus = 'O') AS n_b FROM lineitem GROUP BY 1)"""


@query("q30_operator_per_group", " UNION ALL ".join(_WELCH.format(m=m) for m in ("l_quantity", "l_extendedprice")))
def q30(spark, sf):
    out = per_group(
        table(spark, sf, "lineitem"), compare_groups, ["l_quantity", "l_extendedprice"], group_col="l_linestatus", test="welch", by=["l_returnflag"]
    )
    return rounded(out.select("metric", "l_returnflag", "n", "statistic", "estimate"))

"""Queries for the data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.catalog.registry import longs, query, table
from statloom.functions.text import clean_text
from statloom.operators import quality as D
from statloom.operators.rows import add_stint_columns


@query(
    "d02_orphans",
    """SELECT 'orders(o_custkey) -> customer(c_custkey)' AS "constraint", count(*) AS n_orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'documents(doc_id) -> labels(doc_id)', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 'orders(o_orderkey) -> lineitem(l_orderkey)', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT 'lineitem(l_partkey,l_suppkey) -> bulk(l_partkey,l_suppkey)', count(*) FROM lineitem
    WHERE (l_partkey, l_suppkey) NOT IN (SELECT (l_partkey, l_suppkey) FROM lineitem WHERE l_quantity > 25)""",
)
def d02(spark, sf):
    t = {n: table(spark, sf, n) for n in ("orders", "customer", "documents", "labels", "lineitem")}
    t["bulk"] = t["lineitem"].filter("l_quantity > 25")
    keys = [
        ("orders", ["o_custkey"], "customer", ["c_custkey"]),
        ("documents", ["doc_id"], "labels", ["doc_id"]),
        ("orders", ["o_orderkey"], "lineitem", ["l_orderkey"]),
        ("lineitem", ["l_partkey", "l_suppkey"], "bulk", ["l_partkey", "l_suppkey"]),
    ]
    return D.foreign_key_report(t, keys)


@query(
    "d03_primary_keys",
    """SELECT 'lineitem' AS "table", (count(*) - count(DISTINCT (l_orderkey, l_linenumber)))::bigint AS n_duplicates, 0::bigint AS n_null_keys FROM lineitem
    UNION ALL SELECT 'labelled', (count(*) - (SELECT count(*) FROM (SELECT DISTINCT lang, quality FROM documents LEFT JOIN labels USING (doc_id))))::bigint,
    count(*) FILTER (WHERE quality IS NULL) FROM documents LEFT JOIN labels USING (doc_id)""",
)
def d03(spark, sf):
    labelled = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    one = D.key_check(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "lineitem")
    return one.unionByName(D.key_check(labelled, ["lang", "quality"], "labelled"))


@query(
    "d04_row_floors",
    """SELECT 'orders' AS "table", count(*) AS "rows", 1000::bigint AS floor, count(*) - 1000 AS delta, count(*) >= 1000 AS ok FROM orders
    UNION ALL SELECT 'supplier', count(*), 1000000, count(*) - 1000000, count(*) >= 1000000 FROM supplier""",
)
def d04(spark, sf):
    t = {n: table(spark, sf, n) for n in ("orders", "supplier")}
    return D.row_floors(t, {"orders": 1000, "supplier": 1000000})


@query(
    "d05_domain_offenders",
    """SELECT 'o_orderpriority' AS "column", o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT') GROUP BY 2 ORDER BY n DESC, value LIMIT 3""",
)
def d05(spark, sf):
    return D.domain_offenders(table(spark, sf, "orders"), "o_orderpriority", ["1-URGENT"])


@query(
    "d05_domain_counts",
    """SELECT 'l_returnflag' AS "column", count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) AS n_outside FROM lineitem
    UNION ALL SELECT 'l_linestatus', count(*) FILTER (WHERE l_linestatus NOT IN ('F', 'O')) FROM lineitem""",
)
def d05_counts(spark, sf):
    return D.domain_check(table(spark, sf, "lineitem"), {"l_returnflag": ["A", "N"], "l_linestatus": ["F", "O"]})


_RULES = "d.lang AS lang, d.n_chars, d.source, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"


def _labelled(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars", "source")
    return docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")


@query(
    "d06_check_constraints",
    f"""WITH t AS (SELECT {_RULES}) SELECT 'quality_flag' AS rule, count(*) FILTER (WHERE NOT (quality = 1)) AS n_violations FROM t
    UNION ALL SELECT 'size', count(*) FILTER (WHERE NOT (n_chars BETWEEN 100 AND 5000)) FROM t
    UNION ALL SELECT 'size_or_english', count(*) FILTER (WHERE NOT (n_chars >= 100 OR lang = 'en')) FROM t""",
)
def d06(spark, sf):
    checks = {"quality_flag": "quality = 1", "size": "n_chars between 100 and 5000", "size_or_english": "n_chars >= 100 or lang = 'en'"}
    return D.check_rules(_labelled(spark, sf), checks)


@query(
    "d07_not_null",
    f"""WITH t AS (SELECT {_RULES}) SELECT 'lang not null' AS rule, count(*) FILTER (WHERE lang IS NULL) AS n_violations FROM t
    UNION ALL SELECT 'quality not null', count(*) FILTER (WHERE quality IS NULL) FROM t""",
)
def d07(spark, sf):
    return D.check_rules(_labelled(spark, sf), not_null=["lang", "quality"])


@query(
    "d08_widths",
    """SELECT 'length(p_name) <= 9' AS rule, count(*) FILTER (WHERE length(p_name) > 9) AS n_violations FROM part
    UNION ALL SELECT 'length(p_brand) <= 7', count(*) FILTER (WHERE length(p_brand) > 7) FROM part""",
)
def d08(spark, sf):
    return D.check_rules(table(spark, sf, "part"), widths={"p_name": 9, "p_brand": 7})


@query(
    "d09_grain_assertion",
    "SELECT o_custkey, year(o_orderdate) AS season, count(*) AS n FROM orders GROUP BY 1, 2",
)
def d09(spark, sf):
    mart = table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("season")).agg(F.count(F.lit(1)).alias("n"))
    return D.assert_grain(mart, ["o_custkey", "season"], "customer_season")


_WS = r"[\t-\r \x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query(
    "d10_change_report",
    f"""SELECT doc_id, text AS before, nullif(trim(regexp_replace(text, '{_WS}+', ' ', 'g')), '') AS after FROM documents
    WHERE text IS DISTINCT FROM nullif(trim(regexp_replace(text, '{_WS}+', ' ', 'g')), '')""",
)
def d10(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return D.change_report(docs, docs.withColumn("text", clean_text(F.col("text"))), ["doc_id"], "text")


@query("d11_profile", "SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def d11(spark, sf):
    return D.profile(table(spark, sf, "documents"), ["lang", "source"])


@query(
    "d11_stint_profile",
    """WITH p AS (SELECT l_orderkey, l_returnflag, bool_or(l_linenumber = 7) AS has, count(*) FILTER (WHERE l_linenumber <> 7) AS clubs,
    count(*) FILTER (WHERE l_linenumber = 7) AS totals FROM lineitem GROUP BY 1, 2)
    SELECT count(*) AS n_keys, count(*) FILTER (WHERE has) AS n_with_total, count(*) FILTER (WHERE clubs > 1) AS n_multi_club,
    count(*) FILTER (WHERE totals > 1) AS n_bad_primary FROM p""",
)
def d11_stints(spark, sf):
    team = F.when(F.col("l_linenumber") == 7, "tot").otherwise(F.col("l_suppkey").cast("string"))
    df = table(spark, sf, "lineitem").withColumn("team_id", team)
    df = add_stint_columns(df, "l_orderkey", "l_returnflag", "team_id", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return longs(D.stint_profile(df, "l_orderkey", "l_returnflag"))


@query(
    "d12_verdict",
    """SELECT 3::bigint AS n_checks, n AS failures, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (
    SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) + (SELECT count(*) FROM part WHERE length(p_name) > 9)
    + (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS n)""",
)
def d12(spark, sf):
    return D.verdict(
        {
            "labels": D.orphan_count(table(spark, sf, "documents"), ["doc_id"], table(spark, sf, "labels"), ["doc_id"]),
            "widths": D.check_rules(table(spark, sf, "part"), widths={"p_name": 9}),
            "customers": D.orphan_count(table(spark, sf, "orders"), ["o_custkey"], table(spark, sf, "customer"), ["c_custkey"]),
        }
    )

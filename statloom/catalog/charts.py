"""Queries for the chart-ready reductions."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.catalog.registry import longs, query, rounded, table
from statloom.operators import correlation as R
from statloom.operators import reduce as V
from statloom.operators.categorical import crosstab


def _lines(spark, sf):
    return table(spark, sf, "lineitem")


def _events(spark, sf):
    """All events; those of the tenth of January are a kind of their own, so that the other series have a gap."""
    mark = F.when(F.to_date("ts") == "2024-01-10", "*").otherwise("")
    return table(spark, sf, "events").withColumn("event_type", F.concat("event_type", mark))


@query(
    "v01_column_kinds",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique, CASE WHEN {num} AND count(DISTINCT {c}) >= 10 THEN 'numerical' ELSE 'categorical' END AS kind FROM orders"
        for c, num in (("o_custkey", "true"), ("o_orderstatus", "false"), ("o_totalprice", "true"), ("o_orderpriority", "false"))
    ),
)
def v01(spark, sf):
    df = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return V.column_kinds(df).drop("pos")


def _bins(c: str) -> str:
    return f"""SELECT '{c}' AS "column", i::integer AS bin, round(lo + i * (hi - lo) / 20, 6) AS lower, round(lo + (i + 1) * (hi - lo) / 20, 6) AS upper,
    coalesce(n, 0) AS n, round(coalesce(n, 0) / (t * ((lo + (i + 1) * (hi - lo) / 20) - (lo + i * (hi - lo) / 20))), 8) AS density
    FROM (SELECT min({c}) AS lo, max({c}) AS hi, count(*) AS t FROM lineitem), range(20) r(i) LEFT JOIN (
    SELECT least(floor(({c} - lo) / ((hi - lo) / 20)), 19) AS b, count(*) AS n FROM lineitem, (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem) GROUP BY 1) ON b = i"""


@query("v02_histogram", " UNION ALL ".join(f"SELECT * FROM ({_bins(c)})" for c in ("l_quantity", "l_extendedprice")))
def v02(spark, sf):
    out = V.histogram_bins(_lines(spark, sf), ["l_quantity", "l_extendedprice"], 20, density=True)
    return out.withColumns({"lower": F.round("lower", 6), "upper": F.round("upper", 6), "density": F.round("density", 8)})


@query(
    "v02_mean_median_lines",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(avg({c}), 5) AS mean, round(median({c}), 5) AS median FROM lineitem" for c in ("l_quantity", "l_extendedprice")
    ),
)
def v02_lines(spark, sf):
    return rounded(V.mean_median_lines(_lines(spark, sf), ["l_quantity", "l_extendedprice"]), 5)


@query(
    "v03_kde_curve",
    """WITH h AS (SELECT l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT stddev_samp(l_quantity) * power(count(*), -0.2) AS h, count(*) AS t, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)
    SELECT i::integer AS point, round(lo + i * (hi - lo) / 199, 6) AS x, round(sum(n * exp(-0.5 * ((lo + i * (hi - lo) / 199 - v) / h) ** 2)) / (t * h * 2.5066282746310002), 8) AS density
    FROM h, s, range(200) r(i) GROUP BY i, lo, hi, t, h""",
)
def v03(spark, sf):
    out = V.kde_curve(_lines(spark, sf), "l_quantity")
    return out.select("point", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


@query(
    "v04_top_categories",
    """WITH c AS (SELECT p_brand AS category, count(*) AS n FROM part GROUP BY 1), t AS (SELECT * FROM c ORDER BY n DESC, category LIMIT 10), s AS (SELECT sum(n) AS s FROM c)
    SELECT category, n, round(n / s * 100, 2) AS pct FROM t, s UNION ALL SELECT 'Other', (s - (SELECT sum(n) FROM t))::bigint, round((s - (SELECT sum(n) FROM t)) / s * 100, 2) FROM s""",
)
def v04(spark, sf):
    return V.top_categories(table(spark, sf, "part"), "p_brand", 10)


_BOX = """WITH q AS (SELECT o_orderpriority AS g, count(*) AS n, quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS med, quantile_cont(o_totalprice, 0.75) AS q3, avg(o_totalprice) AS mean FROM orders GROUP BY 1),
    w AS (SELECT g, any_value(n) AS n, any_value(q1) AS q1, any_value(med) AS med, any_value(q3) AS q3, any_value(mean) AS mean, min(o_totalprice) FILTER (WHERE o_totalprice >= q1 - 0.5 * (q3 - q1)) AS lo,
    max(o_totalprice) FILTER (WHERE o_totalprice <= q3 + 0.5 * (q3 - q1)) AS hi, count(*) FILTER (WHERE o_totalprice < q1 - 0.5 * (q3 - q1) OR o_totalprice > q3 + 0.5 * (q3 - q1)) AS out
    FROM orders JOIN q ON g = o_orderpriority GROUP BY 1)
    SELECT g AS "group", n, round(q1, 4) AS q1, round(med, 4) AS median, round(q3, 4) AS q3, round(mean, 4) AS mean, lo AS whisker_low, hi AS whisker_high, out AS n_outliers, round(out / n * 100, 4) AS pct_outliers FROM w"""


@query("v05_box_statistics", _BOX)
def v05(spark, sf):
    return rounded(V.box_stats(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority", whis=0.5), 4)


@query(
    "v06_ecdf",
    """SELECT g AS "group", v AS value, n, cum, round(cum / t, 6) AS ecdf FROM (SELECT g, v, n, (sum(n) OVER (PARTITION BY g ORDER BY v))::bigint AS cum, sum(n) OVER (PARTITION BY g) AS t
    FROM (SELECT l_returnflag AS g, l_extendedprice AS v, count(*) AS n FROM lineitem GROUP BY 1, 2))""",
)
def v06(spark, sf):
    return rounded(V.ecdf(_lines(spark, sf), "l_extendedprice", "l_returnflag"))


@query(
    "v06_marked_quantiles",
    """SELECT l_returnflag AS "group", unnest([0.25, 0.5, 0.9])::double AS p, round(unnest(quantile_cont(l_extendedprice, [0.25, 0.5, 0.9])), 4) AS value FROM lineitem GROUP BY 1""",
)
def v06_marks(spark, sf):
    return rounded(V.marked_quantiles(_lines(spark, sf), "l_extendedprice", [0.25, 0.5, 0.9], "l_returnflag"), 4)


@query("v07_qq_points")
def v07(spark, sf):
    return V.qq_points(table(spark, sf, "orders"), "o_totalprice")


@query("v07_qq_line")
def v07_line(spark, sf):
    return V.qq_line(table(spark, sf, "orders"), "o_totalprice")


@query(
    "v08_missing_bar",
    """WITH t AS (SELECT count(*) AS n, count(*) - count(quality) AS q, count(*) - count(toxic) AS x FROM documents LEFT JOIN labels USING (doc_id))
    SELECT 'lang' AS "column", 0::bigint AS n_missing, n AS n_rows, 0.0::double AS pct_missing, round((q + x) / (n * 3) * 100, 4) AS overall_pct FROM t
    UNION ALL SELECT 'quality', q, n, round(q / n * 100, 4), round((q + x) / (n * 3) * 100, 4) FROM t
    UNION ALL SELECT 'toxic', x, n, round(x / n * 100, 4), round((q + x) / (n * 3) * 100, 4) FROM t""",
)
def v08(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return rounded(V.missing_bar(df, ["doc_id"]), 4)


@query(
    "v09_missing_matrix",
    """WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
    k AS (SELECT DISTINCT floor(j * ((SELECT count(*) FROM documents) - 1) / 99.0)::bigint AS i FROM range(100) r(j))
    SELECT i AS row, 'quality' AS "column", quality IS NULL AS missing FROM d JOIN k USING (i) UNION ALL SELECT i, 'toxic', toxic IS NULL FROM d JOIN k USING (i)""",
)
def v09(spark, sf):
    df = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return longs(V.missing_matrix(df, "doc_id", 100, ["quality", "toxic"]))


@query(
    "v10_trendline",
    """SELECT l_returnflag AS "group", count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
    round(regr_r2(l_extendedprice, l_quantity), 8) AS r_squared FROM lineitem GROUP BY 1""",
)
def v10(spark, sf):
    out = V.trendline(_lines(spark, sf), "l_quantity", "l_extendedprice", "l_returnflag")
    return out.select("group", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r_squared", 8).alias("r_squared"))


@query(
    "v11_histogram_2d",
    """SELECT least(floor((l_quantity - x0) / ((x1 - x0) / 80)), 79)::integer AS x_bin, least(floor((l_extendedprice - y0) / ((y1 - y0) / 80)), 79)::integer AS y_bin, count(*) AS n
    FROM lineitem, (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem) GROUP BY 1, 2""",
)
def v11(spark, sf):
    return V.histogram_2d(_lines(spark, sf), "l_quantity", "l_extendedprice")


@query(
    "v12_bubble_sizes",
    "SELECT p_partkey, round(5 + (p_size - a) / (b - a) * 45, 6) AS bubble_size FROM part, (SELECT min(p_size) AS a, max(p_size) AS b FROM part)",
)
def v12(spark, sf):
    return rounded(V.bubble_sizes(table(spark, sf, "part"), "p_size").select("p_partkey", "bubble_size"))


@query(
    "v12_bubble_legend",
    "SELECT unnest([0.25, 0.75, 1.0])::double AS p, round(unnest(quantile_cont(p_retailprice, [0.25, 0.75, 1.0])), 6) AS value FROM part",
)
def v12_legend(spark, sf):
    return rounded(V.bubble_legend(table(spark, sf, "part"), "p_retailprice"))


@query("v12_top_labels", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def v12_labels(spark, sf):
    return V.top_labels(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 10)


_CM = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")]
_PLACE = {"l_quantity": 0, "l_extendedprice": 1, "l_discount": 2}


@query(
    "v13_correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, count(*) AS n, round(corr({x}, {y}), 6) AS r, abs(corr({x}, {y})) < 0.002 OR {str(_PLACE[y] > _PLACE[x]).lower()} AS masked FROM lineitem"
        for a, b in _CM
        for x, y in ((a, b), (b, a))
    ),
)
def v13(spark, sf):
    out = R.correlation_matrix(_lines(spark, sf), list(_PLACE), threshold=0.002, triangle="lower")
    return rounded(out.select("x", "y", "n", "r", "masked"))


@query("v14_matrix_order")
def v14(spark, sf):
    return R.matrix_order(_lines(spark, sf), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], n_clusters=2)


def _crosstab_sql(value: str) -> str:
    return f"""WITH n AS (SELECT lang AS a, source AS b, count(*) AS o FROM documents GROUP BY 1, 2), r AS (SELECT a, sum(o) AS r FROM n GROUP BY 1),
    c AS (SELECT b, sum(o) AS c FROM n GROUP BY 1), t AS (SELECT sum(o) AS t FROM n)
    SELECT r.a AS row, c.b AS col, coalesce(o, 0) AS n, round({value}::double, 6) AS value FROM r CROSS JOIN c CROSS JOIN t LEFT JOIN n ON n.a = r.a AND n.b = c.b"""


def _crosstab(normalize):
    def run(spark, sf):
        return rounded(crosstab(table(spark, sf, "documents"), "lang", "source", normalize))

    return run


query("v15_crosstab_counts", _crosstab_sql("coalesce(o, 0)"))(_crosstab(None))
query("v15_crosstab_row_pct", _crosstab_sql("coalesce(o, 0) / r * 100"))(_crosstab("row"))
query("v15_crosstab_col_pct", _crosstab_sql("coalesce(o, 0) / c * 100"))(_crosstab("col"))
query("v15_crosstab_total_pct", _crosstab_sql("coalesce(o, 0) / t * 100"))(_crosstab("all"))


@query(
    "v16_ranked_bars",
    """SELECT p_brand AS "group", round(avg(p_retailprice), 6) AS point, count(*) AS n, round(avg(p_retailprice) - 1.959963984540054 * stddev_samp(p_retailprice) / sqrt(count(*)), 6) AS ci_low,
    round(avg(p_retailprice) + 1.959963984540054 * stddev_samp(p_retailprice) / sqrt(count(*)), 6) AS ci_high, round(avg(p_retailprice), 6) AS "key", count(*) < 80 AS low_n
    FROM part GROUP BY 1 ORDER BY avg(p_retailprice) DESC, 1 LIMIT 12""",
)
def v16(spark, sf):
    return rounded(V.ranked_bars(table(spark, sf, "part"), "p_brand", "p_retailprice", min_n_flag=80, top_n=12))


@query("v16_ranked_bars_bootstrap")
def v16_bootstrap(spark, sf):
    return V.ranked_bars(_lines(spark, sf), "l_returnflag", "l_extendedprice", agg="median", split="l_linestatus", n_boot=499)


@query("v17_grouped_boxes", _BOX.replace('pct_outliers FROM w', 'pct_outliers, n < 3000 AS low_n FROM w ORDER BY mean DESC, 1 LIMIT 4').replace("0.5 *", "1.5 *"))
def v17(spark, sf):
    return rounded(V.grouped_boxes(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", sort_by="mean", min_n_flag=3000, top_n=4), 4)


@query(
    "v18_dumbbell",
    """SELECT l_suppkey AS category, round(avg(l_discount), 6) AS start, round(avg(l_tax), 6) AS "end", round(avg(l_tax) - avg(l_discount), 6) AS diff, round(abs(avg(l_tax) - avg(l_discount)), 6) AS abs_diff
    FROM lineitem GROUP BY 1 ORDER BY abs(avg(l_tax) - avg(l_discount)) DESC, 1 LIMIT 15""",
)
def v18(spark, sf):
    return rounded(V.dumbbell(_lines(spark, sf), "l_suppkey", "l_discount", "l_tax", top_n=15))


@query(
    "v19_radar",
    """WITH m AS (SELECT p_brand AS category, avg(p_size) AS p_size, avg(p_retailprice) AS p_retailprice, avg(p_partkey) AS p_partkey FROM part GROUP BY 1),
    e AS (SELECT min(p_size) AS a0, max(p_size) AS a1, min(p_retailprice) AS b0, max(p_retailprice) AS b1, min(p_partkey) AS c0, max(p_partkey) AS c1 FROM m),
    t AS (SELECT * FROM m ORDER BY p_size DESC, category LIMIT 5)
    SELECT category, 'p_size' AS metric, round(p_size, 6) AS mean, round((p_size - a0) / (a1 - a0), 6) AS scaled FROM t, e
    UNION ALL SELECT category, 'p_retailprice', round(p_retailprice, 6), round((p_retailprice - b0) / (b1 - b0), 6) FROM t, e
    UNION ALL SELECT category, 'p_partkey', round(p_partkey, 6), round((p_partkey - c0) / (c1 - c0), 6) FROM t, e""",
)
def v19(spark, sf):
    return rounded(V.radar(table(spark, sf, "part"), "p_brand", ["p_size", "p_retailprice", "p_partkey"], top_n=5))


def _series(agg: str) -> str:
    return f"""WITH e AS (SELECT event_type || CASE WHEN cast(ts AS date) = date '2024-01-10' THEN '*' ELSE '' END AS g, date_trunc('day', ts) AS d, value FROM events),
    s AS (SELECT g, min(d) AS a, max(d) AS b FROM e GROUP BY 1), c AS (SELECT g, unnest(generate_series(a, b, interval 1 day)) AS d FROM s)
    SELECT c.g AS "group", c.d::timestamp AS period, {agg} AS value FROM c LEFT JOIN e ON e.g = c.g AND e.d = c.d GROUP BY 1, 2"""


def _resampled(agg):
    def run(spark, sf):
        out = V.time_resample(_events(spark, sf), "ts", "value", "D", agg, "event_type")
        return rounded(out.withColumn("period", F.col("period").cast("timestamp")), 4)

    return run


query("v20_resample_mean", _series("round(avg(value), 4)"))(_resampled("mean"))
query("v20_resample_sum", _series("round(sum(value), 4)"))(_resampled("sum"))
query("v20_resample_median", _series("round(median(value), 4)"))(_resampled("median"))
query("v20_resample_count", _series("CASE WHEN count(value) > 0 THEN count(value)::double END"))(_resampled("count"))


def _periods(number: str, label: str) -> str:
    """Sums per period of the events, by a period's number and its label."""
    return f"""WITH e AS (SELECT event_type || CASE WHEN cast(ts AS date) = date '2024-01-10' THEN '*' ELSE '' END AS g, ts, value FROM events),
    o AS (SELECT g, min(ts) AS first FROM e GROUP BY 1), n AS (SELECT e.g, first, {number} AS i, value FROM e JOIN o ON o.g = e.g),
    s AS (SELECT g, first, unnest(range(min(i), max(i) + 1)) AS i FROM n GROUP BY 1, 2)
    SELECT s.g AS "group", ({label})::timestamp AS period, round(sum(value), 4) AS value FROM s LEFT JOIN n ON n.g = s.g AND n.i = s.i GROUP BY 1, 2"""


def _every(freq: str):
    def run(spark, sf):
        out = V.time_resample(_events(spark, sf), "ts", "value", freq, "sum", "event_type")
        return rounded(out.withColumn("period", F.col("period").cast("timestamp")), 4)

    return run


query("v20_resample_90_minutes", _periods("floor(date_diff('second', date_trunc('day', first), ts) / 5400.0)::bigint", "date_trunc('day', s.first) + to_seconds(s.i * 5400)"))(_every("90min"))
query(
    "v20_resample_business_days",
    _periods("(floor((date_diff('day', date '1970-01-01', ts::date) + 3) / 7.0) * 5 + least((date_diff('day', date '1970-01-01', ts::date) + 3) % 7, 4))::bigint", "date '1970-01-01' + (floor(s.i / 5.0) * 7 + s.i % 5 - 3)::int"),
)(_every("B"))
query(
    "v20_resample_weeks_to_friday",
    _periods("floor((date_diff('day', date '1970-01-01', ts::date) + 5) / 7.0)::bigint", "date '1970-01-01' + (s.i * 7 + 1)::int"),
)(_every("W-FRI"))
query("v20_resample_month_ends", _periods("(year(ts) * 12 + month(ts) - 1)::bigint", "last_day(make_date((s.i // 12)::bigint, (s.i % 12 + 1)::bigint, 1))"))(_every("ME"))
query("v20_resample_three_days", _periods("floor(date_diff('day', first::date, ts::date) / 3.0)::bigint", "s.first::date + (s.i * 3)::int"))(_every("3D"))


@query(
    "v21_rolling_mean",
    f"""SELECT "group", period, round(avg(v) OVER (PARTITION BY "group" ORDER BY period ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS rolling FROM ({_series('avg(value)').replace(' AS value GROUP', ' AS v GROUP')
    .replace('avg(value) AS value', 'avg(value) AS v')})""",
)
def v21(spark, sf):
    series = V.time_resample(_events(spark, sf), "ts", "value", "D", "mean", "event_type")
    out = V.rolling_mean(series, 7).withColumn("period", F.col("period").cast("timestamp"))
    return rounded(out.select("group", "period", "rolling"), 4)


@query(
    "v22_pareto",
    """WITH t AS (SELECT c_mktsegment || '-' || c_nationkey AS category, sum(c_acctbal) AS value FROM customer GROUP BY 1 HAVING sum(c_acctbal) > 0),
    r AS (SELECT row_number() OVER (ORDER BY value DESC, category) AS place, category, value, value / sum(value) OVER () AS share,
    sum(value) OVER (ORDER BY value DESC, category) / sum(value) OVER () AS cum FROM t)
    SELECT place, category, round(value, 4) AS value, round(share, 6) AS share, round(cum, 6) AS cum_share, (SELECT count(*) FILTER (WHERE cum < 0.8) + 1 FROM r) AS n_cover FROM r""",
)
def v22(spark, sf):
    df = table(spark, sf, "customer").withColumn("cell", F.concat_ws("-", "c_mktsegment", "c_nationkey"))
    out = longs(V.pareto(df, "cell", "c_acctbal"))
    return out.withColumns({"value": F.round("value", 4), "share": F.round("share", 6), "cum_share": F.round("cum_share", 6)})

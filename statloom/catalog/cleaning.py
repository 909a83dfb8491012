"""Queries for the cleaning expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.catalog.registry import query, rounded, table
from statloom.functions import text as X

# The white space Unicode knows, for engines whose \s is ASCII only.
WS = r"[\t-\r \x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query("c01_normalise_headers", "SELECT c_custkey AS customer_id, c_name, c_nationkey, c_mktsegment FROM customer")
def c01(spark, sf):
    df = table(spark, sf, "customer").select(
        F.col("c_custkey").alias(" C_CustKey "), F.col("c_name").alias("C_NAME"), F.col("c_nationkey").alias("c_nationkey "), "c_mktsegment"
    )
    return X.normalize_headers(df, {"c_custkey": "customer_id"})


@query(
    "c02_rename_columns",
    "SELECT o_orderkey AS season_key, o_custkey AS player_id, o_totalprice AS points, o_orderpriority AS position FROM orders",
)
def c02(spark, sf):
    names = {"o_orderkey": "season_key", "o_custkey": "player_id", "o_totalprice": "points", "o_orderpriority": "position"}
    return X.normalize_headers(table(spark, sf, "orders"), names).select(*names.values())


@query("c03_normalize_text", f"SELECT doc_id, nullif(trim(regexp_replace(text, '{WS}+', ' ', 'g')), '') AS text FROM documents")
def c03(spark, sf):
    return X.normalize_text(table(spark, sf, "documents").select("doc_id", "text"), ["text"])


@query("c04_normalize_ids", "SELECT c_custkey, lower(c_name) AS c_name FROM customer")
def c04(spark, sf):
    padded = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit(" \t"), "c_name", F.lit("  ")).alias("c_name"))
    return X.normalize_ids(padded, ["c_name"])


@query(
    "c05_to_team_id",
    """SELECT o_orderkey, CASE WHEN code IS NULL OR lower(trim(code)) = 'tot' OR regexp_full_match(lower(trim(code)), '\\d+tm')
    THEN 'tot' ELSE lower(trim(code)) END AS team_id
    FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'TOT' WHEN 'O' THEN cast(o_custkey % 9 AS varchar) || 'TM'
    ELSE CASE WHEN o_totalprice > 100000 THEN ' ' || substr(o_orderpriority, 3) END END AS code FROM orders)""",
)
def c05(spark, sf):
    code = (
        F.when(F.col("o_orderstatus") == "F", "TOT")
        .when(F.col("o_orderstatus") == "O", F.concat((F.col("o_custkey") % 9).cast("string"), F.lit("TM")))
        .when(F.col("o_totalprice") > 100000, F.concat(F.lit(" "), F.expr("substr(o_orderpriority, 3)")))
    )
    return table(spark, sf, "orders").select("o_orderkey", X.to_team_id(code).alias("team_id"))


@query("c06_fix_mojibake", "SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def c06(spark, sf):
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return table(spark, sf, "documents").select("doc_id", X.fix_mojibake(broken).alias("text"))


_LABEL = "cast(year(o_orderdate) - 1 AS varchar) || '-' || right(cast(year(o_orderdate) AS varchar), 2)"


@query("c07_season_end_year", "SELECT o_orderkey, cast(year(o_orderdate) AS integer) AS season FROM orders")
def c07(spark, sf):
    year = F.year("o_orderdate")
    cell = F.concat((year - 1).cast("string"), F.lit("-"), F.substring(year.cast("string"), -2, 2))
    # A third of the rows already hold the ending year, like the tables that store it as a number.
    cell = F.when(F.col("o_orderstatus") == "P", year.cast("string")).otherwise(cell)
    return table(spark, sf, "orders").select("o_orderkey", X.to_season_end_year(cell).alias("season"))


@query("c08_season_label", f"SELECT o_orderkey, {_LABEL} AS season_label FROM orders")
def c08(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.to_season_label(F.year("o_orderdate")).alias("season_label"))


@query(
    "c09_height_to_cm",
    "SELECT p_partkey, CASE WHEN p_size < 45 THEN round(((p_size // 12) * 30.48 + (p_size % 12) * 2.54)::double, 1) END AS height_cm FROM part",
)
def c09(spark, sf):
    size = F.col("p_size")
    cell = F.when(size < 45, F.concat(F.floor(size / 12).cast("string"), F.lit("-"), (size % 12).cast("string"))).otherwise("tall")
    return table(spark, sf, "part").select("p_partkey", X.height_to_cm(cell).alias("height_cm"))


@query("c10_weight_to_kg", "SELECT p_partkey, round(p_retailprice * 0.45359237, 1) AS weight_kg FROM part")
def c10(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.weight_to_kg(F.col("p_retailprice").cast("string")).alias("weight_kg"))


# A position cell made of the row's own columns: known names, empty tokens, and things that are no position.
_CELL_SQL = """CASE p_type WHEN 'ECONOMY' THEN 'Small Forward, Power Forward, , Shooting Guard' WHEN 'STANDARD' THEN 'Guard/Forward'
    WHEN 'PROMO' THEN 'Point Guard, 6-3, uniform, <' || p_name || '>' WHEN 'SMALL' THEN 'guardian, ' || p_brand ELSE ' center, FORWARD' END"""
_NAMES = "shooting guard|small forward|power forward|point guard|forward|center|guard"


def _cell():
    kind = F.col("p_type")
    return (
        F.when(kind == "ECONOMY", "Small Forward, Power Forward, , Shooting Guard")
        .when(kind == "STANDARD", "Guard/Forward")
        .when(kind == "PROMO", F.concat(F.lit("Point Guard, 6-3, uniform, <"), "p_name", F.lit(">")))
        .when(kind == "SMALL", F.concat(F.lit("guardian, "), "p_brand"))
        .otherwise(" center, FORWARD")
    )


@query(
    "c11_split_positions",
    f"""SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array({_CELL_SQL}, '[,/]'),
    lambda t: regexp_extract(trim(t), '(?i)^({_NAMES})\\b', 1)), lambda x: x <> ''), '|') AS positions FROM part""",
)
def c11(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(X.split_positions(_cell()), "|").alias("positions"))


@query(
    "c12_position_code",
    """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'SF' WHEN 'STANDARD' THEN 'G' WHEN 'PROMO' THEN 'PG' WHEN 'SMALL' THEN NULL
    ELSE 'C' END AS code FROM part""",
)
def c12(spark, sf):
    first = F.try_element_at(X.split_positions(_cell()), F.lit(1))
    return table(spark, sf, "part").select("p_partkey", X.position_code(first).alias("code"))


@query(
    "c13_shooting_hand",
    """SELECT doc_id, CASE WHEN r AND l THEN 'both' WHEN r THEN 'right' WHEN l THEN 'left' END AS hand FROM (
    SELECT doc_id, regexp_matches(cell, '(?i)\\bright\\b') AS r, regexp_matches(cell, '(?i)\\bleft\\b') AS l FROM (
    SELECT doc_id, CASE lang WHEN 'en' THEN 'Shoots: Right Left' WHEN 'fr' THEN 'LEFT' WHEN 'de' THEN 'right ' ELSE 'bright leftover' END AS cell
    FROM documents))""",
)
def c13(spark, sf):
    lang = F.col("lang")
    cell = F.when(lang == "en", "Shoots: Right Left").when(lang == "fr", "LEFT").when(lang == "de", "right ").otherwise("bright leftover")
    return table(spark, sf, "documents").select("doc_id", X.parse_shooting_hand(cell).alias("hand"))


@query(
    "c14_college",
    "SELECT p_partkey, CASE WHEN p_size > 40 THEN NULL ELSE replace(p_name, ' ', ' ') || ' ' || p_brand END AS college FROM part",
)
def c14(spark, sf):
    cell = F.when(F.col("p_size") > 45, "Colleges").when(F.col("p_size") > 40, " , ").otherwise(
        F.concat(F.replace("p_name", F.lit(" "), F.lit(",")), F.lit(" , "), "p_brand")
    )
    return table(spark, sf, "part").select("p_partkey", X.clean_college(cell).alias("college"))


@query(
    "c15_birth_date",
    """SELECT o_orderkey, m AS birth_month, CASE WHEN o_orderstatus <> 'P' THEN
    try_cast(printf('%04d-%02d-%02d', y, m, d) AS date) END AS birth_date FROM (
    SELECT o_orderkey, o_orderstatus, cast(year(o_orderdate) AS integer) AS y, cast(month(o_orderdate) AS integer) AS m,
    cast(o_custkey % 31 + 1 AS integer) AS d FROM orders)""",
)
def c15(spark, sf):
    month = X.month_number(F.concat(F.date_format("o_orderdate", "MMMM"), F.lit(" ")))
    day = F.when(F.col("o_orderstatus") != "P", (F.col("o_custkey") % 31 + 1).cast("int"))
    return table(spark, sf, "orders").select(
        "o_orderkey", month.alias("birth_month"), X.assemble_date(F.year("o_orderdate"), month, day).alias("birth_date")
    )


@query(
    "c16_draft",
    """SELECT o_orderkey, cast(year(o_orderdate) AS integer) AS draft_year, CASE WHEN r <= 2 THEN r END AS draft_round,
    CASE WHEN r <= 2 THEN cast(o_custkey % 30 + 1 AS integer) END AS pick, CASE WHEN r <= 2 THEN cast(o_custkey % 60 + 1 AS integer) END AS overall
    FROM (SELECT *, cast(left(o_orderpriority, 1) AS integer) AS r FROM orders)""",
)
def c16(spark, sf):
    r = F.expr("cast(left(o_orderpriority, 1) AS int)")
    pick = F.when(
        r <= 2,
        F.format_string(
            " %s round (%drd pick, %dth overall)", F.when(r == 1, "1st").otherwise("2nd"), F.col("o_custkey") % 30 + 1, F.col("o_custkey") % 60 + 1
        ),
    ).otherwise("undrafted")
    draft = F.concat(F.year("o_orderdate").cast("string"), F.lit(" NBA Draft"))
    return table(spark, sf, "orders").select(
        "o_orderkey", X.draft_year(draft).alias("draft_year"), X.draft_round(pick).alias("draft_round"),
        X.draft_pick(pick, 1).alias("pick"), X.draft_pick(pick, 2).alias("overall"),
    )


@query(
    "c17_long_date",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE cast(o_orderdate AS date) END AS debut,
    CASE WHEN o_orderstatus = 'F' THEN NULL ELSE cast(year(o_orderdate) AS integer) END AS debut_year FROM orders""",
)
def c17(spark, sf):
    cell = F.when(F.col("o_orderstatus") == "F", "unknown").otherwise(F.date_format("o_orderdate", " MMMM d, yyyy"))
    debut = X.parse_long_date(cell)
    return table(spark, sf, "orders").select("o_orderkey", debut.alias("debut"), F.year(debut).alias("debut_year"))


@query("c18_dash_as_null", "SELECT l_orderkey, l_partkey, CASE WHEN l_discount > 0 THEN l_discount END AS discount FROM lineitem")
def c18(spark, sf):
    cell = F.when(F.col("l_discount") > 0, F.col("l_discount").cast("string")).otherwise(" - ")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", X.dash_to_number(cell).alias("discount"))


@query(
    "c19_coerce_numbers",
    "SELECT event_id, CASE WHEN event_type <> 'click' THEN try_cast(regexp_extract(props, '\\d+') AS integer) END AS k FROM events",
)
def c19(spark, sf):
    cell = F.when(F.col("event_type") == "click", F.col("props")).otherwise(F.regexp_extract("props", r"\d+", 0))
    return X.coerce_numbers(table(spark, sf, "events").select("event_id", cell.alias("k")), ["k"])


@query(
    "c20_trailing_note",
    "SELECT p_partkey, p_name AS name, CASE WHEN p_size > 25 THEN p_type END AS note FROM part",
)
def c20(spark, sf):
    cell = F.when(F.col("p_size") > 25, F.concat("p_name", F.lit("  ("), "p_type", F.lit(") "))).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", X.without_trailing_note(cell).alias("name"), X.trailing_note(cell).alias("note"))


@query(
    "c21_two_part_split",
    """SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS first_part,
    CASE WHEN o_orderstatus = 'F' THEN NULL ELSE split_part(o_orderpriority, '-', 2) END AS second_part FROM orders""",
)
def c21(spark, sf):
    cell = F.when(F.col("o_orderstatus") == "F", F.expr("left(o_orderpriority, 1)")).otherwise(F.col("o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", X.part(cell, "-", 1).alias("first_part"), X.part(cell, "-", 2).alias("second_part"))


@query("c22_last_token_upper", "SELECT p_partkey, upper(split_part(p_name, ' ', -1)) AS token FROM part")
def c22(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.last_token_upper(F.concat("p_name", F.lit(" "))).alias("token"))


@query(
    "c23_sentinel_number",
    "SELECT l_orderkey, l_partkey, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN l_linenumber END AS experience FROM lineitem",
)
def c23(spark, sf):
    flag = F.col("l_returnflag")
    cell = F.when(flag == "A", F.col("l_linenumber").cast("string")).otherwise(flag)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", X.sentinel_to_int(cell).alias("experience"))


@query(
    "c24_rank_and_tie",
    "SELECT o_orderkey, cast(o_custkey % 12 AS integer) AS rank, o_orderstatus = 'P' AS tie FROM orders",
)
def c24(spark, sf):
    cell = F.concat((F.col("o_custkey") % 12).cast("string"), F.when(F.col("o_orderstatus") == "P", "t").otherwise(""))
    return table(spark, sf, "orders").select("o_orderkey", X.rank_number(cell).alias("rank"), X.rank_is_tied(cell).alias("tie"))


@query("c25_league_upper", "SELECT doc_id, upper(lang) AS league FROM documents")
def c25(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.upper("lang").alias("league"))


@query(
    "c26_combine_first",
    """SELECT o_orderkey, coalesce(CASE WHEN o_totalprice > 200000 THEN o_totalprice END, c_acctbal) AS value
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
def c26(spark, sf):
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey, "left")
    primary = F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice"))
    return rounded(joined.select("o_orderkey", F.coalesce(primary, "c_acctbal").alias("value")))

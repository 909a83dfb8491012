"""Queries for page extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.catalog.registry import query, table
from statloom.plans import columns as C
from statloom.sources import pages as H


def _pages(spark, sf):
    return table(spark, sf, "pages")


def _tabled(spark, sf):
    """Every page with a statistics table made of its own address put into the body."""
    c = F.col
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    rows = F.concat(
        F.lit('<table id="stats"><tr class="thead"><th data-stat="season">Season</th></tr><tr><th scope="col" data-stat="season">Season</th></tr>'),
        F.lit('<tr><th scope="row" data-stat="season"><a href="/leagues/'), c("page_id").cast("string"), F.lit('.html">'), (c("page_id") + 1900).cast("string"),
        F.lit('</a>*</th><td data-stat="champion"><a href="/teams/T'), c("page_id").cast("string"), F.lit('/2025.html">'), host,
        F.lit('</a> (7)</td><td data-stat="mvp"> </td></tr><tr><td>no stat</td></tr><tr><td data-stat="season">'), host, F.lit("</td></tr></table>"),
    )
    return _pages(spark, sf).withColumn("html", F.concat(rows, "html"))


_HOST = "regexp_extract(url, '^https?://([^/]+)', 1)"


@query(
    "h01_stat_table_rows",
    f"""SELECT page_id, 0 AS row_no, cast(page_id + 1900 AS varchar) AS season, '/leagues/' || page_id || '.html' AS season_href, {_HOST} AS champion, CAST(NULL AS varchar) AS mvp FROM pages
    UNION ALL SELECT page_id, 1, {_HOST}, NULL, NULL, NULL FROM pages""",
)
def h01(spark, sf):
    rows = H.stat_table_rows(_tabled(spark, sf), "stats")
    return rows.select("page_id", "row_no", *[F.try_element_at("cells", F.lit(k)).alias(k) for k in ("season", "season_href", "champion", "mvp")])


def _boxed(spark, sf):
    c = F.col
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    box = F.concat(
        F.lit('<div id="info"><div id="meta"><h1><span>'), host, F.lit("</span></h1><p><strong>Team Names:</strong> "), host, F.lit(";</p><p><strong>Seasons:</strong>\n 80; 1946-47 to "),
        (c("page_id") + 1900).cast("string"), F.lit("</p><p>none</p><p><strong>Position:</strong> Guard ▪ <strong>Shoots:</strong> Right<br>hand </p></div></div>"),
    )
    return _pages(spark, sf).withColumn("html", F.concat(box, "html"))


@query(
    "h02_meta_box",
    f"SELECT page_id, {_HOST} AS team_names, '80; 1946-47 to ' || (page_id + 1900) AS seasons, 'Guard ▪ Shoots: Right hand' AS position FROM pages",
)
def h02(spark, sf):
    out = H.meta_box(_boxed(spark, sf))
    return out.select("page_id", *[F.try_element_at("fields", F.lit(k)).alias(k) for k in ("team_names", "seasons", "position")])


@query("h03_label_pairs", f"SELECT page_id, {_HOST} AS team_names, 'Guard' AS position, 'Right hand' AS shoots FROM pages")
def h03(spark, sf):
    out = H.label_pairs(_boxed(spark, sf))
    return out.select("page_id", *[F.try_element_at("fields", F.lit(k)).alias(k) for k in ("team_names", "position", "shoots")])


@query(
    "h04_snake_case",
    r"""SELECT page_id, lower(trim(regexp_replace(regexp_replace(url, ':+$', ''), '[^\w]+', '_', 'g'), '_')) AS name FROM (SELECT page_id, replace(url, '__', '_') AS url FROM pages)""",
)
def h04(spark, sf):
    return _pages(spark, sf).select("page_id", H.to_snake_case(F.concat(F.replace("url", F.lit("__"), F.lit("_")), F.lit(":"))).alias("name"))


@query(
    "h05_try_int",
    "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice)::bigint END AS value FROM orders",
)
def h05(spark, sf):
    cell = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("N/A "), "o_orderpriority")).otherwise(F.format_number(F.floor("o_totalprice"), 0))
    return table(spark, sf, "orders").select("o_orderkey", H.try_int(cell).alias("value"))


@query(
    "h06_seasons_summary",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN cast(o_custkey % 90 AS integer) END AS "count",
    CASE o_orderstatus WHEN 'F' THEN 'from ' || year(o_orderdate) WHEN 'O' THEN 'since ' || year(o_orderdate) END AS "range" FROM orders""",
)
def h06(spark, sf):
    year = F.year("o_orderdate").cast("string")
    cell = F.when(F.col("o_orderstatus") == "F", F.concat((F.col("o_custkey") % 90).cast("string"), F.lit("; from "), year)).when(
        F.col("o_orderstatus") == "O", F.concat(F.lit(" since "), year, F.lit(";"))
    ).otherwise("unknown")
    return table(spark, sf, "orders").select("o_orderkey", H.seasons_summary(cell).alias("s")).select("o_orderkey", "s.count", "s.range")


_HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))[^>]*>(.*?)</a>"""
_FORMS = ", ".join(f"unnest(regexp_extract_all(html, '{_HREF}', {i})) AS h{i}" for i in (1, 2, 3))
_LINKS = rf"""found AS (SELECT page_id, url, {_FORMS}, unnest(range(len(regexp_extract_all(html, '{_HREF}', 1)))) AS pos FROM pages),
    links AS (SELECT page_id, url, concat(h1, h2, h3) AS href, pos FROM found),
    abs AS (SELECT page_id, pos, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href ELSE regexp_extract(url, '^([a-zA-Z]+://[^/?]+)', 1) || href END AS link
    FROM links WHERE regexp_matches(href, '^(/|https?:)'))"""


@query("h07_page_links", f"WITH {_LINKS} SELECT page_id, min(pos)::bigint AS pos, link FROM abs GROUP BY page_id, link")
def h07(spark, sf):
    return H.page_links(_pages(spark, sf), "^(/|https?:)").select("page_id", F.col("pos").cast("long").alias("pos"), "link")


@query(
    "h08_merge_links",
    f"""WITH {_LINKS} SELECT link, min(s)::integer AS source FROM (SELECT link, 0 AS s FROM abs WHERE page_id < 100 UNION ALL SELECT link, 1 FROM abs WHERE page_id >= 100) GROUP BY 1""",
)
def h08(spark, sf):
    links = H.page_links(_pages(spark, sf), "^(/|https?:)")
    return H.merge_links([links.filter("page_id < 100"), links.filter("page_id >= 100")]).select("link", "source")


@query(
    "h09_href_id",
    """SELECT page_id, split_part(list_extract(list_filter(string_split(split_part(url, '?', 1), '/'), lambda p: p <> ''), -1), '.', 1) AS last_part,
    split_part(list_extract(list_filter(string_split(split_part(url, '?', 1), '/'), lambda p: p <> ''), -2), '.', 1) AS part_before FROM pages""",
)
def h09(spark, sf):
    return _pages(spark, sf).select("page_id", H.href_id(F.col("url")).alias("last_part"), H.href_id(F.col("url"), -2).alias("part_before"))


@query(
    "h10_normalise_url",
    """SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://[^/]+(?:/[^/?#]*)?') AS parent, regexp_replace(url || '#top', '#.*$', '') AS url FROM pages""",
)
def h10(spark, sf):
    return _pages(spark, sf).select(
        "page_id", H.parent_path(F.col("url"), 1).alias("parent"), H.normalize_url(F.concat("url", F.lit("#top"))).alias("url")
    )


def _bio_pages(spark, sf):
    c = F.col
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    n = c("page_id").cast("string")
    box = F.concat(
        F.lit('<div id="info"><div id="meta"><h1><span>'), host, F.lit("</span></h1><p><strong>Position:</strong> Point Guard and Shooting Guard ▪ <strong>Shoots:</strong> Left</p>"),
        F.lit("<p><span>6-"), (c("page_id") % 12).cast("string"), F.lit("</span>, <span>195lb</span> (198cm)</p><p><strong>Born:</strong> <a href='/friv/birthdays.cgi'>March 4</a>, <a href='/friv/birthyears.cgi'>"),
        (c("page_id") + 1900).cast("string"), F.lit("</a></p><p><strong>College:</strong> <a href='/friv/colleges.fcgi'>"), host, F.lit("</a></p><p><strong>Draft:</strong> <a>"), host,
        F.lit("</a>, 1st round ("), n, F.lit("th pick, "), n, F.lit("th overall), <a>2018 NBA Draft</a></p><p><strong>NBA Debut:</strong> <a>October 28, 2003</a></p>"),
        F.lit("<p><strong>Experience:</strong> "), n, F.lit(" years</p></div></div>"),
    )
    return _pages(spark, sf).withColumn("html", F.concat(box, "html"))


@query(
    "h11_bio_fields",
    f"""SELECT page_id, {_HOST} AS player_name, 'Point Guard, Shooting Guard' AS position, 'Left' AS shoots, '6-' || (page_id % 12) AS height, '195' AS weight, 'March' AS birthmonth, '4' AS birthday,
    cast(page_id + 1900 AS varchar) AS birthyear, {_HOST} AS college, {_HOST} AS draft_team, '1st round (' || page_id || 'th pick, ' || page_id || 'th overall)' AS draft_pick, '2018 NBA Draft' AS draft,
    cast(page_id AS varchar) AS experience, 'October 28, 2003' AS nba_debut FROM pages""",
)
def h11(spark, sf):
    return H.bio_fields(_bio_pages(spark, sf))


@query(
    "h12_career_line",
    "SELECT page_id, cast(page_id + 10 AS varchar) AS games, '20.1' AS points FROM pages",
)
def h12(spark, sf):
    n = (F.col("page_id") + 10).cast("string")
    box = F.concat(
        F.lit("<div class='stats_pullout'><div><div><span>SUMMARY</span><p>2024-25</p><p>Career</p></div><div><span>G</span><p>5</p><p>"), n,
        F.lit("</p></div><div><span>PTS</span><p>20.1</p></div><div><span>WS</span><p>1</p><p>-</p></div></div></div>"),
    )
    out = H.career_line(_pages(spark, sf).withColumn("html", F.concat(box, "html")))
    return out.select("page_id", *[F.try_element_at("stats", F.lit(k)).alias(a) for k, a in (("Career Games", "games"), ("Career Points", "points"))])


@query(
    "h13_map_records",
    f"""SELECT page_id, 'T' || page_id AS team_id, cast(page_id + 1900 AS varchar) AS season_year, {_HOST} AS champion_name FROM pages""",
)
def h13(spark, sf):
    rows = H.stat_table_rows(_tabled(spark, sf), "stats")
    # A season still under way has no champion and is skipped.
    out = H.map_records(rows, C.PAGE_SEASONS, {"team_id": ("champion", -2)}, ["page_id"]).filter(F.col("Champion Name").isNotNull())
    return out.select("page_id", "team_id", F.col("Season Year").alias("season_year"), F.col("Champion Name").alias("champion_name"))


#: What stands before and after a cell's value: quotes of all forms, nested tags, links with decoration.
_MARKUP = [
    ("<td data-stat='{}'>", "</td>"), ('<td class="right" data-stat="{}"> <b>', "</b>\n</td>"),
    ("<TD data-stat={}><div><div>", "</div></div></TD>"), ('<td data-stat="{}"><a href="/x/y.html">', "</a>*</td>"),
]


def _typed_html(kind: str):
    """A page of one type: its table, with header rows, beside another table."""
    spec = C.PAGE_TYPES[kind]
    n = F.col("page_id").cast("string")
    parts = [F.lit(f"<h1>no</h1><table id='other'><tr><td data-stat='age'>1</td></tr></table><div><table id=\"{spec.table}\"><thead><tr class='over_header'><th>x</th></tr><tr><th scope=col data-stat=age>Age</th></tr></thead><tr>")]
    linked = {stat: name for name, (stat, _) in spec.ids.items()}
    for i, stat in enumerate([*spec.columns, *[x for x in linked if x not in spec.columns]]):
        if stat in linked:
            before, after = f'<td data-stat="{stat}"><a href="/t/{stat}', "/2025.html?x=1\">" if spec.ids[linked[stat]][1] == -2 else '.html">'
            parts += [F.lit(before), n, F.lit(after), F.lit(stat + " "), n, F.lit("</a> (3)</td>")]
        else:
            before, after = _MARKUP[i % 4]
            parts += [F.lit(before.format(stat)), n, F.lit(after)]
    return F.concat(*parts, F.lit("</tr><tr class='thead'><td data-stat='age'>Age</td></tr></table></div>"))


def _routed(kind: str):
    spec = C.PAGE_TYPES[kind]
    columns = {**{name: f"'{stat}' || page_id" for name, (stat, _) in spec.ids.items()}}
    linked = {stat for stat, _ in spec.ids.values()}
    columns |= {name: f"'{stat} ' || page_id" if stat in linked else "cast(page_id AS varchar)" for stat, name in spec.columns.items()}
    asked = ", ".join(f'{value} AS "{name}"' for name, value in columns.items())
    sql = f"SELECT page_id, 0 AS row_no, {asked} FROM pages WHERE page_id % 2 = 0"

    def run(spark, sf):
        # Every second page is of this type, the others of one that has the same table under another name.
        pages = _pages(spark, sf).withColumns({"html": F.concat(F.col("html"), _typed_html(kind)), "type": F.when(F.col("page_id") % 2 == 0, kind).otherwise("teams")})
        return H.typed_records(H.route_pages(pages, "type"), kind)

    return sql, run


for _kind in ("player_stats", "advanced_stats", "mvp_candidates", "mvp_winners", "season_summaries", "team_season_rosters", "team_season_totals"):
    _sql, _run = _routed(_kind)
    query(f"h13_route_{_kind}", _sql)(_run)


def _team_pages(spark, sf):
    """Boxes of a club's season, or of a club, with playoff lines, numbers and labels in a row."""
    n, host = F.col("page_id").cast("string"), F.regexp_extract("url", "^https?://([^/]+)", 1)
    box = F.concat(
        F.lit("<div id=info class=x><div id='meta'><h1><span>2024-25</span> <span>"), host, F.lit("</span><span>Roster</span></h1><p><strong>Record:</strong> "), n, F.lit("-3, Finished <a href='/x'>1st</a></p><p>"),
        F.lit("<b><strong>Seasons:</strong> 80; 1946-47 to 2025-26;</b></p><p><strong>Games :</strong> 1,"), F.lpad(n, 3, "0"), F.lit("</p><p><strong>Team Name:</strong>\n"), host,
        F.lit("</p><p><strong>NBA 2025 Playoffs:</strong> Won <strong>Finals</strong> 4-3</p></div></div>"),
    )
    kind = F.when(F.col("page_id") % 2 == 0, "team_seasons").otherwise("teams")
    return _pages(spark, sf).withColumns({"html": F.concat("html", box), "type": kind})


def _field(name: str):
    return F.try_element_at("fields", F.lit(name)).alias(name)


@query(
    "h13_route_team_seasons",
    f"SELECT page_id, '2024-25' AS season, {_HOST} AS team_full_name, page_id || '-3, Finished 1st' AS record, 4::bigint AS n_fields, CAST(NULL AS varchar) AS nba_2025_playoffs FROM pages WHERE page_id % 2 = 0",
)
def h13_team_seasons(spark, sf):
    out = H.typed_records(H.route_pages(_team_pages(spark, sf), "type"), "team_seasons")
    return out.select("page_id", "season", "team_full_name", _field("record"), F.size("fields").cast("long").alias("n_fields"), _field("nba_2025_playoffs"))


@query(
    "h13_route_teams",
    f"SELECT page_id, '2024-25' AS team_full_name, {_HOST} AS team_names, 80 AS seasons_count, '1946-47 to 2025-26' AS seasons_range, '1,' || lpad(page_id::varchar, 3, '0') AS games FROM pages WHERE page_id % 2 = 1",
)
def h13_teams(spark, sf):
    out = H.typed_records(H.route_pages(_team_pages(spark, sf), "type"), "teams")
    return out.select("page_id", "team_full_name", _field("team_names"), "seasons_count", "seasons_range", _field("games"))


@query(
    "h02_meta_numbers",
    f"SELECT page_id, CASE WHEN page_id < 1000 THEN 1000 + page_id END::bigint AS games, page_id || '-3, Finished 1st' AS record, '80; 1946-47 to 2025-26' AS seasons, {_HOST} AS team_name FROM pages WHERE page_id < 1000",
)
def h02_numbers(spark, sf):
    out = H.meta_box(_team_pages(spark, sf).filter("page_id < 1000"))
    return out.select("page_id", F.try_element_at("numbers", F.lit("games")).alias("games"), _field("record"), _field("seasons"), _field("team_name"))


@query(
    "h14_challenge_pages",
    "SELECT page_id, " + " OR ".join(f"contains(html, '{m}')" for m in C.CHALLENGE_MARKERS) + " AS challenged FROM pages",
)
def h14(spark, sf):
    return _pages(spark, sf).select("page_id", H.is_challenge(F.col("html")).alias("challenged"))

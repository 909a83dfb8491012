"""Calendars, densities, Q-Q lines, all-pairs ranks and page events, against independent computations."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.functions import dist
from statloom.operators import compare as C
from statloom.operators import reduce as V
from statloom.operators import resample as B
from statloom.plans.columns import PAGE_CAREER
from statloom.sources import pages as H
from statloom.sources.events import PageScan, snake


@pytest.mark.parametrize("freq", ["7h", "90min", "45s", "3D", "B", "2B", "W-SUN", "W-WED", "2W-FRI", "MS", "ME", "2MS", "3ME", "QS-FEB", "QE-DEC", "2QE-JAN", "YS-APR", "YE-JUN", "2YS", "D", "h"])
def test_any_frequency(spark, freq):
    """Sums per period as pandas gives them, gaps included."""
    rng = np.random.default_rng(3)
    wide = freq[-1] in "DB" or freq[0].isdigit() and freq[1] in "WMQY" or freq[0] in "WMQY" or "Y" in freq
    spread = 3 * 86_400 if not wide else 1500 * 86_400
    stamps = pd.Timestamp("2019-11-27 13:45:10") + pd.to_timedelta(np.sort(rng.integers(0, spread, 60)), unit="s")
    pdf = pd.DataFrame({"t": stamps, "v": np.round(rng.normal(size=60), 3), "g": rng.choice(["a", "b"], 60)})
    df = spark.createDataFrame(pdf.assign(t=pdf["t"].dt.strftime("%Y-%m-%d %H:%M:%S")))
    got = V.time_resample(df, "t", "v", freq, "sum", "g").toPandas()
    for g, part in pdf.groupby("g"):
        index = part.set_index("t")["v"]
        want = index.resample(freq).sum()
        want[index.resample(freq).size() == 0] = np.nan
        mine = got[got["group"] == g].sort_values("period")
        assert list(pd.to_datetime(mine["period"])) == list(want.index), freq
        assert np.allclose(mine["value"], want, equal_nan=True)


def test_unknown_frequencies(spark):
    df = spark.createDataFrame([("2020-01-01", 1.0)], "t string, v double")
    for freq in ("0D", "fortnight", "W-XXX", "MS-FEB", "", "B-MON"):
        with pytest.raises(ValueError, match="unknown frequency"):
            V.time_resample(df, "t", "v", freq)


def test_density_is_the_kernel_sum_at_every_size(spark):
    rng = np.random.default_rng(1)
    for v in (np.round(rng.normal(size=40), 1), np.concatenate([rng.normal(size=6000), [250.0]]), rng.exponential(size=9000) * 1e-6 + 5, np.array([0.0, 1, 2, 3, 1e6])):
        got = V.kde_curve(spark.createDataFrame(pd.DataFrame({"v": v})), "v").orderBy("point").toPandas()
        h = v.std(ddof=1) * len(v) ** -0.2
        x = np.linspace(v.min(), v.max(), 200)
        want = np.exp(-0.5 * ((x[:, None] - v) / h) ** 2).sum(axis=1) / (len(v) * h * math.sqrt(2 * math.pi))
        assert np.allclose(got["x"], x) and np.abs(got["density"] - want).max() < 1e-9 * want.max()
    assert V.kde_curve(spark.createDataFrame([(1.0,)] * 9, "v double"), "v").count() == 0
    assert V.kde_curve(spark.createDataFrame([], "v double"), "v").count() == 0


def test_scores_of_long_runs():
    for n, first, last in ((50_000, 1, 50_000), (50_000, 2, 700), (3000, 1, 3000), (10_000, 5000, 5000), (10_000, 4000, 4127), (10_000, 9000, 10_000), (400_000, 100_000, 399_999)):
        i = np.arange(first, last + 1)
        end = 0.5 ** (1 / n)
        z = dist.norm_ppf_array(np.where(i == n, end, np.where(i == 1, 1 - end, (i - 0.3175) / (n + 0.365))))
        one, two = V.run_scores(np.array([float(first)]), np.array([float(last)]), np.array([float(n)]))
        assert one[0] == pytest.approx(z.sum(), abs=1e-7) and two[0] == pytest.approx((z * z).sum(), rel=1e-10), (n, first, last)


def test_qq_line_from_the_histogram(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([np.round(rng.normal(size=3000) * 2 + 1e4, 1), np.full(2500, 1e4)])
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    points = V.qq_points(df, "v").toPandas()
    slope, intercept = np.polyfit(points["theoretical"], points["sample"], 1)
    got = V.qq_line(df, "v").first()
    assert got["slope"] == pytest.approx(slope) and got["intercept"] == pytest.approx(intercept)
    assert got["r"] == pytest.approx(np.corrcoef(points["theoretical"], points["sample"])[0, 1])
    flat = V.qq_line(spark.createDataFrame([(2.0,)] * 5, "v double"), "v").first()
    assert flat["r"] is None and flat["slope"] == pytest.approx(0, abs=1e-12)


@pytest.mark.parametrize("cells", [2_000_000, 7])
def test_all_pairs_from_one_histogram(spark, monkeypatch, cells):
    monkeypatch.setattr(C, "_CELLS", cells)
    monkeypatch.setattr(C, "_GROUPS_AT_ONCE", 2)
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": rng.choice(["p", "q"], 900), "g": rng.choice(list("abcde"), 900, p=[0.5, 0.2, 0.15, 0.1, 0.05]), "x": np.round(rng.normal(size=900), 1)})
    rows = spark.createDataFrame(pdf).select("k", F.col("g").alias("grp"), F.col("x").alias("value"))
    names = [(k, a, b) for k in "pq" for a, b in itertools.combinations("abcde", 2)]
    pairs = spark.createDataFrame(names, "k string, group_a string, group_b string")
    got = {(r.k, r.group_a, r.group_b): r for r in C.pair_rank_stats(rows, pairs, ["k"]).collect()}
    assert set(got) == set(names)
    for k, a, b in names:
        x, y = (pdf[(pdf["k"] == k) & (pdf["g"] == s)]["x"].to_numpy() for s in (a, b))
        place_x = np.array([(y < v).sum() + (y == v).sum() / 2 for v in x])
        place_y = np.array([(x < v).sum() + (x == v).sum() / 2 for v in y])
        t = pd.Series(np.concatenate([x, y])).value_counts().to_numpy().astype(float)
        gap = max((x <= v).mean() - (y <= v).mean() for v in x), max((y <= v).mean() - (x <= v).mean() for v in y)
        r = got[(k, a, b)]
        assert (r.u, r.u_b, r.ties) == (place_x.sum(), place_y.sum(), (t**3 - t).sum())
        assert (r.qa, r.qb) == pytest.approx(((place_x**2).sum(), (place_y**2).sum()))
        assert (r.d_up, r.d_down) == pytest.approx(gap) and (r.median_a, r.median_b) == pytest.approx((np.median(x), np.median(y)))


def test_pages_of_any_depth_and_markup():
    deep = "<div>" * 5000
    html = f"""{deep}<table id=t><tr><td data-stat=a>1<td data-stat="b"><a href='/x'>two</a> (3)</tr></table>{'</div>' * 2500}
    <div id="info"><p><strong>Outside:</strong> no</p><div id="meta"><p><strong>A:</strong> 1 <em>x</em></p><p><b><strong>B b</strong> in</b> out</p><p>none</p>
    <p><strong>C</strong>: 3 ▪ <strong>D</strong>: <br/>4; <strong></strong>lost</p><p><strong>E</strong></p></div><div id=meta><p><strong>Z</strong> z</p></div></div>"""
    scan = PageScan.of(html, {"t", "none"})
    assert scan.rows("t") == [{"a": "1 two (3)", "b": "two", "b_href": "/x"}] or scan.rows("t") == [{"a": "two", "b": "two", "b_href": "/x", "a_href": "/x"}]
    assert scan.rows("none") == []
    assert scan.first_label == {"a": "1 x", "b_b": "in", "c": "3 ▪ D : 4; lost", "e": ""}
    assert scan.every_label == {"a": "1 x", "c": "3", "d": "4"}
    for text in (None, "", "<", "</p></p><p", "<td data-stat=a>loose", "<table id=t>", "<tr><td data-stat='x'>1", "<div class='stats_pullout'>"):
        empty = PageScan.of(text, {"t"}, PAGE_CAREER)
        assert empty.rows("t") == [] and empty.bio() is None and empty.career() == {} and empty.first_label == {}
    assert len(PageScan.of("</a>" * 20_000 + "<p>" * 20_000, set()).stack) == 1
    assert [snake(x) for x in ("Draft Position:", " NBA  Debut__x: ", "3-Pt %", "É")] == ["draft_position", "nba_debut_x", "3_pt", "é"]


def test_tables_of_a_page_in_one_scan(spark):
    row = "<tr class='thead'><td data-stat=n>h</td></tr><tr><th scope=col data-stat=n>N</th></tr><tr><td>x</td></tr><tr><td data-stat=n> {} </td><td data-stat=m></td></tr>"
    html = "".join(f"<TABLE ID='t{i}'>{row.format(i)}</TABLE>" for i in range(3)) + "<table id=t1><tr><td data-stat=n>again</td></tr></table>"
    pages = spark.createDataFrame([(1, "u", html), (2, "u", None)], "page_id long, url string, html string")
    got = {r.page_id: r.tables for r in H.scan_pages(pages, ["t0", "t1", "t2"]).collect()}
    assert got[1] == {f"t{i}": [{"n": str(i), "m": None}] for i in range(3)}
    assert got[2] == {"t0": [], "t1": [], "t2": []}
    with pytest.raises(KeyError):
        H.typed_records(pages, "nothing")


def test_routing_leaves_out_what_a_type_does_not_want(spark):
    rows = [("season_summaries", "<table id=stats><tr><td data-stat=season>2025</td><td data-stat=champion></td></tr><tr><td data-stat=season>2024</td><td data-stat=champion>X</td></tr></table>"), ("nothing", "<table id=stats></table>"), (None, "x")]
    pages = spark.createDataFrame([(i, k, h) for i, (k, h) in enumerate(rows)], "page_id long, what string, html string")
    scanned = H.route_pages(pages, "what")
    assert [(r["Season Year"], r["Champion Name"], r["row_no"]) for r in H.typed_records(scanned, "season_summaries").collect()] == [("2024", "X", 1)]
    assert H.typed_records(scanned, "teams").count() == 0


def test_group_level_names_survive(spark):
    """Pairwise rank tests against a reference group, by key, with a group too small to take part."""
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"g": ["a"] * 40 + ["b"] * 30 + ["c"] * 20 + ["d"], "x": rng.normal(size=91).round(1)})
    got = C.pairwise_comparisons(spark.createDataFrame(pdf), "g", "x", test="mannwhitney", ref_group="b").toPandas()
    assert len(got) == 2 and B.STATISTICS

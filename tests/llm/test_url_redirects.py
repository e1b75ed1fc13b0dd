import time

import duckdb

from galley.llm import shared
from galley.llm import url_redirects as U
from galley.llm.queries import QUERIES

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "bad.org", "/")]


def page(target=None, refresh=None):
    head = f'<link href="{target}" rel="canonical">' if target else ""
    head += f'<meta http-equiv="refresh" content="0; url={refresh}">' if refresh else ""
    return f"<html><head>{head}</head></html>"


PAGES = [
    (1, "http://www.Example.COM/en/7?x=1", page()),
    (2, "https://a.example.com/en/8#top", page()),
    (3, "http://mirror.net/a", page("http://bad.org/page")),
    (4, "HTTP://mirror.net:80/x/../a#top", page()),
    (5, "http://other.net/b", page(refresh="http://mirror.net/a")),
    (6, "http://fine.net/c", page("/d")),
    (7, "http://fine.net/d", None),
    (8, None, None),
    (9, "nonsense", page("http://bad.org/x")),
    (10, "http://example.com/en/7b", page("http://bad.org/page")),
    (10, "http://example.com/en/7b", page("http://bad.org/page")),
    (11, "http://x.com?/en/", page()),
    (12, "https://rel.net/dir/p?q=1", page("../bad?a=1&amp;b=2")),
    (13, "https://rel.net:443/bad?a=1&b=2", page("//bad.org/z")),
    (14, "https://rel.net/dir/mail", page("mailto:x@bad.org")),
    (15, "https://rel.net/dir/q", page(refresh="?page=2")),
    (16, "https://rel.net/dir/q?page=2", page("other")),
    (17, "https://rel.net/dir/./other", page("http://bad.org/w")),
    (18, "http://mirror.net/a/?utm_source=feed", page()),
    (19, "http://m.fine.net/page.html", page("#top")),
]


def test_rules_aliases_and_precedence(spark):
    rows = U.judge_urls(spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' as host"), RULES).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == len(PAGES)
    assert got[1] == ("www.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[2] == ("a.example.com", "/en/8", "com/en/", "block")
    assert [got[i][2:] for i in (3, 4, 5)] == [(None, "block")] * 3
    assert [got[i][2:] for i in (6, 7, 8, 9)] == [(None, "allow")] * 4
    assert [got[i][2:] for i in (12, 13, 15, 16, 17)] == [(None, "block")] * 5
    assert [got[i][2:] for i in (14, 18, 19)] == [(None, "allow")] * 3
    assert got[8][:2] == got[9][:2] == ("", "")
    assert got[10][2:] == ("example.com/en/7", "allow")
    assert got[11] == ("x.com", "", None, "allow")


def test_same_rows_as_duckdb(spark):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    con = duckdb.connect()
    con.register("pages", frame.toArrow())
    want = con.sql(U.oracle_sql(RULES))
    got = U.judge_urls(frame, RULES).select(*want.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_usual_redirects_are_asked_for(spark):
    rows = U.judge_urls(spark.createDataFrame(PAGES, "page_id long, url string, html string"), RULES, usual=True).collect()
    got = {r.page_id: r.verdict for r in rows}
    assert (got[18], got[19], got[4]) == ("block", "allow", "block")


def test_of_rules_of_one_length_the_lesser_string_wins(spark):
    frame = spark.createDataFrame([(1, "http://a.b.com/x", None)], "page_id long, url string, html string")
    row = U.judge_urls(frame, [("allow", "b.com", "/x"), ("block", "com", "/x"), ("block", "a.b.com", "")]).first()
    assert (row.rule, row.verdict) == ("a.b.com", "block")


def test_observed_redirects_and_empty(spark):
    frame = spark.createDataFrame([(1, "http://p.net/1", None)], "page_id long, url string, html string")
    moves = spark.createDataFrame([("http://p.net/1", "http://q.net/2"), ("http://q.net/2", "http://bad.org/3")], "src string, dst string")
    assert U.judge_urls(frame, RULES, moves).first().verdict == "block"
    assert U.judge_urls(frame.limit(0), RULES).count() == 0


def test_connected_components_on_paths_stars_and_null(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, None), (200, 200), (300, 299)]
    got = {r.node: r.component for r in shared.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)} | {299: 299, 300: 299}


def test_a_long_path_of_ordered_or_mixed_ids_takes_few_rounds(spark):
    n, began = 5000, time.monotonic()
    for name in (lambda i: i, lambda i: i * 2_654_435_761 % 1_000_003):
        edges = spark.createDataFrame([(name(i), name(i + 1)) for i in range(n)], "src long, dst long")
        rows = shared.connected_components(edges).collect()
        assert len(rows) == n + 1 and {r.component for r in rows} == {min(name(i) for i in range(n + 1))}
    assert time.monotonic() - began < 240


def test_the_querys_rules_are_those_of_its_contract(spark, tmp_path):
    urls = ["https://www.example.net/de/1", "http://example.net/de/8", "http://b.org/es/x", "http://a.com/en/7", "http://m.example.com/en/7", "http://a.net/fr/"]
    spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in QUERIES["op1_url_redirects"](spark, str(tmp_path)).collect()}
    want = [("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"), ("com/en/", "block"), ("example.com/en/7", "allow"), (None, "allow")]
    assert [got[i] for i in range(len(urls))] == want

"""URL rules and the cascade under them, against plain Python."""

import pytest
from pyspark.sql import functions as F

from cairn.llm import queries, url_filter
from tests.compare import by_sql, rows


def _judge(url, rules, default="allow"):
    _, sep, rest = (url or "").partition("://")
    stop = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:stop]) if sep else ""
    tail = rest[stop:] if sep else ""
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fit = [(len(h) + len(p), len(h), h + p, v == "block") for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], default if best is None else "block" if best[3] else "allow"


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("a.b.net", "", "block"), ("ünicode.org", "/é", "block"), ("net", "/x", "allow"), ("net", "/x", "block"), ("org:8080", "/", "block")]
URLS = [
    None, "", "no scheme", "http://", "http:///en/", "HTTP://WWW.Example.COM/en/1", "http://example.com/en", "http://example.com/en/?x=://b.net/es/", "https://m.example.com/en/a#f", "http://notexample.com/en/",
    "ftp://b.net/es/", "x://a.b.net", "x://a.b.net?q", "x://z.a.b.net#q", "http://ünicode.org/été", "http://Ünicode.org/été", "http://q.net/xyz", "http://a.org:8080/", "http://a..com./en/", "http://" + "a." * 3000 + "example.com/en/" + "p" * 20000,
    "http://line\nbreak.com/en/x\ny", "http://com", "http://com/",
]


def frames(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "clash", "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, key string, verdict string")
    return pages, spark.createDataFrame(rules, "host string, path string, verdict string")


@pytest.mark.parametrize("part_keys", [1 << 22, 3])
def test_rules_against_brute_force(spark, part_keys):
    pages, rules = frames(spark, URLS, RULES)
    got = url_filter.judge(pages, rules, part_keys=part_keys).collect()
    assert {r["page_id"]: tuple(r)[1:] for r in got} == {i: _judge(u, RULES) for i, u in enumerate(URLS)}
    assert len(got) == len(URLS)


def test_empty_tables_nulls_and_repeats(spark):
    pages, rules = frames(spark, URLS[:6] * 2, RULES)
    none = spark.createDataFrame([], rules.schema)
    assert {(r["rule"], r["verdict"]) for r in url_filter.judge(pages, none, default="block").collect()} == {(None, "block")}
    assert url_filter.judge(pages.limit(0), rules).collect() == []
    odd = spark.createDataFrame([(None, "/", "block"), ("", "/", "block"), ("COM", None, "block"), ("example.com", "/", None)], rules.schema)
    got = [tuple(r)[3:] for r in url_filter.judge(pages, odd).orderBy("page_id").collect()]
    assert got[:6] == got[6:]
    assert got[5] == ("example.com/", "allow")
    assert got[4] == (None, "allow")


@pytest.mark.parametrize("n", [1, 40, 700])
def test_cascade_is_exact_over_its_universe(spark, n):
    universe = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(0, 20000, 20000 // n).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = url_filter.build(listed, universe.unionAll(universe))
    if n > 1:
        assert len(cascade.levels) > 1  # some key did pass the first level without cause
    assert sum(len(x.bitmap) for x in cascade.levels) <= 32 + 8 * listed.count()
    got = universe.where(cascade.holds(F.col("key")))
    assert sorted(got.collect()) == sorted(listed.collect())


def test_no_python_and_no_join_in_the_plan(spark, sf):
    plan = queries.op11_url_filter(spark, sf)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan


def test_query_agrees_with_sql(spark, sf):
    got, want = queries.op11_url_filter(spark, sf).toPandas(), by_sql(queries.ORACLE_SQL["op11_url_filter"], sf)
    assert rows(got) == rows(want)
    assert set(got["verdict"]) == {"allow", "block"}

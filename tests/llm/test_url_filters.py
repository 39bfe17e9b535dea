import pytest
from pyspark.sql import functions as F

from ledgerline.llm.native_queries import URL_RULES
from ledgerline.llm.url_filters import Rule, filter_urls, host_reputation, registered_domain, suffix_of

URLS = [
    ("http://A.Example.COM/en/1?x", "a.example.com", "/en/1", "example.com/en/", "block"),
    ("http://www.example.com/en/1#a", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("https://x.www.example.com/en/", "x.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://b.com/de/", "b.com", "/de/", "com/", "allow"),
    ("https://b.com", "b.com", "", None, "allow"),
    ("https://b.com?x=/en/", "b.com", "", None, "allow"),
    ("https://a.net/es/4", "a.net", "/es/4", "net/es/", "block"),
    ("https://notnet/es/4", "notnet", "/es/4", None, "allow"),
    ("https://net/fr/", "net", "/fr/", "net/fr/", "block"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("x://http://c.com/a", "http:", "//c.com/a", None, "allow"),
    ("http://É.com/É?é", "É.com", "/É", "com/", "allow"),
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "url string, good int")
    found = filter_urls(pages, none, URL_RULES, least_good=-9.0).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in found] == [u[1:] for u in URLS]


def test_equally_long_rules_prefer_the_host_then_block(spark):
    pages = spark.createDataFrame([(1, "http://a.bc/d")], "page_id long, url string")
    none = spark.createDataFrame([], "url string, good int")
    rules = [Rule("allow", "bc", "/d"), Rule("allow", "a.bc", ""), Rule("block", "a.bc", "")]
    assert filter_urls(pages, none, rules).first().verdict == "block"


def test_levels_shrink_towards_each_other(spark):
    outcomes = [("bad.site.com", 0)] * 60 + [("good.site.com", 1)] * 60 + [("few.other.org", 1)] + [("x.other.org", None)]
    labelled = spark.createDataFrame(outcomes, "host string, good int")
    hosts = spark.createDataFrame([(h,) for h in ("bad.site.com", "good.site.com", "new.site.com", "new.tld", "", "few.other.org")], "host string")
    mean = {r.host: r["mean"] for r in host_reputation(hosts, labelled).collect()}
    assert mean["bad.site.com"] < 0.1 < 0.4 < mean["new.site.com"] < 0.6 < 0.9 < mean["good.site.com"]
    assert mean["few.other.org"] > mean["new.site.com"]
    assert 0.4 < mean[""] < 0.7


def test_bound_blocks_bad_hosts(spark):
    pages = spark.createDataFrame([(1, "http://bad.a.com/x"), (2, "http://good.b.org/x"), (2, "http://good.b.org/x")], "page_id long, url string")
    labelled = spark.createDataFrame([("http://bad.a.com/y", 0)] * 50 + [("http://good.b.org/z", 1)] * 50, "url string, good int")
    found = sorted((r.page_id, r.verdict) for r in filter_urls(pages, labelled).collect())
    assert found == [(1, "block"), (2, "allow"), (2, "allow")]


def test_domains(spark):
    rows = spark.createDataFrame([("a.b.co.uk",), ("x.y.com",), ("y.com",), ("com",), ("",)], "h string")
    domain = registered_domain(F.col("h"))
    found = [tuple(r) for r in rows.select(domain, suffix_of(domain)).collect()]
    assert found == [("b.co.uk", "co.uk"), ("y.com", "com"), ("y.com", "com"), ("com", "com"), ("", "")]


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    none = spark.createDataFrame([], "url string, good int")
    assert filter_urls(pages, none, URL_RULES).collect() == []


@pytest.mark.parametrize("limit", ["-1", "10m"])
def test_same_result_with_and_without_broadcast(spark, limit):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        pages = spark.createDataFrame([(i, f"http://h{i % 7}.d{i % 3}.com/p") for i in range(200)], "page_id long, url string")
        labelled = pages.select("url", (F.col("page_id") % 7 > 2).cast("int").alias("good"))
        blocked = {r.host for r in filter_urls(pages, labelled).filter("verdict = 'block'").collect()}
        assert {h.split(".")[0] for h in blocked} == {"h0", "h1", "h2"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_ports_and_addresses(spark):
    hosts = ["a.b.com:8080", "b.com", "1.2.3.4:80", "9.2.3.4", "[::1]:80", "[fe80::1.2]"]
    domain = registered_domain(F.col("h"))
    found = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", domain, suffix_of(domain)).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == {
        "a.b.com:8080": ("b.com", "com"),
        "b.com": ("b.com", "com"),
        "1.2.3.4:80": ("1.2.3.4", "1.2.3.4"),
        "9.2.3.4": ("9.2.3.4", "9.2.3.4"),
        "[::1]:80": ("[::1]", "[::1]"),
        "[fe80::1.2]": ("[fe80::1.2]", "[fe80::1.2]"),
    }


def test_sql_says_the_same_about_ports_addresses_and_long_suffixes(spark, tmp_path):
    import duckdb

    from ledgerline.llm.native_queries import URL_SQL
    from ledgerline.llm.queries import QUERIES

    hosts = ["x.com.br", "y.com.br", "x.com.br:8080", "1.2.3.4", "1.2.3.5:80", "[::1]", "a.b.co.uk", "c.org.uk", "shop.example.org", "example.org:443", "www.example.com", ""]
    pages = [(i, f"http://{hosts[i % len(hosts)]}/en/{i}/p") for i in range(240)] + [(500, None), (501, "none")]
    spark.createDataFrame(pages, "page_id long, url string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    marks = [(i, int(i % len(hosts) in (0, 3, 7) or i % 5 == 0), 0) for i in range(0, 240) if i % len(hosts) not in (1, 4)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    found = sorted((tuple(r) for r in QUERIES["op8_url_filters"](spark, str(tmp_path)).collect()), key=repr)
    base = duckdb.connect()
    for name in ("pages", "labels"):
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert found == sorted(base.execute(URL_SQL).fetchall(), key=repr)
    reputation = host_reputation(
        spark.createDataFrame([("x.com.br",), ("y.com.br",), ("z.com.br",)], "host string"), spark.createDataFrame([("x.com.br", 0)] * 30, "host string, good int")
    )
    domains = {r.host: r.domain for r in reputation.collect()}
    assert domains == {"x.com.br": "x.com.br", "y.com.br": "y.com.br", "z.com.br": "z.com.br"}
    assert spark.range(1).select(registered_domain(F.lit("a.b.c.d"), ["b.c.d"])).first()[0] == "c.d"

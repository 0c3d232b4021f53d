from pyspark.sql import functions as F

from tidemark.llm import url_filter as U

from .helpers import duck, rows, same

SCHEMA = "page_id long, url string, verdict string, host string, w0 string"


def brute(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:k], rest[k:]
    k = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:k]


def test_pages_match_sql(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = U.judged(pages, U.reported(pages))
    same(rows(got.select("page_id", "host", "path", "rule", "verdict")), duck(sf, U.SQL))
    assert got.where("listed and not possible").count() == 0


def test_corner_cases(spark):
    urls = [None, "", "nothing", "://", "http://", "http://ORG", "http://org/", "http://a.Example.ORG/es/x?y", "http://example.org/en/1", "http://xexample.org/es/", "ftp://m.b.com/de/1.html", "http://b.com/fr/#/de/", "HTTP://ÀB.com/x", "a://b://c/d", "http://x.net/" + "p" * 50_000, "http://www.x.net/a.html?q", "https://m.x.net/a/", "http://x.net/a\nb", "http://example.org?x=/es/"]
    data = [(i, u, "v", "h", "w") for i, u in enumerate(urls)] + [(None, urls[15], None, None, None), (15, urls[15], "v", "h", "w")]
    pages = spark.createDataFrame(data, SCHEMA).repartition(3)
    listed = spark.createDataFrame([("x.net/a",), ("x.net/a",), (None,), ("org/",)], "listed string")
    out = U.judged(pages, listed)
    assert out.columns == ["page_id", "url", "w0", "host", "path", "rule", "verdict", "possible", "listed"]
    got = rows(out)
    assert len(got) == len(data)
    for r in got:
        assert (r["host"], r["path"]) == brute(r["url"])
        assert r["listed"] == (r["rule"] is None and U_canonical(r["host"], r["path"]) == "x.net/a")
        assert r["verdict"] == {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block", None: "block" if r["listed"] else "allow"}[r["rule"]]
    assert {r["page_id"]: r["rule"] for r in got if r["page_id"] in (5, 6, 7, 8, 9, 10)} == {5: None, 6: "org/", 7: "example.org/es/", 8: "example.org/en/1", 9: "org/", 10: "com/de/"}
    assert U.judged(pages.limit(0), listed).count() == 0
    assert U.judged(pages, listed.limit(0)).where("listed").count() == 0


def U_canonical(host, path):
    if not host:
        return None
    for p in ("www.", "m."):
        if host.startswith(p):
            host = host[len(p) :]
            break
    return host + path.rstrip("/").removesuffix(".html")


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(20_000).select(F.concat(F.lit("h.net/"), "id").alias("listed"))
    pages = spark.range(60_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.net/"), "id").alias("url"))
    got = U.judged(pages, listed).groupBy("listed", "possible").count().collect()
    n = {(r.listed, r.possible): r["count"] for r in got}
    assert n[(True, True)] == 20_000 and (True, False) not in n
    assert n.get((False, True), 0) < 400


def test_filter_and_list_beyond_the_broadcast(spark, sf, monkeypatch):
    """Shuffled joins, with heavy URLs dealt out, give the same rows."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    hot = spark.range(3000).select((F.col("id") + 10**6).alias("page_id"), F.lit("http://hot.net/x").alias("url"))
    every = pages.union(hot).union(hot.select("page_id", F.lit(None).cast("string")))
    listed = U.reported(pages).union(spark.sql("select 'hot.net/x'"))
    want = sorted(map(str, U.judged(every, listed).collect()))
    monkeypatch.setattr(U, "MOST_BLOCKS", 0)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(str, U.judged(every, listed).collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)

import pytest
from pyspark.sql import Row

from turnweave.llm import url_filter

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"), ("host.net", "block"), ("twice.net/", "allow"), ("twice.net/", "block")]
FOLD = str.maketrans(url_filter.UPPER, url_filter.LOWER)


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host, rest = rest[:end].translate(FOLD), rest[end:]
        path = rest[: next((i for i, c in enumerate(rest) if c in "?#"), len(rest))]
    best = None
    for key, verdict in RULES:
        h, slash, p = key.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            best = max(best or (0, "", ""), (len(key), key, verdict))
    return (host, path, best[1] if best else None, best[2] if best else "allow")


URLS = [None, "", "no scheme", "http://", "http:///x", "http://example.org", "http://example.org/", "HTTP://WWW.Example.ORG/es/1?x#y", "https://example.org/en/123", "https://example.org/en/2", "http://badexample.org/es/", "http://a.b.com/fr/x"]
URLS += ["http://com/de/", "http://x.com/DE/", "http://host.net", "http://sub.host.net?q=/a", "http://twice.net/a", "http://a://b.org/c", "http://Ünï.org/é\nx", "http://e.org:80/", "http://" + "a." * 500 + "org/" + "p" * 3000, "http://x.org/1 2#", "http://example.org/es/"]


@pytest.mark.parametrize("options", [{}, {"max_words": 0}, {"bits_per_key": 1}])
def test_against_rules(spark, options):
    pages = spark.createDataFrame([Row(page_id=i if i != 3 else None, url=u, key="k", rule=1) for i, u in enumerate(URLS + URLS[5:7])], "page_id int, url string, key string, rule int")
    listed = spark.createDataFrame([(k, v, k) for k, v in RULES], "key string, verdict string, rule string")
    got = url_filter.judge(pages, listed, **options).collect()
    assert sorted(map(str, ((r.host, r.path, r.rule, r.verdict) for r in got))) == sorted(map(str, map(brute, URLS + URLS[5:7])))
    assert sum(r.page_id is None for r in got) == 1


def test_unnamed_entries_and_empty_tables(spark):
    schema = "key string, verdict string, rule string"
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://a.net/y")], "page_id int, url string")
    listed = spark.createDataFrame([("a.net/", "block", None), ("net/x", "allow", "net/x")], schema)
    assert {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, listed).collect()} == {1: ("net/x", "allow"), 2: (None, "block")}
    empty = spark.createDataFrame([], schema)
    assert {r.verdict for r in url_filter.judge(pages, empty).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), listed).collect() == []


@pytest.mark.parametrize("bits_per_key", [2, 16])
def test_many_blocks(spark, bits_per_key):
    pages = spark.range(3000).selectExpr("id AS page_id", "concat('http://h', id, '.net/p') AS url")
    listed = spark.range(0, 3000, 2).selectExpr("concat('h', id, '.net/') AS key", "'block' AS verdict", "CAST(NULL AS STRING) AS rule")
    got = url_filter.judge(pages, listed, bits_per_key=bits_per_key)
    assert "PythonUDF" not in got._jdf.queryExecution().toString()
    assert sorted(r.page_id for r in got.where("verdict = 'block'").collect()) == list(range(0, 3000, 2))
    assert got.count() == 3000

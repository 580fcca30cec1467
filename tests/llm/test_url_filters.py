from pyspark.sql import functions as F

from assayframe.llm import url_filters
from assayframe.llm.queries import URL_RULES

CASES = {
    "http://a.example.org/es/1": ("example.org/es/", "block"),
    "https://EXAMPLE.ORG/en/12?q": ("example.org/en/1", "block"),
    "http://example.org/en/2": ("org/", "allow"),
    "http://badexample.org/es/1": ("org/", "allow"),
    "http://x.com/fr/a": ("com/fr/", "allow"),
    "http://com/de/": ("com/de/", "block"),
    "http://x.com/deu/": (None, "allow"),
    "http://x.org": (None, "allow"),
    "http://x.org?/": (None, "allow"),
    "http://org.net/": (None, "allow"),
    "no scheme.org/": (None, "allow"),
    "": (None, "allow"),
    None: (None, "allow"),
    "x://y://z.org/": (None, "allow"),
    "http://É.org/#a/b": ("org/", "allow"),
}


def rules(spark, rows=URL_RULES):
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def test_cases(spark):
    pages = spark.createDataFrame(list(enumerate(CASES)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.judge(pages, rules(spark)).collect()}
    assert got == dict(enumerate(CASES.values()))


def test_parts(spark):
    pages = spark.createDataFrame([(1, "a://H?o/x"), (2, "://Ab:80/p/q?r#s"), (3, "http:/x")], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"]) for r in url_filters.judge(pages, rules(spark)).collect()}
    assert got == {1: ("h", ""), 2: ("ab:80", "/p/q"), 3: ("", "")}


def test_repeated_rows_clashing_columns_and_no_rules(spark):
    pages = spark.createDataFrame(
        [(1, "http://x.org/", "k", "v"), (1, "http://x.org/", "k", "v"), (None, None, None, None)],
        "page_id long, url string, key string, verdict string",
    )
    got = url_filters.judge(pages, rules(spark))
    assert sorted(r["verdict"] for r in got.collect()) == ["allow"] * 3
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert url_filters.judge(pages, rules(spark, []), "block").where("verdict = 'block'").count() == 3
    assert url_filters.judge(pages.limit(0), rules(spark)).count() == 0


def test_contradicting_and_null_rules(spark):
    listed = rules(spark, [("A.org", "/", "allow"), ("a.org", "/", "block"), (None, "/", "block"), ("b.org", None, "block")])
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://b.org/x")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filters.judge(pages, listed).collect()}
    assert got == {1: "block", 2: "allow"}


def test_filter_passes_every_listed_key_and_few_others(spark):
    listed = spark.range(5000).select(F.concat(F.lit("in"), "id").alias("key"))
    others = spark.range(5000).select(F.concat(F.lit("out"), "id").alias("key"))
    assert url_filters.possible_hits(listed, listed).count() == 5000
    assert url_filters.possible_hits(others, listed).count() < 400

"""op1_url_filter judges by the rules of its contract, word by word."""

from pyspark.sql import functions as F

from chronoframe.llm.url_filter import op1_url_filter

#: One url for each rule of the contract, with the rule and the verdict that the contract gives it.
CONTRACT = [
    ("http://a.com/en/1", "com/en/", "block"),
    ("http://b.example.com/en/70", "example.com/en/7", "allow"),
    ("http://a.net/de/8", "net/de/", "allow"),
    ("http://b.example.net/de/80", "example.net/de/8", "block"),
    ("http://example.net/de/9", "net/de/", "allow"),
    ("http://a.org/es/", "org/es/", "block"),
    ("http://a.org/de/", None, "allow"),
]


def test_rules_of_the_contract(spark, tmp_path):
    df = spark.createDataFrame([(i, u, "") for i, (u, *_) in enumerate(CONTRACT)], "page_id long, url string, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = op1_url_filter(spark, str(tmp_path)).orderBy(F.col("page_id")).collect()
    assert [(r.rule, r.verdict) for r in got] == [(rule, verdict) for _, rule, verdict in CONTRACT]

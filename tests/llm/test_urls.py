import re

import pytest
from pyspark.sql import functions as F

from veilspark.llm import url_rules as U


def judged(spark, urls, rules):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    df = df.withColumns({"host": F.lit(1), "best": F.lit("x"), "token": F.lit(2)})
    rows = U.judge_urls(df, U.rule_table(spark, rules)).orderBy("page_id").collect()
    assert len(rows) == len(urls)
    return [(r.host, r.path, r.rule, r.verdict) for r in rows]


def test_base_rules(spark):
    urls = [
        "http://A.Example.NET/en/1?x", "http://example.net/EN/1", "https://xexample.net/en/", "http://example.com/de/",
        "http://example.com", "http://m.example.org/fr/2#t", "http://net?x", None, "no scheme net/", "", "x://org/fr/://net/",
        "http://example.net/en/1", "http://example.net/en/1",
    ]
    got = judged(spark, urls, U.BASE_RULES)
    assert [g[2] for g in got] == [
        "example.net/en/", "net/", "net/", "example.com/de/", None, "org/fr/", None, None, None, None, "org/fr/",
        "example.net/en/", "example.net/en/",
    ]
    assert got[0][:2] == ("a.example.net", "/en/1") and got[7][:2] == ("", "") and got[4][1] == ""


@pytest.mark.parametrize("rule", [U.Rule("a", "/ads/*.gif", "block"), U.Rule("b", "ad", "block"), U.Rule("c", "||x.com^p*z", "allow")])
def test_index_loses_no_match(spark, rule):
    urls = [f"http://{h}/{p}" for h in ("x.com", "m.x.com", "yx.com", "bad.org") for p in ("", "p/z", "ads/i.gif", "add", "ads/.GIF")]
    got = judged(spark, urls, [rule])
    for u, g in zip(urls, got):
        assert (g[2] is not None) == bool(re.search(U.regex_of(rule), g[0] + g[1])), u


def test_no_pages(spark):
    assert judged(spark, [], U.BASE_RULES) == []

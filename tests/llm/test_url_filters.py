import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clicktide.llm import url_filters as filters
from clicktide.llm.url_filters import Rule

RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "example.com", "/en/a"),
    Rule("block", "net", "/es/"),
    Rule("allow", "net", ""),
    Rule("block", "b.net", "/"),
    Rule("allow", "b.net", "/"),
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.DOTALL).groups()
    return "".join(c.lower() if c.isascii() else c for c in host), path


def brute(url):
    host, path = parts(url)
    fitting = [
        (len(r.host + r.path), len(r.host), r.host + r.path, r.verdict)
        for r in RULES
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    rule, verdict = max(fitting)[2:] if fitting else (None, "allow")
    return host, path, rule, verdict


def made_up(n, seed):
    draw = random.Random(seed)
    hosts = ["com", "example.com", "www.example.com", "EXAMPLE.com", "a.b.net", "b.net", "net"]
    hosts += ["xcom", "example.company", "de", "", "a..com", "com.", "b.net:80"]
    paths = ["", "/", "/en/", "/en/a", "/en", "/es/x", "/é/", "/en/a/b?x=/en/", "#/en/", "/\x00", "/en/ü"]
    urls = [f"{draw.choice(['http', 'https'])}://{draw.choice(hosts)}{draw.choice(paths)}" for _ in range(n)]
    return urls + [None, "", "no scheme", "http:/x", "://com/", "http://"]


@pytest.mark.parametrize("partitions", ["2", "16"])
def test_like_every_rule_on_every_url(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        urls = made_up(1_500, 3)
        # One url makes a third of all rows; some rows repeat.
        urls += ["http://www.example.com/en/a"] * 750
        rows = [(at // 2 if at % 9 == 0 else at, url, "mine") for at, url in enumerate(urls)]
        rows += rows[:20] + [(None, "http://com/x", "y")] * 3
        pages = spark.createDataFrame(rows, "page_id long, url string, host string")
        found = Counter(map(tuple, filters.judge(pages, RULES).collect()))
        assert found == Counter((row, *brute(url)) for row, url, _ in rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_edge_tables(spark):
    pages = spark.createDataFrame([(1, "http://com/"), (2, None)], "page_id long, url string")
    assert filters.judge(pages.where("false"), RULES).collect() == []
    rows = sorted(map(tuple, filters.judge(pages, [], default="block").collect()))
    assert rows == [(1, "com", "/", None, "block"), (2, "", "", None, "block")]


def test_long_url(spark):
    url = "http://" + "a." * 500 + "com/" + "x" * 100_000
    pages = spark.createDataFrame([(1, url)], "page_id long, url string")
    assert tuple(filters.judge(pages, RULES).first())[3:] == ("com/", "allow")


def test_hosts_with_very_many_labels(spark):
    """A row for each depth of the rules and one for the whole host, however many labels there are."""
    urls = ["http://" + "a." * 100_000 + end for end in ("www.example.com/en/x", "b.net/", "other/")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = sorted((row["page_id"], row["rule"], row["verdict"]) for row in filters.judge(pages, RULES).collect())
    assert found == [(at, *brute(url)[2:]) for at, url in enumerate(urls)]
    hosts = pages.select(filters.host_of(F.col("url")).alias("host"), filters.path_of(F.col("url")).alias("path"))
    assert filters._host_endings(hosts, [1, 2, 3]).count() == 12

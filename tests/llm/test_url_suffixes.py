"""Registered domains below suffixes of several labels."""

import pytest

from freightaudit.llm import url_filter

HOSTS = {
    "a.shop.co.uk": ("shop.co.uk", "co.uk"),
    "shop.co.uk:8080": ("shop.co.uk", "co.uk"),
    "co.uk": ("co.uk", "co.uk"),
    "x.y.ann.github.io": ("ann.github.io", "github.io"),
    "www.example.org": ("example.org", "org"),
    "k.c.gov.zz.uk": ("c.gov.zz.uk", "gov.zz.uk"),
    "localhost": ("localhost", "localhost"),
    "10.0.0.1": ("10.0.0.1", "10.0.0.1"),
    "": ("", ""),
}


def test_suffixes_of_several_labels(spark):
    rows = spark.createDataFrame([(h,) for h in HOSTS], "host STRING")
    found = url_filter.with_domain_and_suffix(rows, ["co.uk", "github.io", "gov.zz.uk", "zz.uk"])
    assert {r.host: (r.domain, r.suffix) for r in found.collect()} == HOSTS


@pytest.mark.parametrize("host", ["a.b.example.org", "example.org", "org", "u@x.org:1", "[::1]"])
def test_without_a_table_the_last_labels_count(spark, host):
    row = url_filter.with_domain_and_suffix(spark.createDataFrame([(host,)], "host STRING")).first()
    name = "x.org" if "@" in host else host
    labels = [name] if name.startswith("[") else name.split(".")
    assert (row.domain, row.suffix) == (".".join(labels[-2:]), labels[-1])


def test_strangers_below_a_suffix_do_not_share_a_domain(spark):
    pages = [("bad.co.uk", 1)] * 40 + [("good.co.uk", 0)] * 40 + [("new.good.co.uk", None)]
    rows = spark.createDataFrame(pages, "host STRING, bad INT")
    rate = lambda s: {r.host: r.bad_rate for r in url_filter.host_reputation(rows, s).collect()}["new.good.co.uk"]
    assert rate(["co.uk"]) < 0.1 < rate([])

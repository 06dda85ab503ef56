"""Rules, parts of urls and posteriors."""

from __future__ import annotations

import pytest

from clinframe.llm import reputation as R

LABELS = "page_id long, good int"


def judged(spark, urls, outcomes=(), **more):
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    found = R.judge(pages, spark.createDataFrame(list(outcomes), LABELS), **more).collect()
    return {r["page_id"]: r for r in found}


def test_parts_and_rules(spark):
    cases = {
        "http://Example.ORG/es/1": ("example.org", "/es/1", "example.org/es/", "block"),
        "http://a.example.org/en/1x": ("a.example.org", "/en/1x", "example.org/en/1", "block"),
        "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "http://x.org": ("x.org", "", None, "allow"),
        "http://x.com/de/?q=/fr/": ("x.com", "/de/", "com/de/", "block"),
        "http://notcom/de/": ("notcom", "/de/", None, "allow"),
        "http://x.com?q=1#z": ("x.com", "", None, "allow"),
        "http://x.com#/de/": ("x.com", "", None, "allow"),
        "no scheme.com/de/": ("", "", None, "allow"),
        "http://a://b/c": ("a:", "//b/c", None, "allow"),
        "http://É.com/fr/\nx": ("É.com", "/fr/\nx", "com/fr/", "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    found = judged(spark, list(cases))
    for k, want in enumerate(cases.values()):
        assert (found[k]["host"], found[k]["path"], found[k]["rule"], found[k]["verdict"]) == want


def test_bad_hosts_are_blocked_and_neighbours_shrunk(spark):
    urls = [f"http://bad.spam.net/{k}" for k in range(60)] + [f"http://h{k % 20}.good.net/{k}" for k in range(200)]
    urls += ["http://new.spam.net/", "http://new.good.net/", "http://other.info/"]
    outcomes = [(k, 0) for k in range(60)] + [(k, 1) for k in range(60, 260)] + [(3, 0), (None, 1), (5, None), (9999, 0)]
    found = judged(spark, urls, outcomes, rules=())
    assert {found[k]["verdict"] for k in range(60)} == {"block"}
    assert {found[k]["verdict"] for k in range(60, 260)} == {"allow"}
    assert found[260]["upper"] < found[262]["upper"] <= found[261]["upper"] + 1
    assert found[261]["verdict"] == "allow"


def test_no_labels_and_empty_tables(spark):
    assert {r["verdict"] for r in judged(spark, ["http://a.net/", "http://b.net/"]).values()} == {"allow"}
    empty = spark.createDataFrame([], "page_id long, url string")
    assert R.judge(empty, spark.createDataFrame([], LABELS)).collect() == []


def test_levels(spark):
    df = spark.createDataFrame([("a.b.co.uk",), ("a.b.c",), ("b",), ("",)], "host string")
    domain, suffix = R._levels(df["host"])
    assert [tuple(r) for r in df.select(domain, suffix).collect()] == [("b.co.uk", "co.uk"), ("b.c", "c"), ("b", "b"), ("", "")]


def test_posterior_means(spark):
    groups = spark.createDataFrame([(10, 9, 0.5), (10, 1, 0.5), (1, 1, 0.5)], "n long, good long, prior double")
    rows = R._shrunk(groups, "prior", "mean").collect()
    excess, room = 16 + 16 + 0.25 - 21 * 0.25, 180 * 0.25
    strength = room / excess - 1
    assert [r["mean"] for r in rows] == pytest.approx([(g + strength / 2) / (n + strength) for n, g in ((10, 9), (10, 1), (1, 1))])

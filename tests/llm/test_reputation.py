from pyspark.sql import functions as F

from hearthline.llm import reputation
from hearthline.llm.queries import RULES


def run(spark, pages, labels=(), **options):
    p = spark.createDataFrame([(*x, "n", "k") for x in pages], "page_id bigint, url string, n string, bound string")
    good = spark.createDataFrame(list(labels), "page_id bigint, good int")
    return reputation.url_filter(p, good, **options)


def test_host_path_and_rules(spark):
    urls = [
        (0, "HTTP://WWW.Example.COM/en/1?x#y"),
        (1, "http://example.com/en/"),
        (2, "http://a.example.com/en/x"),
        (3, "http://notexample.com/en/"),
        (4, "http://b.net/es/?"),
        (5, "http://b.net/ES/"),
        (6, "http://example.com"),
        (7, "x://É.COM:80?q=/en/"),
        (8, "no scheme"),
        (9, None),
        (10, "a://b://c.com/d"),
        (11, "http://net/fr/x"),
        (12, ""),
        (13, "://com/"),
        (None, "http://10.0.0.1/en/"),
    ]
    made = {r["page_id"]: r for r in run(spark, urls, rules=RULES).collect()}
    assert {i: (r["host"], r["path"], r["rule"], r["verdict"]) for i, r in made.items()} == {
        0: ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        1: ("example.com", "/en/", "example.com/en/", "block"),
        2: ("a.example.com", "/en/x", "example.com/en/", "block"),
        3: ("notexample.com", "/en/", "com/", "allow"),
        4: ("b.net", "/es/", "net/es/", "block"),
        5: ("b.net", "/ES/", None, "allow"),
        6: ("example.com", "", None, "allow"),
        7: ("É.com:80", "", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("", "", None, "allow"),
        10: ("b:", "//c.com/d", None, "allow"),
        11: ("net", "/fr/x", "net/fr/", "block"),
        12: ("", "", None, "allow"),
        13: ("com", "/", "com/", "allow"),
        None: ("10.0.0.1", "/en/", None, "allow"),
    }


def test_shrinkage(spark):
    pages, labels = [], []
    for host, n, k in (("bad.spam.org", 60, 2), ("new.spam.org", 1, 0), ("good.fine.org", 60, 58), ("new.fine.org", 1, 0), ("worse.spam.org", 40, 0), ("also.fine.org", 50, 49)):
        for i in range(n):
            pages.append((len(pages), f"http://{host}/{i}"))
            labels.append((len(pages) - 1, int(i < k)))
    pages += [(900, "http://unseen.spam.org/"), (901, "http://unseen.fine.org/"), (902, None)]
    made = {r["host"]: r for r in run(spark, pages, [*labels, (5000, 1), (None, 1), (3, None)]).collect()}
    assert made["bad.spam.org"]["verdict"] == "block" and made["good.fine.org"]["verdict"] == "allow"
    # One bad page: blocked among bad neighbours, not among good ones; no page at all leans on the domain.
    assert made["new.fine.org"]["bound"] > made["new.spam.org"]["bound"]
    assert made["unseen.fine.org"]["bound"] > made["unseen.spam.org"]["bound"]
    assert made["new.fine.org"]["verdict"] == made["unseen.fine.org"]["verdict"] == "allow"
    assert made["bad.spam.org"]["labelled"] == 60 and made["bad.spam.org"]["good"] == 2


def test_domain_and_suffix(spark):
    row = spark.range(1).select(
        *[reputation.domain_of(F.lit(h)).alias(f"d{i}") for i, h in enumerate(["a.b.c", "c", "", "1.2.3.4"])],
        *[reputation.suffix_of(F.lit(h)).alias(f"s{i}") for i, h in enumerate(["a.b.c", "c", "", "1.2.3.4"])],
    ).first()
    assert tuple(row) == ("b.c", "c", "", "1.2.3.4", "c", "c", "", "")


def test_no_labels_no_pages(spark):
    assert run(spark, []).count() == 0
    twice = run(spark, [(1, "http://a.b/"), (1, "http://a.b/")], [(1, 1), (1, 0)]).collect()
    assert [(r["labelled"], r["good"], r["verdict"]) for r in twice] == [(4, 2, "allow")] * 2


def test_public_suffixes_and_ports(spark):
    hosts = ["a.b.co.uk", "co.uk", "b.co.uk:8080", "x.github.io", "www.example.com:80", "10.0.0.1:80", "notco.uk"]
    known = ["uk", "co.uk", "github.io"]
    row = spark.range(1).select(
        F.array(*[reputation.domain_of(F.lit(h), known) for h in hosts]), F.array(*[reputation.suffix_of(F.lit(h), known) for h in hosts])
    ).first()
    assert row[0] == ["b.co.uk", "co.uk", "b.co.uk", "x.github.io", "example.com", "10.0.0.1", "notco.uk"]
    assert row[1] == ["co.uk", "co.uk", "co.uk", "github.io", "com", "", "uk"]
    pages = [(i, f"http://bad.co.uk/{i}") for i in range(30)] + [(30, "http://new.bad.co.uk:81/"), (31, "http://other.co.uk/")]
    made = {r["host"]: r["bound"] for r in run(spark, pages, [(i, 0) for i in range(30)], suffixes=known).collect()}
    assert made["new.bad.co.uk:81"] < made["other.co.uk"]

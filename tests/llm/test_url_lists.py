import datetime as dt

from aicensus.llm import url_lists as u
from pyspark.sql import functions as F

DAY = dt.date(2020, 1, 1)


def on(n):
    return DAY + dt.timedelta(days=n)


EVENTS = [("a.com", "x", on(0), True), ("a.com", "x", on(10), True), ("a.com", "x", on(20), False), ("A.com", "x", on(400), True),
          ("s.a.com", "y", on(5), True), ("s.a.com", "y", on(5), False), ("s.a.com", "y", on(6), False), (None, "x", on(1), True),
          ("b.org", None, None, True), ("b.org", None, on(3), True), ("b.org", None, on(3), True), ("b.org", None, on(900), None)]
URLS = ["http://a.com/", "https://user@S.A.com:80/p?q", "http://xa.com/", "http://b.org.", "http://www.b.org#f", None, "", "junk",
        "http://" + "a." * 200 + "a.com/"]
CAPTURES = [(i, url, on(n)) for n in (-1, 0, 5, 6, 19, 20, 399, 400, 899, 900, 2000) for i, url in enumerate(URLS)]
CAPTURES += [(0, URLS[0], None), (0, URLS[0], on(5))] + [(50, URLS[1], on(5))] * 40


def brute(url, day):
    host = u.re_host(url)
    active = []
    for d, c in {(d.lower(), c or "") for d, c, *_ in EVENTS if d}:
        if host and day and (host == d or host.endswith("." + d)):
            days = {}
            for ed, ec, when, listed in EVENTS:
                if ed and ed.lower() == d and (ec or "") == c and when and when <= day:
                    days[when] = days.get(when, False) or bool(listed)
            if days and days[max(days)]:
                active.append((len(d), d, c))
    return len(active), max(active)[1] if active else None


def test_against_brute_force(spark, monkeypatch):
    import re

    def re_host(url):
        m = re.match(u.HOST, (url or "").lower())
        host = m[1].rstrip(".") if m else None
        return host if host and len(host) <= 253 else None

    monkeypatch.setattr(u, "re_host", re_host, raising=False)
    events = spark.createDataFrame(EVENTS, "domain string, category string, day date, listed boolean")
    captures = spark.createDataFrame(CAPTURES, "page_id int, url string, fetched_on date").withColumns(
        {c: F.lit(1) for c in ("domain", "valid_from", "year", "best")})
    found = u.judge_captures(captures, u.validity(events))
    assert found.columns[:7] == captures.columns
    got = sorted(((r["page_id"], str(r["fetched_on"]), r["n_active"], r["entry"]) for r in found.collect()), key=str)
    assert got == sorted(((i, str(d), *brute(url, d)) for i, url, d in CAPTURES), key=str)


def test_intervals(spark):
    events = spark.createDataFrame(EVENTS, "domain string, category string, day date, listed boolean")
    rows = sorted(tuple(r) for r in u.validity(events).filter("domain = 'a.com'").collect() if r["valid_to"])
    assert rows == [("x", "a.com", on(0), on(20))]


def test_empty_tables(spark):
    events = spark.createDataFrame([], "domain string, category string, day date, listed boolean")
    captures = spark.createDataFrame([(1, "http://a.com", on(1))], "page_id int, url string, fetched_on date")
    assert not u.judge_captures(captures, u.validity(events)).first()["blocked"]
    assert u.judge_captures(captures.limit(0), u.validity(events)).count() == 0


def test_addresses_have_no_domains_above(spark):
    urls = {"http://[2001:db8::1]/x": ("[2001:db8::1]", ["[2001:db8::1]"]), "https://u@[::1]:80": ("[::1]", ["[::1]"]),
            "http://1.2.3.4:8080/": ("1.2.3.4", ["1.2.3.4"]), "http://[broken/": (None, None),
            "http://1.2.3.4.com": ("1.2.3.4.com", ["1.2.3.4.com", "2.3.4.com", "3.4.com", "4.com", "com"])}
    rows = spark.createDataFrame([(x,) for x in urls], "url string").select("url", u.host_of(F.col("url")).alias("h")).select(
        "url", "h", u.domains_of(F.col("h")).alias("d")).collect()
    assert {r["url"]: (r["h"], r["d"]) for r in rows} == urls
    events = spark.createDataFrame([("[::1]", "x", DAY, True), ("3.4", "x", DAY, True)], "domain string, category string, day date, listed boolean")
    captures = spark.createDataFrame([("http://[::1]/", DAY), ("http://1.2.3.4/", DAY)], "url string, fetched_on date")
    assert {r["url"]: r["blocked"] for r in u.judge_captures(captures, u.validity(events)).collect()} == {"http://[::1]/": True, "http://1.2.3.4/": False}

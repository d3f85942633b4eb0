"""URL filters by dated lists: entries become validity intervals, captures are judged as of their fetch day.

A list is a log of events: a domain is listed or removed on a day, under a category. The events of a
(category, domain) become disjoint intervals [valid_from, valid_to); of events on one day, listing wins.
There are at most as many events per key as days, so the window over a key is bounded. Intervals are dealt to the
years they touch, so the as-of join is an equality on (domain, year) and a domain listed often stays
spread. Captures are first folded to distinct (host, day) pairs: a host with a third of all captures is
judged once a day, and the join back spreads it over its days.

An entry covers its domain and all below it. Hosts are lower-case, without user, port and closing dot; an address, bracketed
or of four numbers, is covered by its own entry only.

Defined results: a capture without a usable host (null or no URL, host over 253 characters) or without a day
matches nothing and is not blocked; events without domain or day are ignored; rows that repeat each get a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@\[]+)"
# Hosts that are addresses: four numbers, or anything in brackets.
ADDRESS = r"^(?:[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|\[.*)$"


def host_of(url: Column) -> Column:
    host = F.rtrim(F.regexp_extract(F.lower(url), HOST, 1), F.lit("."))
    return F.when((host != "") & (F.length(host) <= 253), host)


def domains_of(host: Column) -> Column:
    """The host and every domain above it; an address has none."""
    labels = F.when(host.rlike(ADDRESS), F.array(host)).otherwise(F.split(host, r"\."))
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels) - i + 1), "."))


def validity(events: DataFrame, domain_col: str = "domain", category_col: str = "category", day_col: str = "day",
             listed_col: str = "listed") -> DataFrame:
    """category, domain, valid_from, valid_to (null: still listed) from dated events."""
    days = events.select(
        F.coalesce(F.col(category_col), F.lit("")).alias("category"), F.lower(F.col(domain_col)).alias("domain"),
        F.col(day_col).cast("date").alias("day"), F.coalesce(F.col(listed_col), F.lit(False)).alias("listed"))
    days = days.filter("domain IS NOT NULL AND day IS NOT NULL").groupBy("category", "domain", "day").agg(
        F.max("listed").alias("listed"))
    key = Window.partitionBy("category", "domain").orderBy("day")
    before = F.coalesce(F.lag("listed").over(key), F.lit(False))
    changes = days.withColumn("before", before).filter("listed <> before")
    return changes.withColumn("valid_to", F.lead("day").over(key)).filter("listed").select(
        "category", "domain", F.col("day").alias("valid_from"), "valid_to")


def judge_captures(captures: DataFrame, intervals: DataFrame, url_col: str = "url", day_col: str = "fetched_on") -> DataFrame:
    """The captures with host, n_active, blocked, and the entry of the longest domain: category, entry, since, until."""
    probes = captures.select(host_of(F.col(url_col)).alias("host"), F.col(day_col).cast("date").alias("day")).filter(
        "host IS NOT NULL AND day IS NOT NULL").distinct()
    last_year = F.year(F.coalesce("valid_to", F.lit("9999-12-31").cast("date")))
    horizon = F.lit(captures.agg(F.max(F.year(F.col(day_col).cast("date")))).first()[0] or 0)
    dealt = intervals.filter(F.year("valid_from") <= horizon).withColumn(
        "year", F.explode(F.sequence(F.year("valid_from"), F.least(last_year, horizon))))
    asked = probes.withColumn("year", F.year("day")).withColumn("domain", F.explode(domains_of(F.col("host"))))
    active = asked.join(dealt, ["domain", "year"]).filter(
        (F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to"))))
    verdict = active.groupBy("host", "day").agg(
        F.count(F.lit(1)).alias("n_active"),
        F.max(F.struct(F.length("domain").alias("n"), "domain", "category", "valid_from", "valid_to")).alias("best"))
    keyed = captures.withColumn("_host", host_of(F.col(url_col))).withColumn("_day", F.col(day_col).cast("date"))
    verdict = verdict.select(
        F.col("host").alias("_host"), F.col("day").alias("_day"), F.col("n_active").alias("_n"), F.col("best").alias("_best"))
    return keyed.join(verdict, ["_host", "_day"], "left").select(
        *[keyed[c] for c in captures.columns], F.col("_host").alias("host"), F.coalesce("_n", F.lit(0)).alias("n_active"),
        F.col("_n").isNotNull().alias("blocked"), F.col("_best.category").alias("category"),
        F.col("_best.domain").alias("entry"), F.col("_best.valid_from").alias("since"), F.col("_best.valid_to").alias("until"))

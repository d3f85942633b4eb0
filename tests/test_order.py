"""Running numbers by ranges, and advisory ranges by ranks."""
import random

import pytest
from aicensus.operators import vulns
from aicensus.operators.order import numbered, numbered_within
from pyspark.sql import functions as F


@pytest.mark.parametrize("rows", [[], [(None, 3), (None, 1), ("a", 2)], [("hot", i) for i in range(400)] + [("b", 1), ("c", 0), ("c", 5)]])
def test_numbers(spark, rows):
    df = spark.createDataFrame(rows, "g string, x int").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert sorted(map(tuple, numbered(df, ["g", "x"], "n").collect()), key=lambda r: r[2]) == [(*r, i) for i, r in enumerate(order)]
    want, seen = [], {}
    for r in order:
        want.append((*r, seen.get(r[0], 0)))
        seen[r[0]] = seen.get(r[0], 0) + 1
    assert sorted(map(tuple, numbered_within(df, ["g"], ["x"], "n").collect()), key=str) == sorted(want, key=str)


def test_no_window_holds_a_group(spark):
    df = spark.range(10).selectExpr("id % 2 AS g", "id AS x")
    plan = numbered_within(df, ["g"], ["x"], "n")._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in plan and all("[_part" in line for line in plan.splitlines() if "Window" in line)


def test_ranks_give_the_hits_of_all_pairs(spark, monkeypatch):
    random.seed(2)
    version = lambda: random.choice(["main", None, "", *(f"{random.randrange(4)}.{random.randrange(30)}" for _ in range(30))])
    coords = spark.createDataFrame(list({("pypi", random.choice("ab"), version()) for _ in range(300)}), "ecosystem string, package string, version string")
    ranges = spark.createDataFrame([("pypi", random.choice("abc"), f"A{i}", version(), version()) for i in range(200)],
                                   "ecosystem string, package string, id string, introduced string, fixed string")
    want = sorted(map(str, vulns.direct_hits(coords, ranges).collect()))
    assert want and sorted(map(str, vulns.ranked_hits(coords, ranges).collect())) == want
    monkeypatch.setattr(vulns, "DIRECT_PAIRS", 12_000)
    assert sorted(map(str, vulns.range_hits(coords, ranges).collect())) == want


def test_blocks_cover_a_span_once(spark):
    spans = spark.createDataFrame([(a, b) for a in range(0, 40, 3) for b in range(a + 1, 70, 5)], "a long, b long")
    for r in spans.select("a", "b", vulns.span_nodes(F.col("a"), F.col("b")).alias("n")).collect():
        held = [x for n in r["n"] for x in range(n["node"] << n["level"], (n["node"] + 1) << n["level"])]
        assert sorted(held) == list(range(r["a"], r["b"])) and len(r["n"]) <= 2 * len(bin(r["b"]))


def test_work_grows_with_the_hits(spark):
    """Blocks per range and per version are logarithmic: twice the rows, about twice the joined rows, not four times."""
    def joined(n):
        coords = spark.range(n).selectExpr("'e' AS ecosystem", "'p' AS package", "concat('1.', id) AS version")
        ranges = spark.range(n).selectExpr("'e' AS ecosystem", "'p' AS package", "concat('A', id) AS id", "concat('1.', id) AS introduced",
                                           "concat('1.', id + 3) AS fixed")
        return vulns.ranked_hits(coords, ranges).count()

    assert joined(2000) == 3 * 2000 - 3 and joined(4000) == 3 * 4000 - 3


def test_met_blocks_hold_a_span_once(spark):
    spans = [(a, b) for a in (0, 1, 63, 64, 4095, 4096, 5000, 12288) for b in (1, 64, 70, 4096, 4097, 8192, 9000, 20480, 20500) if a < b]
    rows = spark.createDataFrame(spans, "a long, b long")
    for r in rows.select("a", "b", vulns.met_blocks(F.col("a"), F.col("b")).alias("n")).collect():
        held = [x for n in r["n"] for x in range(n["node"] << n["level"], (n["node"] + 1) << n["level"])]
        assert len(held) == len(set(held)) and set(range(r["a"], r["b"])) <= set(held) and len(held) - (r["b"] - r["a"]) <= 126


def test_wide_and_overlapping_ranges_give_each_hit_once(spark):
    """Ranges of one id, or of no id, overlap, repeat and are open; the hits are not made distinct afterwards."""
    coords = spark.range(10_000).selectExpr("'e' AS ecosystem", "'p' AS package", "concat('1.', id) AS version")
    ranges = spark.createDataFrame(
        [("e", "p", i, lo, hi) for i in ("A", "B", None) for lo, hi in [(None, None), ("1.5", "1.5000"), ("1.400", None), ("1.400", None), ("1.9", "1.9")]]
        + [("e", "p", "C", "1.10", "1.20"), ("e", "p", "C", "1.15", "1.30"), ("e", "p", "C", "1.30", "1.31"), ("e", "p", "C", "1.40", "1.41")],
        "ecosystem string, package string, id string, introduced string, fixed string")
    found = vulns.ranked_hits(coords.unionByName(coords), ranges)
    counts = dict(found.groupBy("id").count().collect())
    assert counts == {"A": 10_000, "B": 10_000, None: 10_000, "C": 22} and found.distinct().count() == 30_022
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Union")


def test_answers_are_joined_to_components_last(spark):
    """One component with several coordinates, null and repeated ids; the answers cross no shuffle once components multiply them."""
    parts = spark.createDataFrame(
        [("s", "c1", "a", "1.0"), ("s", "c1", "b", "1.0"), ("s", "c2", "a", "1.0"), ("s", "c2", "a", "1.0"), (None, None, "a", "1.0"), (None, None, "b", "2.0"),
         (None, "c3", "b", "1.0"), ("s", "c4", "z", "1.0"), ("s", "c5", "a", None)], "scan_id string, component_id string, name string, version string")
    comps = parts.withColumn("purl", F.concat(F.lit("pkg:pypi/"), "name", F.lit("@"), F.coalesce("version", F.lit("1.0"))))
    event = lambda k, v: F.create_map(F.lit(k), F.lit(v))
    advisories = spark.createDataFrame([("G1", "a", "CVE-1"), ("G2", "a", "CVE-1"), ("G3", "b", "CVE-1"), ("G4", "b", "X")], "id string, package string, alias string").select(
        "id", F.array("alias").alias("aliases"), F.lit("pypi").alias("ecosystem"), "package", F.concat(F.lit("bug "), "id").alias("summary"),
        F.array(F.struct(F.lit("CVSS_V3").alias("type"), F.lit("").alias("score"))).alias("severity"), F.lit("HIGH").alias("db_severity"),
        F.array(F.struct(F.lit("ECOSYSTEM").alias("type"), F.array(event("introduced", "0"), event("fixed", "3.0")).alias("events"))).alias("ranges"))
    want = vulns.dedupe_advisories(vulns.match_advisories(comps, advisories))
    found = vulns.component_vulns(comps, advisories)
    assert found.columns == want.columns
    assert want.count() == 7 and sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    beside = comps.select("scan_id", "component_id", F.upper("name").alias("shown"))
    assert sorted(map(str, vulns.component_vulns(comps, advisories, beside).collect())) == sorted(
        map(str, want.join(beside, ["scan_id", "component_id"]).select(*want.columns, "shown").collect()))
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("Join LeftSemi")[0]
    assert "Union" in plan and plan.index("Join Inner") < plan.index("Aggregate")

from pyspark.sql import functions as F

import pytest
from aicensus.functions import identity, text, versions
from aicensus.sources import layers
from aicensus.sources.routing import select_detectors


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("vector, score", [
    ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8),
    ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H", 10.0),
    ("CVSS:3.1/AV:L/AC:H/PR:H/UI:R/S:U/C:L/I:N/A:N", 1.8),
    ("CVSS:3.0/AV:N/AC:L/PR:L/UI:N/S:U/C:H/I:H/A:H", 8.8),
    ("CVSS:3.1/AV:N/AC:L", None),
    ("CVSS:4.0/AV:N", None),
])
def test_cvss(spark, vector, score):
    df = spark.range(1).select(F.lit(vector).alias("vector"))
    assert versions.add_cvss3_score(df).first()["score"] == score


def test_version_order(spark):
    key = lambda v: versions.version_key(F.lit(v))
    assert one(spark, key("4.36.0") > key("4.9.0"))
    assert one(spark, key("1.5") == key("v1.5.0"))
    assert one(spark, key("1.0.0-rc1")) == [1]
    assert one(spark, key("abc")) is None


def test_id_value(spark):
    got = one(spark, identity.component_id(F.lit("hosted-model"), F.lit("openai"), F.lit("gpt-4.1"), F.lit("")))
    assert got == identity.ID_PREFIX + "cfc27e587216febe"


def test_globs(spark):
    for pattern, path, want in [
        ("**/prompts/**", "prompts/a", True), ("**/prompts/**", "x/prompts", True), ("**/prompts/**", "xprompts/a", False),
        ("src/*.py", "src/a.py", True), ("src/*.py", "src/b/a.py", False), ("**", "a/b", True), ("**/*.j2", "a.j2", True),
        ("a/**/b", "a/b", True), ("[ab].txt", "b.txt", True),
    ]:
        assert one(spark, text.matches_glob(F.lit(path), pattern)) is want, (pattern, path)


def test_snippet_and_slug(spark):
    assert one(spark, text.snippet(F.lit("\tx\x01y  "))) == "xy"
    assert len(one(spark, text.snippet(F.lit("é" * 300), 200)).encode()) == 200
    assert len(one(spark, text.snippet(F.lit("é" * 300)))) == 300
    assert one(spark, text.slug(F.lit("--Odd  Risk#7-"))) == "odd-risk-7"
    assert one(spark, text.confidence_text(F.lit(0.9750))) == "0.975"
    assert one(spark, text.confidence_text(F.lit(0.0))) == "0"
    assert one(spark, text.camel_case(F.lit("rules/a-b/c1"))) == "RulesABC1"


def test_clean_path(spark):
    for raw, want in [("a/./b/../c", "a/c"), ("../../c", "c"), ("/a//b/", "a/b"), ("a/..", ""), ("x\\y", "x/y"), ("./a/.", "a"),
                      ("..a/b", "..a/b")]:
        assert one(spark, layers.clean_path(F.lit(raw))) == want, raw


def test_detector_selection():
    ids = lambda e: [s.detector_id for s, _ in select_detectors(e)]
    assert ids("manifest,-manifest/npm,+prompt/file")[-1] == "prompt/file"
    assert "manifest/npm" not in ids("-manifest/npm")
    assert len(ids("")) == len(ids("all"))
    with pytest.raises(ValueError):
        ids("nope")

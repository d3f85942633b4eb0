"""Version ordering and CVSS scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

_MAX = 9223372036854775807


def version_key(version: Column) -> Column:
    """Numeric release parts as an array that compares like the versions do; null if none.

    Trailing zero parts are dropped, so 1.5 and 1.5.0 get one key and arrays of different
    length compare right without padding to a fixed width.
    """
    release = F.regexp_extract(strip(version), r"^v?([0-9]+(?:\.[0-9]+)*)", 1)
    bare = F.regexp_replace(release, r"(?:\.0+)+$", "")
    parts = F.transform(
        F.split(bare, r"\."), lambda p: F.coalesce(p.try_cast("bigint"), F.lit(_MAX))
    )
    return F.when(release != "", parts)


def version_shaped(c: Column) -> Column:
    """Holds a digit and is not a 40-digit hex commit."""
    return c.rlike("[0-9]") & ~c.rlike(r"^[0-9A-Fa-f]{40}$")


# CVSS v3 base-metric weights from the published specification.
_AV = {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.20}
_AC = {"L": 0.77, "H": 0.44}
_UI = {"N": 0.85, "R": 0.62}
_CIA = {"H": 0.56, "L": 0.22, "N": 0.0}
_PR_SAME = {"N": 0.85, "L": 0.62, "H": 0.27}
_PR_CHANGED = {"N": 0.85, "L": 0.68, "H": 0.50}
_REQUIRED = ["AV", "AC", "PR", "UI", "S", "C", "I", "A"]


def _weight(value: Column, table: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for key, weight in table.items():
        out = F.when(value == key, F.lit(weight)).otherwise(out)
    return out


def add_cvss3_score(df: DataFrame, vector: str = "vector", out: str = "score") -> DataFrame:
    """Add the base score of a CVSS v3.0/3.1 vector; null unless all base metrics are usable.

    Metrics, weights and sub-scores are separate projections: each is used several times,
    and one nested expression would outgrow a generated method.
    """
    given = F.col(vector)
    metrics = df.withColumns({
        # A repeated metric is legal; the last one counts.
        f"_m_{m}": F.nullif(F.regexp_extract(given, rf".*/{m}:([^/]*)", 1), F.lit("")) for m in _REQUIRED
    })
    changed = F.col("_m_S") == "C"
    weights = metrics.withColumns({
        "_changed": F.coalesce(changed, F.lit(False)),
        "_av": _weight(F.col("_m_AV"), _AV), "_ac": _weight(F.col("_m_AC"), _AC), "_ui": _weight(F.col("_m_UI"), _UI),
        "_pr": F.when(changed, _weight(F.col("_m_PR"), _PR_CHANGED)).otherwise(_weight(F.col("_m_PR"), _PR_SAME)),
        **{f"_{m}": _weight(F.col(f"_m_{m}"), _CIA) for m in ("C", "I", "A")},
    })
    one = F.lit(1.0)
    scored = weights.withColumn(
        "_iss", one - (one - F.col("_C")) * (one - F.col("_I")) * (one - F.col("_A"))
    ).withColumn(
        "_impact",
        F.when(F.col("_changed"), F.lit(7.52) * (F.col("_iss") - 0.029) - F.lit(3.25) * F.pow(
            F.col("_iss") - 0.02, F.lit(15.0))).otherwise(F.lit(6.42) * F.col("_iss")),
    ).withColumn(
        "_raw", F.col("_impact") + F.lit(8.22) * F.col("_av") * F.col("_ac") * F.col("_pr") * F.col("_ui")
    )
    base = F.least(F.when(F.col("_changed"), F.lit(1.08) * F.col("_raw")).otherwise(F.col("_raw")), F.lit(10.0))
    scored = scored.withColumn("_cents", F.round(base * 100000).cast("bigint"))
    cents = F.col("_cents")
    rounded = F.when(cents % 10000 == 0, cents / 100000.0).otherwise((F.floor(cents / 10000.0) + 1) / 10.0)
    usable = given.rlike(r"^CVSS:3\.[01]/")
    for m in _REQUIRED:
        usable = usable & given.rlike(rf"/{m}:")
    for w in ("_av", "_ac", "_ui", "_pr"):
        usable = usable & (F.col(w) > 0)
    result = F.when(usable, F.when(F.col("_impact") <= 0, F.lit(0.0)).otherwise(rounded))
    return scored.select(*[F.col(c) for c in df.columns], result.alias(out))


def severity_from_score(score: Column) -> Column:
    return (
        F.when(score >= 9.0, "critical")
        .when(score >= 7.0, "high")
        .when(score >= 4.0, "medium")
        .when(score > 0.0, "low")
        .otherwise("unknown")
    )


def severity_from_text(text: Column) -> Column:
    up = F.upper(F.coalesce(text, F.lit("")))
    return (
        F.when(up == "CRITICAL", "critical")
        .when(up == "HIGH", "high")
        .when(up.isin("MODERATE", "MEDIUM"), "medium")
        .when(up == "LOW", "low")
        .otherwise("unknown")
    )


def severity_rank(severity: Column) -> Column:
    return (
        F.when(severity == "critical", 4)
        .when(severity == "high", 3)
        .when(severity == "medium", 2)
        .when(severity == "low", 1)
        .otherwise(0)
    )

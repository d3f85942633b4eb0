"""Headline queries, seconds each: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every query runs three times into a no-op sink, or twice where that takes over BENCH_QUERY_SEC (default 30) seconds; the
median counts (of two runs, the second). ``scan`` detects with all shipped rules over all
documents as source files, ``assembly`` builds components from all findings; both give their sizes. Nothing is kept between
runs: queries over the inventory assemble it each time.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from aicensus.operators import rules  # noqa: E402
from aicensus.plans import pipeline  # noqa: E402
from aicensus.queries import derive, detection, registry  # noqa: E402
from aicensus.rulepacks.shipped import SHIPPED  # noqa: E402
from aicensus.session import build_session  # noqa: E402

HEADLINE = [
    "component_ids", "occurrences", "occurrence_dedupe", "confidence_noisy_or", "inventory_components", "edges",
    "edge_confidence", "gate_verdicts", "summary_by_kind", "sarif_results", "rule_scan_documents",
    "rule_scan_pages", "line_matches_pages", "keyword_candidates", "requirements_deps", "gguf_artifacts",
    "layer_squash", "k8s_images", "component_vulns",
]


def timed(df) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def scan(spark, sf_dir: str) -> dict:
    """Seconds, files and megabytes of a whole detection."""
    files = detection.document_files(spark, sf_dir).withColumn("path", F.concat("path", F.lit(".py")))
    loaded = rules.load_rules(rules.effective_rules(rules.rules_from(spark, SHIPPED)))
    size = files.agg(F.count("*"), F.sum("size") / 1e6).first()
    start = time.perf_counter()
    timed(pipeline.detect(files, loaded)[0])
    return {"sec": round(time.perf_counter() - start, 3), "files": size[0], "mb": round(size[1], 1)}


def assembly(spark, sf_dir: str) -> dict:
    """Seconds and findings of a whole assembly."""
    findings = derive.findings(spark, sf_dir)
    start = time.perf_counter()
    timed(pipeline.build(findings, derive.scans(spark, sf_dir)).components)
    return {"sec": round(time.perf_counter() - start, 3), "findings": findings.count()}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "aicensus-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    limit = float(os.environ.get("BENCH_QUERY_SEC", "30"))
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        runs: list[float] = []
        while len(runs) < 2 or len(runs) < 3 and sum(runs) < limit:
            start = time.perf_counter()
            timed(registry.QUERIES[name](spark, sf_dir))
            runs.append(time.perf_counter() - start)
        seconds[name] = round(sorted(runs)[1] if len(runs) == 3 else runs[1], 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name, "scan": scan(spark, sf_dir), "assembly": assembly(spark, sf_dir),
        "conf": {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")},
    }))
    spark.stop()


if __name__ == "__main__":
    main()

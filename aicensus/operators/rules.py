"""Rule tables: layering, checks, the keyword gate, and the native single-line match."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import fold, fold_literal, lines_of, snippet, utf16_length
from ..schemas import RELATION_TYPES, RULES
from ..session import collect_config, stored
from ..sources import corpus
from ..sources.files import language_of, text_of
from .risks import RISK_CATALOG

# Kinds and languages a rule may name.
RULE_KINDS = [
    "hosted-llm", "embedding-model", "framework", "library", "vector-db", "prompt", "dataset",
    "ai-config", "infra", "service",
]
RULE_LANGUAGES = ["python", "javascript", "typescript", "go", "java", "rust", "csharp", "kotlin"]

TEMPLATE = re.compile(r"\$\{([a-zA-Z_][a-zA-Z0-9_]*)\}")


def rules_from(spark: SparkSession, rules: list[dict], layer_seq: int = 0) -> DataFrame:
    """A rules table from plain dicts; absent attributes become nulls."""
    names = ["id", "kind", "provider", "languages", "keywords", "pattern", "regions", "claim",
             "relations", "within_lines", "param_names", "risk", "confidence"]
    rows = []
    for r in rules:
        row = {n: r.get(n) for n in names}
        row["layer_seq"] = r.get("layer_seq", layer_seq)
        row["disable"] = bool(r.get("disable", False))
        claim = r.get("claim")
        row["claim"] = claim and {k: claim.get(k) for k in ("name", "group", "version")}
        row["relations"] = [
            {k: rel.get(k) for k in ("type", "target_kind", "name", "from_field", "local_ref")}
            for rel in r.get("relations") or []
        ]
        rows.append(row)
    return spark.createDataFrame(rows, RULES)


def effective_rules(layers: DataFrame) -> DataFrame:
    """Merge layers by rule id: the last layer wins; a last layer that disables removes."""
    return (
        layers.groupBy("id")
        .agg(F.max_by(F.struct(*[c for c in layers.columns if c != "id"]), "layer_seq").alias("r"))
        .select("id", "r.*")
        .filter("NOT disable")
    )


def layer_errors(layers: DataFrame) -> DataFrame:
    """Rules a layer may not hold: ids repeated in a layer, disabling in the base layer or
    without a lower rule to disable."""
    per_layer = layers.groupBy("id", "layer_seq").agg(F.count("*").alias("n"), F.bool_or("disable").alias("off"))
    lowest = layers.filter("NOT disable").groupBy("id").agg(F.min("layer_seq").alias("first_seq"))
    reason = (
        F.when(F.col("n") > 1, "duplicate id within a layer")
        .when(F.col("off") & (F.col("layer_seq") == 0), "disable is for overlays only")
        .when(F.col("off") & (F.col("first_seq").isNull() | (F.col("first_seq") >= F.col("layer_seq"))),
              "nothing to disable")
    )
    return per_layer.join(lowest, "id", "left").select("id", "layer_seq", reason.alias("reason")).filter(
        "reason IS NOT NULL"
    )


def check_rule(rule) -> None:
    """Raise on a rule that could not run as its author meant."""
    def need(ok: bool, why: str) -> None:
        if not ok:
            raise ValueError(f"rule {rule['id']!r}: {why}")

    need(re.fullmatch(r"[a-z0-9-]+/[a-z0-9/-]+", rule["id"]) is not None, "id must be <pack>/<slug>")
    need(rule["kind"] in RULE_KINDS, f"kind {rule['kind']!r} cannot be claimed by a rule")
    need(all(lang in RULE_LANGUAGES for lang in rule["languages"] or []), "unsupported language")
    need(bool(rule["keywords"]) and all(k.strip() for k in rule["keywords"]), "keywords must be non-empty")
    need(all(r in ("code", "string") for r in rule["regions"] or []), "regions are code and string")
    need(0 < rule["confidence"] <= 0.99, "confidence must be in (0, 0.99]")
    need(bool(rule["claim"] and rule["claim"]["name"]), "claim name is required")
    need(rule["risk"] in (None, "", *[r[0] for r in RISK_CATALOG]), f"risk {rule['risk']!r} is not in the catalog")
    groups = set(re.compile(python_pattern(rule["pattern"]).encode()).groupindex)
    params = set(rule["param_names"] or [])
    if rule["within_lines"] is not None:
        need(1 <= rule["within_lines"] <= 64, "within_lines must be in [1, 64]")
        need(bool(params), "parameter names must be non-empty")
    used = {"model"}
    for part in ("name", "group", "version"):
        for g in TEMPLATE.findall(rule["claim"][part] or ""):
            need(g in groups, f"claim {part} names an unknown group {g!r}")
            used.add(g)
    for rel in rule["relations"] or []:
        need(rel["type"] in RELATION_TYPES, f"unknown relation type {rel['type']!r}")
        forms = [f for f in ("name", "from_field", "local_ref") if rel[f]]
        need(len(forms) == 1, "a relation target sets exactly one of name, from_field, local_ref")
        if forms != ["local_ref"]:
            need(rel["target_kind"] in RULE_KINDS, "a relation target needs a kind")
        for g in TEMPLATE.findall(rel["name"] or ""):
            need(g in groups, f"relation names an unknown group {g!r}")
            used.add(g)
        if rel["from_field"]:
            implicit = rel["from_field"] == "model" and rule["within_lines"] is not None
            need(rel["from_field"] in groups | params or implicit, f"unknown field {rel['from_field']!r}")
            used.add(rel["from_field"])
    need(groups <= used, f"groups never used: {sorted(groups - used)}")


def load_rules(rules: DataFrame) -> list[dict]:
    """Effective rules on the driver in id order, checked. The table's size is bounded."""
    rows = sorted((r.asDict(recursive=True) for r in collect_config(rules)), key=lambda r: r["id"])
    for row in rows:
        check_rule(row)
    return rows


# ── regular-expression dialects ──────────────────────────────────────────────


def python_pattern(pattern: str) -> str:
    """RE2 pattern for Python bytes: ``\\s`` without vertical tab, a bare ``$`` only at the end."""
    multiline = re.match(r"\(\?[a-z]*m", pattern) is not None
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            pair = pattern[i : i + 2]
            if pair == r"\s":
                out.append(r"\t\n\f\r " if in_class else r"[\t\n\f\r ]")
            elif pair == r"\S" and not in_class:
                out.append(r"[^\t\n\f\r ]")
            elif pair == r"\z":
                out.append(r"\Z")
            else:
                out.append(pair)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        if ch == "$" and not in_class and not multiline:
            out.append(r"\Z")
        else:
            out.append(ch)
        i += 1
    return "".join(out)


def java_pattern(pattern: str) -> str:
    """RE2 pattern for the built-in regular-expression functions."""
    return re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern)


# ── native operators ─────────────────────────────────────────────────────────


def language_open(languages: list[str] | None, any_language: bool) -> Column:
    if languages:
        return F.col("language").isin(*languages)
    return F.lit(True) if any_language else F.col("language").isin(*RULE_LANGUAGES)


def candidate_rules(files: DataFrame, rules: list[dict], any_language: bool = False) -> DataFrame:
    """(file, rule) pairs that pass the language and keyword gates.

    Rules are plan-time configuration: one array of conditionals per file, exploded. No join,
    no shuffle, and each file's text is folded once.
    """
    folded = files.withColumn("_folded", fold(text_of(F.col("content"))))
    hits = []
    for r in rules:
        gate = F.lit(False)
        for kw in r["keywords"]:
            gate = gate | F.col("_folded").contains(fold_literal(kw))
        hits.append(F.when(language_open(r["languages"], any_language) & gate, F.lit(r["id"])))
    return folded.select(
        "scan_id", "path", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("rule_id")
    )


def match_lines(files: DataFrame, rules: list[dict], any_language: bool = True) -> DataFrame:
    """Single-line rules matched natively: one row per match, all text taken as code.

    For corpora without a lexed language, and patterns that never span lines. A line is
    tested only against rules whose keywords its file holds; positions are UTF-16 columns.
    """
    text = text_of(F.col("content"))
    folded = files.withColumn("_text", text).withColumn("_folded", fold(F.col("_text")))
    gated = folded.withColumn("_gates", keyword_gates(rules, any_language)).filter(F.exists("_gates", lambda g: g))
    return match_gated(gated, rules)


def keyword_gates(rules: list[dict], any_language: bool) -> Column:
    """For each rule whether a row's language and folded text (``_folded``) let it run."""
    gates = []
    for r in rules:
        gate = F.lit(False)
        for kw in r["keywords"]:
            gate = gate | F.col("_folded").contains(fold_literal(kw))
        gates.append(language_open(r["languages"], any_language) & gate)
    return F.array(*gates)


def match_pieces(spark: SparkSession, cuts: DataFrame, root: str, rules: list[dict], *, scan_id: str | None = None,
                 any_language: bool = True) -> tuple[DataFrame, DataFrame]:
    """``match_lines`` over files of any size, given as pieces of whole lines (``corpus.line_cuts``): (matches, unknowns).

    A rule's keywords open a whole file, so a first pass reads the pieces for their gates (a keyword may lie across a
    border: each piece is seen with the text in front of it) and a second reads those of files that some rule may match.
    """
    cuts = stored(cuts, "line-cuts").withColumn("language", language_of(F.col("path")))
    longest = max((len(fold_literal(k).encode()) for r in rules for k in r["keywords"]), default=1)
    read = corpus.line_pieces(cuts, root, scan_id=scan_id, before_bytes=longest)
    seen = read.withColumn("_folded", fold(text_of(F.concat("before", "content"))))
    seen = stored(seen.select("scan_id", "path", "start", "error", F.when(F.col("error").isNull(), keyword_gates(
        rules, any_language)).alias("g")), "piece-gates")
    gates = seen.groupBy("scan_id", "path").agg(F.array(*[
        F.coalesce(F.bool_or(F.col("g")[i]), F.lit(False)) for i in range(len(rules))]).alias("_gates")).filter(F.exists("_gates", lambda g: g))
    pieces = corpus.line_pieces(cuts.join(gates, ["scan_id", "path"]), root, scan_id=scan_id)
    # A piece ends with its last line's end, which would be one more, empty line.
    body = F.regexp_replace(text_of(F.col("content")), r"\n\z", "")
    found = match_gated(pieces.filter("error IS NULL").withColumn("_text", body), rules, F.col("first_line"))
    return found, seen.filter("error IS NOT NULL").select(
        "scan_id", "path", F.lit("reader").alias("detector_id"), F.col("error").alias("reason"))


def match_gated(gated: DataFrame, rules: list[dict], first_line: Column | int = 1) -> DataFrame:
    """The matches of rows with ``_text`` and the ``_gates`` of each rule; ``first_line`` is the number of a row's first line."""
    first = F.lit(first_line) if isinstance(first_line, int) else first_line
    lines = gated.select(
        "scan_id", "path", "_gates", first.alias("_first"), F.posexplode(lines_of(F.col("_text"))).alias("_i", "text")
    )
    per_rule = []
    for i, r in enumerate(rules):
        pattern = java_pattern(r["pattern"])
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        per_rule.append(F.when(
            F.col("_gates")[i] & F.col("text").rlike(pattern),
            F.struct(F.lit(i).alias("rule_no"), F.lit(r["id"]).alias("rule_id"), found.alias("found")),
        ))
    hits = lines.select(
        "scan_id", "path", (F.col("_i") + F.col("_first")).alias("line"), "text",
        F.explode(F.filter(F.array(*per_rule), lambda h: h.isNotNull())).alias("h"),
    )
    # Start of the n-th match: search for its text after the end of the one before.
    ends = F.aggregate(
        F.slice("h.found", 1, F.col("_n") + 1),
        F.struct(F.lit(0).alias("start"), F.lit(1).alias("next")),
        lambda acc, m: F.struct(
            F.position(m, F.col("text"), acc["next"]).alias("start"),
            (F.position(m, F.col("text"), acc["next"]) + F.length(m)).alias("next"),
        ),
    )
    return (
        hits.select("*", F.posexplode("h.found").alias("_n", "matched"))
        .withColumn("_at", ends["start"])
        .select(
            "scan_id", "path", "line", F.col("h.rule_no").alias("rule_no"), F.col("h.rule_id").alias("rule_id"),
            F.col("_n").alias("match_no"),
            (utf16_length(F.substring("text", F.lit(1), F.col("_at") - 1)) + 1).alias("col"),
            "matched", snippet(F.col("text")).alias("snippet"),
        )
    )


def cap_matches(matches: DataFrame, cap: int) -> DataFrame:
    """Keep the first ``cap`` matches per (rule, file), as the Arrow rule scan does when asked to.

    Counting the matches of earlier lines needs one window per (file, rule), which one
    file's lines bound.
    """
    order = W.partitionBy("scan_id", "path", "rule_id").orderBy("line", "match_no")
    return matches.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= cap).drop("_rn")


def claim_findings(matches: DataFrame, rules: list[dict]) -> DataFrame:
    """Matches of the native path as findings: templates filled from the pattern's groups."""
    names = []
    for i, r in enumerate(rules):
        java = java_pattern(r["pattern"])
        order = {g: n for g, n in re.compile(python_pattern(r["pattern"]).encode()).groupindex.items()}
        fields = F.create_map(*[
            x for g, n in order.items() for x in (F.lit(g), F.regexp_extract("matched", java, n))
        ]) if order else F.create_map().cast("map<string,string>")
        parts = {p: _fill(r["claim"][p], order, java) for p in ("name", "group", "version")}
        names.append(F.when(F.col("rule_no") == i, F.struct(
            F.lit(r["kind"]).alias("kind"), parts["name"].alias("name"), parts["group"].alias("group"),
            parts["version"].alias("version"), F.lit(r["provider"]).alias("provider"),
            F.lit(r["confidence"]).cast("double").alias("confidence"),
            F.map_filter(fields, lambda k, v: v != "").alias("fields"),
            F.when(F.lit(bool(r["risk"])), F.array(F.struct(
                F.lit(r["risk"]).cast("string").alias("id"), F.array().cast("array<string>").alias("detail")
            ))).alias("risks"),
        )))
    filled = matches.withColumn("c", F.coalesce(*names)).filter(F.col("c.name") != "")
    return filled.select(
        "scan_id", "path", "line", "col", F.lit("source-code-analysis").alias("method"),
        F.concat(F.lit("rules/"), "rule_id").alias("detector_id"), "snippet", "c.*",
    )


def _fill(template: str | None, groups: dict[str, int], java: str) -> Column:
    if not template:
        return F.lit("")
    parts: list[Column] = []
    pos = 0
    for m in TEMPLATE.finditer(template):
        parts.append(F.lit(template[pos : m.start()]))
        parts.append(F.regexp_extract("matched", java, groups[m[1]]))
        pos = m.end()
    parts.append(F.lit(template[pos:]))
    return F.concat(*parts)

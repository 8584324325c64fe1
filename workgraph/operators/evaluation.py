"""Scoring generated summaries and checking the findings of review runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workgraph.functions import text as T
from workgraph.operators.scan import ranked, top_per_key

# Kinds of a change, weights of a score, severities, and lines searched around a citation.
KINDS = ["behavior", "refactor", "rename", "test", "config"]
KIND_WEIGHT, GROUNDING_WEIGHT, RECALL_WEIGHT, COUNTS_WEIGHT = 0.30, 0.35, 0.25, 0.10
SEVERITIES = ["info", "low", "medium", "high"]
VERIFY_WINDOW = 2
_COUNTS = r"\+(\d+)\s*/\s*[-−](\d+)"
_OUTPUT = "kind string, what string, behavior string, inferred_why string, impact string, risk_flags array<string>, confidence double"
_FINDING = ("severity string, title string, explanation string, evidence array<struct<path:string,line:int,excerpt:string>>, "
            "confidence double, suggested_comment string")


def is_json(text):
    """Whether a text is one JSON value and nothing after it; a lone parse would ignore what follows, and blank text is none."""
    boxed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.rlike(text, F.lit(r"\S")) & boxed.isNotNull() & F.try_variant_get(boxed, "$[1]", "variant").isNull()


def valid_output(outputs: DataFrame) -> DataFrame:
    """Model output as columns: json_valid, kind, what, inferred_why, impact.

    Valid means parseable JSON with an allowed kind and a headline in ``what``
    or ``behavior``. ``outputs`` has the raw text in ``output``.
    """
    clean = T.clean_json("output")
    rows = outputs.withColumn("_p", F.from_json(clean, _OUTPUT, {"mode": "PERMISSIVE"})) \
        .withColumn("_ok", is_json(clean))
    what = F.coalesce(F.when(F.col("_p.what") != "", F.col("_p.what")), F.col("_p.behavior"), F.lit(""))
    good = F.col("_ok") & F.col("_p.kind").isin(KINDS) & (what != "")
    return rows.withColumn("json_valid", F.coalesce(good, F.lit(False))).withColumn("kind", F.coalesce("_p.kind", F.lit(""))) \
        .withColumn("what", what).withColumn("inferred_why", F.coalesce("_p.inferred_why", F.lit(""))) \
        .withColumn("impact", F.coalesce("_p.impact", F.lit(""))).drop("_p", "_ok")


def score_cases(cases: DataFrame, outputs: DataFrame) -> DataFrame:
    """One result per output: kind match, grounding of named symbols, recall of expected ones, counts, score.

    ``cases`` is (case_id, path, hunk, enclosing_function, expected_kind,
    expected_symbols, added_lines, removed_lines); ``outputs`` is (case_id,
    json_valid, kind, what, inferred_why, impact, ...). Invalid output scores 0;
    saying nothing about counts costs nothing.
    """
    rows = outputs.join(cases, "case_id")
    haystack = F.concat_ws("\n", "path", "hunk", "enclosing_function")
    mentions = F.concat_ws("\n", "what", "inferred_why", "impact")
    tokens = F.regexp_extract_all("what", F.lit(T.SYMBOL_TOKEN), 0)
    named = F.array_distinct(F.transform(F.filter(tokens, lambda t: T.looks_like_symbol(t)), lambda t: T.bare_token(t)))
    rows = rows.withColumn("_hay", haystack).withColumn("_said", mentions).withColumn("candidates", named)
    rows = rows.withColumn("hallucinated", F.filter("candidates", lambda t: ~F.contains(F.col("_hay"), t))) \
        .withColumn("found", F.filter("expected_symbols", lambda s: F.contains(F.col("_said"), s))) \
        .withColumn("missed", F.filter("expected_symbols", lambda s: ~F.contains(F.col("_said"), s)))
    valid = F.col("json_valid")
    share = lambda part, whole, none: F.when(F.size(whole) > 0, F.size(part) / F.size(whole)).otherwise(F.lit(none))
    said = F.regexp_extract("_said", _COUNTS, 0) != ""
    right = F.concat_ws("/", F.regexp_extract("_said", _COUNTS, 1), F.regexp_extract("_said", _COUNTS, 2)) == \
        F.concat_ws("/", F.col("added_lines").cast("string"), F.col("removed_lines").cast("string"))
    match = F.col("kind") == F.col("expected_kind")
    score = KIND_WEIGHT * match.cast("double") + GROUNDING_WEIGHT * (1 - share("hallucinated", "candidates", 0.0)) + \
        RECALL_WEIGHT * share("found", "expected_symbols", 1.0) + COUNTS_WEIGHT * F.when(said & ~right, 0.0).otherwise(1.0)
    empty = F.array().cast("array<string>")
    for name in ["candidates", "hallucinated", "found", "missed"]:
        rows = rows.withColumn(name, F.when(valid, F.col(name)).otherwise(empty))
    return rows.withColumn("kind_match", valid & match).withColumn("counts_mentioned", valid & said) \
        .withColumn("counts_correct", valid & said & right) \
        .withColumn("score", F.when(valid, score).otherwise(F.lit(0.0))).drop("_hay", "_said")


def summarize_models(results: DataFrame, keys: list[str]) -> DataFrame:
    """Aggregates per model: mean score, kind accuracy, pooled hallucination rate, valid share, latency, tokens per second."""
    rate = lambda top, bottom: F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))
    sums = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cases"), F.sum("score").alias("_score"),
        F.count(F.when(F.col("kind_match"), 1)).alias("_kinds"), F.count(F.when(F.col("json_valid"), 1)).alias("_valid"),
        F.sum(F.size("candidates")).alias("_named"), F.sum(F.size("hallucinated")).alias("_invented"),
        F.sum("completion_tokens").alias("_tokens"), F.sum("latency_ms").alias("_ms"))
    return sums.select(*keys, "cases", rate("_score", "cases").alias("mean_score"), rate("_kinds", "cases").alias("kind_accuracy"),
                       rate("_invented", "_named").alias("hallucination_rate"), rate("_valid", "cases").alias("json_rate"),
                       rate("_ms", "cases").alias("mean_latency_ms"), (rate("_tokens", "_ms") * 1000).alias("tokens_per_second"))


def valid_finding(findings: DataFrame) -> DataFrame:
    """Finding JSON judged against its schema: the parsed columns and a ``reason`` (NULL when valid)."""
    rows = findings.withColumn("_v", is_json(F.col("finding"))).withColumn("f", F.from_json("finding", _FINDING))
    missing = F.lit(None).cast("string")
    for name in reversed(["severity", "title", "explanation", "evidence", "confidence"]):
        missing = F.when(F.col(f"f.{name}").isNull(), F.lit(f"{name} is missing or has the wrong type")).otherwise(missing)
    broken = F.exists("f.evidence", lambda e: e["path"].isNull() | e["line"].isNull() | e["excerpt"].isNull())
    reason = F.when(~F.coalesce(F.col("_v"), F.lit(False)), F.lit("not JSON")).when(missing.isNotNull(), missing) \
        .when(~F.col("f.severity").isin(SEVERITIES), F.lit("severity is not an allowed word")) \
        .when(~F.col("f.confidence").between(0.0, 1.0), F.lit("confidence is not within 0..1")) \
        .when(broken, F.lit("evidence is incomplete"))
    return rows.withColumn("reason", reason).select(*findings.columns, "f.*", "reason")


def locate_evidence(evidence: DataFrame, file_lines: DataFrame, window: int = VERIFY_WINDOW) -> DataFrame:
    """Evidence (finding_id, ev_no, repo_id, path, line, excerpt) with ``found_line``: the nearest line holding the excerpt.

    The cited line is tried first, then one after, one before, and so on. Each
    citation looks up its few candidate lines by equality, so nothing scans a
    file.
    """
    want = F.trim(F.regexp_replace(F.coalesce("excerpt", F.lit("")), r"^\s+|\s+$", ""))
    steps = [0] + [d * s for d in range(1, window + 1) for s in (1, -1)]
    tries = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(d).alias("step")) for i, d in enumerate(steps)])
    asked = evidence.withColumn("_want", want).filter("_want != ''").withColumn("_t", F.explode(tries)) \
        .select("finding_id", "ev_no", "repo_id", "path", "_want", "_t.rank", (F.col("line") + F.col("_t.step")).alias("_at"))
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    hits = asked.join(file_lines.select("repo_id", "path", F.col("line").alias("_at"), text.alias("_text")), ["repo_id", "path", "_at"]) \
        .filter(F.contains("_text", F.col("_want")))
    best = hits.groupBy("finding_id", "ev_no").agg(F.min_by("_at", "rank").alias("found_line"))
    return evidence.join(best, ["finding_id", "ev_no"], "left")


def verify_evidence(findings: DataFrame, evidence: DataFrame, file_lines: DataFrame, window: int = VERIFY_WINDOW) -> DataFrame:
    """Findings with ``verified`` and a message; one piece of evidence found is enough.

    A finding's evidence comes from one parsed answer, so its reasons may be joined.
    """
    known = file_lines.select("repo_id", "path").distinct().withColumn("_file", F.lit(True))
    rows = locate_evidence(evidence, file_lines, window).join(known, ["repo_id", "path"], "left")
    cited = F.concat("path", F.lit(":"), F.col("line").cast("string"))
    reason = F.when(F.col("found_line").isNotNull(), F.lit(None).cast("string")) \
        .when(F.trim(F.coalesce("excerpt", F.lit(""))) == "", F.concat(cited, F.lit(": empty excerpt"))) \
        .when(F.col("_file").isNull(), F.concat("path", F.lit(": file not found"))) \
        .otherwise(F.concat(cited, F.lit(f": excerpt not found within +/-{window} lines")))
    per = rows.withColumn("_why", reason).groupBy("finding_id").agg(
        F.count("found_line").alias("_ok"), F.count(F.lit(1)).alias("_all"),
        F.array_sort(F.collect_list(F.when(F.col("_why").isNotNull(), F.struct("ev_no", "_why")))).alias("_r"))
    joined = F.array_join(F.transform("_r", lambda r: r["_why"]), "; ")
    message = F.when(F.col("_all").isNull(), F.lit("rejected: no evidence")) \
        .when(F.col("_ok") == 0, F.concat(F.lit("rejected: "), joined)) \
        .otherwise(F.format_string("verified %d/%d evidence line(s)", "_ok", "_all"))
    return findings.join(per, "finding_id", "left").withColumn("verified", F.coalesce(F.col("_ok") > 0, F.lit(False))) \
        .withColumn("verification", message).drop("_ok", "_all", "_r")


def cap_findings(findings: DataFrame, n: int) -> DataFrame:
    """The first n verified findings of each run, numbered; n of 0 keeps all. ``findings`` has run_id, seq, verified."""
    good = findings.filter("verified")
    order = [F.col("seq")]
    kept = top_per_key(good, ["run_id"], order, n, "number") if n > 0 else ranked(good, ["run_id"], order, "number")
    return kept.withColumn("number_id", F.concat_ws("-", F.col("run_id").cast("string"), F.col("number").cast("string")))


def run_counts(findings: DataFrame, n: int) -> DataFrame:
    """Emitted and rejected findings per run; what follows the n-th verified one is neither."""
    capped = cap_findings(findings, n)
    last = capped.groupBy("run_id").agg(F.count(F.lit(1)).alias("emitted"), F.max("seq").alias("_last"))
    full = (F.col("emitted") >= n) if n > 0 else F.lit(False)
    seen = findings.join(last, "run_id", "left").filter(~F.coalesce(full, F.lit(False)) | (F.col("seq") <= F.col("_last")))
    return seen.groupBy("run_id").agg(F.max(F.coalesce("emitted", F.lit(0))).alias("emitted"),
                                      F.count(F.when(~F.col("verified"), 1)).alias("rejected"))


def blind_judging_set(cases: DataFrame, outputs: DataFrame, seed: int = 42) -> DataFrame:
    """Outputs of each case in a repeatable shuffled order, the label set aside in its own column."""
    label = F.concat_ws(" @ ", "model", "variant")
    labelled = outputs.withColumn("label", label)
    shuffled = labelled.withColumn("_h", F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col("case_id").cast("string"), "label", F.col("output_id").cast("string"))))
    placed = ranked(shuffled, ["case_id"], [F.col("_h"), F.col("output_id")], "slot").drop("_h")
    parts = F.concat_ws("\n", F.when(F.col("what") != "", F.col("what")),
                        F.when(F.col("inferred_why") != "", F.concat(F.lit("Why: "), "inferred_why")),
                        F.when(F.col("impact") != "", F.concat(F.lit("Impact: "), "impact")))
    return placed.join(cases, "case_id").withColumn("text", parts)

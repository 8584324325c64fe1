"""Reports as ordered lines: sort keys and a ``text`` column, so a report of any size is a range sort.

``write_text`` in the file sources writes them; nothing here gathers a report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

V = "review_id"


def _lines(rows: DataFrame, keys: list, text) -> DataFrame:
    return rows.select(*keys, text.alias("text"))


def model_report(aggregates: DataFrame, results: DataFrame) -> DataFrame:
    """Markdown table of models, then a table of cases per model: (part, model, variant, case_id, n, text)."""
    key = lambda part, n, case=F.lit(""): [F.lit(part).alias("part"), "model", "variant", case.alias("case_id"), F.lit(n).alias("n")]
    top = aggregates.select(*key(1, 0), F.format_string(
        "| %s @ %s | %.3f | %.0f%% | %.1f%% | %.0f%% | %.0f ms | %.1f |", "model", "variant", "mean_score", F.col("kind_accuracy") * 100,
        F.col("hallucination_rate") * 100, F.col("json_rate") * 100, "mean_latency_ms", "tokens_per_second").alias("text"))
    dash = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(F.lit("-"))
    rows = results.select(*key(2, 1, F.col("case_id").cast("string")), F.format_string(
        "| %s | %s / %s | %.2f | %s | %s | %s |", F.col("case_id").cast("string"), "expected_kind", "kind", "score",
        F.col("json_valid").cast("string"), dash(F.col("hallucinated")), dash(F.col("missed"))).alias("text"))
    heads = aggregates.select(*key(2, 0), F.concat(F.lit("| Case | Kind (want/got) | Score | JSON valid | Hallucinated symbols | Missed symbols | of "),
                                                   "model", F.lit(" @ "), "variant").alias("text"))
    title = aggregates.limit(1).select(F.lit(0).alias("part"), F.lit("").alias("model"), F.lit("").alias("variant"), F.lit("").alias("case_id"),
                                       F.lit(0).alias("n"), F.lit("| Model | Score | Kind acc. | Hallucination rate | JSON valid | Mean latency | Tokens/s |").alias("text"))
    return title.unionByName(top).unionByName(heads).unionByName(rows)


def flow_report(flow: DataFrame) -> DataFrame:
    """A review order: headings, files with why, then the unclassified: (review_id, block, pos, n, text)."""
    grouped, rest = flow.filter("group_no IS NOT NULL"), flow.filter("group_no IS NULL")
    counts = flow.groupBy(V).agg(F.countDistinct("group_no").alias("groups"), F.count(F.when(F.col("group_no").isNull(), 1)).alias("rest"))
    plural = F.when(F.col("groups") == 1, " (1 group)").when(F.col("groups") > 1, F.format_string(" (%d groups)", "groups")).otherwise("")
    key = lambda block, pos, n: [V, block.cast("long").alias("block"), pos.cast("long").alias("pos"), F.lit(n).alias("n")]
    zero, last = F.lit(0), F.lit(1 << 40)
    head = _lines(counts, key(zero, zero, 0), F.concat(F.lit("order: flow"), plural))
    titles = _lines(grouped.select(V, "group_no", "title").distinct(), key(F.col("group_no"), zero, 0), F.format_string("== %s ==", "title"))
    paths = _lines(grouped, key(F.col("group_no"), F.col("pos_in_group"), 0), F.concat(F.lit("  "), "path"))
    whys = _lines(grouped.filter("why != ''"), key(F.col("group_no"), F.col("pos_in_group"), 1), F.concat(F.lit("      "), "why"))
    tail = _lines(counts.filter("rest > 0"), key(last, zero, 0), F.format_string("Unclassified (%d):", "rest"))
    left = _lines(rest, key(last, F.col("pos_in_group"), 0), F.concat(F.lit("  "), "path"))
    return head.unionByName(titles).unionByName(paths).unionByName(whys).unionByName(tail).unionByName(left)


# Parts of a radius report in order, the heading of each and how a line starts.
RADIUS_PARTS = {"caller": (1, "  unchanged callers (%d):", "    "), "site": (2, "  call sites (%d):", "    "),
                "impl": (3, "  implementers (%d):", "    "), "warning": (4, "  warnings (%d):", "  WARNING: ")}


def radius_report(changed: DataFrame, radius: DataFrame) -> DataFrame:
    """What each changed function affects: (review_id, repo_id, symbol, part_no, other, path, line, text).

    ``changed`` is (review_id, repo_id, symbol, kind, signature_changed).
    """
    pick = lambda i: F.element_at(F.create_map(*[x for part, spec in RADIUS_PARTS.items() for x in (F.lit(part), F.lit(spec[i]))]), F.col("part"))
    none = F.lit(None).cast("string")
    head = changed.select(V, "repo_id", "symbol", F.lit(0).alias("part_no"), none.alias("other"), none.alias("path"), F.lit(None).cast("long").alias("line"),
                          F.concat("symbol", F.lit(" ("), "kind", F.lit(")"), F.when(F.col("signature_changed"), " [signature changed]").otherwise("")).alias("text"))
    counts = radius.groupBy(V, "repo_id", "symbol", "part").agg(F.count(F.lit(1)).alias("n"))
    titles = counts.select(V, "repo_id", "symbol", pick(0).alias("part_no"), none.alias("other"), none.alias("path"), F.lit(None).cast("long").alias("line"),
                           F.replace(pick(1), F.lit("%d"), F.col("n").cast("string")).alias("text"))
    seat = F.when(F.col("path").isNotNull(), F.format_string(" (%s:%d)", "path", "line")).otherwise("")
    flag = F.when(F.col("in_diff"), " [in diff]").otherwise(" [not in diff]")
    rows = radius.select(V, "repo_id", "symbol", pick(0).alias("part_no"), "other", "path", "line", F.concat(pick(2), "other", seat, flag).alias("text"))
    return head.unionByName(titles).unionByName(rows)


def reach_report(reach: DataFrame, commands: DataFrame) -> DataFrame:
    """Which changed functions a test reaches and how to run those tests: (review_id, repo_id, part_no, id, n, text)."""
    key = lambda part, ident, n: [V, "repo_id", F.lit(part).alias("part_no"), ident.alias("id"), F.lit(n).alias("n")]
    totals = reach.groupBy(V, "repo_id").agg(F.count(F.when(F.col("reached"), 1)).alias("hit"), F.count(F.lit(1)).alias("all"))
    head = _lines(totals, key(0, F.lit(""), 0), F.format_string("Test reach: %d/%d changed functions reached by a test", "hit", "all"))
    marks = _lines(reach, key(1, F.col("id"), 0), F.concat(F.lit("  ["), F.when(F.col("reached"), "x").otherwise(" "), F.lit("] "), "id"))
    by = _lines(reach.filter("reached"), key(1, F.col("id"), 1), F.concat(F.lit("        by "), F.array_join("tests", ", ")))
    hint = _lines(commands.select(V, "repo_id").distinct(), key(2, F.lit(""), 0), F.lit("Suggested:"))
    runs = _lines(commands, key(3, F.col("dir"), 0), F.concat(F.lit("  "), "command"))
    return head.unionByName(marks).unionByName(by).unionByName(hint).unionByName(runs)


def context_report(wanted: DataFrame, edges: DataFrame) -> DataFrame:
    """Callers, callees and implementations of each symbol: (repo_id, id, section, confidence_no, other, path, line, text).

    ``edges`` is (repo_id, id, section, other, confidence, path, line), section 1 to 3.
    """
    # Section titles and confidences in the order they are listed.
    titles = {1: "Callers", 2: "Callees", 3: "Implementations"}
    levels = ["static", "interface-dispatch", "heuristic"]
    sections = F.explode(F.array(*[F.struct(F.lit(i).alias("section"), F.lit(t).alias("title")) for i, t in titles.items()])).alias("s")
    counts = edges.groupBy("repo_id", "id", "section").agg(F.count(F.lit(1)).alias("n"))
    every = wanted.select("repo_id", "id").distinct().select("repo_id", "id", sections).select("repo_id", "id", "s.section", "s.title") \
        .join(counts, ["repo_id", "id", "section"], "left").fillna(0, ["n"])
    blank = F.lit(None).cast("string")
    shape = lambda rows, section, level, text, other=blank, path=blank, line=F.lit(None).cast("long"): rows.select(
        "repo_id", "id", section.alias("section"), level.alias("confidence_no"), other.alias("other"), path.alias("path"), line.cast("long").alias("line"), text.alias("text"))
    head = shape(wanted.select("repo_id", "id").distinct(), F.lit(0), F.lit(0), F.col("id"))
    tops = shape(every, F.col("section"), F.lit(0), F.format_string("%s (%d):", "title", "n"))
    none = shape(every.filter("n = 0"), F.col("section"), F.lit(1), F.lit("  none"))
    level = F.array_position(F.array(*[F.lit(c) for c in levels]), F.col("confidence")).cast("int")
    groups = shape(edges.select("repo_id", "id", "section", "confidence").distinct(), F.col("section"), level, F.format_string("  [%s]", "confidence"))
    seat = F.when(F.col("path").isNotNull(), F.format_string(" (%s:%d)", "path", "line")).otherwise("")
    rows = shape(edges, F.col("section"), level, F.concat(F.lit("    "), "other", seat), F.col("other"), F.col("path"), F.col("line"))
    return head.unionByName(tops).unionByName(none).unionByName(groups).unionByName(rows)

"""Scenario files: outline, step texts, and the step definitions that match them.

``lines`` is (repo_id, path, line, text) of feature files. A file of any length
is scanned in blocks of lines; steps and definitions are joined, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workgraph.functions import ids as X
from workgraph.functions import paths as P
from workgraph.functions import text as T
from workgraph.operators.code import V, enclosing_symbol
from workgraph.operators.intervals import new_range, overlaps
from workgraph.operators.literals import literal_matches
from workgraph.operators.scan import BLOCK, carry_all
from workgraph.session import cut

FILE = ["repo_id", "path"]
# Headings of a feature file, the kind each opens and its nesting level.
HEADINGS = [("Feature:", "feature", 0), ("Rule:", "rule", 1), ("Background:", "background", 2),
            ("Scenario Outline:", "scenario", 2), ("Scenario:", "scenario", 2)]
STEP_LEVEL = 3


def feature_outline(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """Headings and steps with their nesting: (repo_id, path, kind, name, parent, id, start_line, end_line).

    A heading ends before the next one of its level or above; a step is one
    line. The parent is the nearest line above of a lower level. The open
    headings are carried from block to block of ``block`` lines, downwards for
    parents and upwards for ends, so no task holds a whole file.
    """
    text = F.trim(F.regexp_replace("text", r"\s+$", ""))
    kind, level, name = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("string")
    for keyword in T.STEP_KEYWORDS:
        here = F.startswith(text, F.lit(keyword))
        kind, level, name = F.when(here, "step").otherwise(kind), F.when(here, STEP_LEVEL).otherwise(level), F.when(here, text).otherwise(name)
    for prefix, what, depth in reversed(HEADINGS):
        here = F.startswith(text, F.lit(prefix))
        rest = F.trim(F.substring(text, len(prefix) + 1, 1 << 30))
        kind, level, name = F.when(here, what).otherwise(kind), F.when(here, depth).otherwise(level), F.when(here, rest).otherwise(name)
    tagged = lines.withColumn("kind", kind).withColumn("level", level).withColumn("name", name)
    bottom = lines.groupBy(*FILE).agg(F.max("line").alias("_bottom"))
    heads = tagged.filter("kind IS NOT NULL").drop("text")
    opened = {f"_above{d}": F.when(F.col("level") < d, F.col("name")) for d in range(1, STEP_LEVEL + 1)}
    closed = {f"_below{d}": F.when(F.col("level") <= d, F.col("line")) for d in range(STEP_LEVEL)}
    heads = carry_all(heads, FILE, "line", opened, inclusive=False, block=block)
    heads = carry_all(heads, FILE, "line", closed, inclusive=False, backward=True, block=block)
    parent, closing = F.lit(None).cast("string"), F.lit(None).cast("int")
    for depth in range(STEP_LEVEL + 1):
        here = F.col("level") == depth
        parent = F.when(here, F.col(f"_above{depth}")).otherwise(parent) if depth else parent
        closing = F.when(here, F.col(f"_below{depth}")).otherwise(closing) if depth < STEP_LEVEL else closing
    rows = heads.withColumn("_parent", parent).withColumn("_next", closing).join(bottom, FILE)
    end = F.when(F.col("level") == STEP_LEVEL, F.col("line")).otherwise(F.coalesce(F.col("_next") - 1, F.col("_bottom")))
    owner = F.coalesce("_parent", F.lit(""))
    ident = F.concat("path", F.lit("#"), F.when(owner != "", F.concat(owner, F.lit("."))).otherwise(F.lit("")), "name")
    return rows.select(*FILE, "kind", "name", owner.alias("parent"), ident.alias("id"), F.col("line").alias("start_line"), end.alias("end_line"))


def _cells(text):
    inner = F.substring(F.trim(text), 2, 1 << 30)
    return F.transform(F.split(F.regexp_replace(inner, r"\|$", ""), r"\|"), lambda c: F.trim(c))


def examples_first_row(lines: DataFrame, outline: DataFrame) -> DataFrame:
    """Header and first row after the first ``Examples:`` of each scenario: (repo_id, path, start_line, header, row)."""
    scenarios = outline.filter("kind = 'scenario'").select(*FILE, "start_line", "end_line")
    marks = lines.filter(F.trim("text") == "Examples:").select(*FILE, F.col("line").alias("_m"))
    first = overlaps(scenarios, marks, FILE, ("start_line", "end_line"), ("_m", "_m")) \
        .groupBy(*FILE, "start_line", "end_line").agg(F.min("_m").alias("_m"))
    table = F.trim("text").rlike(r"(?s)^\|.*\|$") & (F.length(F.trim("text")) >= 2)
    rows = lines.filter(table).select(*FILE, F.col("line").alias("_at"), _cells(F.col("text")).alias("_c"))
    at = lambda step, out: rows.select(*FILE, (F.col("_at") - step).alias("_m"), F.col("_at").alias(f"{out}_line"), F.col("_c").alias(out))
    both = first.join(at(1, "header"), [*FILE, "_m"]).filter("header_line <= end_line").join(at(2, "row"), [*FILE, "_m"], "left")
    inside = F.col("row_line") <= F.col("end_line")
    return both.select(*FILE, "start_line", "header", F.when(inside, F.col("row")).alias("row"))


def step_texts(lines: DataFrame, outline: DataFrame) -> DataFrame:
    """Steps with the text to match: keyword off, placeholders from the first example row or a plain word."""
    outline = cut(outline)
    steps = outline.filter("kind = 'step'").withColumn("text", T.strip_keyword("name"))
    open_ = steps.filter(F.contains("text", F.lit("<"))).withColumn("line", F.col("start_line")).drop("end_line")
    scenarios = outline.filter("kind = 'scenario'").select(*FILE, F.col("start_line").alias("id"), "start_line", "end_line") \
        .withColumn("ord", F.col("start_line"))
    homes = enclosing_symbol(open_.select(*FILE, "line").distinct(), scenarios, FILE)
    examples = examples_first_row(lines, outline).select(*FILE, F.col("start_line").alias("enclosing"), "header", "row")
    filled = open_.join(homes, [*FILE, "line"], "left").join(examples, [*FILE, "enclosing"], "left") \
        .withColumn("text", F.coalesce(T.substitute_example("text", "header", "row"), T.wildcard("text"))) \
        .select(*FILE, F.col("id").alias("step_id"), "start_line", "text")
    plain = steps.filter(~F.contains("text", F.lit("<"))).select(*FILE, F.col("id").alias("step_id"), "start_line", "text")
    return plain.unionByName(filled)


def match_steps(steps: DataFrame, step_defs: DataFrame) -> DataFrame:
    """Steps linked to the definitions whose pattern matches: (…step columns, to_id, def_id, confidence).

    One match is static; of several all are kept as heuristic; none gives a row
    with NULL. ``step_defs`` is (repo_id, def_id, pattern, handler_id). Each
    distinct text is tested once, against the patterns whose rarest literal it
    holds (:mod:`workgraph.operators.literals`).
    """
    texts = cut(steps.select("repo_id", "text").distinct())
    met = literal_matches(texts, step_defs, ["repo_id"]).select("repo_id", "text", "def_id", "handler_id")
    counts = met.groupBy("repo_id", "text").agg(F.count(F.lit(1)).alias("_n"))
    linked = met.join(counts, ["repo_id", "text"])
    confidence = F.when(F.col("_n") == 1, "static").when(F.col("_n") > 1, "heuristic")
    return steps.join(linked, ["repo_id", "text"], "left").withColumn("confidence", confidence) \
        .withColumn("to_id", F.coalesce(F.when(F.col("handler_id") != "", F.col("handler_id")), "def_id")).drop("_n", "handler_id")


def scenarios_using(links: DataFrame, outline: DataFrame) -> DataFrame:
    """Scenarios, else backgrounds, around the steps linked to each target: (repo_id, to_id, path, id, name, start_line)."""
    points = links.filter("to_id IS NOT NULL").select(*FILE, F.col("start_line").alias("line")).distinct()
    boxes = outline.filter(F.col("kind").isin("scenario", "background")) \
        .select(*FILE, "kind", F.col("start_line").alias("_start"), F.col("end_line").alias("_end"))
    # A scenario wins over a background, the smallest of either over the rest.
    met = overlaps(points, boxes, FILE, ("line", "line"), ("_start", "_end"))
    home = met.groupBy(*FILE, "line").agg(F.min(F.struct(F.when(F.col("kind") == "scenario", 0).otherwise(1).alias("k"),
                                                         (F.col("_end") - F.col("_start")).alias("span"), "_start")).alias("_b"))
    home = home.select(*FILE, F.col("line").alias("start_line"), F.col("_b._start").alias("_start"))
    named = outline.filter(F.col("kind").isin("scenario", "background")).select(*FILE, F.col("start_line").alias("_start"), "id", "name")
    return links.filter("to_id IS NOT NULL").select(*FILE, "start_line", "to_id").join(home, [*FILE, "start_line"]) \
        .join(named, [*FILE, "_start"]).select("repo_id", "to_id", "path", "id", "name", F.col("_start").alias("start_line")).distinct()


def steps_for_scenario(outline: DataFrame) -> DataFrame:
    """Steps inside each scenario or background: (repo_id, path, scenario_id, step, start_line)."""
    boxes = outline.filter(F.col("kind").isin("scenario", "background")).select(
        *FILE, F.col("id").alias("scenario_id"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e"))
    steps = outline.filter("kind = 'step'").select(*FILE, F.col("name").alias("step"), "start_line")
    return overlaps(boxes, steps, FILE, ("_s", "_e"), ("start_line", "start_line")).select(
        *FILE, "scenario_id", "step", "start_line")


def changed_scenarios(outline: DataFrame, hunks: DataFrame) -> DataFrame:
    """Scenarios a new-side hunk overlaps: (review_id, repo_id, path, id)."""
    live = hunks.filter("status != 'deleted'") if "status" in hunks.columns else hunks
    ranges = live.select(V, *FILE, new_range()[0].alias("_hs"), new_range()[1].alias("_he")).distinct()
    boxes = outline.filter("kind = 'scenario'").select(*FILE, "id", "start_line", "end_line")
    return overlaps(ranges, boxes, FILE, ("_hs", "_he"), ("start_line", "end_line")).select(V, *FILE, "id").distinct()


def splice_scenarios(symbols: DataFrame, step_defs: DataFrame, uses: DataFrame) -> DataFrame:
    """Scenarios reaching a handler in the call graph: (repo_id, id, scenario_id).

    Handlers are known by structural id, call-graph symbols by exact id; the two
    meet on the structural id computed from a symbol. Only Go handlers can.
    """
    exact = symbols.select("repo_id", "id", X.structural_id("path", "receiver", "name").alias("handler_id"))
    go = step_defs.filter("handler_id != '' AND language = 'go'").select("repo_id", "handler_id").distinct()
    return exact.join(go, ["repo_id", "handler_id"]).join(
        uses.select("repo_id", F.col("to_id").alias("handler_id"), F.col("id").alias("scenario_id")), ["repo_id", "handler_id"]) \
        .select("repo_id", "id", "scenario_id").distinct()


# How step registrations are written per language.
_GO = (r"(?m)^[ \t]*[A-Za-z_][A-Za-z0-9_]*\.(Step|Given|When|Then)\(\s*(`[^`]*`|" r'"(?:[^"\\]|\\.)*")\s*,\s*([A-Za-z_][A-Za-z0-9_.]*)\s*\)')
_JAVA = r'@(Given|When|Then|And|But)\(\s*("(?:[^"\\]|\\.)*")\s*()\)'
_JS = (X.START + r"(Given|When|Then|And|But)\(\s*(/(?:[^/\\\n]|\\.)*/|'(?:[^'\\]|\\.)*'|" r'"(?:[^"\\]|\\.)*")\s*,\s*'
       r"(async\s+function|function" + X.END + r"|\([^)]*\)\s*=>|[A-Za-z_$][A-Za-z0-9_$]*\s*=>|[A-Za-z_$][A-Za-z0-9_$.]*)")


def _registrations(sources: DataFrame, pattern: str) -> DataFrame:
    """Every match with its groups and the line it starts on, counted from the text before it."""
    group = lambda i: F.regexp_extract_all("text", F.lit(pattern), i)
    rows = sources.select(*FILE, "language", F.split("text", pattern, -1).alias("_gaps"), group(0).alias("_all"),
                          F.posexplode(F.arrays_zip(group(1).alias("keyword"), group(2).alias("literal"), group(3).alias("handler"))).alias("_i", "_m"))
    before = F.concat(F.array_join(F.expr("slice(_gaps, 1, _i + 1)"), ""), F.array_join(F.expr("slice(_all, 1, _i)"), ""))
    return rows.select(*FILE, "language", "_m.keyword", "_m.literal", "_m.handler", F.size(F.split(before, "\n")).alias("line"))


def extract_step_defs(sources: DataFrame, symbols: DataFrame) -> DataFrame:
    """Step registrations of Go, Java and JavaScript sources.

    ``sources`` is (repo_id, path, language, text); ``symbols`` has language and
    ord. Output (repo_id, def_id, path, line, language, keyword, raw, pattern,
    handler_id). A handler named in code is resolved when the repository has
    one function of that name; an inline or annotated one is the function around
    the registration.
    """
    script = F.col("language").isin("javascript", "typescript", "tsx")
    go = _registrations(sources.filter("language = 'go'"), _GO)
    java = _registrations(sources.filter("language = 'java'"), _JAVA)
    js = _registrations(sources.filter(script), _JS).withColumn("language", F.lit("javascript"))
    rows = cut(go.unionByName(java).unionByName(js))
    body = F.expr("substring(literal, 2, length(literal) - 2)")
    plain = F.regexp_replace(body, r"\\([\\'\"])", "$1")
    raw = F.when(F.startswith("literal", F.lit("`")) | F.startswith("literal", F.lit("/")), body).otherwise(plain)
    is_regex = (F.col("language") == "go") | F.startswith("literal", F.lit("/")) | F.startswith(raw, F.lit("^"))
    rows = rows.withColumn("raw", raw).withColumn("pattern", F.when(is_regex, raw).otherwise(T.cucumber_to_regex(raw))) \
        .withColumn("keyword", F.when(F.col("keyword") == "Step", "").otherwise(F.col("keyword"))) \
        .withColumn("def_id", F.concat(F.lit("gherkin-stepdef:"), "path", F.lit(":"), F.col("line").cast("string")))
    around = (F.col("language") == "java") | F.col("handler").rlike(r"^(function|async)|=>")
    family = F.when(F.col("language").isin("typescript", "tsx"), "javascript").otherwise(F.col("language"))
    functions = symbols.filter(F.col("kind").isin("func", "method"))
    unique = functions.withColumn("language", family).groupBy("repo_id", "language", F.col("name").alias("handler")) \
        .agg(F.min("id").alias("_id"), F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")
    named = rows.filter(~around).join(unique, ["repo_id", "language", "handler"], "left")
    inline = rows.filter(around)
    homes = enclosing_symbol(inline.select(*FILE, "line").distinct(), functions, FILE).withColumnRenamed("enclosing", "_id")
    out = ["repo_id", "def_id", "path", "line", "language", "keyword", "raw", "pattern", "_id"]
    return named.select(*out).unionByName(inline.join(homes, [*FILE, "line"], "left").select(*out)) \
        .withColumn("handler_id", F.coalesce("_id", F.lit(""))).drop("_id")

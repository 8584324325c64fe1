"""Scenario-file queries over feature files rendered from documents and steps derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from workgraph.functions import text as T
from workgraph.operators import features as O
from workgraph.plans.registry import query
from workgraph.session import cut

# Step definitions the derived steps are matched against; the second and fifth overlap the rest.
PATTERNS = [r'^user "([^"]*)" does click (\d+)$', r'^user "u1[^"]*" does (\w+) (\d+)$', r"does view [0-4]$",
            r'^user "([^"]*)" does purchase (-?\d+)$', r'^user "u8" .*$']
_PATTERN_SQL = "[" + ", ".join("'" + p + "'" for p in PATTERNS) + "]"

_OUT = """tg AS (SELECT *, CASE WHEN starts_with(trim(text), 'Feature:') THEN 'feature' WHEN starts_with(trim(text), 'Rule:') THEN 'rule'
      WHEN starts_with(trim(text), 'Background:') THEN 'background' WHEN regexp_matches(trim(text), '^Scenario( Outline)?:') THEN 'scenario'
      WHEN regexp_matches(trim(text), '^(Given|When|Then|And|But|\\*) ') THEN 'step' END AS kind FROM feature_lines),
lv AS (SELECT *, CASE kind WHEN 'feature' THEN 0 WHEN 'rule' THEN 1 WHEN 'background' THEN 2 WHEN 'scenario' THEN 2 WHEN 'step' THEN 3 END AS level,
    CASE kind WHEN 'step' THEN trim(text) ELSE trim(regexp_replace(trim(text), '^[A-Za-z ]+:', '')) END AS name FROM tg),
ol AS (SELECT *, coalesce(CASE level WHEN 1 THEN last_value(CASE WHEN level < 1 THEN name END IGNORE NULLS) OVER up
      WHEN 2 THEN last_value(CASE WHEN level < 2 THEN name END IGNORE NULLS) OVER up WHEN 3 THEN last_value(CASE WHEN level < 3 THEN name END IGNORE NULLS) OVER up END, '') AS parent,
    CASE level WHEN 3 THEN line WHEN 0 THEN coalesce(min(CASE WHEN level <= 0 THEN line END) OVER dn - 1, max(line) OVER (PARTITION BY path))
      WHEN 1 THEN coalesce(min(CASE WHEN level <= 1 THEN line END) OVER dn - 1, max(line) OVER (PARTITION BY path))
      WHEN 2 THEN coalesce(min(CASE WHEN level <= 2 THEN line END) OVER dn - 1, max(line) OVER (PARTITION BY path)) END AS end_line
  FROM lv WINDOW up AS (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    dn AS (PARTITION BY path ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
outl AS (SELECT path, kind, name, parent, path || '#' || CASE WHEN parent <> '' THEN parent || '.' ELSE '' END || name AS id, line AS start_line, end_line FROM ol WHERE kind IS NOT NULL)"""
_EX = _OUT + """,
exm AS (SELECT o.path, o.start_line, o.end_line, min(l.line) AS m FROM outl o JOIN feature_lines l ON l.path = o.path AND l.line BETWEEN o.start_line AND o.end_line
    AND trim(l.text) = 'Examples:' WHERE o.kind = 'scenario' GROUP BY 1, 2, 3),
exr AS (SELECT e.path, e.start_line, h.text AS header, r.text AS row FROM exm e JOIN feature_lines h ON h.path = e.path AND h.line = e.m + 1 AND h.line <= e.end_line AND starts_with(h.text, '|')
    LEFT JOIN feature_lines r ON r.path = e.path AND r.line = e.m + 2 AND r.line <= e.end_line AND starts_with(r.text, '|'))"""


def _outline(t):
    return O.feature_outline(t.feature_lines)


@query("feature_outline", "WITH " + _OUT + " SELECT * FROM outl")
def feature_outline(t):
    return _outline(t).drop("repo_id")


@query("examples_first_row", "WITH " + _EX + """ SELECT path, start_line, array_to_string(list_transform(string_split(header[2:-2], '|'), lambda c: trim(c)), ',') AS header,
    array_to_string(list_transform(string_split(row[2:-2], '|'), lambda c: trim(c)), ',') AS row FROM exr""")
def examples_first_row(t):
    return O.examples_first_row(t.feature_lines, cut(_outline(t))).select(
        "path", "start_line", F.array_join("header", ",").alias("header"), F.array_join("row", ",").alias("row"))


@query("step_texts", "WITH " + _EX + r""",
st AS (SELECT *, regexp_replace(name, '^(Given|When|Then|And|But|\*) ', '') AS tx FROM outl WHERE kind = 'step'),
hm AS (SELECT s.path, s.start_line, s.id, s.tx, x.header, x.row, row_number() OVER (PARTITION BY s.path, s.start_line ORDER BY o.end_line - o.start_line, o.start_line) AS rn
    FROM st s LEFT JOIN outl o ON o.path = s.path AND o.kind = 'scenario' AND s.start_line BETWEEN o.start_line AND o.end_line
    LEFT JOIN exr x ON x.path = o.path AND x.start_line = o.start_line)
SELECT path, id AS step_id, start_line, CASE WHEN tx = 'a <who> does <n>' AND header = '| who | n |' AND row IS NOT NULL AND len(string_split(row, '|')) = 4
    THEN 'a ' || trim(string_split(row, '|')[2]) || ' does ' || trim(string_split(row, '|')[3]) ELSE regexp_replace(tx, '<[^>]+>', 'x', 'g') END AS text FROM hm WHERE rn = 1""")
def step_texts(t):
    return O.step_texts(t.feature_lines, _outline(t)).drop("repo_id")


@query("steps_for_scenario", "WITH " + _OUT + """ SELECT b.path, b.id AS scenario_id, s.name AS step, s.start_line FROM outl b JOIN outl s ON s.path = b.path AND s.kind = 'step'
    AND s.start_line BETWEEN b.start_line AND b.end_line WHERE b.kind IN ('scenario', 'background')""")
def steps_for_scenario(t):
    return O.steps_for_scenario(cut(_outline(t))).drop("repo_id")


def _step_defs(t):
    patterns = F.array(*[F.lit(p) for p in PATTERNS])
    return t.steps.select("repo_id").distinct().select("repo_id", F.posexplode(patterns).alias("def_id", "pattern")) \
        .withColumn("handler_id", F.when(F.col("def_id") == 3, "h.go#bought").otherwise(""))


@query("match_steps", "WITH pt AS (SELECT unnest(range(5)) AS def_id, unnest(" + _PATTERN_SQL + r""") AS pattern),
st AS (SELECT step_id, regexp_replace(text, '^Given ', '') AS text FROM steps),
mt AS (SELECT s.step_id, p.def_id, count(*) OVER (PARTITION BY s.step_id) AS n FROM st s JOIN pt p ON regexp_matches(s.text, p.pattern))
SELECT s.step_id, m.def_id, CASE WHEN m.def_id = 3 THEN 'h.go#bought' ELSE CAST(m.def_id AS VARCHAR) END AS to_id, CASE WHEN n = 1 THEN 'static' WHEN n > 1 THEN 'heuristic' END AS confidence
FROM st s LEFT JOIN mt m USING (step_id)""")
def match_steps(t):
    steps = t.steps.withColumn("text", T.strip_keyword("text"))
    defs = _step_defs(t).withColumn("def_id", F.col("def_id").cast("string"))
    return O.match_steps(steps, defs).select("step_id", F.col("def_id").cast("long").alias("def_id"), "to_id", "confidence")


# Step definitions for feature files: words of the rendered steps.
def _links(t, outline):
    defs = F.array(*[F.struct(F.lit(i).alias("def_id"), F.lit(p).alias("pattern")) for i, p in
                     {"who": r"^a (\S+) does (\d+)$", "end": "ends$", "the": "[Tt]he"}.items()])
    step_defs = t.spark.range(1).select(F.expr("CAST(0 AS INT)").alias("repo_id"), F.explode(defs).alias("d")) \
        .select("repo_id", "d.def_id", "d.pattern", F.lit("").alias("handler_id"))
    return O.match_steps(O.step_texts(t.feature_lines, outline), step_defs)


@query("scenarios_using", "WITH " + _EX + r""",
st AS (SELECT *, regexp_replace(name, '^(Given|When|Then|And|But|\*) ', '') AS tx FROM outl WHERE kind = 'step'),
hm AS (SELECT s.path, s.start_line, s.tx, x.header, x.row, row_number() OVER (PARTITION BY s.path, s.start_line ORDER BY o.end_line - o.start_line, o.start_line) AS rn
    FROM st s LEFT JOIN outl o ON o.path = s.path AND o.kind = 'scenario' AND s.start_line BETWEEN o.start_line AND o.end_line LEFT JOIN exr x ON x.path = o.path AND x.start_line = o.start_line),
tx AS (SELECT path, start_line, CASE WHEN tx = 'a <who> does <n>' AND header = '| who | n |' AND row IS NOT NULL AND len(string_split(row, '|')) = 4 THEN 'a u1 does 3' ELSE regexp_replace(tx, '<[^>]+>', 'x', 'g') END AS text FROM hm WHERE rn = 1),
lk AS (SELECT path, start_line, 'who' AS to_id FROM tx WHERE regexp_matches(text, '^a (\S+) does (\d+)$') UNION ALL SELECT path, start_line, 'end' FROM tx WHERE regexp_matches(text, 'ends$')
    UNION ALL SELECT path, start_line, 'the' FROM tx WHERE regexp_matches(text, '[Tt]he')),
bx AS (SELECT lk.to_id, b.path, b.id, b.name, b.start_line, row_number() OVER (PARTITION BY lk.path, lk.start_line, lk.to_id ORDER BY CASE WHEN b.kind = 'scenario' THEN 0 ELSE 1 END, b.end_line - b.start_line, b.start_line) AS rn
    FROM lk JOIN outl b ON b.path = lk.path AND b.kind IN ('scenario', 'background') AND lk.start_line BETWEEN b.start_line AND b.end_line)
SELECT DISTINCT to_id, path, id, name, start_line FROM bx WHERE rn = 1""")
def scenarios_using(t):
    outline = cut(_outline(t))
    return O.scenarios_using(cut(_links(t, outline)), outline).drop("repo_id")


@query("changed_scenarios", "WITH " + _OUT + """, hk AS (SELECT DISTINCT l_suppkey AS review_id, CAST(l_suppkey % 2 AS INT) AS repo_id, 'd' || (l_partkey % 50) || '.feature' AS path, l_linenumber AS s, l_linenumber + greatest(l_suppkey % 3 - 1, 0) AS e FROM lineitem)
SELECT DISTINCT h.review_id, h.repo_id, o.path, o.id FROM hk h JOIN outl o ON o.path = h.path AND o.kind = 'scenario' AND o.start_line + 3 * h.repo_id <= h.e AND h.s <= o.end_line + 3 * h.repo_id""")
def changed_scenarios(t):
    hunks = t.lineitem.select(F.col("l_suppkey").alias("review_id"), (F.col("l_suppkey") % 2).cast("int").alias("repo_id"), F.concat(F.lit("d"), (F.col("l_partkey") % 50).cast("string"), F.lit(".feature")).alias("path"),
                              F.col("l_linenumber").alias("new_start"), (F.col("l_suppkey") % 3).alias("new_lines"))
    outline = cut(_outline(t))
    # The second repository holds the same paths and ids, three lines further down.
    moved = outline.withColumn("repo_id", F.lit(1)).withColumns({c: F.col(c) + 3 for c in ("start_line", "end_line")})
    return O.changed_scenarios(outline.unionByName(moved), hunks)


@query("splice_scenarios", "WITH " + _OUT + """ SELECT DISTINCT 's' || p.p_partkey AS id, o.id AS scenario_id FROM part p JOIN outl o ON o.path = 'd' || (p.p_partkey % 300) || '.feature' AND o.kind = 'scenario' WHERE p.p_size % 2 = 0""")
def splice_scenarios(t):
    symbols = t.part.select(F.expr("CAST(0 AS INT)").alias("repo_id"), F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("id"),
                            F.lit("steps.go").alias("path"), F.lit("*S").alias("receiver"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name"))
    handler = F.concat(F.lit("steps.go#S.f"), F.col("p_partkey").cast("string"))
    defs = t.part.select(F.expr("CAST(0 AS INT)").alias("repo_id"), handler.alias("handler_id"),
                         F.when(F.col("p_size") % 2 == 0, "go").otherwise("java").alias("language"))
    scenarios = _outline(t).filter("kind = 'scenario'")
    uses = t.part.select(F.concat(F.lit("d"), (F.col("p_partkey") % 300).cast("string"), F.lit(".feature")).alias("path"), handler.alias("to_id")) \
        .join(scenarios, "path").select("repo_id", "to_id", "id")
    return O.splice_scenarios(symbols, defs, uses).select("id", "scenario_id")


@query("cucumber_to_regex", r"""SELECT p_partkey, '^the ' || CASE p_partkey % 4 WHEN 0 THEN '(-?\d+)' WHEN 1 THEN '(-?\d+(?:\.\d+)?)' WHEN 2 THEN '"([^"]*)"' ELSE '(\S+)' END
    || ' of ' || p_name || '\? \(a\.b\)$' AS pattern, true AS hit FROM part""")
def cucumber_to_regex(t):
    kind = F.expr("CASE p_partkey % 4 WHEN 0 THEN '{int}' WHEN 1 THEN '{float}' WHEN 2 THEN '{string}' ELSE '{word}' END")
    said = F.expr("""CASE p_partkey % 4 WHEN 0 THEN '-4' WHEN 1 THEN '2.5' WHEN 2 THEN '"x y"' ELSE 'z' END""")
    tail = F.concat(F.lit(" of "), F.col("p_name"), F.lit("? (a.b)"))
    pattern = T.cucumber_to_regex(F.concat(F.lit("the "), kind, tail))
    return t.part.select("p_partkey", pattern.alias("pattern"), F.rlike(F.concat(F.lit("the "), said, tail), pattern).alias("hit"))


@query("extract_step_defs", r"""SELECT 0 AS repo_id, 'gherkin-stepdef:src/' || p_partkey || ':' || (p_size + 1) AS def_id, 'src/' || p_partkey AS path, p_size + 1 AS line,
    CASE p_partkey % 3 WHEN 0 THEN 'go' WHEN 1 THEN 'java' ELSE 'javascript' END AS language, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Given' ELSE 'When' END AS keyword,
    CASE p_partkey % 3 WHEN 0 THEN '^' || p_name || '$' WHEN 1 THEN p_name || ' {int}' ELSE p_name || ' {word}' END AS raw,
    CASE p_partkey % 3 WHEN 0 THEN '^' || p_name || '$' WHEN 1 THEN '^' || p_name || ' (-?\d+)$' ELSE '^' || p_name || ' (\S+)$' END AS pattern,
    'src/' || p_partkey || '#f' AS handler_id FROM part""")
def extract_step_defs(t):
    """Sources with one registration per language form, each after as many lines as its part's size."""
    form = F.expr("""CASE p_partkey % 3 WHEN 0 THEN concat('\\tctx.Step(`^', p_name, '$`, do', p_partkey, ')')
        WHEN 1 THEN concat('  @Given("', p_name, ' {int}")') ELSE concat("When('", p_name, " {word}', (w) => {") END""")
    language = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'go' WHEN 1 THEN 'java' ELSE 'typescript' END")
    path = F.concat(F.lit("src/"), F.col("p_partkey").cast("string"))
    sources = t.part.select(F.expr("CAST(0 AS INT)").alias("repo_id"), path.alias("path"), language.alias("language"),
                            F.concat(F.repeat(F.lit("x\n"), F.col("p_size")), form, F.lit("\ny\n")).alias("text"))
    symbols = t.part.select(F.expr("CAST(0 AS INT)").alias("repo_id"), path.alias("path"), language.alias("language"), F.lit("func").alias("kind"),
                            F.concat(F.lit("do"), F.col("p_partkey").cast("string")).alias("name"), F.concat(path, F.lit("#f")).alias("id"),
                            F.lit(1).alias("start_line"), F.lit(60).alias("end_line"), F.lit(0).alias("ord"))
    return O.extract_step_defs(sources, symbols)

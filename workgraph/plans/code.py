"""Symbol, call-graph and flow queries over parts, suppliers and order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from workgraph.functions import ids as X
from workgraph.operators import closure
from workgraph.operators import code as O
from workgraph.operators import flow as W
from workgraph.plans.registry import query
from workgraph.session import cut

V, R = "review_id", "repo_id"
ZERO = "CAST(0 AS INT)"


_TOUCH = """ch AS (SELECT DISTINCT h.review_id, h.repo_id, s.id, s.kind, s.pk FROM hunks h JOIN symbols s ON s.repo_id = h.repo_id AND s.path = h.path
    AND s.start_line <= h.new_start + greatest(h.new_lines - 1, 0) AND h.new_start <= s.end_line)"""


@query("changed_symbols", "WITH " + _TOUCH + " SELECT review_id, repo_id, id FROM ch")
def changed_symbols(t):
    return O.changed_symbols(t.symbols, t.hunks)


@query("changed_functions", "WITH " + _TOUCH + " SELECT review_id, repo_id, id FROM ch WHERE kind IN ('func', 'method')")
def changed_functions(t):
    return O.changed_functions(t.symbols, t.hunks)


@query("navigable", "SELECT repo_id, id, kind FROM symbols WHERE kind IN ('func', 'method')")
def navigable(t):
    return O.navigable(t.symbols).select(R, "id", "kind")


@query("decl_lines", "SELECT repo_id, path, start_line AS line FROM symbols WHERE kind IN ('func', 'method')")
def decl_lines(t):
    return O.decl_lines(t.symbols)


# Two revisions: the old one lacks one brand, the new one lacks one type; a signature is the brand, then the type.
def _revisions(t):
    extra = t.part.select(F.col("p_partkey").alias("pk"), "p_brand", "p_type")
    rows = t.symbols.join(extra, "pk")
    old = rows.filter("p_brand <> 'Brand#3'").withColumn("signature", F.col("p_brand"))
    new = rows.filter("p_type <> 'PROMO'").withColumn(
        "signature", F.when(F.col("p_type") == "ECONOMY", F.col("p_brand")).otherwise(F.col("p_type")))
    hunks = t.hunks.withColumn("old_start", F.col("new_start") + 3).withColumn("old_lines", F.col("new_lines"))
    paths = hunks.select(V, R, F.col("path").alias("old_path")).distinct().withColumn("status", F.lit("modified"))
    return old, new, hunks, paths


_DETAIL = """rev AS (SELECT s.*, p.p_brand, p.p_type, CASE WHEN p_type = 'ECONOMY' THEN p_brand ELSE p_type END AS new_sig FROM symbols s JOIN part p ON p.p_partkey = s.pk),
od AS (SELECT DISTINCT h.review_id, h.repo_id, s.id, s.kind, s.p_brand, s.p_type, s.new_sig FROM hunks h JOIN rev s ON s.repo_id = h.repo_id AND s.path = h.path AND s.p_brand <> 'Brand#3'
    AND s.start_line <= h.new_start + 3 + greatest(h.new_lines - 1, 0) AND h.new_start + 3 <= s.end_line),
nw AS (SELECT DISTINCT h.review_id, h.repo_id, s.id, s.kind FROM hunks h JOIN rev s ON s.repo_id = h.repo_id AND s.path = h.path AND s.p_type <> 'PROMO'
    AND s.start_line <= h.new_start + greatest(h.new_lines - 1, 0) AND h.new_start <= s.end_line),
det AS (SELECT review_id, repo_id, id, kind, CASE WHEN p_type <> 'PROMO' THEN 'modified' ELSE 'deleted' END AS change,
    p_type <> 'PROMO' AND new_sig <> p_brand AS signature_changed FROM od
  UNION ALL SELECT review_id, repo_id, id, kind, 'added', false FROM nw WHERE NOT EXISTS (SELECT 1 FROM od WHERE od.review_id = nw.review_id AND od.repo_id = nw.repo_id AND od.id = nw.id))"""


def _changes(t):
    old, new, hunks, paths = _revisions(t)
    return O.changed_symbols_detailed(old, new, hunks, paths)


@query("changed_symbols_detailed", "WITH " + _DETAIL + " SELECT review_id, repo_id, id, change, signature_changed FROM det")
def changed_symbols_detailed(t):
    return _changes(t)


@query("enclosing_symbol", """WITH pt AS (SELECT DISTINCT review_id, repo_id, path, new_start AS line FROM hunks),
m AS (SELECT pt.*, s.id, row_number() OVER (PARTITION BY pt.review_id, pt.repo_id, pt.path, pt.line ORDER BY s.end_line - s.start_line, s.pk) AS rn
    FROM pt JOIN symbols s ON s.repo_id = pt.repo_id AND s.path = pt.path AND pt.line BETWEEN s.start_line AND s.end_line WHERE s.kind IN ('func', 'method'))
SELECT review_id, repo_id, path, line, id AS enclosing FROM m WHERE rn = 1""")
def enclosing_symbol(t):
    points = t.hunks.select(V, R, "path", F.col("new_start").alias("line")).distinct()
    return O.enclosing_symbol(points, O.navigable(t.symbols).withColumn("ord", F.col("pk")))


@query("attach_receiver", """WITH m AS (SELECT s.repo_id, s.id, c.name, row_number() OVER (PARTITION BY s.pk ORDER BY c.end_line - c.start_line, c.pk) AS rn
    FROM symbols s LEFT JOIN symbols c ON c.repo_id = s.repo_id AND c.path = s.path AND c.kind IN ('type', 'interface') AND c.start_line * 30 <= s.start_line * 30 AND s.end_line * 30 <= c.end_line * 30
    WHERE s.kind = 'method') SELECT repo_id, id, name AS receiver FROM m WHERE rn = 1""")
def attach_receiver(t):
    spans = t.symbols.withColumn("start_byte", F.col("start_line") * 30).withColumn("end_byte", F.col("end_line") * 30)
    containers = spans.filter("kind IN ('type', 'interface')").withColumn("ord", F.col("pk"))
    return O.attach_receiver(spans.filter("kind = 'method'").select(R, "path", "id", "start_byte", "end_byte"), containers) \
        .select(R, "id", "receiver")


@query("dedup_edges", """SELECT DISTINCT 'calls' AS kind, l_suppkey AS from_id, l_partkey % 20 AS to_id,
    CASE WHEN l_returnflag <> 'N' THEN 'f' || l_linenumber END AS site_path, CASE WHEN l_returnflag <> 'N' THEN l_linenumber END AS site_line FROM lineitem""")
def dedup_edges(t):
    sited = F.col("l_returnflag") != "N"
    return O.dedup_edges(t.lineitem.select(
        F.lit("calls").alias("kind"), F.col("l_suppkey").alias("from_id"), (F.col("l_partkey") % 20).alias("to_id"),
        F.when(sited, F.concat(F.lit("f"), F.col("l_linenumber").cast("string"))).alias("site_path"),
        F.when(sited, F.col("l_linenumber")).alias("site_line")))


def _wanted(t):
    return t.symbols.filter("kind = 'func'").select(R, "id")


@query("callers", "SELECT e.repo_id, e.from_id, e.to_id, e.site_path, e.site_line FROM call_edges e JOIN symbols s ON s.repo_id = e.repo_id AND s.id = e.to_id WHERE s.kind = 'func'")
def callers(t):
    return O.callers(t.call_edges, _wanted(t)).select(R, "from_id", "to_id", "site_path", "site_line")


@query("callees", "SELECT e.repo_id, e.from_id, e.to_id, e.site_path, e.site_line FROM call_edges e JOIN symbols s ON s.repo_id = e.repo_id AND s.id = e.from_id WHERE s.kind = 'func'")
def callees(t):
    return O.callees(t.call_edges, _wanted(t)).select(R, "from_id", "to_id", "site_path", "site_line")


@query("name_search_edges", """WITH lang AS (SELECT *, CASE WHEN pk % 3 = 0 THEN 'go' WHEN pk % 3 = 1 THEN 'typescript' ELSE 'tsx' END AS language FROM symbols),
cl AS (SELECT repo_id, path, start_line + 1 AS line, pk, name, CASE WHEN language = 'go' THEN 'go' ELSE 'typescript' END AS family FROM lang),
en AS (SELECT cl.*, s.id AS enclosing, row_number() OVER (PARTITION BY cl.pk ORDER BY s.end_line - s.start_line, s.pk) AS rn FROM cl
    JOIN symbols s ON s.repo_id = cl.repo_id AND s.path = cl.path AND cl.line BETWEEN s.start_line AND s.end_line AND s.kind IN ('func', 'method'))
SELECT e.repo_id, e.enclosing AS from_id, d.id AS to_id, e.path AS site_path, e.line AS site_line, e.pk AS site_col FROM en e
  JOIN lang d ON d.repo_id = e.repo_id AND d.name = e.name AND d.kind IN ('func', 'method') AND CASE WHEN d.language = 'go' THEN 'go' ELSE 'typescript' END = e.family WHERE e.rn = 1""")
def name_search_edges(t):
    language = F.expr("CASE pk % 3 WHEN 0 THEN 'go' WHEN 1 THEN 'typescript' ELSE 'tsx' END")
    defs = t.symbols.withColumn("language", language).withColumn("ord", F.col("pk"))
    calls = defs.select(R, "language", "path", (F.col("start_line") + 1).alias("line"), F.col("pk").alias("col"), "name")
    return O.name_search_edges(calls, defs).select(R, "from_id", "to_id", "site_path", "site_line", "site_col")


_IMPL = """imp AS (SELECT i.repo_id, i.iface_id, m.type_id FROM interfaces i JOIN methods m ON m.repo_id = i.repo_id AND m.method = i.method
    GROUP BY 1, 2, 3 HAVING count(*) = (SELECT count(*) FROM interfaces j WHERE j.repo_id = i.repo_id AND j.iface_id = i.iface_id))"""


@query("implements", "WITH " + _IMPL + " SELECT * FROM imp")
def implements(t):
    return O.implements(t.interfaces, t.methods)


@query("implements_methods", "WITH " + _IMPL + " SELECT imp.repo_id, imp.iface_id, imp.type_id, i.method FROM imp JOIN interfaces i USING (repo_id, iface_id)")
def implements_methods(t):
    return O.implements_methods(t.interfaces, t.methods)


# Nations are declared in every repository; a third of the declarations have no method.
@query("open_interfaces", """SELECT r AS repo_id, n_nationkey AS iface_id, n_nationkey % 3 = 0 AS fits_every_type FROM nation CROSS JOIN range(3) x(r)""")
def open_interfaces(t):
    declared = t.interfaces.select(R, "iface_id").distinct()
    return O.open_interfaces(declared, t.interfaces.filter("iface_id % 3 <> 0"))


_HIT = """{0}h AS (SELECT DISTINCT x.review_id, x.repo_id, x.path, x.{1}, x.{2} FROM {0} x JOIN hunks h ON h.review_id = x.review_id AND h.repo_id = x.repo_id AND h.path = x.path
    WHERE h.new_start <= x.{2} AND x.{1} <= h.new_start + greatest(h.new_lines - 1, 0))"""
_INDIFF = """EXISTS (SELECT 1 FROM {0}h h WHERE h.review_id = {0}.review_id AND h.repo_id = {0}.repo_id AND h.path = {0}.path AND h.{1} = {0}.{1} AND h.{2} = {0}.{2})"""


def _review_functions(t):
    """Each supplier's review asks about the functions among the symbols it ships."""
    return t.review_symbols.join(_wanted(t), [R, "id"], "left_semi").select(V, R, "id")


_ASKED = "w AS (SELECT r.review_id, r.repo_id, r.id FROM review_symbols r JOIN symbols s ON s.repo_id = r.repo_id AND s.id = r.id WHERE s.kind = 'func')"


@query("symbol_targets", "WITH " + _ASKED + """,
tg AS (SELECT w.review_id, w.repo_id, w.id, e.from_id AS other, CASE WHEN f.pk % 2 = 0 THEN 'Store.' ELSE '' END || f.name AS name, e.site_path AS path, CAST(e.site_line AS BIGINT) AS line
  FROM w JOIN call_edges e ON e.repo_id = w.repo_id AND e.to_id = w.id JOIN symbols f ON f.repo_id = e.repo_id AND f.id = e.from_id),
""" + _HIT.format("tg", "line", "line").replace("x.line, x.line FROM", "x.line FROM") + " SELECT *, " + _INDIFF.format("tg", "line", "line") + " AS in_diff FROM tg")
def symbol_targets(t):
    symbols = t.symbols.withColumn("receiver", F.when(F.col("pk") % 2 == 0, "*Store").otherwise(""))
    return O.symbol_targets(t.call_edges, _review_functions(t), symbols, t.hunks, prefer_site=True).drop("kind", "confidence")


_RADIUS = _DETAIL + """,
me AS (SELECT * FROM det WHERE change <> 'deleted' AND kind IN ('func', 'method')),
mt AS (SELECT me.review_id, me.repo_id, me.id AS symbol, e.from_id AS other, e.site_path AS path, CAST(e.site_line AS BIGINT) AS line, me.signature_changed
    FROM me JOIN call_edges e ON e.repo_id = me.repo_id AND e.to_id = me.id),
im AS (SELECT me.review_id, me.repo_id, me.id AS symbol, s.id AS other, s.path, s.start_line AS line, s.end_line FROM me JOIN rev s ON s.repo_id = me.repo_id
      AND (s.id = 's' || (CAST(substr(me.id, 2) AS BIGINT) + 4) OR s.id = 's' || (CAST(substr(me.id, 2) AS BIGINT) - 4)) WHERE me.signature_changed),
""" + _HIT.format("mt", "line", "line").replace("x.line, x.line FROM", "x.line FROM") + ", " + _HIT.format("im", "line", "end_line") + """,
fl AS (SELECT DISTINCT review_id, repo_id, path, true AS there FROM hunks), lv AS (SELECT DISTINCT review_id, repo_id, id FROM det WHERE change <> 'deleted'),
rad AS (SELECT mt.review_id, mt.repo_id, symbol, 'caller' AS part, other, mt.path, line, coalesce(there, false) AS in_diff FROM mt
    LEFT JOIN fl ON fl.review_id = mt.review_id AND fl.repo_id = mt.repo_id AND fl.path = mt.path
    ANTI JOIN lv ON lv.review_id = mt.review_id AND lv.repo_id = mt.repo_id AND lv.id = mt.other
UNION ALL SELECT review_id, repo_id, symbol, 'site', other, path, line, """ + _INDIFF.format("mt", "line", "line") + """ FROM mt WHERE signature_changed
UNION ALL SELECT review_id, repo_id, symbol, 'impl', other, path, line, """ + _INDIFF.format("im", "line", "end_line") + " FROM im)"


def _radius(t):
    changes = cut(_changes(t).join(t.symbols.select(R, "id", "kind"), [R, "id"]))
    next_id = F.concat(F.lit("s"), (F.substring("id", 2, 9).cast("long") + 4).cast("string"))
    related = t.symbols.select(R, F.col("id").alias("from_id"), next_id.alias("to_id")) \
        .join(t.symbols.select(R, F.col("id").alias("to_id")), [R, "to_id"], "left_semi")
    return changes, O.func_radius(changes, t.call_edges, related, t.symbols, t.hunks)


@query("func_radius", "WITH " + _RADIUS + " SELECT * FROM rad")
def func_radius(t):
    return _radius(t)[1]


# An interface is satisfied by the long methods of its name.
@query("interface_radius", "WITH " + _TOUCH + """,
tg AS (SELECT DISTINCT ch.review_id, ch.repo_id, s.id AS iface_id, s.id || '.' || s.name AS symbol, s.name, s.exported AS was_old FROM ch JOIN symbols s ON s.repo_id = ch.repo_id AND s.id = ch.id
    WHERE s.kind = 'interface'),
vd AS (SELECT i.repo_id, i.id AS iface_id, m.name, m.id AS impl_id FROM symbols i JOIN symbols m ON m.repo_id = i.repo_id AND m.name = i.name AND m.kind = 'method' AND m.end_line - m.start_line > 25
    WHERE i.kind = 'interface'),
im0 AS (SELECT tg.review_id, tg.repo_id, tg.symbol, vd.impl_id AS other, 'static' AS confidence FROM tg JOIN vd USING (repo_id, iface_id, name)
    UNION ALL SELECT tg.review_id, tg.repo_id, tg.symbol, m.id, 'heuristic' FROM tg JOIN symbols m ON m.repo_id = tg.repo_id AND m.name = tg.name AND m.kind = 'method'
      WHERE tg.was_old AND NOT EXISTS (SELECT 1 FROM vd WHERE vd.repo_id = tg.repo_id AND vd.iface_id = tg.iface_id AND vd.impl_id = m.id)),
im1 AS (SELECT im0.*, s.path, s.start_line AS line, s.end_line FROM im0 JOIN symbols s ON s.repo_id = im0.repo_id AND s.id = im0.other),
""" + _HIT.format("im1", "line", "end_line") + """,
im AS (SELECT *, """ + _INDIFF.format("im1", "line", "end_line") + """ AS in_diff FROM im1),
st AS (SELECT DISTINCT im.review_id, im.repo_id, im.symbol, e.from_id AS other, e.confidence, e.site_path AS path, CAST(e.site_line AS BIGINT) AS line
    FROM im JOIN call_edges e ON e.repo_id = im.repo_id AND e.to_id = im.other),
""" + _HIT.format("st", "line", "line").replace("x.line, x.line FROM", "x.line FROM") + """
SELECT review_id, repo_id, symbol, 'impl' AS part, other, confidence, path, line, in_diff FROM im
UNION ALL SELECT review_id, repo_id, symbol, 'warning', other, confidence, path, line, in_diff FROM im WHERE NOT in_diff
UNION ALL SELECT review_id, repo_id, symbol, 'site', other, confidence, path, line, """ + _INDIFF.format("st", "line", "line") + " FROM st")
def interface_radius(t):
    ifaces = t.symbols.filter("kind = 'interface'")
    target = O.changed_symbols(ifaces, t.hunks).join(ifaces.select(R, "id", "name", "exported"), [R, "id"]).select(
        V, R, F.col("id").alias("iface_id"), F.concat("id", F.lit("."), "name").alias("method"), "name", F.col("exported").alias("was_old"))
    methods = t.symbols.filter("kind = 'method'")
    valid = ifaces.select(R, F.col("id").alias("iface_id"), "name").join(
        methods.filter(F.col("end_line") - F.col("start_line") > 25).select(R, "name", F.col("id").alias("impl_id")), [R, "name"])
    return O.interface_radius(target, valid, methods, t.call_edges, t.hunks)


# Tests are the functions; edges are the tree and the permutation with its loops. No shortest path is near 40 hops here.
_GRAPH = """ge AS (SELECT DISTINCT repo_id, from_id AS a, to_id AS b FROM call_edges UNION SELECT repo_id, from_id, to_id FROM loop_edges),
ts AS (SELECT repo_id, id, name, path FROM symbols WHERE kind = 'func'),
wk AS (SELECT ts.repo_id, id AS test, b AS id, 1 AS depth FROM ts JOIN ge ON ge.repo_id = ts.repo_id AND ge.a = ts.id WHERE b <> ts.id
    UNION SELECT w.repo_id, w.test, g.b, w.depth + 1 FROM wk w JOIN ge g ON g.repo_id = w.repo_id AND g.a = w.id WHERE w.depth < 40 AND g.b <> w.test),
hit AS (SELECT repo_id, test, id, min(depth) AS depth FROM wk GROUP BY 1, 2, 3)"""


def _graph(t):
    return t.call_edges.select(R, "from_id", "to_id").unionByName(t.loop_edges).distinct()


def _tests(t):
    return t.symbols.filter("kind = 'func'")


@query("reach_from_tests", "WITH " + _GRAPH + " SELECT repo_id, test, id, depth FROM hit")
def reach_from_tests(t):
    return O.reach_from_tests(_graph(t), _tests(t), paths=False)


@query("reach_paths", """WITH tp AS (SELECT symbols.repo_id, symbols.id AS test, to_id AS id, 1 AS depth, symbols.id || '>' || to_id AS path FROM symbols
      JOIN call_edges ON call_edges.repo_id = symbols.repo_id AND from_id = symbols.id WHERE symbols.kind = 'func' AND symbols.id <> to_id
    UNION ALL SELECT tp.repo_id, tp.test, e.to_id, tp.depth + 1, tp.path || '>' || e.to_id FROM tp JOIN call_edges e ON e.repo_id = tp.repo_id AND e.from_id = tp.id)
SELECT repo_id, test, id, depth, path FROM tp""")
def reach_paths(t):
    return O.reach_from_tests(t.call_edges, _wanted(t)).select(
        R, "test", "id", "depth", F.array_join("path", ">").alias("path"))


_TOP = _GRAPH + ", " + _ASKED + """,
tp AS (SELECT * FROM (SELECT w.review_id, w.repo_id, w.id, h.test, h.depth, row_number() OVER (PARTITION BY w.review_id, w.repo_id, w.id ORDER BY h.depth, h.test) AS place
    FROM w JOIN hit h ON h.repo_id = w.repo_id AND h.id = w.id) x WHERE place <= 5)"""
# Every reaching test, by directory; in the even repositories the directories lie in a module of their own.
_RUNS = """u AS (SELECT DISTINCT w.review_id, w.repo_id, 'mod' || (ts.repo_id % 2) || '/' || ts.path AS dir, ts.path AS rel, ts.name FROM w JOIN hit h ON h.repo_id = w.repo_id AND h.id = w.id
    JOIN ts ON ts.repo_id = h.repo_id AND ts.id = h.test),
cm AS (SELECT review_id, repo_id, dir, string_agg(name, ',' ORDER BY name) AS tests, CASE WHEN repo_id % 2 = 0 THEN 'cd mod0 && go test ./' || rel ELSE 'go test ./' || dir END
    || ' -run ''^(' || string_agg(name, '|' ORDER BY name) || ')$''' AS command FROM u GROUP BY 1, 2, 3, rel)"""


@query("top_reaching_tests", "WITH " + _TOP + " SELECT * FROM tp")
def top_reaching_tests(t):
    asked = _review_functions(t)
    return O.top_reaching_tests(O.nearest_tests(_graph(t), _tests(t), asked), asked).drop("path")


@query("test_reach", "WITH " + _TOP + """ SELECT w.review_id, w.repo_id, w.id, count(tp.test) > 0 AS reached, coalesce(string_agg(tp.test, ',' ORDER BY tp.place), '') AS tests
    FROM w LEFT JOIN tp ON tp.review_id = w.review_id AND tp.repo_id = w.repo_id AND tp.id = w.id GROUP BY 1, 2, 3""")
def test_reach(t):
    asked = _review_functions(t)
    out = O.test_reach(asked, O.nearest_tests(_graph(t), _tests(t), asked))
    return out.select(V, R, "id", "reached", F.coalesce(F.array_join("tests", ","), F.lit("")).alias("tests"))


def _commands(t, asked):
    tests = _tests(t).withColumn("path", F.concat(F.lit("mod"), (F.col(R) % 2).cast("string"), F.lit("/"), "path", F.lit("/x_test.go")))
    modules = tests.select(R, F.lit("mod0").alias("module_dir")).distinct()
    return O.test_commands(O.reaching_tests(asked, _graph(t), tests, named=True), tests, modules)


@query("test_commands", "WITH " + _TOP + ", " + _RUNS + " SELECT * FROM cm")
def test_commands(t):
    return _commands(t, _review_functions(t))


@query("import_scope", """WITH sc AS (SELECT c.review_id, 'p' || substr(split_part(c.path, '/', 2), 2) AS node FROM changed_paths c
    UNION SELECT sc.review_id, i.pkg FROM sc JOIN imports i ON i.imported = sc.node)
SELECT review_id, node FROM sc""")
def import_scope(t):
    packages = t.supplier.select(F.expr(ZERO).alias("repo_id"), F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("pkg"),
                                 F.concat(F.lit("src/d"), F.col("s_suppkey").cast("string")).alias("dir"))
    return O.import_scope(packages, t.imports, t.changed_paths).select(V, "node")


def _entry_symbols(t):
    """Symbols with file names, packages and signature shapes derived from the part columns."""
    part = t.part.select(F.col("p_partkey").alias("pk"), "p_brand", "p_type", "p_size")
    name = F.expr("CASE p_brand WHEN 'Brand#1' THEN concat('Test', pk) WHEN 'Brand#2' THEN 'main' WHEN 'Brand#3' THEN 'init' ELSE name END")
    return t.symbols.join(part, "pk").withColumn("name", name) \
        .withColumn("path", F.concat("path", F.when(F.col("p_size") < 25, "_test.go").otherwise(".go"))) \
        .withColumn("receiver", F.when(F.col("kind") == "method", "T").otherwise("")) \
        .withColumn("package_name", F.when(F.col("p_size") % 2 == 0, "main").otherwise("lib")) \
        .withColumn("shape", F.when(F.col("p_type") == "ECONOMY", "func(http.ResponseWriter, *http.Request)").otherwise("func(int)"))


_ENTRY = """es AS (SELECT s.repo_id, s.id, s.kind, s.exported, p_type, p_size, CASE p_brand WHEN 'Brand#1' THEN 'Test' || s.pk WHEN 'Brand#2' THEN 'main' WHEN 'Brand#3' THEN 'init' ELSE s.name END AS name
    FROM symbols s JOIN part ON p_partkey = s.pk WHERE s.kind IN ('func', 'method')),
en0 AS (SELECT repo_id, id, 'test' AS kind, 'test function (Test*)' AS reason FROM es WHERE kind = 'func' AND p_size < 25 AND starts_with(name, 'Test')
  UNION ALL SELECT repo_id, id, 'main', 'package main''s main function' FROM es WHERE kind = 'func' AND name = 'main' AND p_size % 2 = 0
  UNION ALL SELECT repo_id, id, 'init', 'init function, run automatically before main' FROM es WHERE kind = 'func' AND name = 'init'
  UNION ALL SELECT repo_id, id, 'http-handler', 'HTTP handler: signature func(http.ResponseWriter, *http.Request)' FROM es WHERE p_type = 'ECONOMY'
  UNION ALL SELECT repo_id, id, 'custom', 'rings' FROM es WHERE regexp_matches(name, 'ring$') AND p_type <> 'ECONOMY'),
ent AS (SELECT * FROM en0 UNION ALL SELECT repo_id, id, 'unreferenced', 'exported, no in-module callers' FROM es WHERE exported
    AND NOT EXISTS (SELECT 1 FROM en0 WHERE en0.repo_id = es.repo_id AND en0.id = es.id) AND NOT EXISTS (SELECT 1 FROM call_edges e WHERE e.repo_id = es.repo_id AND e.to_id = es.id))"""


def _entries(t):
    return O.entry_points(_entry_symbols(t), t.call_edges, [("ring$", "func(int)", "rings")])


@query("entry_points", "WITH " + _ENTRY + " SELECT repo_id, id, kind, reason FROM ent")
def entry_points(t):
    return _entries(t).select(R, "id", "kind", "reason")


@query("entry_point_index", "WITH " + _ENTRY + """ SELECT repo_id, id, kind, reason FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, id ORDER BY CASE kind WHEN 'main' THEN 0 WHEN 'init' THEN 1
    WHEN 'http-handler' THEN 2 WHEN 'test' THEN 5 WHEN 'custom' THEN 6 ELSE 7 END, reason) AS rn FROM ent) x WHERE rn = 1""")
def entry_point_index(t):
    return O.entry_point_index(_entries(t)).select(R, "id", "kind", "reason")


@query("connected_components", """WITH bo AS (SELECT repo_id, from_id AS a, to_id AS b FROM call_edges UNION SELECT repo_id, to_id, from_id FROM call_edges),
cc AS (SELECT repo_id, id AS a, id AS b FROM symbols UNION SELECT cc.repo_id, cc.a, bo.b FROM cc JOIN bo ON bo.repo_id = cc.repo_id AND bo.a = cc.b)
SELECT repo_id, a AS node, min(b) AS component FROM cc GROUP BY 1, 2""")
def connected_components(t):
    return closure.connected_components(t.symbols.select(R, F.col("id").alias("node")), t.call_edges, tenant=R, src="from_id", dst="to_id")


@query("topo_order", """WITH ly AS (SELECT repo_id, id, 0 AS layer FROM symbols
    UNION SELECT e.repo_id, e.to_id, ly.layer + 1 FROM ly JOIN call_edges e ON e.repo_id = ly.repo_id AND e.from_id = ly.id)
SELECT repo_id, id AS node, max(layer) AS layer FROM ly GROUP BY 1, 2""")
def topo_order(t):
    nodes = t.symbols.select(R, F.lit("all").alias("component"), F.col("id").alias("node"))
    return closure.topo_layers(nodes, t.call_edges, tenant=R, src="from_id", dst="to_id").select(R, "node", "layer")


# A review is an order; it changes the symbols of its lines. Exported functions are entry points.
def _flow_inputs(t):
    symbols = t.symbols.withColumn("receiver", F.when(F.col("kind") == "method", "*T").otherwise(""))
    info = symbols.select(R, "id", "name", "receiver", "path", F.when((F.col("kind") == "func") & F.col("exported"), "main").alias("entry_kind"))
    return t.order_symbols, t.call_edges.select(R, "from_id", "to_id"), info


_WALK = """ey AS (SELECT repo_id, id FROM symbols WHERE kind = 'func' AND exported),
wk AS (SELECT review_id, repo_id, id AS node, 0 AS depth FROM order_symbols UNION SELECT w.review_id, w.repo_id, e.from_id, w.depth + 1 FROM wk w
    JOIN call_edges e ON e.repo_id = w.repo_id AND e.to_id = w.node WHERE w.repo_id || '/' || w.node NOT IN (SELECT repo_id || '/' || id FROM ey)),
nd AS (SELECT review_id, repo_id, node, min(depth) AS depth, repo_id || '/' || node IN (SELECT repo_id || '/' || id FROM ey) AS is_entry FROM wk GROUP BY 1, 2, 3)"""


@query("flow_subgraph", "WITH " + _WALK + """ SELECT n.review_id, n.repo_id, n.node, n.depth, n.is_entry, o.id IS NOT NULL AS changed, false AS cut_off FROM nd n
    LEFT JOIN order_symbols o ON o.review_id = n.review_id AND o.repo_id = n.repo_id AND o.id = n.node""")
def flow_subgraph(t):
    changed, calls, info = _flow_inputs(t)
    nodes, _ = W.flow_subgraph(changed, calls, info.filter("entry_kind IS NOT NULL").select(R, "id"), paths=False)
    return nodes.select(V, R, "node", "depth", "is_entry", "changed", "cut_off")


@query("flow_edges", "WITH " + _WALK + """ SELECT DISTINCT n.review_id, n.repo_id, e.from_id AS caller, n.node AS callee FROM nd n
    JOIN call_edges e ON e.repo_id = n.repo_id AND e.to_id = n.node WHERE NOT n.is_entry""")
def flow_edges(t):
    changed, calls, info = _flow_inputs(t)
    return W.flow_subgraph(changed, calls, info.filter("entry_kind IS NOT NULL").select(R, "id"), paths=False)[1]


def _flow(t):
    changed, calls, info = _flow_inputs(t)
    files = changed.join(info.select(R, "id", "path"), [R, "id"]).groupBy(V, R, "path").agg(F.min("ord").alias("diff_no"))
    return W.flow_order(files, changed, calls, info)


@query("flow_order")
def flow_order(t):
    return _flow(t)


@query("unclassified", """WITH fl AS (SELECT DISTINCT l_orderkey AS review_id, l_orderkey % 2 AS repo_id, 'f' || (l_partkey % 20) AS path FROM lineitem),
dp AS (SELECT l_orderkey AS review_id, 'f' || (l_partkey % 20) AS path, min(l_linenumber) AS d FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2),
hs AS (SELECT p_partkey % 2 AS repo_id, 'f' || (CAST(floor(p_partkey / 2) AS BIGINT) % 20) AS path, max(p_size) / 50.0 AS score FROM part WHERE p_type = 'PROMO' GROUP BY 1, 2)
SELECT f.review_id, f.repo_id, f.path, row_number() OVER (PARTITION BY f.review_id ORDER BY coalesce(dp.d, 1073741824), -coalesce(hs.score, 0), f.path) AS place
FROM fl f LEFT JOIN dp ON dp.review_id = f.review_id AND dp.path = f.path LEFT JOIN hs ON hs.repo_id = f.repo_id AND hs.path = f.path
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = f.review_id AND 'f' || (l.l_partkey % 20) = f.path AND l.l_returnflag = 'R')""")
def unclassified(t):
    path = F.concat(F.lit("f"), (F.col("l_partkey") % 20).cast("string")).alias("path")
    lines = t.lineitem.select(F.col("l_orderkey").alias(V), (F.col("l_orderkey") % 2).alias(R), path, "l_linenumber", "l_returnflag")
    files = lines.select(V, R, "path").distinct()
    nodes = lines.filter("l_returnflag = 'A'").select(V, R, F.col("path").alias("node"), F.col("l_linenumber").alias("depth"))
    info = files.select(R, F.col("path").alias("id"), "path").distinct()
    scored = F.concat(F.lit("f"), (F.floor(F.col("p_partkey") / 2) % 20).cast("string")).alias("path")
    scores = t.part.filter("p_type = 'PROMO'").groupBy((F.col("p_partkey") % 2).alias(R), scored).agg((F.max("p_size") / 50.0).alias("score"))
    return W.unclassified(files, lines.filter("l_returnflag = 'R'").select(V, R, "path"), nodes, info, scores).select(V, R, "path", "place")


def _order_files(t):
    return t.commit_files.select(F.col("sha").alias(V), "path", (-F.col("added")).alias("diff_no"))


for _how, _sql in {"alpha": "path", "dir": "substr(path, 1, 2), path", "diff": "-added, -added"}.items():
    def _ordered(t, how=_how):
        files = _order_files(t)
        out = W.order_files(files.withColumn("diff_no", F.col("diff_no") * 100 + F.regexp_extract("path", "f([0-9]+)", 1).cast("int"))
                            if how == "diff" else files, how)
        return out.select(V, "path", "place")
    query(f"order_{_how}", f"""SELECT sha AS review_id, path, row_number() OVER (PARTITION BY sha ORDER BY
        {_sql if _how != 'diff' else "-added * 100 + CAST(regexp_extract(path, 'f([0-9]+)', 1) AS INT)"}) AS place FROM commit_files""")(_ordered)


@query("symbol_names", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Store.' || p_name ELSE p_name END AS display,
    'a/b.go#' || CASE WHEN p_partkey % 2 = 0 THEN 'Store.' || p_name ELSE p_name END AS structural,
    CASE WHEN p_partkey % 2 = 0 THEN 'ex.com/m.(Store).' || p_name ELSE 'ex.com/m.' || p_name END AS symbol,
    CASE WHEN p_partkey % 2 = 0 THEN 'Store.' || p_name ELSE p_name END AS fallback,
    CASE WHEN p_partkey % 2 = 0 THEN 'Store.' || p_name ELSE p_name END AS fallback_structural FROM part""")
def symbol_names(t):
    receiver = F.when(F.col("p_partkey") % 2 == 0, "*Store").otherwise("")
    structural = X.structural_id(F.lit("a/b.go"), receiver, "p_name")
    symbol = X.symbol_id(F.lit("ex.com/m"), receiver, "p_name")
    return t.part.select("p_partkey", X.display_name(receiver, "p_name").alias("display"), structural.alias("structural"),
                         symbol.alias("symbol"), X.fallback_name(symbol).alias("fallback"),
                         X.fallback_name(structural).alias("fallback_structural"))


@query("hop_labels", """SELECT p_partkey, CASE WHEN p_size < 25 THEN CASE WHEN p_type = 'ECONOMY' THEN 'handler ' WHEN p_type = 'PROMO' THEN 'exported function ' ELSE 'entry point ' END || p_name
    ELSE CASE WHEN p_partkey % 2 = 0 THEN 'Store.' ELSE '' END || p_name || CASE WHEN p_partkey % 3 = 0 THEN ' (changed)' ELSE '' END END AS label FROM part""")
def hop_labels(t):
    kind = F.expr("CASE p_type WHEN 'ECONOMY' THEN 'http-handler' WHEN 'PROMO' THEN 'unreferenced' ELSE 'odd' END")
    receiver = F.when(F.col("p_partkey") % 2 == 0, "*Store").otherwise("")
    return t.part.select("p_partkey", X.hop_label(F.col("p_size") < 25, kind, receiver, "p_name", F.col("p_partkey") % 3 == 0).alias("label"))

"""Symbols and call graphs: what a patch touches, who calls it, which tests reach it.

``symbols`` is (repo_id, id, name, kind, path, start_line, end_line, ...),
``call_edges`` is (repo_id, kind, from_id, to_id, site_path, site_line,
confidence, ...), ``hunks`` is (review_id, repo_id, path, new_start, new_lines, ...).
Paths and ids repeat between repositories, so every join has ``repo_id`` among its keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workgraph.functions import ids as X
from workgraph.functions import paths as P
from workgraph.operators import closure
from workgraph.operators.intervals import new_range, old_range, overlaps, salted_join
from workgraph.operators.scan import first_per_key, ranked, top_per_key
from workgraph.session import cut

V, R = "review_id", "repo_id"
FILE = [R, "path"]
# Fixed value: closest tests shown per function.
TESTS_SHOWN = 5
# Signature shapes of request handlers and why they are entry points.
HANDLERS = {
    "func(http.ResponseWriter, *http.Request)": "HTTP handler: signature func(http.ResponseWriter, *http.Request)",
    "func(*gin.Context)": "gin handler: signature func(*gin.Context)",
    "func(echo.Context) error": "echo handler: signature func(echo.Context) error",
    "func(*fiber.Ctx) error": "fiber handler: signature func(*fiber.Ctx) error",
}
# Prefixes of test functions and the reason each gives.
TEST_PREFIXES = {"Test": "test function (Test*)", "Benchmark": "benchmark function (Benchmark*)",
                 "Example": "example function (Example*)", "Fuzz": "fuzz function (Fuzz*)"}

# Reasons of the other entry points.
MAIN_REASON, INIT_REASON = "package main's main function", "init function, run automatically before main"
IDLE_REASON = "exported, no in-module callers"


def navigable(symbols: DataFrame) -> DataFrame:
    return symbols.filter(F.col("kind").isin("func", "method"))


def decl_lines(symbols: DataFrame) -> DataFrame:
    """Start lines of function and method declarations per path, one row each."""
    return navigable(symbols).select("repo_id", "path", F.col("start_line").alias("line"))


def changed_symbols(symbols: DataFrame, hunks: DataFrame) -> DataFrame:
    """Symbols a new-side hunk overlaps: (review_id, repo_id, id), each once."""
    live = hunks.filter("status != 'deleted'") if "status" in hunks.columns else hunks
    ranges = live.select(V, *FILE, new_range()[0].alias("_hs"), new_range()[1].alias("_he")).distinct()
    spans = symbols.select(*FILE, "id", "start_line", "end_line")
    return overlaps(ranges, spans, FILE, ("_hs", "_he"), ("start_line", "end_line")).select(V, R, "id").distinct()


def changed_functions(symbols: DataFrame, hunks: DataFrame) -> DataFrame:
    return changed_symbols(navigable(symbols), hunks)


def changed_symbols_detailed(old_symbols: DataFrame, new_symbols: DataFrame, hunks: DataFrame,
                             old_paths: DataFrame) -> DataFrame:
    """Changes per review: (review_id, repo_id, id, change, signature_changed).

    ``old_paths`` is (review_id, repo_id, old_path, status) of files whose old
    side is read. A touched old declaration that still exists by id is modified,
    with its signature compared; one that does not is deleted; a touched new
    symbol with neither is added. A rename is therefore a delete and an add.
    """
    sides = old_paths.filter(F.col("status").isin("modified", "renamed", "deleted")).select(V, R, F.col("old_path").alias("path"))
    ranges = hunks.join(sides, [V, *FILE], "left_semi") \
        .select(V, *FILE, old_range()[0].alias("_hs"), old_range()[1].alias("_he")).distinct()
    touched = overlaps(ranges, old_symbols.select(*FILE, "id", "signature", "start_line", "end_line"), FILE,
                       ("_hs", "_he"), ("start_line", "end_line")).select(V, R, "id", F.col("signature").alias("_old")).distinct()
    now = new_symbols.select(R, "id", F.coalesce("signature", F.lit("")).alias("_new")).withColumn("_exists", F.lit(True))
    old_side = touched.join(now, [R, "id"], "left")
    resigned = (F.col("_new") != "") & (F.col("_new") != F.coalesce("_old", F.lit("")))
    judged = old_side.select(V, R, "id", F.when(F.col("_exists"), "modified").otherwise("deleted").alias("change"),
                             F.coalesce(resigned, F.lit(False)).alias("signature_changed"))
    added = changed_symbols(new_symbols, hunks).join(judged.select(V, R, "id"), [V, R, "id"], "left_anti") \
        .select(V, R, "id", F.lit("added").alias("change"), F.lit(False).alias("signature_changed"))
    return judged.unionByName(added)


def enclosing_symbol(points: DataFrame, symbols: DataFrame, keys: Sequence[str] = tuple(FILE), line: str = "line",
                     order: str = "ord") -> DataFrame:
    """The smallest symbol around each point, the first in ``order`` on ties: points plus ``enclosing``."""
    met = overlaps(points, symbols.select(*keys, F.col("id").alias("_id"), F.col(order).alias("_ord"), "start_line", "end_line"),
                   keys, (line, line), ("start_line", "end_line"))
    span = F.struct((F.col("end_line") - F.col("start_line")).alias("span"), F.col("_ord"), F.col("_id"))
    return met.groupBy(*points.columns).agg(F.min(span).alias("_b")) \
        .select(*points.columns, F.col("_b._id").alias("enclosing"))


def attach_receiver(methods: DataFrame, containers: DataFrame) -> DataFrame:
    """Methods with the smallest class or interface whose byte range holds them: adds ``receiver``.

    ``methods`` is (repo_id, path, id, start_byte, end_byte), ``containers`` (repo_id, path, name, start_byte, end_byte, ord).
    """
    boxes = containers.select(*FILE, F.col("name").alias("_name"), F.col("ord").alias("_ord"),
                              F.col("start_byte").alias("_cs"), F.col("end_byte").alias("_ce"))
    met = overlaps(methods, boxes, FILE, ("start_byte", "start_byte"), ("_cs", "_ce"), size=4096) \
        .filter("end_byte <= _ce")
    best = met.groupBy(*FILE, "id").agg(
        F.min(F.struct((F.col("_ce") - F.col("_cs")).alias("span"), "_ord", "_name")).alias("_b")) \
        .select(*FILE, "id", F.col("_b._name").alias("receiver"))
    return methods.join(best, [*FILE, "id"], "left")


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One row per (kind, from, to, site); a missing site is a value of its own."""
    keys = [c for c in ["repo_id", "kind", "from_id", "to_id", "site_path", "site_line", "site_col"] if c in edges.columns]
    return edges.dropDuplicates(keys)


def callers(call_edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Edges into wanted (repo_id, id) symbols."""
    return dedup_edges(call_edges.join(wanted.select("repo_id", F.col("id").alias("to_id")).distinct(), ["repo_id", "to_id"], "left_semi"))


def callees(call_edges: DataFrame, wanted: DataFrame) -> DataFrame:
    return dedup_edges(call_edges.join(wanted.select("repo_id", F.col("id").alias("from_id")).distinct(), ["repo_id", "from_id"], "left_semi"))


def language_family(language) -> Column:
    return F.when(X.col(language).isin("typescript", "tsx"), F.lit("typescript")).otherwise(X.col(language))


def name_search_edges(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """A heuristic call graph: every function or method a call site's name could mean.

    ``calls`` is (repo_id, language, path, line, col, name), ``definitions`` is
    symbols with language and ord. The caller is the innermost definition around the
    site; sites outside any are dropped. Names that hold very many sites are
    dealt over salts.
    """
    functions = navigable(definitions).withColumn("family", language_family("language")).filter("language != 'gherkin'")
    sites = calls.withColumn("family", language_family("language"))
    sites = enclosing_symbol(sites, functions, ["repo_id", "path"])
    targets = functions.select("repo_id", "family", "name", F.col("id").alias("to_id"))
    return salted_join(sites, targets, ["repo_id", "family", "name"]).select(
        "repo_id", F.lit("calls").alias("kind"), F.col("enclosing").alias("from_id"), "to_id",
        F.col("path").alias("site_path"), F.col("line").alias("site_line"), F.col("col").alias("site_col"),
        F.lit("heuristic").alias("confidence"), F.lit("name-search").alias("source"))


def implements(interfaces: DataFrame, methods: DataFrame) -> DataFrame:
    """(repo_id, iface_id, type_id) where a type has every method of an interface.

    ``interfaces`` is (repo_id, iface_id, method), ``methods`` is (repo_id,
    type_id, method); a method is its name and signature. Only types having an
    interface's rarest method are candidates, so a method every type has forms no
    pairs. An interface without methods fits every type: see :func:`open_interfaces`.
    """
    need, have = interfaces.distinct(), methods.distinct()
    rarity = have.groupBy(R, "method").agg(F.count(F.lit(1)).alias("_types"))
    sized = need.join(rarity, [R, "method"], "left").fillna(0, ["_types"])
    rarest = sized.groupBy(R, "iface_id").agg(F.min(F.struct("_types", "method")).alias("_m"), F.count(F.lit(1)).alias("_need"))
    candidates = rarest.select(R, "iface_id", "_need", F.col("_m.method").alias("method")).join(have, [R, "method"]).drop("method")
    proved = candidates.join(need, [R, "iface_id"]).join(have, [R, "type_id", "method"], "left_semi")
    return proved.groupBy(R, "iface_id", "type_id", "_need").count().filter("count = _need").select(R, "iface_id", "type_id")


def implements_methods(interfaces: DataFrame, methods: DataFrame) -> DataFrame:
    """Method-level edges of every implementing pair: (repo_id, iface_id, type_id, method)."""
    return implements(interfaces, methods).join(interfaces.distinct(), [R, "iface_id"])


def open_interfaces(declared: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Declared (repo_id, iface_id) with ``fits_every_type``: whether the interface has no method.

    Which types such an interface fits is said by this flag, not by pairs.
    """
    needs = interfaces.select(R, "iface_id").distinct().withColumn("_needs", F.lit(True))
    return declared.join(needs, [R, "iface_id"], "left").withColumn("fits_every_type", F.col("_needs").isNull()).drop("_needs")


def touched(points: DataFrame, hunks: DataFrame, start: str = "line", end: str = "line") -> DataFrame:
    """``points`` (review_id, repo_id, path, ...) plus ``in_diff``: whether a new-side hunk of the review covers any of the range."""
    asked = points.select(V, *FILE, F.col(start).alias("_ps"), F.col(end).alias("_pe")).distinct()
    ranges = hunks.select(V, *FILE, new_range()[0].alias("_hs"), new_range()[1].alias("_he")).distinct()
    hit = overlaps(asked, ranges, [V, *FILE], ("_ps", "_pe"), ("_hs", "_he")) \
        .select(V, *FILE, F.col("_ps").alias(start), *([F.col("_pe").alias(end)] if end != start else [])).distinct()
    return points.join(hit.withColumn("_hit", F.lit(True)), list(dict.fromkeys([V, *FILE, start, end])), "left") \
        .withColumn("in_diff", F.coalesce("_hit", F.lit(False))).drop("_hit")


def symbol_targets(edges: DataFrame, wanted: DataFrame, symbols: DataFrame, hunks: DataFrame, prefer_site: bool) -> DataFrame:
    """Far ends of edges of wanted (review_id, repo_id, id) symbols, resolved to a name and place.

    Callers show the call site, others the declaration; a place outside the
    repository (an absolute path) is dropped.
    """
    mine = "to_id" if prefer_site else "from_id"
    other = "from_id" if prefer_site else "to_id"
    met = edges.join(wanted.select(V, R, F.col("id").alias(mine)), [R, mine]) \
        .select(V, R, F.col(mine).alias("id"), F.col(other).alias("other"), "confidence", "site_path", "site_line")
    names = symbols.select(R, F.col("id").alias("other"), X.display_name("receiver", "name").alias("_name"), "kind",
                           F.col("path").alias("_path"), F.col("start_line").alias("_line"))
    rows = met.join(names, [R, "other"], "left")
    site_first = F.col("site_path").isNotNull() if prefer_site else F.col("_path").isNull()
    placed = rows.withColumn("name", F.coalesce("_name", X.fallback_name("other"))) \
        .withColumn("path", F.when(site_first, F.col("site_path")).otherwise(F.col("_path"))) \
        .withColumn("line", F.when(site_first, F.col("site_line")).otherwise(F.col("_line")).cast("long")) \
        .filter(~F.startswith(F.coalesce("path", F.lit("")), F.lit("/")))
    return touched(placed.select(V, R, "id", "other", "name", "kind", "confidence", "path", "line"), hunks)


def func_radius(changes: DataFrame, call_edges: DataFrame, impl_edges: DataFrame, symbols: DataFrame,
                hunks: DataFrame) -> DataFrame:
    """What a changed function affects: (review_id, repo_id, symbol, part, other, path, line, in_diff).

    Parts: ``caller`` (unchanged callers; in_diff by file), ``site`` (every
    call when the signature changed; in_diff by hunk), ``impl`` (related
    methods when the signature changed). ``changes`` has kind; ``impl_edges``
    is (repo_id, from_id, to_id).
    """
    live = changes.filter("change != 'deleted'")
    mine = live.filter(F.col("kind").isin("func", "method")).select(V, R, F.col("id").alias("symbol"), "signature_changed")
    calls = call_edges.select(R, F.col("to_id").alias("symbol"), F.col("from_id").alias("other"), F.col("site_path").alias("path"),
                              F.col("site_line").cast("long").alias("line"))
    met = cut(mine.join(calls, [R, "symbol"]))
    files = hunks.select(V, *FILE).distinct().withColumn("in_diff", F.lit(True))
    unchanged = met.join(live.select(V, R, F.col("id").alias("other")), [V, R, "other"], "left_anti") \
        .join(files, [V, *FILE], "left").fillna(False, ["in_diff"])
    sites = touched(met.filter("signature_changed"), hunks)
    related = impl_edges.select(R, F.col("from_id").alias("symbol"), F.col("to_id").alias("other")) \
        .unionByName(impl_edges.select(R, F.col("to_id").alias("symbol"), F.col("from_id").alias("other")))
    impls = mine.filter("signature_changed").join(related, [R, "symbol"]) \
        .join(symbols.select(R, F.col("id").alias("other"), "path", F.col("start_line").cast("long").alias("line"),
                             F.col("end_line").cast("long").alias("_end")), [R, "other"], "left")
    impls = touched(impls, hunks, "line", "_end")
    out = [V, R, "symbol", "part", "other", "path", "line", "in_diff"]
    return unchanged.withColumn("part", F.lit("caller")).select(*out) \
        .unionByName(sites.withColumn("part", F.lit("site")).select(*out)) \
        .unionByName(impls.withColumn("part", F.lit("impl")).select(*out))


def interface_radius(ifaces: DataFrame, valid: DataFrame, methods: DataFrame, call_edges: DataFrame, hunks: DataFrame) -> DataFrame:
    """What a re-signed interface affects, per method: (review_id, repo_id, symbol, part, other, confidence, path, line, in_diff).

    ``ifaces`` is (review_id, repo_id, iface_id, method, name, was_old): methods
    of changed interfaces; ``valid`` is (repo_id, iface_id, name, impl_id):
    methods that satisfy one; ``methods`` is symbols of methods. Valid
    implementers are static; for a method that existed before, same-named methods
    that no longer satisfy it are heuristic. Implementers outside the diff give a ``warning``.
    """
    target = ifaces.select(V, R, "iface_id", F.col("method").alias("symbol"), "name", "was_old").distinct()
    static = target.join(valid, [R, "iface_id", "name"]).select(V, R, "symbol", F.col("impl_id").alias("other"), F.lit("static").alias("confidence"))
    named = methods.filter("kind = 'method'").select(R, "name", F.col("id").alias("other"))
    former = salted_join(target.filter("was_old"), named, [R, "name"]).select(V, R, "symbol", "other") \
        .join(static.select(V, R, "symbol", "other"), [V, R, "symbol", "other"], "left_anti") \
        .withColumn("confidence", F.lit("heuristic"))
    place = methods.select(R, F.col("id").alias("other"), "path", F.col("start_line").cast("long").alias("line"),
                           F.col("end_line").cast("long").alias("_end"))
    impls = cut(touched(static.unionByName(former).distinct().join(place, [R, "other"], "left"), hunks, "line", "_end").drop("_end"))
    calls = call_edges.select(R, F.col("to_id").alias("_impl"), F.col("from_id").alias("other"), F.col("site_path").alias("path"),
                              F.col("site_line").cast("long").alias("line"), "confidence")
    sites = impls.select(V, R, "symbol", F.col("other").alias("_impl")).join(calls, [R, "_impl"]).drop("_impl") \
        .dropDuplicates([V, R, "symbol", "other", "path", "line"])
    out = [V, R, "symbol", "part", "other", "confidence", "path", "line", "in_diff"]
    warned = impls.filter("NOT in_diff").withColumn("part", F.lit("warning"))
    return impls.withColumn("part", F.lit("impl")).select(*out).unionByName(warned.select(*out)) \
        .unionByName(touched(sites, hunks).withColumn("part", F.lit("site")).select(*out))


def reach_from_tests(call_edges: DataFrame, tests: DataFrame, max_depth: int | None = None, paths: bool = True) -> DataFrame:
    """Shortest call path from each test (repo_id, id): (repo_id, test, id, depth, path); callees in id order.

    ``paths`` False leaves the path out; without ``max_depth`` the tests then walk packed, and rows of a test and a symbol are formed at the end.
    """
    starts = tests.select("repo_id", F.col("id").alias("start"))
    if not paths:
        found = closure.reach(call_edges, starts, tenant=R, src="from_id", dst="to_id", max_depth=max_depth) if max_depth is not None else \
            closure.unpacked(closure.packed_reach(call_edges, starts, tenant=R, src="from_id", dst="to_id"), R).filter("depth > 0")
        return found.select(R, F.col("start").alias("test"), F.col("node").alias("id"), "depth")
    found = closure.reach(call_edges, starts, tenant="repo_id", src="from_id", dst="to_id", order=F.col("to_id"),
                          max_depth=max_depth)
    return found.select("repo_id", F.col("start").alias("test"), F.col("node").alias("id"), "depth",
                        F.concat(F.array("start"), "path").alias("path"))


def nearest_tests(call_edges: DataFrame, tests: DataFrame, wanted: DataFrame, n: int = TESTS_SHOWN) -> DataFrame:
    """The n closest tests of every wanted (repo_id, id) and their shortest paths: (repo_id, test, id, depth, path).

    A backward walk finds the symbols that lead to a wanted one; labels of the
    tests among them then walk forward, at most n + 1 a symbol.
    """
    # One group: the walk is a set of symbols, whoever asked for them.
    asked = wanted.select(F.lit(0).alias("_all"), R, F.col("id").alias("node")).distinct()
    edges = call_edges.select(R, "from_id", "to_id").distinct()
    leading = cut(closure.spread(asked, edges.select(R, F.col("to_id").alias("src"), F.col("from_id").alias("dst")), group="_all", keys=[R]).select(R, "node"))
    inside = edges.join(leading.select(R, F.col("node").alias("to_id")), [R, "to_id"], "left_semi")
    starts = tests.select(R, F.col("id").alias("node")).join(leading, [R, "node"], "left_semi").select(R, F.col("node").alias("start"))
    found = closure.nearest_labels(inside, starts, tenant=R, src="from_id", dst="to_id", n=n)
    return found.select(R, F.col("start").alias("test"), F.col("node").alias("id"), "depth", F.concat(F.array("start"), "path").alias("path"))


def top_reaching_tests(hits: DataFrame, wanted: DataFrame, n: int = TESTS_SHOWN) -> DataFrame:
    """The n closest tests of each wanted (review_id, repo_id, id), nearest first, then by test id.

    ``hits`` is from :func:`nearest_tests` or :func:`reach_from_tests`.
    """
    met = wanted.join(hits, ["repo_id", "id"])
    return top_per_key(met, [V, "repo_id", "id"], [F.col("depth"), F.col("test")], n, "place")


def test_reach(wanted: DataFrame, hits: DataFrame) -> DataFrame:
    """Every wanted function with whether a test reaches it, the closest tests and the shortest path."""
    # The closest tests belong to the symbol, at most TESTS_SHOWN; a function a review asks for several times counts each test as often.
    near = top_per_key(hits, [R, "id"], [F.col("depth"), F.col("test")], TESTS_SHOWN, "_place").groupBy(R, "id").agg(
        F.array_sort(F.collect_list(F.struct("_place", "test"))).alias("_t"), F.min_by("path", "_place").alias("path"))
    times = F.least(F.count(F.lit(1)).over(Window.partitionBy(V, R, "id")), F.lit(TESTS_SHOWN)).cast("int")
    asked = F.col(V).isNotNull() & F.col("_t").isNotNull()
    return wanted.withColumn("_k", times).join(near, [R, "id"], "left") \
        .withColumn("path", F.when(asked, F.col("path"))).withColumn("reached", asked) \
        .withColumn("tests", F.when(asked, F.slice(F.flatten(F.transform("_t", lambda t: F.array_repeat(t["test"], F.col("_k")))), 1, TESTS_SHOWN))) \
        .select(V, R, "id", *[c for c in wanted.columns if c not in (V, R, "id")], "path", "reached", "tests")


def reaching_tests(wanted: DataFrame, call_edges: DataFrame, tests: DataFrame, named: bool = False) -> DataFrame:
    """Every test that reaches a wanted function other than itself: (review_id, repo_id, test).

    What a review wants walks backward as one set, ``PACK`` reviews a row, over the loops of the graph: members of a loop reach the
    same, so a loop is one node of the walk and no rows of a review, a function and a test are formed.
    A wanted test counts if it reaches another wanted function: one of its own loop, or one behind an edge that leaves
    its loop (or itself, where it is on none). With ``named`` the rows are (review_id, repo_id, dir, name): tests of one name in one
    directory and loop are told apart only where a review wants one of them.
    """
    edges = cut(call_edges.select(R, "from_id", "to_id").dropna().distinct())
    asked = cut(wanted.select(R, F.col(V).alias("start"), F.col("id").alias("node")).dropna(subset=[R, "node"]).distinct())
    names = cut(closure.packed_names(asked, tenant=R))
    loops = cut(closure.loops(edges, tenant=R, src="from_id", dst="to_id"))

    def home(column: str, name: str) -> DataFrame:
        return loops.select(R, F.col("node").alias(column), F.col("loop").alias(name))

    leaving = cut(edges.join(home("from_id", "_a"), [R, "from_id"], "left").join(home("to_id", "_b"), [R, "to_id"], "left")
                  .select(R, F.coalesce("_a", "from_id").alias("home"), F.coalesce("_b", "to_id").alias("node")).filter("home != node").distinct())
    housed = cut(asked.join(home("node", "_a"), [R, "node"], "left").withColumn("home", F.coalesce("_a", "node")).drop("_a"))
    walk = closure.packed_reach(leaving, names, tenant=R, src="node", dst="home", seeds=housed.select(R, "start", F.col("home").alias("node")).distinct())
    reached = cut(walk.groupBy(R, "block", F.col("node").alias("home")).agg(F.bit_or("bits").alias("bits")))
    mine = names.select(F.col(R).alias("_r"), F.col("start").alias("_s"), "block", "bits")
    whose = (F.col(R) == F.col("_r")) & F.col("start").eqNullSafe(F.col("_s"))
    outside = leaving.join(reached.withColumnRenamed("home", "node"), [R, "node"]).select(R, "block", "home", "bits")
    several = housed.join(loops.select(R, "node"), [R, "node"], "left_semi").groupBy(R, "start", "home").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    inside = several.join(mine, whose).select(R, "block", "home", "bits")
    others = outside.unionByName(inside).groupBy(R, "block", "home").agg(F.bit_or("bits").alias("_others"))
    # A review that wants a test and nothing else that it reaches.
    alone = housed.join(tests.select(R, F.col("id").alias("node")), [R, "node"], "left_semi").join(mine, whose) \
        .groupBy(R, "block", "home", "node").agg(F.bit_or("bits").alias("_own")).join(others, [R, "block", "home"], "left") \
        .select(R, "block", "node", F.expr("_own & ~coalesce(_others, 0L)").alias("_alone")).filter("_alone != 0")
    called = F.struct(P.dirname("path").alias("dir"), "name") if named else F.struct(F.col("id").alias("test"))
    each = cut(tests.select(R, F.col("id").alias("node"), called.alias("_g")).distinct().join(home("node", "_a"), [R, "node"], "left")
               .withColumn("home", F.coalesce("_a", "node")).drop("_a"))
    groups = each.groupBy(R, "home", "_g").agg(F.count(F.lit(1)).alias("_tests"))
    barred = alone.join(each, [R, "node"]).groupBy(R, "block", "home", "_g").agg(F.bit_and("_alone").alias("_alone"), F.count(F.lit(1)).alias("_k"))
    left = groups.join(reached, [R, "home"]).join(barred, [R, "block", "home", "_g"], "left") \
        .withColumn("bits", F.when(F.col("_k") == F.col("_tests"), F.expr("bits & ~_alone")).otherwise(F.col("bits")))
    found = left.groupBy(R, "block", "_g").agg(F.bit_or("bits").alias("bits")).filter("bits != 0")
    return found.join(names.select(R, "block", F.col("start").alias(V), F.col("bits").alias("_own")), [R, "block"]) \
        .filter("bits & _own != 0").select(V, R, "_g.*")


def test_commands(reaching: DataFrame, tests: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """One command per directory that runs all its reaching tests: (review_id, repo_id, dir, tests, command).

    ``reaching`` is from :func:`reaching_tests`, by test or ``named``. ``modules`` is (repo_id, module_dir); a directory below one runs inside the
    nearest such module. The names of a command are its text, so they are gathered.
    """
    used = reaching.select(V, R, "dir", "name").distinct() if "dir" in reaching.columns else \
        reaching.select(V, R, F.col("test").alias("id")).distinct().join(tests.select(R, "id", "name", "path"), [R, "id"]) \
        .select(V, R, P.dirname("path").alias("dir"), "name").distinct()
    rows = used.groupBy(V, R, "dir").agg(F.array_sort(F.collect_list("name")).alias("names"))
    rows = _in_module(rows, modules) if modules is not None else rows.withColumn("module", F.lit(""))
    pattern = F.array_join(F.transform("names", lambda n: X.quote_regex(n)), "|")
    inside = F.when(F.col("module") == "", F.col("dir")).when(F.col("dir") == F.col("module"), F.lit(".")) \
        .otherwise(F.expr("substring(dir, length(module) + 2)"))
    target = F.when(inside == ".", F.lit(".")).otherwise(F.concat(F.lit("./"), inside))
    enter = F.when(F.col("module") == "", F.lit("")).otherwise(F.concat(F.lit("cd "), "module", F.lit(" && ")))
    return rows.select(V, R, "dir", F.array_join("names", ",").alias("tests"),
                       F.concat(enter, F.lit("go test "), target, F.lit(" -run '^("), pattern, F.lit(")$'")).alias("command"))


def _in_module(rows: DataFrame, modules: DataFrame) -> DataFrame:
    """``module``: the longest module directory that is the row's directory or above it, '' for the root."""
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    dirs = rows.select(R, "dir").distinct().withColumn("module_dir", F.explode(above))
    homes = dirs.join(modules.filter("module_dir NOT IN ('', '.')").select(R, "module_dir").distinct(), [R, "module_dir"]) \
        .groupBy(R, "dir").agg(F.max_by("module_dir", F.length("module_dir")).alias("module"))
    return rows.join(homes, [R, "dir"], "left").withColumn("module", F.coalesce("module", F.lit("")))


def import_scope(packages: DataFrame, imports: DataFrame, changed: DataFrame) -> DataFrame:
    """Packages holding changed paths and everything that imports them: (review_id, repo_id, node, depth).

    ``packages`` is (repo_id, pkg, dir), ``imports`` (repo_id, pkg, imported), ``changed`` (review_id, repo_id, path).
    Packages that any review changed walk once, as packed sets; reviews join what their packages reach at the end and meet
    each node at its smallest depth.
    """
    seeds = cut(changed.withColumn("dir", P.dirname("path")).join(packages, [R, "dir"])
                .select(V, R, F.col("pkg").alias("start")).distinct())
    inside = imports.join(packages.select(R, F.col("pkg").alias("imported")), [R, "imported"], "left_semi") \
        .select(R, F.col("imported").alias("src"), F.col("pkg").alias("dst"))
    reached = cut(closure.unpacked(closure.packed_reach(inside, seeds.select(R, "start"), tenant=R, src="src", dst="dst"), R))
    return seeds.join(reached, [R, "start"]).groupBy(V, R, "node").agg(F.min("depth").alias("depth"))


def entry_points(symbols: DataFrame, call_edges: DataFrame | None = None, patterns: Sequence[tuple[str, str, str]] = (),
                 registered: DataFrame | None = None) -> DataFrame:
    """Where flows start: (repo_id, id, kind, reason, rule); a symbol may have several, ``rule`` numbers them in order.

    ``patterns`` are (name regex, signature shape, reason), either part may be
    ''. ``registered`` are entry points found elsewhere. With ``call_edges``,
    exported functions nothing calls are added. ``symbols`` has receiver,
    package_name, path, shape and exported.
    """
    functions = navigable(symbols)
    free = F.coalesce("receiver", F.lit("")) == ""
    rules = []

    def rule(rows: DataFrame, kind: str, reason: str) -> DataFrame:
        return rows.select(R, "id", F.lit(kind).alias("kind"), F.lit(reason).alias("reason"), F.lit(len(rules)).alias("rule"))

    for prefix, reason in TEST_PREFIXES.items():
        here = free & F.endswith(F.col("path"), F.lit("_test.go")) & F.startswith(F.col("name"), F.lit(prefix))
        rules.append(rule(functions.filter(here), "test", reason))
    rules.append(rule(functions.filter(free & (F.col("name") == "main") & (F.col("package_name") == "main")),
                      "main", MAIN_REASON))
    rules.append(rule(functions.filter(free & (F.col("name") == "init")), "init", INIT_REASON))
    for shape, reason in HANDLERS.items():
        rules.append(rule(functions.filter(F.col("shape") == shape), "http-handler", reason))
    for name, shape, reason in patterns:
        if name or shape:
            fits = (F.col("name").rlike(name) if name else F.lit(True)) & (F.col("shape") == shape if shape else F.lit(True))
            rules.append(rule(functions.filter(fits), "custom", reason))
    if registered is not None:
        rules.append(registered.select(R, "id", "kind", "reason", F.lit(len(rules)).alias("rule")))
    found = rules[0]
    for more in rules[1:]:
        found = found.unionByName(more)
    if call_edges is None:
        return found
    called = call_edges.select(R, F.col("to_id").alias("id"))
    idle = functions.filter("exported").join(found.select(R, "id"), [R, "id"], "left_anti") \
        .join(called, [R, "id"], "left_anti")
    return found.unionByName(rule(idle, "unreferenced", IDLE_REASON))


def entry_point_index(entries: DataFrame) -> DataFrame:
    """One entry point per symbol: the most specific kind, the first rule on ties."""
    return first_per_key(entries, [R, "id"], F.struct(X.entry_priority("kind"), "rule", "reason"))

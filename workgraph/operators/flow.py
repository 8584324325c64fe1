"""Review order by flow: walk back from changed symbols to entry points, then read each flow from its entry.

``changed`` is (review_id, repo_id, id, ord): changed symbols in the order the
patch lists them. ``call_edges`` is (repo_id, from_id, to_id). ``info`` is
(repo_id, id, name, receiver, path, entry_kind), entry_kind NULL unless a symbol
is an entry point. Ids and paths repeat between repositories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workgraph.functions import ids as X
from workgraph.functions import paths as P
from workgraph.operators import closure
from workgraph.operators.closure import _remember, _union
from workgraph.operators.scan import first_per_key, ranked, top_per_key
from workgraph.session import cut

V, R = "review_id", "repo_id"
VR = [V, R]
# What is said of a symbol nothing calls, and of a group without an entry point.
NO_CALLERS, NO_ENTRY = "no in-repo callers found", " (no entry point found)"


def _walks(changed: DataFrame, call_edges: DataFrame, entry_ids: DataFrame, depth: int | None = None,
           paths: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(seeds, pairs, calls): what is above a symbol does not depend on the review, so every changed symbol walks once.

    ``seeds`` is (review_id, repo_id, start, ord), ``pairs`` (repo_id, start, node, depth, is_entry[, path]) with the
    start itself at depth 0, ``calls`` (repo_id, node, caller).
    """
    calls = cut(call_edges.select(R, F.col("to_id").alias("node"), F.col("from_id").alias("caller")).distinct())
    entries = cut(entry_ids.select(R, F.col("id").alias("node")).distinct())
    seeds = cut(changed.groupBy(*VR, F.col("id").alias("start")).agg(F.min("ord").alias("ord")))
    starts = seeds.select(R, "start").distinct()
    open_ = calls.join(entries, [R, "node"], "left_anti")
    order = F.col("caller") if paths else None
    hops = closure.widened(open_, tenant=R, src="node", dst="caller", order=order)
    above = closure.reach(open_, starts, tenant=R, src="node", dst="caller", order=order, max_depth=depth, hops=hops)
    own = starts.select(R, "start", F.col("start").alias("node"), F.lit(0).alias("depth"),
                        *([F.array().cast("array<string>").alias("path")] if paths else []))
    pairs = own.unionByName(above).join(entries.withColumn("is_entry", F.lit(True)), [R, "node"], "left")
    return seeds, cut(pairs.withColumn("is_entry", F.coalesce("is_entry", F.lit(False)))), calls


def _reached(seeds: DataFrame, pairs: DataFrame) -> DataFrame:
    """Nodes of each review, merged in one aggregation: (review_id, repo_id, node, depth[, path], changed, is_entry)."""
    met = seeds.join(pairs, [R, "start"], "left").withColumn("node", F.coalesce("node", "start")) \
        .withColumn("depth", F.coalesce("depth", F.lit(0))).withColumn("is_entry", F.coalesce("is_entry", F.lit(False)))
    marks = [F.max(F.col("depth") == 0).alias("changed"), F.max("is_entry").alias("is_entry")]
    if "path" not in pairs.columns:
        return met.groupBy(*VR, "node").agg(F.min("depth").alias("depth"), *marks)
    path = F.concat(F.array(F.lpad(F.col("ord").cast("string"), 12, "0")), F.coalesce("path", F.array().cast("array<string>")))
    return met.groupBy(*VR, "node").agg(F.min(F.struct("depth", path.alias("path"))).alias("_p"), *marks) \
        .select(*VR, "node", "_p.depth", "_p.path", "changed", "is_entry")


def flow_subgraph(changed: DataFrame, call_edges: DataFrame, entry_ids: DataFrame, depth: int | None = None,
                  max_nodes: int | None = None, paths: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) found walking callers back from the changed symbols of each review.

    Entry points are reached but not expanded. The walk ends when nothing new
    is found, unless the caller bounds it: ``depth`` by hops, ``max_nodes`` by
    nodes counted in discovery order, changed symbols first; a review that
    ``max_nodes`` stops has ``cut_off`` set on its nodes. ``nodes`` is (review_id,
    repo_id, node, depth, path, changed, is_entry, cut_off); ``edges`` is
    (review_id, repo_id, caller, callee). ``path`` is the order of discovery; ``paths`` False leaves it out.

    Without ``max_nodes`` symbols walk, not reviews (:func:`_walks`): a review joins what is above its symbols at the
    end, so rounds write rows of symbols only. ``max_nodes`` counts per review and walks review by review.
    """
    if max_nodes is None:
        seeds, pairs, calls = _walks(changed, call_edges, entry_ids, depth, paths)
        above = pairs.filter(~F.col("is_entry") & (F.lit(True) if depth is None else F.col("depth") < depth)) \
            .join(calls, [R, "node"]).select(R, "start", "caller", F.col("node").alias("callee"))
        return _reached(seeds, pairs).withColumn("cut_off", F.lit(False)), \
            seeds.join(above, [R, "start"]).select(*VR, "caller", "callee").distinct()
    calls = cut(call_edges.select(R, F.col("to_id").alias("node"), F.col("from_id").alias("caller")).distinct())
    entries = cut(entry_ids.select(R, F.col("id").alias("node")).distinct()).withColumn("is_entry", F.lit(True))
    mark = lambda rows: rows.join(entries, [R, "node"], "left").withColumn("is_entry", F.coalesce("is_entry", F.lit(False)))
    seeds = changed.groupBy(*VR, F.col("id").alias("node")).agg(F.min("ord").alias("_o")) \
        .select(*VR, "node", F.lit(0).alias("depth"), F.array(F.lpad(F.col("_o").cast("string"), 12, "0")).alias("path"),
                F.lit(True).alias("changed"))
    nodes = cut(mark(seeds))
    frontier, level, tried, rounds = nodes, 0, [], [nodes]
    while depth is None or level < depth:
        sizes = nodes.groupBy(*VR).agg(F.count(F.lit(1)).alias("_n"))
        open_ = frontier.filter(~F.col("is_entry")).join(sizes.filter(F.col("_n") < max_nodes).select(*VR), VR, "left_semi")
        seen = cut(open_.join(calls, [R, "node"]).select(
            *VR, F.col("node").alias("callee"), "caller", F.concat("path", F.array("caller")).alias("path")))
        if seen.isEmpty():
            break
        _remember(tried, seen)
        level += 1
        fresh = seen.join(nodes.select(*VR, F.col("node").alias("caller")), [*VR, "caller"], "left_anti") \
            .groupBy(*VR, F.col("caller").alias("node")).agg(F.min("path").alias("path"))
        # A review never needs more new nodes than its bound.
        fresh = top_per_key(fresh, VR, [F.col("path")], max_nodes, "_k").drop("_k")
        frontier = cut(mark(fresh.withColumn("depth", F.lit(level)).withColumn("changed", F.lit(False))).select(*nodes.columns))
        _remember(rounds, frontier)
        nodes = _union(rounds)
    if not tried:
        return nodes.withColumn("cut_off", F.lit(False)), nodes.select(*VR, F.col("node").alias("caller"), F.col("node").alias("callee")).limit(0)
    edges = _union(tried)
    found = nodes.groupBy(*VR).agg((F.count(F.lit(1)) >= max_nodes).alias("cut_off"))
    seeds_kept = nodes.filter("depth = 0")
    room = seeds_kept.groupBy(*VR).agg(F.count(F.lit(1)).alias("_seeds"))
    later = top_per_key(nodes.filter("depth > 0"), VR, [F.col("depth"), F.col("path")], max_nodes, "_place")
    later = cut(later.join(room, VR).filter(F.col("_place") <= max_nodes - F.col("_seeds")))
    nodes = seeds_kept.unionByName(later.drop("_place", "_seeds").select(*seeds_kept.columns)).join(found, VR)
    # The discovery that fills a review is the last thing recorded for it.
    full = later.filter(F.col("_place") == max_nodes - F.col("_seeds")).select(*VR, F.struct("depth", "path").alias("_last"))
    kept = edges.join(full, VR, "left").filter(
        F.col("_last").isNull() | (F.struct(F.size("path") - 1, "path") <= F.col("_last")))
    ends = nodes.select(*VR, "node")
    kept = kept.join(ends.withColumnRenamed("node", "caller"), [*VR, "caller"], "left_semi") \
        .join(ends.withColumnRenamed("node", "callee"), [*VR, "callee"], "left_semi")
    return nodes, kept.select(*VR, "caller", "callee").distinct()


def _why(nodes: DataFrame, edges: DataFrame, info: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """The chain of callers above each changed node, always along the smallest caller id; it ends at an entry point,
    at a node without callers, or where it would come round again.

    ``edges`` (caller, callee) and ``places`` (node, is_entry; by default those of ``nodes``) are of a review or, where
    all reviews share them, of a repository: then chains are followed once a symbol, and reviews only add their marks.
    """
    places = nodes if places is None else places
    keys = [c for c in VR if c in places.columns]
    up = edges.groupBy(*keys, F.col("callee").alias("node")).agg(F.min("caller").alias("up"))
    said = lambda marked: X.hop_label("is_entry", "entry_kind", "receiver", "name", F.lit(marked))
    labels = cut(places.select(*keys, "node", "is_entry").join(info.withColumnRenamed("id", "node"), [R, "node"], "left").join(up, [*keys, "node"], "left")
                 .select(*keys, "node", F.struct(F.col("node").alias("id"), said(False).alias("plain"), said(True).alias("marked")).alias("hop"), "is_entry", "up"))
    step = labels.select(*keys, F.col("node").alias("_at"), F.col("hop").alias("_h"), F.col("is_entry").alias("_e"), F.col("up").alias("_up"))
    asked = cut(nodes.filter("changed").select(*VR, "node"))
    going = cut(labels.filter("up IS NOT NULL").select(*keys, "node", F.col("up").alias("_at"), F.array().cast("array<struct<id:string,plain:string,marked:string>>").alias("hops"), F.array("node").alias("_seen"))
                .join(asked.select(*keys, "node").distinct(), [*keys, "node"], "left_semi"))
    ended = []
    while not going.isEmpty():
        seen = F.concat("_seen", F.array("_at"))
        above = F.when(F.col("_e") | F.array_contains(seen, F.col("_up")), F.lit(None).cast("string")).otherwise(F.col("_up"))
        going = cut(going.join(step, [*keys, "_at"], "left").select(*keys, "node", above.alias("_at"), F.concat("hops", F.array("_h")).alias("hops"), seen.alias("_seen")))
        _remember(ended, going.filter("_at IS NULL").select(*keys, "node", "hops"))
        going = going.filter("_at IS NOT NULL")
    if not ended:
        return asked.withColumn("why", F.lit(NO_CALLERS))
    chains = cut(_union(ended).withColumn("_chain", F.monotonically_increasing_id()))
    hops = asked.join(chains, [*keys, "node"]).select(*VR, "node", "_chain", F.posexplode("hops").alias("_i", "_h"))
    marks = asked.select(*VR, F.col("node").alias("_id"), F.lit(True).alias("_marked"))
    label = F.when(F.col("_marked"), F.col("_h.marked")).otherwise(F.col("_h.plain"))
    piece = F.coalesce(F.concat(F.when(F.col("_i") == 0, F.lit("")).otherwise(F.lit(" ← ")), label), F.lit(""))
    # One chain is one output text.
    texts = hops.withColumn("_id", F.col("_h.id")).join(marks, [*VR, "_id"], "left").groupBy(*VR, "node", "_chain") \
        .agg(F.array_sort(F.collect_list(F.struct("_i", piece.alias("t")))).alias("_t")) \
        .select(*VR, "node", F.concat(F.lit("called from "), F.array_join("_t.t", "")).alias("why"))
    return asked.join(texts, [*VR, "node"], "left").withColumn("why", F.coalesce("why", F.lit(NO_CALLERS)))


def _components(seeds: DataFrame, pairs: DataFrame) -> DataFrame:
    """(review_id, repo_id, start, component): changed symbols of a review belong together where they reach a common node.

    The smallest node names a component. Only symbols that share a node enter the loop.
    """
    lows = pairs.groupBy(R, "start").agg(F.min("node").alias("low"))
    several = seeds.groupBy(*VR).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*VR)
    met = seeds.join(several, VR, "left_semi").join(pairs.select(R, "start", "node"), [R, "start"])
    shared = cut(met.groupBy(*VR, "node").agg(F.min("start").alias("a"), F.max("start").alias("b"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    more = met.join(shared.filter("_n > 2").select(*VR, "node", "a"), [*VR, "node"]).select(*VR, "a", F.col("start").alias("b"))
    both = F.struct(*VR).alias("_t")
    links = cut(shared.select(*VR, "a", "b").unionByName(more).filter("a != b").distinct().select(both, "a", "b"))
    linked = links.select("_t", F.col("a").alias("node")).union(links.select("_t", "b")).distinct()
    label = closure.connected_components(linked, links, tenant="_t", src="a", dst="b") \
        .select("_t.*", F.col("node").alias("start"), F.col("component").alias("_label"))
    named = seeds.join(label, [*VR, "start"], "left").withColumn("_label", F.coalesce("_label", "start")).join(lows, [R, "start"])
    least = named.groupBy(*VR, "_label").agg(F.min("low").alias("component"))
    return cut(named.select(*VR, "start", "_label").join(least, [*VR, "_label"]).drop("_label"))


def _layers(comps: DataFrame, pairs: DataFrame, calls: DataFrame) -> DataFrame:
    """(review_id, repo_id, component, node, layer) of the changed symbols.

    All callers of a node that is no entry point are in its review, so its layer is that of the repository, unless it
    lies on a loop or behind one: components that hold such a symbol are peeled on their own.
    """
    symbols = pairs.select(R, "node", "is_entry").distinct()
    entering = cut(calls.join(symbols.filter("NOT is_entry").select(R, "node"), [R, "node"], "left_semi").filter("caller IS NOT NULL"))
    whole = closure.topo_layers(symbols.select(R, F.lit(0).alias("component"), "node"), entering, tenant=R, src="caller", dst="node", release=False)
    own = cut(comps.withColumnRenamed("start", "node").join(whole.drop("component"), [R, "node"], "left"))
    behind = cut(own.filter("layer IS NULL").select(*VR, "component").distinct())
    if behind.isEmpty():
        return own
    both = F.struct(*VR).alias("_t")
    nodes = cut(comps.join(behind, [*VR, "component"], "left_semi").join(pairs, [R, "start"]).select(*VR, both, "component", "node").distinct())
    edges = nodes.join(entering, [R, "node"]).select("_t", "caller", F.col("node").alias("callee"))
    peeled = closure.topo_layers(nodes.select("_t", "component", "node"), edges, tenant="_t", src="caller", dst="callee").select("_t.*", "component", "node", "layer")
    rest = own.drop("layer").join(behind, [*VR, "component"], "left_semi").join(peeled, [*VR, "component", "node"])
    return own.join(behind, [*VR, "component"], "left_anti").select(*VR, "component", "node", "layer").unionByName(rest.select(*VR, "component", "node", "layer"))


def flow_order(files: DataFrame, changed: DataFrame, call_edges: DataFrame, info: DataFrame,
               hotspots: DataFrame | None = None) -> DataFrame:
    """Changed files grouped by flow: (review_id, repo_id, group_no, title, entry_id, pos_in_group, path, why, hotspot).

    ``files`` is (review_id, repo_id, path, diff_no); ``hotspots`` is (repo_id, path, score).
    Within a group files follow their earliest changed symbol from the entry
    down; a path goes to the first group that claims it. Files no group claims
    have NULL group columns and are ordered by :func:`unclassified`.

    Walks, layers, chains and first entry points are worked out once a symbol; rows of a review are its changed symbols.
    """
    files = cut(files)
    seeds, pairs, calls = _walks(changed, call_edges, info.filter("entry_kind IS NOT NULL").select(R, "id"))
    seeds = seeds.filter("start IS NOT NULL").select(*VR, "start")
    comps = _components(seeds, pairs)
    facts = info.withColumnRenamed("id", "node")
    label = X.display_name("receiver", "name")
    layers = cut(_layers(comps, pairs, calls).join(facts, [R, "node"], "left"))
    # Nothing enters an entry point, so its layer is 0.
    heads_of = pairs.filter("is_entry").join(facts, [R, "node"], "left").groupBy(R, "start").agg(F.min(
        F.struct(F.lit(0).alias("layer"), "node", F.concat(X.entry_label("entry_kind"), F.lit(" "), label).alias("t"))).alias("_e"))
    entered = comps.join(heads_of, [R, "start"]).groupBy(*VR, "component").agg(F.min("_e").alias("_e"))
    titles = layers.groupBy(*VR, "component").agg(F.min(F.struct("layer", "node", F.concat(label, F.lit(NO_ENTRY)).alias("t"))).alias("_c")) \
        .join(entered, [*VR, "component"], "left") \
        .select(*VR, "component", F.coalesce("_e.t", "_c.t", F.lit("unknown")).alias("title"), F.col("_e.node").alias("entry_id"))
    hits = layers.join(files, [*VR, "path"]).groupBy(*VR, "path", "diff_no", "component").agg(F.min(F.struct("layer", "node")).alias("at"))
    claimed = cut(first_per_key(hits, [*VR, "path"], F.col("component")))
    score = files.select(R, "path").distinct().withColumn("hotspot", F.lit(0.0)) if hotspots is None else \
        hotspots.select(R, "path", F.col("score").alias("hotspot"))
    symbols = pairs.select(R, "node", "is_entry").distinct()
    above = calls.join(symbols.filter("NOT is_entry"), [R, "node"], "left_semi").select(R, "caller", F.col("node").alias("callee"))
    why = _why(seeds.select(*VR, F.col("start").alias("node"), F.lit(True).alias("changed")), above, info, symbols)
    rows = claimed.withColumn("node", F.col("at.node")).join(titles, [*VR, "component"]).join(why, [*VR, "node"])
    rows = rows.join(score, [R, "path"], "left").withColumn("hotspot", F.coalesce("hotspot", F.lit(0.0)))
    heads = rows.groupBy(*VR, "component").agg(F.min("diff_no").alias("_first"))
    numbered = ranked(heads, [V], [F.col("_first"), F.col(R), F.col("component")], "group_no")
    out = ranked(rows, [*VR, "component"], [F.col("at.layer"), F.col("at.node"), -F.col("hotspot"), F.col("path")], "pos_in_group") \
        .join(numbered.drop("_first"), [*VR, "component"]) \
        .select(*VR, "group_no", "title", "entry_id", "pos_in_group", "path", "why", "hotspot")
    # Only reviews with a file left need all their nodes.
    left = files.join(claimed.select(*VR, "path"), [*VR, "path"], "left_anti").select(*VR).distinct()
    nodes = _reached(seeds.join(left, VR, "left_semi"), pairs)
    rest = unclassified(files, claimed.select(*VR, "path"), nodes, info, hotspots).select(
        *VR, F.lit(None).cast("long").alias("group_no"), F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("entry_id"), F.col("place").alias("pos_in_group"), "path",
        F.lit("").alias("why"), "hotspot")
    return out.unionByName(rest)


def unclassified(files: DataFrame, placed: DataFrame, nodes: DataFrame, info: DataFrame,
                 hotspots: DataFrame | None = None) -> DataFrame:
    """Changed files no group claimed, by shallowest symbol, then hotspot, then path: adds place and hotspot."""
    depth = nodes.select(*VR, "node", "depth").join(info.select(R, F.col("id").alias("node"), "path"), [R, "node"]).groupBy(*VR, "path").agg(F.min("depth").alias("_d"))
    rows = files.join(placed, [*VR, "path"], "left_anti").join(depth, [*VR, "path"], "left") \
        .withColumn("_d", F.coalesce("_d", F.lit(1 << 30)))
    rows = rows.withColumn("hotspot", F.lit(0.0)) if hotspots is None else \
        rows.join(hotspots.select(R, "path", F.col("score").alias("hotspot")), [R, "path"], "left").fillna(0.0, ["hotspot"])
    return ranked(rows, [V], [F.col("_d"), -F.col("hotspot"), F.col("path"), F.col(R)], "place").drop("_d")


def order_files(files: DataFrame, how: str) -> DataFrame:
    """Files of a review numbered by ``alpha`` (path), ``dir`` (directory, then path) or ``diff`` (as given).

    Ordering by commit is declared but not supported.
    """
    orders = {"alpha": [F.col("path")], "dir": [P.dirname("path"), F.col("path")], "diff": [F.col("diff_no")]}
    if how not in orders:
        raise ValueError(f"unsupported order {how!r}")
    return ranked(files, [V], [*orders[how], F.col("diff_no")], "place")

"""Graph operators over ``(tenant, source, destination)`` edge tables.

Every loop runs for all tenants at once, writes each round with
:func:`workgraph.session.cut` and stops on an empty frontier. A first-come
breadth-first walk visits a node by its shortest path and, among those, by the
smallest path of sibling keys; carrying that path as an array lets one
aggregation reproduce the visiting order without a queue.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workgraph.operators.scan import ranked
from workgraph.session import cut, scratch

#: Starts packed into one long; the sign bit is left alone.
PACK = 62
#: Rows that widening a path table may make of one of its rows.
SPREAD = 4
#: Nodes and edges a tenant may have to be walked inside one row; larger ones walk in rounds.
SMALL = 128


def _union(rounds: Sequence[DataFrame]) -> DataFrame:
    """What all rounds of a loop wrote."""
    return reduce(DataFrame.unionByName, rounds)


def _remember(rounds: list[DataFrame], found: DataFrame) -> None:
    """Add a round; every few rounds are rewritten as one table, so plans and file lists stay short."""
    rounds.append(found)
    if len(rounds) >= 6:
        rounds[:] = [cut(_union(rounds))]


def _nearest(paths: DataFrame, keys: Sequence[str], ordered: bool) -> DataFrame:
    """One row per key: the smallest depth and, if ordered, the smallest path of that depth."""
    if not ordered:
        return paths.groupBy(*keys).agg(F.min("depth").alias("depth"))
    best = paths.groupBy(*keys).agg(F.min(F.struct("depth", "path")).alias("_best"))
    return best.select(*keys, "_best.depth", "_best.path")


def _join_paths(left: DataFrame, right: DataFrame, tenant: str, head: str, ordered: bool) -> DataFrame:
    """Extend paths ending at ``node`` by paths starting there."""
    r = right.select(F.col(tenant), F.col("_from").alias("node"), F.col("node").alias("_to"),
                     F.col("depth").alias("_d"), *([F.col("path").alias("_p")] if ordered else []))
    joined = left.join(r, [tenant, "node"]).filter(F.col(head) != F.col("_to"))
    cols = [F.col(tenant), F.col(head), F.col("_to").alias("node"),
            (F.col("depth") + F.col("_d")).alias("depth")]
    if ordered:
        cols.append(F.concat("path", "_p").alias("path"))
    return joined.select(*cols)


def reach(edges: DataFrame, starts: DataFrame | None = None, *, tenant: str, src: str, dst: str,
          order: Column | None = None, max_depth: int | None = None, stride: int | None = None,
          hops: DataFrame | None = None) -> DataFrame:
    """Everything reachable from each start: ``(tenant, start, node, depth[, path])``.

    ``starts`` has columns (tenant, start); None means every source node. The
    start itself is never reported. ``order`` is the sibling key; with it
    ``path`` holds the keys along the visiting path. Edges are first widened to
    paths of up to ``stride`` hops so a walk of depth d needs d/stride rounds;
    only nodes exactly at a round's last depth are extended, which keeps the
    work of a plain frontier. Widening pays when most nodes are starts or
    edges are few per node; with few starts in a dense graph leave it at 1, or
    give paths that :func:`widened` made of the edges as ``hops``.
    """
    ordered = order is not None
    if stride is None:
        stride = 4 if starts is None else 1
    if max_depth is not None:
        stride = min(stride, max_depth)
    if hops is None:
        one = edges.select(F.col(tenant), F.col(src).alias("_from"), F.col(dst).alias("node"),
                           F.lit(1).alias("depth"), *([F.array(order).alias("path")] if ordered else []))
        one = one.filter(F.col("_from") != F.col("node"))
        hop_keys = [tenant, "_from", "node"]
        hops, width = _nearest(one, hop_keys, ordered), 1
        while width < stride:
            hops = _nearest(hops.unionByName(_join_paths(hops, hops, tenant, "_from", ordered)),
                            hop_keys, ordered)
            width *= 2
        hops = cut(hops)
    else:
        width = hops._width
    keys = [tenant, "start", "node"]
    if starts is None:
        found = hops.withColumnRenamed("_from", "start")
    else:
        begin = starts.select(F.col(tenant), F.col("start"), F.col("start").alias("_from")).distinct()
        found = cut(begin.join(hops, [tenant, "_from"]).drop("_from"))
    if max_depth is not None and max_depth < width:
        found = found.filter(F.col("depth") <= max_depth)
    rounds, depth = [found], width
    frontier = found.filter(F.col("depth") == depth)
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        candidates = _nearest(_join_paths(frontier, hops, tenant, "start", ordered), keys, ordered)
        if max_depth is not None:
            candidates = candidates.filter(F.col("depth") <= max_depth)
        seen = _union(rounds)
        # What has been seen grows without bound, so it is merged with, never broadcast.
        found = cut(candidates.join(seen.select(*keys).hint("merge"), keys, "left_anti"))
        _remember(rounds, found)
        depth += width
        frontier = found.filter(F.col("depth") == depth)
    result = _union(rounds)
    return result


def connected_components(nodes: DataFrame, edges: DataFrame, *, tenant: str, src: str, dst: str) -> DataFrame:
    """Undirected components of ``nodes(tenant, node)``: ``(tenant, node, component)``, the smallest id names it."""
    both = cut(edges.select(F.col(tenant), F.col(src).alias("node"), F.col(dst).alias("other"))
               .unionByName(edges.select(F.col(tenant), F.col(dst).alias("node"), F.col(src).alias("other")))
               .filter(F.col("node") != F.col("other")).distinct())
    labels = nodes.select(tenant, "node", F.col("node").alias("component")).distinct()
    while True:
        heard = both.join(labels.select(tenant, F.col("node").alias("other"), "component"), [tenant, "other"]) \
            .groupBy(tenant, "node").agg(F.min("component").alias("_heard"))
        lowered = labels.join(heard, [tenant, "node"], "left") \
            .withColumn("_new", F.least("component", F.coalesce("_heard", F.col("component"))))
        # Jump: follow the label's own label, which halves long chains.
        jump = labels.select(tenant, F.col("node").alias("_new"), F.col("component").alias("_jump"))
        step = cut(lowered.join(jump, [tenant, "_new"], "left")
                   .select(tenant, "node", F.least("_new", F.coalesce("_jump", F.col("_new"))).alias("_next"),
                           F.col("component").alias("_old")))
        labels = step.select(tenant, "node", F.col("_next").alias("component"))
        if step.filter(F.col("_next") != F.col("_old")).isEmpty():
            return labels


def _trim(edges: DataFrame, tenant: str) -> DataFrame:
    """Drop edges that cannot lie on a loop: repeatedly remove nodes without an in- or an out-edge."""
    while True:
        entered = edges.select(tenant, F.col("dst").alias("src")).distinct()
        left = edges.select(tenant, F.col("src").alias("dst")).distinct()
        kept = cut(edges.join(entered, [tenant, "src"], "left_semi").join(left, [tenant, "dst"], "left_semi")
                   .select(tenant, "src", "dst"))
        if kept.count() == edges.count():
            return kept
        edges = kept


def loops(edges: DataFrame, *, tenant: str, src: str, dst: str) -> DataFrame:
    """Members of strongly connected groups that hold a loop: ``(tenant, node, loop)``.

    ``loop`` is the smallest member. Trimming leaves only nodes between loops;
    then the smallest id is spread forward (a colour) and each colour's own
    members are those that reach its root backward. No pairs of members are
    ever formed, so one huge loop costs its edges, not their square.
    """
    live = cut(edges.select(F.col(tenant), F.col(src).alias("src"), F.col(dst).alias("dst")).distinct())
    groups = None
    while True:
        live = _trim(live, tenant)
        if live.isEmpty():
            break
        nodes = live.select(tenant, F.col("src").alias("node")).union(live.select(tenant, "dst")).distinct()
        colour = nodes.withColumn("colour", F.col("node"))
        while True:
            heard = live.join(colour.select(tenant, F.col("node").alias("src"), "colour"), [tenant, "src"]) \
                .groupBy(tenant, F.col("dst").alias("node")).agg(F.min("colour").alias("_heard"))
            step = cut(colour.join(heard, [tenant, "node"], "left")
                       .select(tenant, "node", F.least("colour", F.coalesce("_heard", F.col("colour"))).alias("_next"),
                               F.col("colour").alias("_old")))
            colour = step.select(tenant, "node", F.col("_next").alias("colour"))
            if step.filter(F.col("_next") != F.col("_old")).isEmpty():
                break
        inside = cut(live.join(colour.select(tenant, F.col("node").alias("src"), F.col("colour").alias("_a")),
                               [tenant, "src"])
                     .join(colour.select(tenant, F.col("node").alias("dst"), F.col("colour").alias("_b")),
                           [tenant, "dst"])
                     .filter("_a = _b").select(tenant, "src", "dst", F.col("_a").alias("colour")))
        member = colour.filter(F.col("node") == F.col("colour"))
        rounds, frontier = [member], member
        while True:
            back = inside.join(frontier.select(tenant, F.col("node").alias("dst"), "colour"),
                               [tenant, "dst", "colour"]) \
                .select(tenant, F.col("src").alias("node"), "colour").distinct()
            frontier = cut(back.join(_union(rounds), [tenant, "node", "colour"], "left_anti"))
            if frontier.isEmpty():
                break
            _remember(rounds, frontier)
        members = _union(rounds)
        members = cut(members.select(tenant, "node", F.col("colour").alias("loop")))
        # A lone member holds a loop only through an edge to itself.
        sizes = members.groupBy(tenant, "loop").count()
        selfish = live.filter("src = dst").select(tenant, F.col("src").alias("loop")).distinct() \
            .withColumn("_self", F.lit(True))
        real = members.join(sizes, [tenant, "loop"]).join(selfish, [tenant, "loop"], "left") \
            .filter((F.col("count") > 1) | F.col("_self")).select(tenant, "node", "loop")
        groups = real if groups is None else groups.unionByName(real)
        live = cut(live.join(members.select(tenant, F.col("node").alias("src")), [tenant, "src"], "left_anti")
                   .join(members.select(tenant, F.col("node").alias("dst")), [tenant, "dst"], "left_anti")
                   .select(tenant, "src", "dst"))
    if groups is None:
        return edges.select(F.col(tenant), F.col(src).alias("node"), F.col(src).alias("loop")).limit(0)
    return groups


def topo_layers(nodes: DataFrame, edges: DataFrame, *, tenant: str, src: str, dst: str, release: bool = True) -> DataFrame:
    """Peel layers of nodes without an incoming edge: ``(tenant, component, node, layer)``.

    ``nodes`` is (tenant, component, node). A component in which every node
    left is entered releases only its smallest id; with ``release`` False such
    nodes are left out. Reading nodes by (layer, node) gives the order.
    """
    keys = [tenant, "component"]
    left = cut(nodes.select(*keys, "node").distinct())
    live = cut(edges.select(F.col(tenant), F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()
               .join(left.select(tenant, F.col("node").alias("src")), [tenant, "src"], "left_semi")
               .join(left.select(tenant, F.col("node").alias("dst")), [tenant, "dst"], "left_semi"))
    layers, layer = [], 0
    while not left.isEmpty():
        entered = live.select(tenant, F.col("dst").alias("node")).distinct().withColumn("_in", F.lit(1))
        marked = left.join(entered, [tenant, "node"], "left")
        if not release:
            judged = cut(marked.select(*keys, "node", F.col("_in").isNull().alias("_goes")))
            if judged.filter("_goes").isEmpty():
                break
        else:
            free = F.count(F.when(F.col("_in").isNull(), 1))
            state = marked.groupBy(*keys).agg(free.alias("_free"), F.min("node").alias("_least"))
            goes = F.col("_in").isNull() | ((F.col("_free") == 0) & (F.col("node") == F.col("_least")))
            judged = cut(marked.join(state, keys).select(*keys, "node", goes.alias("_goes")))
        _remember(layers, judged.filter("_goes").select(*keys, "node", F.lit(layer).alias("layer")))
        left = judged.filter("NOT _goes").drop("_goes")
        stays = left.select(tenant, "node")
        live = cut(live.join(stays.withColumnRenamed("node", "src"), [tenant, "src"], "left_semi")
                   .join(stays.withColumnRenamed("node", "dst"), [tenant, "dst"], "left_semi"))
        layer += 1
    if not layers:
        return nodes.select(*keys, "node", F.lit(0).alias("layer")).limit(0)
    result = _union(layers)
    return result


def layered_passes(nodes: DataFrame, edges: DataFrame, *, tenant: str, node: str = "id",
                   pos: str = "pos", src: str = "src", dep: str = "dep") -> DataFrame:
    """The pass in which a blockers-first multi-pass walk in file order emits each node.

    A dependency costs a further pass exactly when it stands later in the file.
    Nodes on a loop, naming a missing id, or behind either get a NULL pass.
    Output ``(tenant, node, pos, pass)``.
    """
    own = nodes.select(F.col(tenant), F.col(node).alias("node"), F.col(pos).alias("pos"))
    wants = edges.select(F.col(tenant), F.col(src).alias("node"), F.col(dep).alias("dep")).distinct()
    waiting = cut(own.join(wants.select(tenant, "node").distinct(), [tenant, "node"], "left_semi"))
    done = cut(own.join(wants.select(tenant, "node").distinct(), [tenant, "node"], "left_anti")
               .withColumn("pass", F.lit(1)))
    rounds = [done]
    open_edges = cut(wants.join(own.select(tenant, "node", "pos"), [tenant, "node"])
                     .withColumn("_pass", F.lit(None).cast("int")))
    fresh = done
    while not fresh.isEmpty():
        known = fresh.select(tenant, F.col("node").alias("dep"), F.col("pos").alias("_dpos"),
                             F.col("pass").alias("_dpass"))
        cost = F.col("_dpass") + F.when(F.col("_dpos") > F.col("pos"), 1).otherwise(0)
        open_edges = cut(open_edges.join(known, [tenant, "dep"], "left")
                         .withColumn("_pass", F.coalesce("_pass", cost)).drop("_dpos", "_dpass"))
        settled = open_edges.groupBy(tenant, "node", "pos") \
            .agg(F.max("_pass").alias("pass"), F.count(F.when(F.col("_pass").isNull(), 1)).alias("_left")) \
            .filter("_left = 0").drop("_left")
        fresh = cut(settled)
        _remember(rounds, fresh)
        open_edges = open_edges.join(fresh.select(tenant, "node"), [tenant, "node"], "left_anti")
    emitted = _union(rounds)
    stuck = waiting.join(emitted.select(tenant, "node"), [tenant, "node"], "left_anti") \
        .withColumn("pass", F.lit(None).cast("int"))
    return emitted.unionByName(stuck)


def spread(seeds: DataFrame, edges: DataFrame, *, group: str, keys: Sequence[str]) -> DataFrame:
    """Nodes each group of seeds reaches: (group, *keys, node, depth), seeds at depth 0.

    ``seeds`` is (group, *keys, node), ``edges`` (*keys, src, dst). A group
    walks as one set, so no pairs of its seeds and nodes are formed.
    """
    cols = [group, *keys, "node"]
    frontier = cut(seeds.select(*cols).distinct().withColumn("depth", F.lit(0)))
    rounds, depth = [frontier], 0
    step = cut(edges.select(*keys, F.col("src").alias("node"), F.col("dst").alias("_to")).distinct())
    while not frontier.isEmpty():
        depth += 1
        found = frontier.join(step, [*keys, "node"]).select(group, *keys, F.col("_to").alias("node")).distinct()
        frontier = cut(found.join(_union(rounds).select(*cols).hint("merge"), cols, "left_anti").withColumn("depth", F.lit(depth)))
        _remember(rounds, frontier)
    result = _union(rounds)
    return result


def nearest_labels(edges: DataFrame, starts: DataFrame, *, tenant: str, src: str, dst: str, n: int,
                   max_depth: int | None = None) -> DataFrame:
    """The ``n`` nearest starts of every node: (tenant, node, start, depth, path), ties to the smaller start.

    ``starts`` is (tenant, start); a start is not a label of itself. Labels
    walk forward round by round and a node keeps no more than the first
    ``n + 1``, itself included, so no pairs of starts and nodes are formed:
    what is not among the first of a node is not among those of its successors
    either. ``path`` is the smallest of the shortest paths, from the start's
    successor to the node; each of its prefixes ends at a node that keeps the label.
    """
    with scratch() as held:
        step = cut(edges.select(F.col(tenant), F.col(src).alias("node"), F.col(dst).alias("_to")).filter("node != _to").distinct())
        frontier = cut(starts.select(tenant, F.col("start").alias("node"), "start").distinct()
                       .select(tenant, "node", "start", F.lit(0).alias("depth"), F.array().cast("array<string>").alias("path")))
        rounds, depth = [frontier], 0
        place = Window.partitionBy(tenant, "node").orderBy("start")
        while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
            depth += 1
            heard = frontier.join(step, [tenant, "node"]).groupBy(tenant, F.col("_to").alias("node"), "start") \
                .agg(F.min(F.concat("path", F.array(F.col("_to").cast("string")))).alias("path"))
            # At most n + 1 labels a node.
            known = _union(rounds).groupBy(tenant, "node").agg(F.collect_set("start").alias("_known"))
            left = heard.join(known.hint("merge"), [tenant, "node"], "left").withColumn("_held", F.coalesce(F.size("_known"), F.lit(0))) \
                .filter((F.col("_held") <= n) & ~F.coalesce(F.array_contains("_known", F.col("start")), F.lit(False)))
            frontier = cut(left.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= n + 1)
                           .filter(F.col("_place") + F.col("_held") <= n + 1)
                           .select(tenant, "node", "start", F.lit(depth).alias("depth"), "path"))
            _remember(rounds, frontier)
        order = Window.partitionBy(tenant, "node").orderBy("depth", "start")
        first = _union(rounds).filter(F.col("node") != F.col("start")).withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= n)
        return held.keep(cut(first.drop("_place")))


def widened(edges: DataFrame, *, tenant: str, src: str, dst: str, order: Column | None = None, stride: int = 4) -> DataFrame:
    """Shortest paths of up to ``stride`` hops, a power of two: (tenant, _from, node, depth[, path]).

    Paths are doubled only while the degrees say that at most ``SPREAD`` rows come of one; so a hub, whose
    predecessors times successors are no longer in proportion to the edges, leaves the walk at the hops it has.
    """
    ordered = order is not None
    one = edges.select(F.col(tenant), F.col(src).alias("_from"), F.col(dst).alias("node"), F.lit(1).alias("depth"),
                       *([F.array(order).alias("path")] if ordered else [])).filter("_from != node")
    hops, width, keys = cut(_nearest(one, [tenant, "_from", "node"], ordered)), 1, [tenant, "node"]
    while width < stride:
        enter = hops.groupBy(*keys).agg(F.count(F.lit(1)).alias("_in"))
        leave = hops.groupBy(tenant, F.col("_from").alias("node")).agg(F.count(F.lit(1)).alias("_out"))
        come = enter.join(leave, keys, "left").agg(F.sum("_in").alias("rows"), F.sum(F.col("_in").cast("double") * F.col("_out")).alias("pairs")).head()
        if come["pairs"] is None or come["pairs"] > SPREAD * come["rows"]:
            break
        hops = cut(_nearest(hops.unionByName(_join_paths(hops, hops, tenant, "_from", ordered)), [tenant, "_from", "node"], ordered))
        width *= 2
    hops._width = width
    return hops


def packed_names(starts: DataFrame, *, tenant: str) -> DataFrame:
    """The block and the bit of each start of ``starts(tenant, start)``: (tenant, start, block, bits)."""
    return ranked(starts.select(tenant, "start").distinct(), [tenant], [F.col("start")], "_i") \
        .select(tenant, "start", F.floor((F.col("_i") - 1) / PACK).alias("block"), F.expr(f"shiftleft(1L, CAST((_i - 1) % {PACK} AS INT))").alias("bits"))


def packed_reach(edges: DataFrame, starts: DataFrame, *, tenant: str, src: str, dst: str, stride: int = 4, hops: DataFrame | None = None,
                 seeds: DataFrame | None = None) -> DataFrame:
    """What each start reaches, ``PACK`` starts a row: (tenant, block, node, bits, depth); a start is at depth 0.

    ``starts`` is (tenant, start). Bit ``i`` of block ``b`` is start ``i`` of that
    block, see :func:`unpacked`. With ``seeds`` (tenant, start, node) a start is a set of nodes that walks as one, all of them at depth 0;
    ``starts`` is then from :func:`packed_names` and says which bit is whose. A round ORs the fresh bits of a block along
    the paths of :func:`widened` (``hops``, where the caller has them); a bit appears in the row of its shortest
    depth only, so a walk has at most starts / PACK rows a node and depth.
    """
    with scratch() as held:
        hops = widened(edges, tenant=tenant, src=src, dst=dst, stride=stride) if hops is None else hops
        width = hops._width
        step = hops.select(tenant, F.col("_from").alias("node"), F.col("node").alias("_to"), F.col("depth").alias("_hops"))
        if seeds is None:
            named = packed_names(starts, tenant=tenant).select(tenant, F.col("start").alias("node"), "block", "bits")
        else:
            own = starts.select(F.col(tenant).alias("_t"), F.col("start").alias("_s"), "block", "bits")
            named = seeds.join(own, (F.col(tenant) == F.col("_t")) & F.col("start").eqNullSafe(F.col("_s"))) \
                .groupBy(tenant, "node", "block").agg(F.bit_or("bits").alias("bits"))
        frontier = cut(named.withColumn("depth", F.lit(0)))
        rounds, depth, keys = [frontier], 0, [tenant, "block", "node"]
        while not frontier.isEmpty():
            # Only what is exactly at a round's last depth goes on; the rest was reached from there too.
            heard = frontier.filter(F.col("depth") == depth).drop("depth").join(step, [tenant, "node"]).groupBy(tenant, "block", F.col("_to").alias("node")) \
                .agg(*[F.coalesce(F.bit_or(F.when(F.col("_hops") == h, F.col("bits"))), F.lit(0)).cast("long").alias(f"_b{h}") for h in range(1, width + 1)])
            known = _union(rounds).groupBy(*keys).agg(F.bit_or("bits").alias("_b0"))
            met = heard.join(known.hint("merge"), keys, "left").withColumn("_b0", F.coalesce("_b0", F.lit(0)).cast("long"))
            fresh = [F.struct(F.lit(depth + h).alias("depth"), F.expr(f"_b{h} & ~(" + " | ".join(f"_b{k}" for k in range(h)) + ")").alias("bits")) for h in range(1, width + 1)]
            found = cut(met.select(*keys, F.explode(F.array(*fresh)).alias("_f")).select(tenant, "node", "block", "_f.bits", "_f.depth").filter("bits != 0"))
            _remember(rounds, found)
            depth += width
            frontier = found.filter(F.col("depth") == depth)
        return held.keep(cut(_union(rounds)))


def unpacked(packed: DataFrame, tenant: str) -> DataFrame:
    """(tenant, start, node, depth) of a packed walk, or of some of its rows and those of depth 0."""
    starts = packed.filter("depth = 0").select(tenant, F.col("node").alias("start"), "block", F.col("bits").alias("_own"))
    return packed.join(starts, [tenant, "block"]).filter("bits & _own != 0").select(tenant, "start", "node", "depth")


def packed_counts(packed: DataFrame, tenant: str, weights: DataFrame | None = None) -> DataFrame:
    """What each start of a packed walk reaches, as numbers: (tenant, start, total), starts that reach nothing left out.

    ``weights`` is (tenant, node, weight), a long; None counts every node as 1.
    The bits of a block are added up column by column, so rows are as many as
    the walk's, then as many as the starts; no pairs of starts and nodes.
    """
    met = packed.filter("depth > 0")
    met = met.withColumn("weight", F.lit(1).cast("long")) if weights is None else met.join(weights.select(tenant, "node", "weight"), [tenant, "node"])
    sums = met.groupBy(tenant, "block").agg(*[F.sum(F.expr(f"(shiftrightunsigned(bits, {i}) & 1L) * weight")).alias(f"_s{i}") for i in range(PACK)])
    each = sums.select(tenant, "block", F.posexplode(F.array(*[f"_s{i}" for i in range(PACK)])).alias("_i", "total")).filter("total != 0") \
        .select(tenant, "block", F.expr("shiftleft(1L, _i)").alias("bits"), "total")
    starts = packed.filter("depth = 0").select(tenant, "block", "bits", F.col("node").alias("start"))
    return each.join(starts, [tenant, "block", "bits"]).select(tenant, "start", "total")


def large_tenants(*tables: DataFrame, tenant: str) -> DataFrame:
    """(tenant) of those with more than ``SMALL`` rows in all tables together."""
    held = reduce(DataFrame.unionAll, [t.select(tenant) for t in tables])
    return cut(held.dropna().groupBy(tenant).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > SMALL).select(tenant))


def small_rows(large: DataFrame, *, tenant: str, **tables: DataFrame) -> DataFrame:
    """One row per tenant that is not ``large``: an array of structs per table, smallest first, at most ``SMALL`` in all.

    Only such tenants are gathered; a table a tenant has no rows in is an empty array.
    """
    names = list(tables)
    every = [t.select(tenant, *[F.struct(*[c for c in t.columns if c != tenant]).alias(n) if n == name else F.lit(None).alias(n) for n in names])
             for name, t in tables.items()]
    rows = reduce(DataFrame.unionAll, every).filter(F.col(tenant).isNotNull()).join(large, tenant, "left_anti")
    return rows.repartition(tenant).groupBy(tenant).agg(*[F.sort_array(F.collect_list(n)).alias(n) for n in names])


def queue_walk(begin: Column, follow: Callable[[Column], Column], n: Column) -> Column:
    """The numbers a queue visits from those of ``begin`` on, in order; ``follow`` gives the successors of one, ``n`` is how many there are."""
    return F.aggregate(F.sequence(F.lit(1), n), begin, lambda seen, k: F.when(
        k <= F.size(seen), F.concat(seen, F.array_except(follow(F.get(seen, k - 1)), seen))).otherwise(seen))


def visits(nodes: DataFrame, edges: DataFrame, large: DataFrame, *, tenant: str, src: str, dst: str, order: str) -> DataFrame:
    """What each start reaches in tenants that are not ``large``: (tenant, node, label, ahead).

    ``nodes`` is (tenant, node, label, starts), one row a node. ``ahead`` holds (place, node, label) of the nodes reached, in the
    order of a queue that takes successors by ``order``: by depth, then by the smallest path of sibling keys. A tenant is walked
    inside its row, which holds at most ``SMALL`` nodes and edges.
    """
    links = edges.select(tenant, F.col(order).alias("order"), F.col(src).alias("src"), F.col(dst).alias("dst")).dropna()
    rows = small_rows(large, tenant=tenant, nodes=nodes.select(tenant, "node", "label", "starts"), links=links)
    # Nodes of the table come first, so their numbers are their places in it.
    named = rows.select(tenant, "nodes", "links", F.array_distinct(F.concat("nodes.node", "links.src")).alias("ids"))
    place = lambda c: (F.array_position("ids", c) - 1).cast("int")
    step = named.select(tenant, "nodes", F.size("ids").alias("n"), F.transform("ids", lambda i: F.filter(F.transform(
        F.filter("links", lambda e: e["src"] == i), lambda e: place(e["dst"])), lambda x: x >= 0)).alias("next"))
    number = F.sequence(F.lit(0), F.size("nodes") - 1)
    walk = lambda i: queue_walk(F.array(i), lambda x: F.get("next", x), F.col("n"))
    seen = lambda i: F.transform(F.filter(walk(i), lambda x: x != i), lambda x, p: F.struct(
        p.alias("place"), F.get("nodes", x)["node"].alias("node"), F.get("nodes", x)["label"].alias("label")))
    each = step.filter(F.size("nodes") > 0).select(tenant, F.explode(F.transform(F.filter(number, lambda i: F.get("nodes", i)["starts"]), lambda i: F.struct(
        F.get("nodes", i)["node"].alias("node"), F.get("nodes", i)["label"].alias("label"), seen(i).alias("ahead")))).alias("_w"))
    return each.select(tenant, "_w.node", "_w.label", "_w.ahead")


def best_ahead(edges: DataFrame, ranks: DataFrame, *, tenant: str, src: str, dst: str, order: Column, stride: int = 4,
               hops: DataFrame | None = None) -> DataFrame:
    """The best other node each node reaches: (tenant, node, rank, depth, best).

    ``ranks`` is (tenant, node, rank), one row per node that may be an answer.
    The smallest rank wins, then the fewest hops, then the smallest path of
    sibling keys; ``order`` is unique among the successors of a node.

    Labels walk backward along the paths of :func:`widened` (``hops``, where the caller has them), and a
    node keeps its two best with itself among them: the answer is the first
    that is not the node, loops included. A label carries its first path and
    its place at the end of it, which compare as whole paths do, because labels of one depth
    arrive together. Only labels new at a node go on, and only along the longest
    paths, so a round forms at most two rows a path.
    """
    keys = [tenant, "node"]
    key = F.struct("rank", "depth", "path", "place")
    with scratch() as held:
        hops = widened(edges, tenant=tenant, src=src, dst=dst, order=order, stride=stride) if hops is None else hops
        width = hops._width
        back = hops.select(tenant, "_from", "node", F.col("depth").alias("_hops"), F.col("path").alias("_path"))
        state = cut(ranks.groupBy(*keys).agg(F.min("rank").alias("rank"))
                    .select(*keys, "rank", F.lit(0).alias("depth"), F.array().cast("array<string>").alias("path"), F.lit(1).alias("place"), F.col("node").alias("best")))
        fresh, depth = state, 0
        while not fresh.isEmpty():
            # From depth 0 every path counts; what lies deeper came over shorter ones already.
            heard = fresh.join(back if depth == 0 else back.filter(F.col("_hops") == width), keys).groupBy(tenant, F.col("_from").alias("node"), "best") \
                .agg(F.min(F.struct(F.col("rank"), (F.col("depth") + F.col("_hops")).alias("depth"), F.col("_path").alias("path"), F.col("place"))).alias("_k"))
            both = state.select(*keys, "best", key.alias("_k")).unionByName(heard).groupBy(*keys, "best").agg(F.min("_k").alias("_k"))
            first = Window.partitionBy(*keys).orderBy("_k")
            state = cut(both.withColumn("_at", F.row_number().over(first)).filter("_at <= 2")
                        .select(*keys, "_k.rank", "_k.depth", "_k.path", F.when(F.col("_k.depth") > depth, F.col("_at")).otherwise(F.col("_k.place")).alias("place"), "best"))
            fresh = state.filter(F.col("depth") > depth)
            depth += width
        other = state.filter("best != node").withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(key))).filter("_at = 1")
        return held.keep(cut(other.select(*keys, "rank", "depth", "best")))

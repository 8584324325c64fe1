"""Graph operators against short brute-force walks on random graphs, loops included."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from workgraph.operators import closure, code


def graphs(seed, count, nodes, edges):
    rng = random.Random(seed)
    return {g: [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(rng.randrange(edges))] for g in range(count)}


def table(frame, made):
    return frame([(g, f"n{a:02d}", f"n{b:02d}") for g, es in made.items() for a, b in es], "t int, src string, dst string")


def queue_walk(next_of, start):
    """Visit breadth first, siblings in order; the visiting order without the start."""
    seen, queue, out = {start}, list(next_of[start]), []
    while queue:
        node = queue.pop(0)
        if node not in seen:
            seen.add(node)
            out.append(node)
            queue += next_of[node]
    return out


def adjacency(edges):
    out = defaultdict(list)
    for a, b in sorted(set(edges)):
        out[f"n{a:02d}"].append(f"n{b:02d}")
    return out


def test_reach_visits_in_queue_order(frame):
    made = graphs(1, 40, 9, 22)
    df = table(frame, made)
    for stride in (1, 4):
        found = closure.reach(df, tenant="t", src="src", dst="dst", order=F.col("dst"), stride=stride).collect()
        got = defaultdict(list)
        for r in sorted(found, key=lambda r: (r.depth, r.path)):
            got[r.t, r.start].append(r.node)
        for g, es in made.items():
            near = adjacency(es)
            for start in {f"n{a:02d}" for a, _ in es}:
                assert got.get((g, start), []) == queue_walk(near, start)


def test_reach_stops_at_depth(frame):
    chain = frame([(0, f"n{i:02d}", f"n{i + 1:02d}") for i in range(9)], "t int, src string, dst string")
    starts = frame([(0, "n00")], "t int, start string")
    got = closure.reach(chain, starts, tenant="t", src="src", dst="dst", max_depth=5).collect()
    assert sorted(r.depth for r in got) == [1, 2, 3, 4, 5]


def test_components(frame):
    made = graphs(2, 30, 12, 12)
    nodes = frame([(g, f"n{i:02d}") for g in made for i in range(12)], "t int, node string")
    got = {(r.t, r.node): r.component for r in closure.connected_components(nodes, table(frame, made), tenant="t", src="src", dst="dst").collect()}
    for g, es in made.items():
        label = {f"n{i:02d}": f"n{i:02d}" for i in range(12)}
        for _ in range(12):
            for a, b in es:
                low = min(label[f"n{a:02d}"], label[f"n{b:02d}"])
                label[f"n{a:02d}"] = label[f"n{b:02d}"] = low
        assert {n: got[g, n] for n in label} == label


def test_loops_are_mutual_reach(frame):
    made = graphs(3, 40, 8, 14)
    got = {(r.t, r.node): r.loop for r in closure.loops(table(frame, made), tenant="t", src="src", dst="dst").collect()}
    for g, es in made.items():
        near = adjacency(es)
        reach = {}
        for n in [f"n{i:02d}" for i in range(8)]:
            todo, seen = list(near[n]), set()
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += near[x]
            reach[n] = seen
        for n in reach:
            mutual = [m for m in reach if m in reach[n] and n in reach[m]]
            assert got.get((g, n)) == (min(mutual) if n in reach[n] else None)


def test_topo_layers_release_smallest_when_stuck(frame):
    made = graphs(4, 30, 8, 14)
    nodes = frame([(g, "c", f"n{i:02d}") for g in made for i in range(8)], "t int, component string, node string")
    got = defaultdict(list)
    for r in sorted(closure.topo_layers(nodes, table(frame, made), tenant="t", src="src", dst="dst").collect(), key=lambda r: (r.layer, r.node)):
        got[r.t].append(r.node)
    for g, es in made.items():
        left, edges, order = {f"n{i:02d}" for i in range(8)}, {(f"n{a:02d}", f"n{b:02d}") for a, b in es}, []
        while left:
            free = sorted(n for n in left if not any(b == n and a in left for a, b in edges)) or [min(left)]
            order += free
            left -= set(free)
        assert got[g] == order


def test_layered_passes_match_a_multi_pass_walk(frame):
    made = graphs(5, 40, 9, 12)
    nodes = frame([(g, f"n{i:02d}", i) for g in made for i in range(9)], "t int, id string, pos int")
    edges = [(g, f"n{a:02d}", f"n{b:02d}" if b else "gone") for g, es in made.items() for a, b in es]
    got = {(r.t, r.node): r["pass"] for r in closure.layered_passes(nodes, frame(edges, "t int, src string, dep string"), tenant="t").collect()}
    for g in made:
        wants = defaultdict(set)
        for t, a, b in edges:
            if t == g:
                wants[a].add(b)
        emitted, left, number = {}, [f"n{i:02d}" for i in range(9)], 0
        while left:
            number += 1
            later = []
            for n in left:
                if wants[n] <= emitted.keys():
                    emitted[n] = number
                else:
                    later.append(n)
            if len(later) == len(left):
                break
            left = later
        assert {n: got[g, n] for n in [f"n{i:02d}" for i in range(9)]} == {n: emitted.get(n) for n in [f"n{i:02d}" for i in range(9)]}


def test_spread_walks_groups_as_sets(frame):
    edges = frame([(0, "a", "b"), (0, "b", "c"), (0, "c", "a"), (0, "x", "y")], "r int, src string, dst string")
    seeds = frame([("v1", 0, "a"), ("v1", 0, "x"), ("v2", 0, "y")], "g string, r int, node string")
    got = {(r.g, r.node): r.depth for r in closure.spread(seeds, edges, group="g", keys=["r"]).collect()}
    assert got == {("v1", "a"): 0, ("v1", "x"): 0, ("v1", "b"): 1, ("v1", "y"): 1, ("v1", "c"): 2, ("v2", "y"): 0}


def random_graph(seed, nodes=40, edges=90, repos=2):
    rng = random.Random(seed)
    return sorted({(r, f"n{rng.randrange(nodes):02d}", f"n{rng.randrange(nodes):02d}") for r in range(repos) for _ in range(edges)})


def plain_walk(edges, repo, start):
    """Depth and smallest shortest path of everything behind ``start``."""
    out = {start: (0, [])}
    layer = [start]
    while layer:
        found = {}
        for a in layer:
            for r, x, y in edges:
                if r == repo and x == a and y not in out:
                    path = out[a][1] + [y]
                    found[y] = min(found.get(y, path), path)
        out |= {y: (len(p), p) for y, p in found.items()}
        layer = list(found)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_labels_are_the_first_of_all_pairs(frame, seed):
    edges = random_graph(seed)
    starts = [(r, f"n{i:02d}") for r in (0, 1) for i in range(0, 40, 2)]
    got = {}
    for r in closure.nearest_labels(frame(edges, "r int, a string, b string"), frame(starts, "r int, start string"), tenant="r", src="a", dst="b", n=3).collect():
        got.setdefault((r.r, r.node), []).append((r.depth, r.start, r.path))
    want = {}
    for r, s in starts:
        for node, (depth, path) in plain_walk(edges, r, s).items():
            if node != s:
                want.setdefault((r, node), []).append((depth, s, path))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:3] for k, v in want.items()}


def test_labels_stay_few_where_pairs_are_many(frame, monkeypatch):
    """300 starts into one hub with a long tail: at most n + 1 labels a node are ever written."""
    edges = frame([(0, f"t{i:03d}", "hub") for i in range(300)] + [(0, "hub", "c00")] + [(0, f"c{i:02d}", f"c{i + 1:02d}") for i in range(9)], "r int, a string, b string")
    starts = frame([(0, f"t{i:03d}") for i in range(300)], "r int, start string")
    written, cut = [], closure.cut
    monkeypatch.setattr(closure, "cut", lambda df: written.append(out := cut(df)) or out)
    found = closure.nearest_labels(edges, starts, tenant="r", src="a", dst="b", n=5)
    counts = {(r.node, r["count"]) for r in found.groupBy("node").count().collect()}
    assert counts == {("hub", 5)} | {(f"c{i:02d}", 5) for i in range(10)}


@pytest.mark.parametrize("seed, stride", [(3, 4), (4, 4), (5, 1), (6, 2)])
def test_packed_walks_equal_plain_ones(frame, monkeypatch, seed, stride):
    monkeypatch.setattr(closure, "PACK", 7)
    edges = random_graph(seed, edges=70)
    starts = [(r, f"n{i:02d}") for r in (0, 1) for i in range(0, 40, 3)] + [(0, "lonely")]
    walk = closure.packed_reach(frame(edges, "r int, a string, b string"), frame(starts, "r int, start string"), tenant="r", src="a", dst="b", stride=stride)
    got = [tuple(x) for x in closure.unpacked(walk, "r").collect()]
    want = {(r, s, node, depth) for r, s in starts for node, (depth, _) in plain_walk(edges, r, s).items()}
    assert len(got) == len(set(got)) and set(got) == want
    assert walk.count() < len(got)


def test_rounds_of_import_scope_do_not_depend_on_reviews(frame, monkeypatch):
    packages = frame([(0, f"p{i}", f"d{i}") for i in range(12)], "repo_id int, pkg string, dir string")
    imports = frame([(0, f"p{i + 1}", f"p{i}") for i in range(11)] + [(0, "p0", "p5")], "repo_id int, pkg string, imported string")
    rounds = []
    cut = closure.cut
    monkeypatch.setattr(closure, "cut", lambda df: rounds.append(1) or cut(df))
    seen = []
    for reviews in (1, 40):
        rounds.clear()
        changed = frame([(f"v{k}", 0, f"d{k % 3}/x.go") for k in range(reviews)], "review_id string, repo_id int, path string")
        got = {(r.review_id, r.node): r.depth for r in code.import_scope(packages, imports, changed).collect()}
        seen.append(len(rounds))
        assert len(got) == 12 * reviews and got["v0", "p0"] == 0 and got["v0", "p11"] == 11
    assert seen[1] <= seen[0] + 1


def test_packed_counts_are_the_sizes_of_walks(frame):
    made = graphs(11, 12, 90, 200)
    df = table(frame, made)
    starts = df.select("t", F.col("src").alias("start")).distinct()
    weights = df.select("t", F.col("dst").alias("node")).distinct().filter("node < 'n60'").withColumn("weight", F.when(F.col("node") < "n20", (1 << 32) + 1).otherwise(1).cast("long"))
    packed = closure.packed_reach(df, starts, tenant="t", src="src", dst="dst")
    plain = {(r.t, r.start): r.total for r in closure.packed_counts(packed, "t").collect()}
    heavy = {(r.t, r.start): r.total for r in closure.packed_counts(packed, "t", weights).collect()}
    for g, es in made.items():
        near, known = adjacency(es), {f"n{b:02d}" for _, b in es}
        for start in {f"n{a:02d}" for a, _ in es}:
            seen = queue_walk(near, start)
            assert plain.get((g, start), 0) == len(seen)
            assert heavy.get((g, start), 0) == sum((n < "n60") + (n < "n20") * (1 << 32) for n in seen if n in known)


def test_best_ahead_is_the_first_of_the_best_on_loops_too(frame):
    made = graphs(12, 60, 12, 26)
    df = table(frame, made)
    rng = random.Random(5)
    ranks = {(g, f"n{i:02d}"): rng.randrange(3) for g in made for i in range(12) if rng.random() < 0.6}
    table_of = frame([(g, n, r) for (g, n), r in ranks.items()], "t int, node string, rank int")
    for stride in (1, 4):
        found = closure.best_ahead(df, table_of, tenant="t", src="src", dst="dst", order=F.col("dst"), stride=stride).collect()
        got = {(r.t, r.node): (r.rank, r.best) for r in found}
        for g, es in made.items():
            near = adjacency(es)
            for start in {f"n{x:02d}" for e in es for x in e}:
                # The walk visits by depth, then by path, so the first of the least rank is the answer.
                able = [(ranks[g, n], i, n) for i, n in enumerate(queue_walk(near, start)) if (g, n) in ranks]
                assert got.get((g, start)) == ((min(able)[0], min(able)[2]) if able else None)


def test_a_hub_is_not_widened(frame):
    hub = frame([(0, f"a{i:02d}", "hub") for i in range(40)] + [(0, "hub", f"z{i:02d}") for i in range(40)], "t int, src string, dst string")
    assert closure.widened(hub, tenant="t", src="src", dst="dst")._width == 1
    chain = frame([(0, f"n{i:02d}", f"n{i + 1:02d}") for i in range(30)], "t int, src string, dst string")
    assert closure.widened(chain, tenant="t", src="src", dst="dst")._width == 4
    starts = hub.select("t", F.col("src").alias("start")).distinct()
    counts = closure.packed_counts(closure.packed_reach(hub, starts, tenant="t", src="src", dst="dst"), "t").collect()
    assert {(r.start, r.total) for r in counts} == {(f"a{i:02d}", 41) for i in range(40)} | {("hub", 40)}


def test_best_ahead_and_counts_on_a_long_chain_and_without_edges(frame):
    chain = frame([(0, f"n{i:02d}", f"n{i + 1:02d}") for i in range(30)] + [(0, "n30", "n00")], "t int, src string, dst string")
    ranks = frame([(0, "n17", 0), (0, "n03", 1)], "t int, node string, rank int")
    got = {r.node: (r.best, r.depth) for r in closure.best_ahead(chain, ranks, tenant="t", src="src", dst="dst", order=F.col("dst")).collect()}
    assert got == {f"n{i:02d}": ("n17", (17 - i) % 31) if i != 17 else ("n03", 17) for i in range(31)}
    assert closure.best_ahead(chain.limit(0), ranks, tenant="t", src="src", dst="dst", order=F.col("dst")).count() == 0


def test_sets_of_seeds_walk_as_one(frame):
    made = graphs(31, 20, 10, 18)
    sets = {(g, f"r{k}"): {f"n{(g * 7 + k * i) % 10:02d}" for i in range(1, 4)} for g in made for k in range(70)}
    seeds = frame([(g, s, n) for (g, s), ns in sets.items() for n in sorted(ns)], "t int, start string, node string")
    names = closure.packed_names(seeds, tenant="t")
    walk = closure.packed_reach(table(frame, made), names, tenant="t", src="src", dst="dst", seeds=seeds).collect()
    whose = {(r.t, r.block, r.bits): r.start for r in names.collect()}
    assert len(whose) == len(sets) and max(r.block for r in walk) == 1
    got = defaultdict(dict)
    for r in walk:
        for i in range(closure.PACK):
            if r.bits >> i & 1:
                assert r.node not in got[r.t, whose[r.t, r.block, 1 << i]]
                got[r.t, whose[r.t, r.block, 1 << i]][r.node] = r.depth
    for (g, s), ns in sets.items():
        near, depth, front, d = adjacency(made[g]), {n: 0 for n in ns}, ns, 0
        while front:
            d += 1
            front = {b for a in front for b in near[a]} - set(depth)
            depth |= {n: d for n in front}
        assert got[g, s] == depth

"""Flow order, walk caps, blast radius and test reach on small call graphs."""

import random

from pyspark.sql import functions as F

from conftest import rows
from workgraph.operators import closure
from workgraph.operators import code as O
from workgraph.operators import flow as W

V = "review_id"


def test_flow_order_golden(frame):
    info = frame([(r, *row) for r in (0, 1) for row in [
        ("h.CreateUser", "CreateUser", "", "handler/handler.go", "http-handler"), ("s.CreateUser", "CreateUser", "", "service/service.go", None),
        ("r.Insert", "Insert", "*Repo", "repo/repo.go", None), ("v.Validate", "Validate", "", "service/validate.go", None),
        ("t.step", "aRequestIsValidated", "", "steps/steps.go", None), ("f#Create.user", "Validate a request", "Create user", "f.feature", "scenario"),
        ("u.helper", "helper", "", "util/util.go", None)]], "repo_id int, id string, name string, receiver string, path string, entry_kind string")
    # The second repository has the same ids and paths, and other calls.
    calls = frame([(0, "h.CreateUser", "s.CreateUser"), (0, "s.CreateUser", "r.Insert"), (0, "t.step", "v.Validate"), (0, "f#Create.user", "t.step"),
                   (1, "u.helper", "r.Insert"), (1, "h.CreateUser", "u.helper")], "repo_id int, from_id string, to_id string")
    paths = ["service/service.go", "repo/repo.go", "service/validate.go", "util/util.go", "README.md"]
    files = frame([("v", 0, p, i) for i, p in enumerate(paths)], f"{V} string, repo_id int, path string, diff_no int")
    changed = frame([("v", 0, i, n) for n, i in enumerate(["s.CreateUser", "r.Insert", "v.Validate", "u.helper"])], f"{V} string, repo_id int, id string, ord int")
    out = W.flow_order(files, changed, calls, info).collect()
    got = [(r.group_no, r.title, r.path, r.why) for r in sorted(out, key=lambda r: (r.group_no or 99, r.pos_in_group))]
    assert got == [
        (1, "handler CreateUser", "service/service.go", "called from handler CreateUser"),
        (1, "handler CreateUser", "repo/repo.go", "called from CreateUser (changed) ← handler CreateUser"),
        (2, "scenario Create user.Validate a request", "service/validate.go", "called from aRequestIsValidated ← scenario Validate a request"),
        (3, "helper (no entry point found)", "util/util.go", "no in-repo callers found"),
        (None, None, "README.md", "")]


def test_flow_walk_has_no_bound_of_its_own(frame):
    """A chain longer than any old depth, a hub wider than any old node count, and a ring whose why-chain must end."""
    chain = [(0, f"c{i + 1:02d}", f"c{i:02d}") for i in range(12)]
    fan = [(0, f"x{i:03d}", "hub") for i in range(620)]
    ring = [(0, f"r{(i + 1) % 4}", f"r{i}") for i in range(4)]
    calls = frame(chain + fan + ring, "repo_id int, from_id string, to_id string")
    ids = sorted({x for _, a, b in chain + fan + ring for x in (a, b)})
    info = frame([(0, i, i, "", f"{i[0]}.go", None) for i in ids], "repo_id int, id string, name string, receiver string, path string, entry_kind string")
    changed = frame([("v", 0, "c00", 0), ("v", 0, "hub", 1), ("v", 0, "r0", 2)], f"{V} string, repo_id int, id string, ord int")
    nodes, edges = W.flow_subgraph(changed, calls, info.filter("entry_kind IS NOT NULL").select("repo_id", "id"))
    assert nodes.count() == 13 + 621 + 4 and edges.count() == 12 + 620 + 4
    assert nodes.filter("cut_off").count() == 0 and nodes.filter("node = 'c12'").first().depth == 12
    why = {r.node: r.why for r in W._why(nodes, edges, info).collect()}
    assert why["c00"].count("←") == 11 and why["r0"] == "called from r1 ← r2 ← r3" and why["hub"] == "called from x000"


def queue_walk(seeds, callers, entries, depth, cap):
    """Nodes and edges in discovery order, one queue, as a person would write it."""
    level = {s: 0 for s in seeds}
    queue, edges = [s for s in level if s not in entries], set()
    while queue and len(level) < cap:
        node = queue.pop(0)
        if level[node] >= depth:
            continue
        for caller in sorted(callers.get(node, ())):
            if len(level) >= cap:
                break
            if caller not in level:
                level[caller] = level[node] + 1
                if caller not in entries:
                    queue.append(caller)
            edges.add((caller, node))
    return level, edges


def test_walk_caps_match_a_queue(frame):
    rng = random.Random(11)
    for cap in (6, 9, 100):
        name = lambda i: f"n{i:02d}"
        made = {(name(rng.randrange(20)), name(rng.randrange(20))) for _ in range(45)}
        entries = {name(i) for i in rng.sample(range(20), 4)}
        seeds = {f"v{k}": rng.sample([name(i) for i in range(20)], rng.randrange(1, 8)) for k in range(12)}
        changed = frame([(v, s, i) for v, ss in seeds.items() for i, s in enumerate(ss)], f"{V} string, id string, ord int").withColumn("repo_id", F.lit(7))
        nodes, edges = W.flow_subgraph(changed, frame(list(made), "from_id string, to_id string").withColumn("repo_id", F.lit(7)),
                                       frame([(e,) for e in entries], "id string").withColumn("repo_id", F.lit(7)),
                                       depth=3, max_nodes=cap)
        callers = {}
        for a, b in made:
            callers.setdefault(b, set()).add(a)
        got_nodes = {(r[V], r.node): r.depth for r in nodes.collect()}
        got_edges = {tuple(r) for r in edges.select(V, "caller", "callee").collect()}
        for v, ss in seeds.items():
            level, found = queue_walk(ss, callers, entries, 3, cap)
            assert {n: d for (w, n), d in got_nodes.items() if w == v} == level
            assert {(a, b) for w, a, b in got_edges if w == v} == found


def test_radius_of_a_changed_signature(frame):
    # Repository 1 has the same paths and ids; nothing of it may turn up.
    both = lambda made, schema: frame([(r, *row) for r in (0, 1) for row in made], "repo_id int, " + schema)
    symbols = both([("f", "f", "func", "a.go", 1, 5), ("g", "g", "func", "b.go", 1, 5), ("h", "h", "func", "c.go", 1, 5), ("I.f", "f", "method", "d.go", 1, 2)],
                   "id string, name string, kind string, path string, start_line int, end_line int")
    changes = frame([("v", 0, "f", "modified", True, "func"), ("v", 0, "g", "modified", False, "func"), ("v", 0, "x", "deleted", False, "func")],
                    f"{V} string, repo_id int, id string, change string, signature_changed boolean, kind string")
    calls = frame([(0, "g", "f", "b.go", 3), (0, "h", "f", "c.go", 2), (1, "z", "f", "c.go", 2)], "repo_id int, from_id string, to_id string, site_path string, site_line int")
    impls = frame([(0, "f", "I.f"), (1, "f", "J.f")], "repo_id int, from_id string, to_id string")
    hunks = frame([("v", 0, "a.go", 1, 2), ("v", 0, "b.go", 3, 1), ("v", 1, "c.go", 1, 9)], f"{V} string, repo_id int, path string, new_start int, new_lines int")
    assert rows(O.func_radius(changes, calls, impls, symbols, hunks), "symbol", "part", "other", "in_diff") == [
        ("f", "caller", "h", False), ("f", "impl", "I.f", False), ("f", "site", "g", True), ("f", "site", "h", False)]


def test_changes_stay_in_their_repository(frame):
    symbols = frame([(1, "a.f", "main.go", "func", "f()", 1, 9, 1), (2, "b.g", "main.go", "func", "g()", 1, 9, 1), (2, "a.f", "main.go", "func", "f(x)", 20, 29, 2)],
                    "repo_id int, id string, path string, kind string, signature string, start_line int, end_line int, ord int")
    hunks = frame([("v", 1, "main.go", 2, 1, 2, 1)], f"{V} string, repo_id int, path string, new_start int, new_lines int, old_start int, old_lines int")
    assert rows(O.changed_symbols(symbols, hunks)) == [("v", 1, "a.f")]
    olds = frame([("v", 1, "main.go", "modified")], f"{V} string, repo_id int, old_path string, status string")
    assert rows(O.changed_symbols_detailed(symbols, symbols, hunks, olds)) == [("v", 1, "a.f", "modified", False)]
    points = frame([(1, "main.go", 3), (2, "main.go", 3), (2, "main.go", 25), (3, "main.go", 3)], "repo_id int, path string, line int")
    assert rows(O.enclosing_symbol(points, symbols)) == [(1, "main.go", 3, "a.f"), (2, "main.go", 3, "b.g"), (2, "main.go", 25, "a.f")]


def test_reach_lists_closest_tests_and_a_command(frame):
    calls = frame([(0, "TestA", "mid"), (0, "mid", "f"), (0, "TestB", "f"), (1, "TestA", "f")], "repo_id int, from_id string, to_id string")
    tests = frame([(0, "TestA", "TestA", "pkg/a_test.go"), (0, "TestB", "Test.B", "b_test.go"), (1, "TestA", "TestA", "sub/mod/pkg/a_test.go")],
                  "repo_id int, id string, name string, path string")
    asked = frame([("v", 0, "f"), ("v", 0, "lonely"), ("w", 1, "f")], f"{V} string, repo_id int, id string")
    hits = O.reach_from_tests(calls, tests)
    got = {(r[V], r.id): r for r in O.test_reach(asked, hits).collect()}
    near = O.nearest_tests(calls, tests, asked)
    assert {(r[V], r.id): r for r in O.test_reach(asked, near).collect()} == got
    assert got["v", "f"].reached and got["v", "f"].tests == ["TestB", "TestA"] and got["v", "f"].path == ["TestB", "f"] and not got["v", "lonely"].reached
    modules = frame([(0, "."), (1, "sub"), (1, "sub/mod")], "repo_id int, module_dir string")
    assert rows(O.test_commands(O.reaching_tests(asked, calls, tests), tests, modules), V, "dir", "command") == [
        ("v", ".", "go test . -run '^(Test\\.B)$'"), ("v", "pkg", "go test ./pkg -run '^(TestA)$'"),
        ("w", "sub/mod/pkg", "cd sub/mod && go test ./pkg -run '^(TestA)$'")]


def test_reach_has_no_bound_of_its_own(frame):
    calls = frame([(0, f"n{i:02d}", f"n{i + 1:02d}") for i in range(14)] + [(0, f"T{i}", "n13") for i in range(8)], "repo_id int, from_id string, to_id string")
    tests = frame([(0, "n00", "TestFar", "far_test.go")] + [(0, f"T{i}", f"Test{i}", "near_test.go") for i in range(8)], "repo_id int, id string, name string, path string")
    asked = frame([("v", 0, "n14")], f"{V} string, repo_id int, id string")
    hits = O.reach_from_tests(calls, tests)
    assert hits.filter("test = 'n00' AND id = 'n14'").first().depth == 14
    commands = O.test_commands(O.reaching_tests(asked, calls, tests), tests).first()
    assert commands.tests.split(",") == sorted(["TestFar", *[f"Test{i}" for i in range(8)]])


def test_implements_needs_every_method(frame):
    need = frame([(0, "I", "a"), (0, "I", "b"), (0, "J", "a"), (1, "J", "b")], "repo_id int, iface_id string, method string")
    have = frame([(0, "T", "a"), (0, "T", "b"), (0, "U", "a"), (1, "U", "a")], "repo_id int, type_id string, method string")
    assert rows(O.implements(need, have)) == [(0, "I", "T"), (0, "J", "T"), (0, "J", "U")]
    declared = frame([(0, "I"), (0, "Any"), (1, "I")], "repo_id int, iface_id string")
    assert rows(O.open_interfaces(declared, need)) == [(0, "Any", True), (0, "I", False), (1, "I", True)]


def test_first_rule_wins_a_tie(frame):
    symbols = frame([(0, "x", "doWork", "func", "a.go", "", "lib", "func()", False)],
                    "repo_id int, id string, name string, kind string, path string, receiver string, package_name string, shape string, exported boolean")
    found = O.entry_points(symbols, None, [("Work$", "", "zebra"), ("^do", "", "apple")])
    assert rows(O.entry_point_index(found), "id", "reason") == [("x", "zebra")]


def test_rounds_of_the_flow_walk_do_not_depend_on_reviews(frame, monkeypatch):
    """A walk writes rows of symbols, however many reviews changed them; each review still gets its own whole answer."""
    from workgraph.operators import closure
    from workgraph.session import cut
    written = []
    chain = [(0, f"c{i + 1:02d}", f"c{i:02d}") for i in range(9)] + [(0, "c05", "side"), (1, "c01", "c00")]
    calls = frame(chain, "repo_id int, from_id string, to_id string")
    entries = frame([(0, "c07")], "repo_id int, id string")

    def counted(df):
        out = cut(df)
        written.append(out.count() if V not in out.columns else 0)
        return out

    monkeypatch.setattr(W, "cut", counted)
    monkeypatch.setattr(closure, "cut", counted)
    totals = []
    for reviews in (1, 30):
        written.clear()
        changed = frame([(f"v{k}", 0, i, n) for k in range(reviews) for n, i in enumerate(["c00", "side", "c05", "c09"])], f"{V} string, repo_id int, id string, ord int")
        nodes, edges = W.flow_subgraph(changed, calls, entries)
        per = {f"c{i:02d}": d for i, d in enumerate([0, 1, 2, 3, 4, 0, 1, 2])} | {"side": 0, "c09": 0}
        assert {(r[V], r.node): r.depth for r in nodes.collect()} == {(f"v{k}", n): d for k in range(reviews) for n, d in per.items()}
        assert edges.count() == reviews * 8 and nodes.filter("is_entry").count() == reviews and nodes.filter("changed").count() == 4 * reviews
        assert nodes.filter("node = 'c06'").first().path == ["000000000002", "c06"]
        totals.append(sum(written))
        assert set(W.flow_subgraph(changed, calls, entries, paths=False)[0].columns) == set(nodes.columns) - {"path"}
    assert totals[0] == totals[1]


def test_flow_order_writes_a_review_as_its_changed_symbols(frame, monkeypatch):
    """Neither components nor layers nor chains write a row per review and node above its symbols; a loop's review is peeled on its own."""
    from workgraph.operators import closure
    from workgraph.session import cut
    written = []

    def counted(df):
        out = cut(df)
        if V in out.columns or "_t" in out.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(W, "cut", counted)
    monkeypatch.setattr(closure, "cut", counted)
    chain = [(0, f"c{i + 1}", f"c{i}") for i in range(6)] + [(0, "l1", "l0"), (0, "l0", "l1")]
    calls = frame(chain, "repo_id int, from_id string, to_id string")
    info = frame([(0, i, i, "", f"{i[0]}.go", "main" if i == "c6" else None) for i in ["l0", "l1", *[f"c{i}" for i in range(7)]]],
                 "repo_id int, id string, name string, receiver string, path string, entry_kind string")
    changed = frame([(f"v{k}", 0, "c0", 0) for k in range(9)] + [("w", 0, "l1", 0)], f"{V} string, repo_id int, id string, ord int")
    files = frame([(f"v{k}", 0, "c.go", 0) for k in range(9)] + [("w", 0, "l.go", 0)], f"{V} string, repo_id int, path string, diff_no int")
    out = {r[V]: r for r in W.flow_order(files, changed, calls, info).collect()}
    assert len(out) == 10 and all(out[f"v{k}"].entry_id == "c6" and out[f"v{k}"].why.count("←") == 5 for k in range(9))
    assert out["w"].title == "l1 (no entry point found)" and out["w"].why == "called from l0"
    assert max(written) <= 10


def test_reaching_tests_walk_by_review(frame, monkeypatch):
    """Wanted tests count only by another wanted function; no walk is taken apart into rows of function and test."""
    def refuse(*_):
        raise AssertionError("a row per function and test")
    monkeypatch.setattr(closure, "unpacked", refuse)
    rng = random.Random(5)
    edges = {(r, f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for r in range(6) for _ in range(rng.randrange(16))}
    asked = {(v, r, f"n{rng.randrange(9)}") for r in range(6) for v in [None, *range(70)] for _ in range(rng.randrange(4))}
    tests = {(r, f"n{i}") for r in range(6) for i in range(0, 9, 2)}
    reach = set(edges)
    while more := {(r, a, c) for r, a, b in reach for s, x, c in edges if (s, x) == (r, b)} - reach:
        reach |= more
    want = {(v, r, t) for v, r, f in asked for q, t in tests if q == r and t != f and (r, t, f) in reach}
    got = O.reaching_tests(frame([*asked, *asked, (1, 0, None)], "review_id int, repo_id int, id string"),
                           frame([*edges, (0, "n1", None), (0, None, "n2")], "repo_id int, from_id string, to_id string"),
                           frame([*tests, (0, None)], "repo_id int, id string")).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want


def _behind(edges, node):
    """What ``node`` reaches over at least one edge."""
    seen, todo = set(), [b for a, b in edges if a == node]
    while todo:
        at = todo.pop()
        if at not in seen:
            seen.add(at)
            todo += [b for a, b in edges if a == at]
    return seen


def test_named_reaching_tests_against_brute_force(frame):
    """Tests that share a directory and a name stand for each other only where one of them reaches what is wanted."""
    rng = random.Random(4)
    edges = {r: sorted({(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(17)}) for r in range(6)}
    asked = sorted({(v, r, f"n{rng.randrange(14)}") for r in edges for v in range(70) for _ in range(1 + v % 3)})
    tests = [(r, f"n{i}", f"T{i % 3}", f"d{i % 2}/x_test.go") for r in edges for i in range(9)] + [(0, "n1", "again", "e/x_test.go")]
    by_test, named = set(), set()
    for r, calls in edges.items():
        wanted = {v: {i for w, s, i in asked if (w, s) == (v, r)} for v in range(70)}
        for _, i, name, path in [t for t in tests if t[0] == r]:
            for v, ids in wanted.items():
                if (_behind(calls, i) - {i}) & ids:
                    by_test.add((v, r, i))
                    named.add((v, r, path.split("/")[0], name))
    calls = frame([(r, *e) for r in edges for e in edges[r]], "repo_id int, from_id string, to_id string")
    wanted = frame(asked, f"{V} int, repo_id int, id string")
    cases = frame(tests, "repo_id int, id string, name string, path string")
    got = O.reaching_tests(wanted, calls, cases, named=True)
    assert sorted(map(tuple, got.select(V, "repo_id", "dir", "name").collect())) == sorted(named)
    plain = O.reaching_tests(wanted, calls, cases)
    assert sorted(map(tuple, plain.select(V, "repo_id", "test").collect())) == sorted(by_test)
    assert rows(O.test_commands(got, cases)) == rows(O.test_commands(plain, cases))


def test_reaching_tests_walk_loops_as_one_node(frame, monkeypatch):
    """What is walked has a row a loop: the nodes of a loop of forty are one."""
    seen, plain = [], closure.packed_reach

    def watched(edges, *args, **kwargs):
        seen.append(edges.count())
        return plain(edges, *args, **kwargs)

    monkeypatch.setattr(closure, "packed_reach", watched)
    calls = frame([(0, f"n{i}", f"n{(i + 1) % 40}") for i in range(40)] + [(0, "t", "n0"), (0, "n5", "z")], "repo_id int, from_id string, to_id string")
    cases = frame([(0, "t", "T", "d/x_test.go"), (0, "n3", "U", "d/x_test.go")], "repo_id int, id string, name string, path string")
    got = O.reaching_tests(frame([("v", 0, "z"), ("w", 0, "n3")], f"{V} string, repo_id int, id string"), calls, cases)
    assert sorted(map(tuple, got.select(V, "test").collect())) == [("v", "n3"), ("v", "t"), ("w", "t")]
    assert seen == [2]


def test_closest_tests_of_a_function_asked_for_twice(frame):
    """The closest tests are worked out once a symbol; a function asked for twice counts each test twice, a review without an id none."""
    hits = frame([(0, f"t{i}", "f", 1 + i // 2, [f"t{i}", "f"]) for i in range(6)], "repo_id int, test string, id string, depth int, path array<string>")
    asked = frame([("v", 0, "f"), ("w", 0, "f"), ("w", 0, "f"), (None, 0, "f"), ("v", 0, "g")], f"{V} string, repo_id int, id string")
    got = sorted(((r[V] or "", r.id, r.reached, r.tests, r.path) for r in O.test_reach(asked, hits).collect()))
    five, twice = [f"t{i}" for i in range(5)], ["t0", "t0", "t1", "t1", "t2"]
    assert got == [("", "f", False, None, None), ("v", "f", True, five, ["t0", "f"]), ("v", "g", False, None, None),
                   ("w", "f", True, twice, ["t0", "f"]), ("w", "f", True, twice, ["t0", "f"])]


def test_reach_from_tests_without_paths(frame):
    rng = random.Random(6)
    calls = frame(sorted({(r, f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for r in (0, 1) for _ in range(150)}), "repo_id int, from_id string, to_id string")
    tests = frame([(r, f"n{i}") for r in (0, 1) for i in range(80)], "repo_id int, id string")
    for bound in (None, 2):
        whole = O.reach_from_tests(calls, tests, bound).drop("path")
        short = O.reach_from_tests(calls, tests, bound, paths=False)
        assert short.dtypes == whole.dtypes and rows(short) == rows(whole)

"""Board queries over issues derived from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from workgraph.functions import ids as X
from workgraph.operators import board as O
from workgraph.operators import closure
from workgraph.plans.registry import query

B = "board_id"

_OPEN = """openb AS (SELECT e.* FROM edges e LEFT JOIN issues d ON d.board_id = e.board_id AND d.id = e.dep
    WHERE d.id IS NULL OR d.status <> 'done')"""
_RANK = "CASE coalesce({0}, 'normal') WHEN 'must' THEN 0 WHEN 'high' THEN 1 WHEN 'normal' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"


def _rank(c):
    return _RANK.format(c)


_NUM = "CAST(substr({0}, 4) AS BIGINT)"


def _waits(edges="edges"):
    """Every (start, node) where node transitively waits on start, with its depth-first-found shortest depth."""
    return f"""step AS (SELECT DISTINCT board_id, dep AS a, src AS b FROM {edges}),
walk AS (SELECT board_id, a AS start, b AS node, 1 AS depth FROM step WHERE a <> b
  UNION SELECT w.board_id, w.start, s.b, w.depth + 1 FROM walk w JOIN step s ON s.board_id = w.board_id AND s.a = w.node
    WHERE s.b <> w.start AND w.depth < 60),
waits AS (SELECT board_id, start, node, min(depth) AS depth FROM walk GROUP BY 1, 2, 3)"""


# The acyclic walk with the path of sibling numbers, as a queue would visit it.
_PATHS = f"""step AS (SELECT DISTINCT board_id, dep AS a, src AS b FROM edges),
walk AS (SELECT board_id, a AS start, b AS node, 1 AS depth, [{_NUM.format('b')}] AS path FROM step
  UNION ALL SELECT w.board_id, w.start, s.b, w.depth + 1, list_append(w.path, {_NUM.format('s.b')}) FROM walk w
    JOIN step s ON s.board_id = w.board_id AND s.a = w.node),
waits AS (SELECT board_id, start, node, min(depth) AS depth, arg_min(path, (depth, path)) AS path FROM walk GROUP BY 1, 2, 3)"""
_LEV = _PATHS + f""",
lev0 AS (SELECT i.board_id, i.id, i.status, i.priority, i.pos, i.title, i.updated_at, i.okey,
    count(d.id) AS unblocks, count(CASE WHEN {_rank('d.priority')} <= 1 AND d.id IS NOT NULL THEN 1 END) AS unblocks_urgent,
    min(CASE WHEN d.id IS NOT NULL THEN {_rank('d.priority')} END) AS best,
    arg_min(d.id, ({_rank('d.priority')}, w.depth, w.path)) FILTER (d.id IS NOT NULL) AS best_id
  FROM issues i LEFT JOIN waits w ON w.board_id = i.board_id AND w.start = i.id
  LEFT JOIN issues d ON d.board_id = w.board_id AND d.id = w.node AND d.status <> 'done'
  GROUP BY ALL),
lev1 AS (SELECT *, {_rank('priority')} AS own, CASE WHEN unblocks >= 10 THEN 0 WHEN unblocks >= 3 THEN 1 ELSE 9 END AS floor_rank FROM lev0),
lev AS (SELECT *, CASE least(own, coalesce(best, 9), floor_rank) WHEN 0 THEN 'must' WHEN 1 THEN 'high' WHEN 2 THEN 'normal' ELSE 'low' END AS urgency,
    CASE WHEN floor_rank < least(own, coalesce(best, 9)) THEN '' WHEN best < own THEN best_id ELSE '' END AS urgency_from FROM lev1)"""
_READY = _OPEN + """,
can AS (SELECT i.* FROM issues i WHERE i.status <> 'done'
    AND NOT EXISTS (SELECT 1 FROM openb o WHERE o.board_id = i.board_id AND o.src_pos = i.pos))"""
_VIEW = _LEV + ", " + _OPEN + """,
ob AS (SELECT board_id, src_pos AS pos, count(*) AS open_blockers, string_agg(dep, ',' ORDER BY dep_pos) AS open_blocker_ids
    FROM openb GROUP BY 1, 2),
bl AS (SELECT board_id, a AS id, count(*) AS blocks FROM step GROUP BY 1, 2),
view_ AS (SELECT l.board_id, l.pos, l.id, l.status, coalesce(l.priority, 'normal') AS priority, l.unblocks, l.unblocks_urgent,
    l.urgency, l.urgency_from, coalesce(ob.open_blockers, 0) AS open_blockers, coalesce(ob.open_blocker_ids, '') AS open_blocker_ids,
    coalesce(bl.blocks, 0) AS blocks, l.status <> 'done' AND ob.pos IS NULL AS ready
  FROM lev l LEFT JOIN ob ON ob.board_id = l.board_id AND ob.pos = l.pos LEFT JOIN bl ON bl.board_id = l.board_id AND bl.id = l.id)"""
_VIEW_COLS = ["board_id", "pos", "id", "status", "priority", "unblocks", "unblocks_urgent", "urgency", "urgency_from",
              "open_blockers", "open_blocker_ids", "blocks", "ready"]


@query("open_blockers", "WITH " + _OPEN + " SELECT board_id, src, dep, dep_pos FROM openb")
def open_blockers(t):
    return O.open_blockers(t.issues, t.edges).select(B, "src", "dep", "dep_pos")


@query("ready", "WITH " + _READY + " SELECT board_id, id, status FROM can")
def ready(t):
    return O.ready(t.issues, t.edges).select(B, "id", "status")


@query("blocks", "SELECT DISTINCT board_id, dep AS id, src AS waiter FROM edges_cyclic")
def blocks(t):
    return O.blocks(t.edges_cyclic).select(B, "id", "waiter")


@query("dangling", """SELECT e.board_id, e.src, e.dep FROM edges_cyclic e JOIN issues i ON i.board_id = e.board_id AND i.pos = e.src_pos
    WHERE i.status <> 'done' AND NOT EXISTS (SELECT 1 FROM issues d WHERE d.board_id = e.board_id AND d.id = e.dep)""")
def dangling(t):
    return O.dangling(t.issues, t.edges_cyclic).select(B, "src", "dep")


_DEPS = """step AS (SELECT DISTINCT board_id, src AS a, dep AS b FROM edges_cyclic),
walk AS (SELECT board_id, a AS start, b AS node FROM step
  UNION SELECT w.board_id, w.start, s.b FROM walk w JOIN step s ON s.board_id = w.board_id AND s.a = w.node)"""


@query("deps", "WITH " + _DEPS + " SELECT board_id, start, node FROM walk WHERE start <> node")
def deps(t):
    return O.deps(t.issues, t.edges_cyclic).select(B, "start", "node")


@query("deps_ordered", f"""WITH step AS (SELECT board_id, src AS a, dep AS b, min(dep_pos) AS o FROM edges GROUP BY 1, 2, 3),
walk AS (SELECT board_id, a AS start, b AS node, 1 AS depth, [o] AS path FROM step
  UNION ALL SELECT w.board_id, w.start, s.b, w.depth + 1, list_append(w.path, s.o) FROM walk w
    JOIN step s ON s.board_id = w.board_id AND s.a = w.node)
SELECT board_id, start, node, min(depth) AS depth,
  array_to_string(arg_min(path, (depth, path)), '.') AS visit FROM walk GROUP BY 1, 2, 3""")
def deps_ordered(t):
    return O.deps(t.issues, t.edges).select(B, "start", "node", "depth",
                                            F.array_join(F.transform("path", lambda p: p.cast("string")), ".").alias("visit"))


@query("dependents", """WITH step AS (SELECT DISTINCT board_id, dep AS a, src AS b FROM edges_cyclic),
walk AS (SELECT board_id, a AS start, b AS node FROM step
  UNION SELECT w.board_id, w.start, s.b FROM walk w JOIN step s ON s.board_id = w.board_id AND s.a = w.node)
SELECT board_id, start, node FROM walk WHERE start <> node""")
def dependents(t):
    return O.dependents(t.edges_cyclic, ordered=False).select(B, "start", "node")


@query("unblocks", "WITH " + _LEV + " SELECT board_id, id, unblocks, unblocks_urgent FROM lev")
def unblocks(t):
    return O.unblocks(t.issues, t.edges)


@query("urgency", "WITH " + _LEV + " SELECT board_id, id, urgency, urgency_from FROM lev")
def urgency(t):
    return O.leverage(t.issues, t.edges).select(B, "id", "urgency", "urgency_from")


@query("board_view", "WITH " + _VIEW + " SELECT * FROM view_")
def board_view(t):
    return O.board_view(t.issues, t.edges).select(*_VIEW_COLS)


@query("list_issues", "WITH " + _VIEW + """ SELECT board_id, id, status, urgency FROM view_
    WHERE status = 'todo' AND urgency = 'high' AND ready""")
def list_issues(t):
    return O.list_issues(O.board_view(t.issues, t.edges), status="todo", priority="high", ready=True) \
        .select(B, "id", "status", "urgency")


@query("list_blocked", "WITH " + _VIEW + " SELECT board_id, id, status, open_blockers FROM view_ WHERE open_blockers > 0")
def list_blocked(t):
    return O.list_issues(O.board_view(t.issues, t.edges), blocked=True).select(B, "id", "status", "open_blockers")


@query("progress_cells", "WITH " + _VIEW + """ SELECT board_id, id,
    urgency || CASE WHEN urgency <> priority THEN '↑' ELSE '' END AS priority_cell,
    CASE WHEN urgency = priority THEN '' WHEN urgency_from <> '' THEN 'raised to ' || urgency || ' by ' || urgency_from || ', which waits on this'
      ELSE 'raised to ' || urgency || ': ' || unblocks || ' issues are waiting on this' END AS why FROM view_""")
def progress_cells(t):
    return O.progress_cells(O.board_view(t.issues, t.edges)).select(B, "id", "priority_cell", "why")


_QUEUE = "WITH " + _LEV + ", " + _READY + f""",
q AS (SELECT l.board_id, l.id, l.urgency, l.unblocks, row_number() OVER (PARTITION BY l.board_id ORDER BY
    CASE WHEN l.urgency = 'must' THEN 0 ELSE 1 END, l.unblocks DESC, l.unblocks_urgent DESC, {_rank('l.urgency')},
    CASE WHEN l.status = 'doing' THEN 0 ELSE 1 END, l.pos) AS place
  FROM lev l JOIN can c ON c.board_id = l.board_id AND c.pos = l.pos)"""


@query("ready_queue", _QUEUE + " SELECT * FROM q")
def ready_queue(t):
    return O.next_queue(t.issues, t.edges).select(B, "id", "urgency", "unblocks", "place")


@query("next_queue", _QUEUE + " SELECT * FROM q WHERE place <= 3")
def next_queue(t):
    return O.next_queue(t.issues, t.edges, n=3).select(B, "id", "urgency", "unblocks", "place")


# Loop members: open issues that reach themselves; the smallest number they reach both ways names the loop.
_LOOPS = f"""live AS (SELECT DISTINCT e.board_id, {_NUM.format('e.src')} AS a, {_NUM.format('e.dep')} AS b FROM edges_cyclic e
    JOIN issues i ON i.board_id = e.board_id AND i.id = e.src AND i.status <> 'done'
    JOIN issues j ON j.board_id = e.board_id AND j.id = e.dep AND j.status <> 'done'),
lw AS (SELECT board_id, a, b FROM live UNION SELECT w.board_id, w.a, s.b FROM lw w JOIN live s ON s.board_id = w.board_id AND s.a = w.b),
looped AS (SELECT x.board_id, x.a AS n, min(x.b) AS loop FROM lw x JOIN lw y ON y.board_id = x.board_id AND y.a = x.b AND y.b = x.a
    GROUP BY 1, 2)"""


@query("cycles", "WITH " + _LOOPS + " SELECT board_id, 'TH-' || loop AS loop, 'TH-' || n AS id FROM looped")
def cycles(t):
    return O.cycles(t.issues, t.edges_cyclic)


@query("witness_loops", "WITH " + _LOOPS + """,
ins AS (SELECT DISTINCT l.board_id, p.loop, l.a, l.b FROM live l JOIN looped p ON p.board_id = l.board_id AND p.n = l.a
    JOIN looped q ON q.board_id = l.board_id AND q.n = l.b AND q.loop = p.loop),
wk AS (SELECT board_id, loop, b AS n, 1 AS depth FROM ins WHERE a = loop
    UNION SELECT w.board_id, w.loop, s.b, w.depth + 1 FROM wk w JOIN ins s ON s.board_id = w.board_id AND s.loop = w.loop AND s.a = w.n
      WHERE w.n <> w.loop AND w.depth < 40)
SELECT board_id, 'TH-' || loop AS loop, min(depth) AS length FROM wk WHERE n = loop GROUP BY 1, 2""")
def witness_loops(t):
    return O.witness_loops(t.issues, t.edges_cyclic).select(B, "loop", F.size("witness").alias("length"))


@query("forced_pick", "WITH " + _LOOPS + f""",
openb AS (SELECT e.* FROM edges_cyclic e LEFT JOIN issues d ON d.board_id = e.board_id AND d.id = e.dep
    WHERE d.id IS NULL OR d.status <> 'done'),
can AS (SELECT DISTINCT i.board_id FROM issues i WHERE i.status <> 'done'
    AND NOT EXISTS (SELECT 1 FROM openb o WHERE o.board_id = i.board_id AND o.src_pos = i.pos)),
dw AS (SELECT DISTINCT board_id, dep AS a, src AS b FROM edges_cyclic
    UNION SELECT w.board_id, w.a, s.src FROM dw w JOIN edges_cyclic s ON s.board_id = w.board_id AND s.dep = w.b),
dc AS (SELECT board_id, a AS id, count(DISTINCT b) AS dependents FROM dw WHERE a <> b GROUP BY 1, 2),
pick AS (SELECT i.board_id, i.id, coalesce(dc.dependents, 0) AS dependents, row_number() OVER (PARTITION BY i.board_id
    ORDER BY {_rank('i.priority')}, coalesce(dc.dependents, 0) DESC, i.pos) AS rn
  FROM issues i LEFT JOIN dc ON dc.board_id = i.board_id AND dc.id = i.id
  WHERE i.status <> 'done' AND i.board_id NOT IN (SELECT board_id FROM can)),
miss AS (SELECT DISTINCT e.board_id FROM edges_cyclic e JOIN issues i ON i.board_id = e.board_id AND i.pos = e.src_pos
    WHERE i.status <> 'done' AND NOT EXISTS (SELECT 1 FROM issues d WHERE d.board_id = e.board_id AND d.id = e.dep))
SELECT board_id, id, dependents, CASE WHEN board_id IN (SELECT board_id FROM looped) THEN 'loop'
    WHEN board_id IN (SELECT board_id FROM miss) THEN 'missing' ELSE 'waiting' END AS cause FROM pick WHERE rn = 1""")
def forced_pick(t):
    return O.forced_pick(t.issues, t.edges_cyclic).select(B, "id", "dependents", "cause")


@query("status_counts", """SELECT c.c_custkey AS board_id, count(CASE WHEN i.status <> 'done' THEN 1 END) AS open,
    count(CASE WHEN i.status = 'done' THEN 1 END) AS done, CASE WHEN count(i.id) = 0 THEN 'empty'
    WHEN count(CASE WHEN i.status <> 'done' THEN 1 END) = 0 THEN 'all done' ELSE 'open' END AS state
    FROM customer c LEFT JOIN issues i ON i.board_id = c.c_custkey GROUP BY 1""")
def status_counts(t):
    return O.status_counts(t.customer.select(F.col("c_custkey").alias(B)), t.issues)


_DUP = """held AS (SELECT board_id, id, count(*) AS holders FROM issues_dup GROUP BY 1, 2),
dup AS (SELECT h.board_id, h.id, h.holders, d.id IS NOT NULL AS retired FROM held h
    LEFT JOIN (SELECT DISTINCT board_id, id FROM done_log) d ON d.board_id = h.board_id AND d.id = h.id
    WHERE h.holders > 1 OR d.id IS NOT NULL)"""


@query("duplicates", "WITH " + _DUP + """ SELECT i.board_id, i.id, i.pos, i.title, dup.holders, dup.retired
    FROM issues_dup i JOIN dup ON dup.board_id = i.board_id AND dup.id = i.id""")
def duplicates(t):
    return O.duplicates(t.issues_dup, t.done_log)


_NEXT = """nums AS (SELECT board_id, max(CAST(substr(id, 4) AS BIGINT)) AS used FROM
      (SELECT board_id, id FROM issues_dup UNION ALL SELECT board_id, id FROM done_log) x GROUP BY 1),
nxt AS (SELECT b.board_id, greatest(b.next_id, coalesce(n.used + 1, 0), 1) AS next_id FROM boards b LEFT JOIN nums n USING (board_id))"""


@query("mint_ids", "WITH " + _NEXT + """ SELECT r.board_id, r.okey AS seq, 'TH-' || (n.next_id - 1 +
    row_number() OVER (PARTITION BY r.board_id ORDER BY r.okey)) AS id
    FROM (SELECT board_id, okey FROM issues WHERE status = 'doing') r JOIN nxt n USING (board_id)""")
def mint_ids(t):
    requests = t.issues.filter("status = 'doing'").select(B, F.col("okey").alias("seq"))
    return O.mint_ids(t.boards, t.issues_dup, t.done_log, requests)


_MOVES = _NEXT + """,
mv0 AS (SELECT i.board_id, i.pos, i.id, i.title FROM (SELECT *, min(pos) OVER (PARTITION BY board_id, id) AS first_pos FROM issues_dup) i
    WHERE i.pos <> i.first_pos OR EXISTS (SELECT 1 FROM done_log d WHERE d.board_id = i.board_id AND d.id = i.id)),
mv AS (SELECT m.board_id, m.pos, m.id AS from_id, 'TH-' || (n.next_id - 1 + row_number() OVER (PARTITION BY m.board_id ORDER BY m.pos)) AS to_id,
    m.title FROM mv0 m JOIN nxt n USING (board_id))"""


@query("renumber", "WITH " + _MOVES + " SELECT * FROM mv")
def renumber(t):
    return O.renumber(t.boards, t.issues_dup, t.done_log)


@query("renumber_edges", "WITH " + _MOVES + """,
fm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY board_id, from_id ORDER BY pos) AS rn FROM mv) x WHERE rn = 1),
now AS (SELECT i.board_id, i.pos, coalesce(m.to_id, i.id) AS id FROM issues_dup i LEFT JOIN mv m ON m.board_id = i.board_id AND m.pos = i.pos),
gone AS (SELECT * FROM fm WHERE NOT EXISTS (SELECT 1 FROM now n WHERE n.board_id = fm.board_id AND n.id = fm.from_id))
SELECT e.board_id, e.src_pos, n.id AS src, coalesce(g.to_id, e.dep) AS dep, e.dep_pos FROM edges e
  JOIN now n ON n.board_id = e.board_id AND n.pos = e.src_pos
  LEFT JOIN gone g ON g.board_id = e.board_id AND g.from_id = e.dep""")
def renumber_edges(t):
    moves = O.renumber(t.boards, t.issues_dup, t.done_log)
    return O.apply_renumber(t.issues_dup, t.edges, moves)[1].select(B, "src_pos", "src", "dep", "dep_pos")


_CUT = "TIMESTAMP '1998-06-01 00:00:00'"


def _cutoff():
    return F.lit("1998-06-01 00:00:00").cast("timestamp_ntz")


@query("archive_done", f"""WITH mv AS (SELECT * FROM issues WHERE status = 'done' AND updated_at < {_CUT}),
dr AS (SELECT e.board_id, count(*) AS dropped FROM edges e JOIN mv d ON d.board_id = e.board_id AND d.id = e.dep
    WHERE NOT EXISTS (SELECT 1 FROM mv s WHERE s.board_id = e.board_id AND s.pos = e.src_pos) GROUP BY 1)
SELECT m.board_id, count(*) AS moved, coalesce(max(dr.dropped), 0) AS dropped FROM mv m LEFT JOIN dr USING (board_id) GROUP BY 1""")
def archive_done(t):
    return O.archive_report(t.issues, t.edges, _cutoff())


@query("archive_kept_edges", f"""SELECT e.board_id, e.src, e.dep FROM edges e
    JOIN issues s ON s.board_id = e.board_id AND s.pos = e.src_pos JOIN issues d ON d.board_id = e.board_id AND d.id = e.dep
    WHERE NOT (s.status = 'done' AND s.updated_at < {_CUT}) AND NOT (d.status = 'done' AND d.updated_at < {_CUT})""")
def archive_kept_edges(t):
    return O.archive_done(t.issues, t.edges, _cutoff())[2].select(B, "src", "dep")


@query("show_issue", """WITH want AS (SELECT board_id, id FROM edges_wanted), f AS (
  SELECT i.board_id, i.id, i.title, i.status, false AS archived, i.pos FROM issues i JOIN want USING (board_id, id)),
n AS (SELECT f.board_id, f.id, 'blocked_by' AS direction, e.dep AS other FROM f JOIN edges_cyclic e ON e.board_id = f.board_id AND e.src_pos = f.pos
  UNION ALL SELECT DISTINCT f.board_id, f.id, 'blocks', e.src FROM f JOIN edges_cyclic e ON e.board_id = f.board_id AND e.dep = f.id)
SELECT f.board_id, f.id, f.title, f.status, f.archived, n.direction, n.other || ' (' || coalesce(o.status, 'missing') || ')' AS note
FROM f LEFT JOIN n ON n.board_id = f.board_id AND n.id = f.id LEFT JOIN issues o ON o.board_id = n.board_id AND o.id = n.other"""
       .replace("SELECT board_id, id FROM edges_wanted", "SELECT board_id, max_by(id, pos) AS id FROM issues GROUP BY board_id"))
def show_issue(t):
    wanted = t.issues.groupBy(B).agg(F.max_by("id", "pos").alias("id"))
    return O.show_issue(t.issues, t.done_log, t.edges_cyclic, wanted).drop("priority")


@query("layered_passes", """WITH bad AS (
    SELECT e.board_id, e.src AS id FROM edges_cyclic e WHERE NOT EXISTS (SELECT 1 FROM issues d WHERE d.board_id = e.board_id AND d.id = e.dep)),
st AS (SELECT DISTINCT board_id, src AS a, dep AS b FROM edges_cyclic),
wk AS (SELECT board_id, a, b FROM st UNION SELECT w.board_id, w.a, s.b FROM wk w JOIN st s ON s.board_id = w.board_id AND s.a = w.b),
selfish AS (SELECT board_id, a AS id FROM wk WHERE a = b UNION SELECT board_id, id FROM bad),
stuck AS (SELECT board_id, id FROM selfish UNION SELECT w.board_id, w.a FROM wk w JOIN selfish s ON s.board_id = w.board_id AND s.id = w.b),
ok AS (SELECT i.board_id, i.id, i.pos FROM issues i WHERE NOT EXISTS (SELECT 1 FROM stuck s WHERE s.board_id = i.board_id AND s.id = i.id)),
pp AS (SELECT board_id, id, pos, 1 AS pass FROM ok
    UNION SELECT s.board_id, o.id, o.pos, p.pass + CASE WHEN p.pos > o.pos THEN 1 ELSE 0 END FROM pp p
      JOIN st s ON s.board_id = p.board_id AND s.b = p.id JOIN ok o ON o.board_id = s.board_id AND o.id = s.a)
SELECT i.board_id, i.id AS node, i.pos, max(pp.pass) AS pass FROM issues i LEFT JOIN pp ON pp.board_id = i.board_id AND pp.id = i.id
GROUP BY 1, 2, 3""")
def layered_passes(t):
    return closure.layered_passes(t.issues, t.edges_cyclic, tenant=B)


@query("sync_order", """SELECT board_id, id, row_number() OVER (PARTITION BY board_id ORDER BY pos) AS place FROM issues""")
def sync_order(t):
    return O.sync_order(t.issues, t.edges).select(B, "id", "place")


def _links(t):
    return t.issues.filter("okey % 2 = 0").select(
        B, "id", (F.col("okey") + 1000).alias("number"), (F.col("okey") % 3).cast("int").alias("comments"),
        F.when(F.col("okey") % 4 == 0, "CLOSED").otherwise("open").alias("state"))


_LINKS = """links AS (SELECT board_id, id, okey + 1000 AS number, okey % 3 AS comments,
    CASE WHEN okey % 4 = 0 THEN 'CLOSED' ELSE 'open' END AS state FROM issues WHERE okey % 2 = 0)"""
_REFS = _LINKS + """,
refs AS (SELECT e.board_id, e.src_pos AS pos, string_agg(CASE WHEN l.number IS NULL THEN e.dep ELSE '#' || l.number END, ', ' ORDER BY e.dep_pos) AS refs
    FROM edges e LEFT JOIN links l ON l.board_id = e.board_id AND l.id = e.dep GROUP BY 1, 2)"""


@query("sync_plan", "WITH " + _REFS + """ SELECT i.board_id, i.id, CASE WHEN l.number IS NULL THEN 'create' ELSE 'update' END AS action,
    l.number, CASE WHEN l.state = 'open' AND i.status = 'done' THEN 'close' WHEN l.state = 'CLOSED' AND i.status <> 'done' THEN 'reopen' END AS state_change,
    i.title || chr(10) || chr(10) || CASE WHEN r.refs IS NULL THEN '' ELSE '**Blocked by:** ' || r.refs || chr(10) || chr(10) END
      || '---' || chr(10) || 'board: `' || i.id || '`' || chr(10) AS body,
    CASE WHEN l.number IS NULL THEN 0 ELSE greatest(2 - l.comments, 0) END AS new_comments
    FROM issues i LEFT JOIN links l ON l.board_id = i.board_id AND l.id = i.id LEFT JOIN refs r ON r.board_id = i.board_id AND r.pos = i.pos""")
def sync_plan(t):
    issues = t.issues.withColumn("description", F.col("title")) \
        .withColumn("comments", F.array(F.lit("first"), F.lit("second")))
    return O.sync_plan(issues, t.edges, _links(t)).select(
        B, "id", "action", "number", "state_change", "body", F.col("new_comments").cast("long").alias("new_comments"))


@query("blocker_refs", "WITH " + _REFS + " SELECT * FROM refs")
def blocker_refs(t):
    return O.blocker_refs(t.issues, t.edges, _links(t))


@query("export_labels", """SELECT board_id, id, 'order' || CASE WHEN status = 'doing' THEN ',doing' ELSE '' END
    || CASE WHEN priority IN ('must', 'high', 'low') THEN ',' || priority ELSE '' END AS labels FROM issues""")
def export_labels(t):
    return t.issues.select(B, "id", F.array_join(O.export_labels(F.array(F.lit("order")), "status", "priority"), ",").alias("labels"))


@query("finished_issues", """SELECT board_id, id, title, false AS archived FROM issues WHERE status = 'done'
    UNION ALL SELECT board_id, id, title, true FROM done_log""")
def finished_issues(t):
    return O.finished_issues(t.issues, t.done_log).drop("updated_at")


# Each issue proposes to wait on the next one, itself every 7th order, and an unknown id every 11th.
_PROPOSE = """prop AS (SELECT board_id, id, CASE WHEN okey % 7 = 0 THEN id WHEN okey % 11 = 0 THEN 'th-9000'
      ELSE 'th-' || (pos + 1) END AS raw, 0 AS ord FROM issues
    UNION ALL SELECT board_id, id, 'TH-1', 1 FROM issues UNION ALL SELECT board_id, id, '1', 2 FROM issues)"""


def _proposals(t):
    first = F.expr("CASE WHEN okey % 7 = 0 THEN id WHEN okey % 11 = 0 THEN 'th-9000' ELSE concat('th-', pos + 1) END")
    rows = t.issues.select(B, "id", F.posexplode(F.array(first, F.lit("TH-1"), F.lit("1"))).alias("ord", "dep"))
    return rows


@query("set_blockers", "WITH " + _waits() + ", " + _PROPOSE + """,
p2 AS (SELECT board_id, id, CASE WHEN raw = '1' THEN 'TH-1' ELSE upper(raw) END AS dep, ord FROM prop)
SELECT p.board_id, p.id, p.dep, p.ord, CASE
    WHEN NOT EXISTS (SELECT 1 FROM issues i WHERE i.board_id = p.board_id AND i.id = p.dep) THEN 'unknown'
    WHEN p.dep = p.id THEN 'self'
    WHEN EXISTS (SELECT 1 FROM p2 q WHERE q.board_id = p.board_id AND q.id = p.id AND q.dep = p.dep AND q.ord < p.ord) THEN 'duplicate'
    WHEN EXISTS (SELECT 1 FROM waits w WHERE w.board_id = p.board_id AND w.start = p.id AND w.node = p.dep) THEN 'cycle'
    ELSE 'ok' END AS verdict FROM p2 p""")
def set_blockers(t):
    return O.set_blockers(t.issues, t.edges, _proposals(t))


# Every issue enters the lists of set_blockers in file order: later ones meet what earlier ones left.
@query("admit_blockers")
def admit_blockers(t):
    order = t.issues.select(B, "id", F.col("pos").cast("long").alias("seq"))
    return O.admit_blockers(t.issues, t.edges, _proposals(t).join(order, [B, "id"])).select(B, "seq", "id", "verdict")


@query("edit_blockers", """SELECT board_id, id, 'TH-2' || CASE WHEN pos > 2 THEN ',' || id ELSE '' END AS blockers FROM issues""")
def edit_blockers(t):
    own = F.array(F.lit("TH-1"), F.lit("TH-2"))
    return t.issues.select(B, "id", F.array_join(O.edit_blockers(own, add=F.array("id", F.lit("TH-2")),
                                                                 remove=F.array(F.lit("TH-1"))), ",").alias("blockers"))


@query("labels_update", """SELECT board_id, id, 'board,' || status || CASE WHEN priority IS NOT NULL THEN ',' || priority ELSE '' END AS labels FROM issues""")
def labels_update(t):
    own = F.array(F.lit("board"), F.lit("old"), F.col("status"))
    add = F.array_compact(F.array(F.col("status"), F.col("priority")))
    return t.issues.select(B, "id", F.array_join(O.labels_update(own, add, F.array(F.lit("old"))), ",").alias("labels"))


_DOCTOR_REST = """cyc AS (SELECT board_id, 'TH-' || loop AS loop, 'TH-' || n AS id FROM looped),
miss AS (SELECT e.board_id, e.src, e.dep FROM edges_cyclic e JOIN issues i ON i.board_id = e.board_id AND i.pos = e.src_pos
    WHERE i.status <> 'done' AND NOT EXISTS (SELECT 1 FROM issues d WHERE d.board_id = e.board_id AND d.id = e.dep)),
dp AS (SELECT board_id, id, '1 and done log' AS detail FROM issues i WHERE EXISTS (SELECT 1 FROM done_log d WHERE d.board_id = i.board_id AND d.id = i.id)),
found AS (SELECT board_id, 'duplicate' AS problem, id, detail FROM dp UNION ALL SELECT board_id, 'loop', id, loop FROM cyc
    UNION ALL SELECT board_id, 'missing', src, dep FROM miss)"""


@query("doctor", "WITH " + _LOOPS + ", " + _DOCTOR_REST + """ SELECT * FROM found
    UNION ALL SELECT board_id, 'healthy', '', '' FROM boards WHERE board_id NOT IN (SELECT board_id FROM found)""")
def doctor(t):
    return O.doctor(t.boards, t.issues, t.edges_cyclic, t.done_log)


@query("bulk_add", "WITH " + _NEXT + """,
ad AS (SELECT r.board_id, r.okey, r.title, r.id AS blocker, 'TH-' || (n.next_id - 1 + row_number() OVER (PARTITION BY r.board_id ORDER BY r.okey)) AS id
    FROM (SELECT board_id, okey, title, id FROM issues WHERE status = 'todo') r JOIN nxt n USING (board_id))
SELECT board_id, id AS src, blocker AS dep FROM ad UNION ALL SELECT board_id, 'TH-1', id FROM ad""")
def bulk_add(t):
    batch = t.issues.filter("status = 'todo'").select(
        B, F.col("okey").alias("seq"), "title", "priority", F.array("id").alias("blocked_by"),
        F.array(F.lit("TH-1")).alias("blocks"))
    return O.bulk_add(t.boards, t.issues_dup, t.done_log, batch)[1]


@query("validate_enums", """SELECT o_orderkey, CASE WHEN o_orderstatus NOT IN ('F') THEN 'bad status ' || o_orderstatus
    ELSE 'bad priority ' || o_orderpriority END AS reason FROM orders""")
def validate_enums(t):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "done")
                           .otherwise(F.col("o_orderstatus")).alias("status"), F.col("o_orderpriority").alias("priority"))
    return O.validate_enums(rows).select("o_orderkey", "reason")

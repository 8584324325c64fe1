"""Issue boards: readiness, urgency, leverage, repair and export plans.

``issues`` is (board_id, pos, id, title, status, priority, updated_at, ...) in
file order; ``edges`` is (board_id, src_pos, src, dep, dep_pos), one row per
blocker an issue names. An id held twice resolves to its first holder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workgraph.functions import ids as X
from workgraph.operators import closure
from workgraph.operators.scan import first_per_key, ranked, top_per_key
from workgraph.session import cut

B = "board_id"


def edges_of(issues: DataFrame) -> DataFrame:
    """Edge rows of the ``blocked_by`` arrays."""
    return issues.select(B, F.col("pos").alias("src_pos"), F.col("id").alias("src"),
                         F.posexplode("blocked_by").alias("dep_pos", "dep"))


def first_holder(issues: DataFrame) -> DataFrame:
    return first_per_key(issues, [B, "id"], F.col("pos"))


def _states(issues: DataFrame) -> DataFrame:
    """(board, id, status, priority) of first holders."""
    return issues.groupBy(B, "id").agg(F.min_by(F.struct("status", "priority", "pos"), "pos").alias("h")) \
        .select(B, "id", "h.status", "h.priority", "h.pos")


def open_blockers(issues: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose blocker is missing or not done, duplicates and order kept."""
    state = _states(issues).select(B, F.col("id").alias("dep"), F.col("status").alias("dep_status"))
    return edges.join(state, [B, "dep"], "left") \
        .filter(F.col("dep_status").isNull() | (F.col("dep_status") != "done"))


def ready(issues: DataFrame, edges: DataFrame) -> DataFrame:
    """Issues that can start now: not done, with no open blocker."""
    blocked = open_blockers(issues, edges).select(B, F.col("src_pos").alias("pos"))
    return issues.filter("status != 'done'").join(blocked, [B, "pos"], "left_anti")


def blocks(edges: DataFrame) -> DataFrame:
    """Reverse edges, one row per (issue, waiter), with the waiter's sort key."""
    return edges.select(B, F.col("dep").alias("id"), F.col("src").alias("waiter")).distinct() \
        .withColumn("waiter_order", X.id_sort_key("waiter"))


def dangling(issues: DataFrame, edges: DataFrame) -> DataFrame:
    """Blockers of open issues that name no issue on the board."""
    is_open = issues.filter("status != 'done'").select(B, F.col("pos").alias("src_pos"))
    known = issues.select(B, F.col("id").alias("dep"))
    return edges.join(is_open, [B, "src_pos"], "left_semi").join(known, [B, "dep"], "left_anti")


def deps(issues: DataFrame, edges: DataFrame, starts: DataFrame | None = None, known_only: bool = False) -> DataFrame:
    """Everything each issue transitively waits on, nearest first in stored order.

    Missing ids are reported but never expanded; ``known_only`` drops them.
    """
    held = first_holder(issues.select(B, "id", "pos")).select(B, F.col("pos").alias("src_pos"))
    live = edges.join(held, [B, "src_pos"], "left_semi")
    out = closure.reach(live, starts, tenant=B, src="src", dst="dep", order=F.col("dep_pos"))
    if known_only:
        out = out.join(issues.select(B, F.col("id").alias("node")), [B, "node"], "left_semi")
    return out


def dependents(edges: DataFrame, starts: DataFrame | None = None, ordered: bool = True) -> DataFrame:
    """Everything that transitively waits on each issue, done issues included.

    Boards name few blockers per issue, so four hops are taken per round.
    """
    return closure.reach(blocks(edges), starts, tenant=B, src="id", dst="waiter",
                         order=F.col("waiter_order") if ordered else None, stride=4)


def _waiting(graph: DataFrame, state: DataFrame, starts: DataFrame, hops: DataFrame | None = None) -> DataFrame:
    """Open issues that transitively wait on each start, and how many are urgent by stored priority.

    One packed walk counts both: an urgent issue also weighs in the upper half of the sum.
    """
    weights = state.filter("status != 'done'").select(
        B, F.col("id").alias("node"), F.when(X.priority_rank("priority") <= 1, F.lit((1 << 32) + 1)).otherwise(F.lit(1)).cast("long").alias("weight"))
    walk = closure.packed_reach(graph, starts, tenant=B, src="id", dst="waiter", hops=hops)
    return closure.packed_counts(walk, B, weights).select(
        B, F.col("start").alias("id"), F.expr("total & 4294967295L").alias("unblocks"), F.shiftrightunsigned("total", 32).alias("unblocks_urgent"))


def unblocks(issues: DataFrame, edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """How much open work finishing an issue frees, and how much of it is urgent by stored priority."""
    ids = issues.select(B, "id").distinct() if starts is None else \
        starts.select(B, F.col("start").alias("id")).distinct()
    counts = _waiting(blocks(edges), _states(issues), ids.select(B, F.col("id").alias("start")))
    return ids.join(counts, [B, "id"], "left").fillna(0, ["unblocks", "unblocks_urgent"])


def _large_leverage(own: DataFrame, graph: DataFrame) -> DataFrame:
    """Counts and the best waiter of the starts of ``own``, by walks in rounds."""
    hops = closure.widened(graph, tenant=B, src="id", dst="waiter", order=F.col("waiter_order"))
    ranks = own.filter("status != 'done'").select(
        B, F.col("id").alias("node"), X.priority_rank("priority").alias("rank"))
    begin = own.filter("starts")
    counts = _waiting(graph, own, begin.select(B, F.col("id").alias("start")), hops)
    best = closure.best_ahead(graph, ranks, tenant=B, src="id", dst="waiter", order=F.col("waiter_order"), hops=hops) \
        .select(B, F.col("node").alias("id"), F.struct("rank", F.col("best").alias("node")).alias("best"))
    return begin.join(counts, [B, "id"], "left").join(best, [B, "id"], "left").fillna(0, ["unblocks", "unblocks_urgent"])


def leverage(issues: DataFrame, edges: DataFrame, starts: DataFrame | None = None, boards: DataFrame | None = None,
             high=X.ESCALATE_HIGH, must=X.ESCALATE_MUST) -> DataFrame:
    """Urgency and leverage per first holder.

    Columns: board_id, id, unblocks, unblocks_urgent, urgency, urgency_from.
    ``urgency_from`` is empty unless a waiting issue raised the urgency.
    ``boards`` may carry esc_high and esc_must per board. A board of few issues and edges is walked in its row
    (:func:`closure.visits`); on larger ones counts come from a packed walk and urgency from the best label
    ahead, so no pairs of issues and waiters are formed.
    """
    state = _states(issues)
    own = state.withColumn("starts", F.lit(True)) if starts is None else \
        state.join(starts.select(B, F.col("start").alias("id")).distinct().withColumn("starts", F.lit(True)), [B, "id"], "left").fillna(False, ["starts"])
    own = cut(own)
    links = cut(edges.select(B, F.col("dep").alias("id"), F.col("src").alias("waiter")).filter("id != waiter"))
    large = closure.large_tenants(own, links, tenant=B)
    label = F.struct("priority", F.when(F.col("status") != "done", X.priority_rank("priority")).alias("rank"))
    walked = closure.visits(own.select(B, F.col("id").alias("node"), label.alias("label"), "starts"),
                            links.withColumn("order", X.id_sort_key("waiter")), large, tenant=B, src="id", dst="waiter", order="order")
    open_ = walked.select(B, F.col("node").alias("id"), F.col("label.priority").alias("priority"),
                          F.filter(F.transform("ahead", lambda x: F.struct(x["label"]["rank"].alias("rank"), x["place"].alias("place"), x["node"].alias("node"))),
                                   lambda x: x["rank"].isNotNull()).alias("open"))
    small = open_.select(B, "id", "priority", F.size("open").cast("long").alias("unblocks"),
                         F.size(F.filter("open", lambda x: x["rank"] <= 1)).cast("long").alias("unblocks_urgent"), F.array_min("open").alias("best")) \
        .withColumn("best", F.when(F.col("best").isNotNull(), F.struct("best.rank", "best.node")))
    lone = own.filter(F.col(B).isNull() & F.col("starts")).select(
        B, "id", "priority", F.lit(0).cast("long").alias("unblocks"), F.lit(0).cast("long").alias("unblocks_urgent"),
        F.lit(None).cast(small.schema["best"].dataType).alias("best"))
    rows = small.unionByName(lone)
    if not large.isEmpty():
        rows = rows.unionByName(_large_leverage(own.join(large, B, "left_semi"), blocks(edges).join(large, B, "left_semi")).select(rows.columns))
    if boards is not None:
        rows = rows.join(boards.select(B, "esc_high", "esc_must"), B, "left")
        floor = X.escalation_floor("unblocks", F.col("esc_high"), F.col("esc_must"))
    else:
        floor = X.escalation_floor("unblocks", high, must)
    raised = F.col("best").isNotNull() & (F.col("best.rank") < F.col("own_rank"))
    best_rank = F.when(raised, F.col("best.rank")).otherwise(F.col("own_rank"))
    by_count = F.col("floor").isNotNull() & (X.priority_rank("floor") < F.col("best_rank"))
    return (rows.withColumn("own_rank", X.priority_rank("priority")).withColumn("floor", floor)
            .withColumn("best_rank", best_rank)
            .select(B, "id", "unblocks", "unblocks_urgent",
                    F.when(by_count, F.col("floor"))
                    .when(raised, X.priority_name("best_rank"))
                    .otherwise(X.effective_priority("priority")).alias("urgency"),
                    F.when(raised & ~by_count, F.col("best.node")).otherwise(F.lit("")).alias("urgency_from")))


def _open_counts(issues: DataFrame, edges: DataFrame) -> DataFrame:
    return open_blockers(issues, edges).groupBy(B, F.col("src_pos").alias("pos")) \
        .agg(F.count(F.lit(1)).alias("open_blockers"),
             F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dep_pos", "dep"))),
                                      lambda e: e["dep"]), ",").alias("open_blocker_ids"))


def board_view(issues: DataFrame, edges: DataFrame, **kw) -> DataFrame:
    """The row every listing shows: effective priority, open blockers, readiness, leverage and urgency.

    An issue's own blocker list is bounded by its row, so it is joined into a
    text; its waiters are not, so they stay rows of :func:`blocks` and only
    their number is shown.
    """
    edges = cut(edges.select(B, "src_pos", "src", "dep", "dep_pos"))
    waiting = blocks(edges).groupBy(B, "id").agg(F.count(F.lit(1)).alias("blocks"))
    out = issues.join(_open_counts(issues, edges), [B, "pos"], "left") \
        .join(leverage(issues, edges, **kw), [B, "id"], "left").join(waiting, [B, "id"], "left") \
        .fillna(0, ["open_blockers", "blocks"]).fillna("", ["open_blocker_ids"])
    return out.withColumn("priority", X.effective_priority("priority")) \
        .withColumn("ready", (F.col("status") != "done") & (F.col("open_blockers") == 0))


def list_issues(view: DataFrame, status=None, label=None, priority=None, ready=False, blocked=False) -> DataFrame:
    """Conjunctive filter of a board view; ``priority`` compares urgency, ``blocked`` keeps done issues."""
    if status:
        view = view.filter(F.col("status") == status)
    if label:
        view = view.filter(F.array_contains("labels", label))
    if priority:
        view = view.filter(F.col("urgency") == priority)
    if ready:
        view = view.filter("ready")
    if blocked:
        view = view.filter("open_blockers > 0")
    return view


def progress_cells(view: DataFrame) -> DataFrame:
    """Display urgency with an arrow when raised, and the reason."""
    raised = F.col("urgency") != F.col("priority")
    by_issue = F.format_string("raised to %s by %s, which waits on this", "urgency", "urgency_from")
    by_count = F.format_string("raised to %s: %d issues are waiting on this", "urgency", "unblocks")
    return view.withColumn("priority_cell", F.concat("urgency", F.when(raised, F.lit("↑")).otherwise(F.lit("")))) \
        .withColumn("why", F.when(~raised, F.lit("")).when(F.col("urgency_from") != "", by_issue).otherwise(by_count))


def _queue_order() -> list[Column]:
    must = F.when(F.col("urgency") == "must", 0).otherwise(1)
    return [must, -F.col("unblocks"), -F.col("unblocks_urgent"), X.priority_rank("urgency"),
            F.when(F.col("status") == "doing", 0).otherwise(1), F.coalesce(X.id_num("id"), F.lit(0)), F.col("pos")]


def next_queue(issues: DataFrame, edges: DataFrame, n: int = 0, **kw) -> DataFrame:
    """Ready issues in the order to take them, numbered per board; ``n`` keeps the first n.

    Only ready issues start a walk, so finished and blocked work costs nothing.
    """
    edges = cut(edges.select(B, "src_pos", "src", "dep", "dep_pos"))
    can_start = cut(ready(issues, edges))
    starts = can_start.select(B, F.col("id").alias("start"))
    rows = can_start.join(leverage(issues, edges, starts, **kw), [B, "id"])
    if n > 0:
        return top_per_key(rows, [B], _queue_order(), n, "place")
    return ranked(rows, [B], _queue_order(), "place")


def cycles(issues: DataFrame, edges: DataFrame) -> DataFrame:
    """Open issues on a loop of open issues: (board_id, loop, id), ``loop`` named by its smallest member."""
    key = X.id_sort_key
    is_open = issues.filter("status != 'done'").groupBy(B, "id").agg(F.max("pos").alias("src_pos"))
    # An id held twice answers with its last open holder's blockers here.
    live = edges.join(is_open.select(B, "src_pos"), [B, "src_pos"], "left_semi") \
        .join(is_open.select(B, F.col("id").alias("dep")), [B, "dep"], "left_semi") \
        .select(B, key("src").alias("s"), key("dep").alias("d"))
    found = closure.loops(live, tenant=B, src="s", dst="d")
    bare = lambda c: F.substring_index(c, "|", -1)
    return found.select(B, bare("loop").alias("loop"), bare("node").alias("id"))


def witness_loops(issues: DataFrame, edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """The shortest loop through the smallest member of each looped group, as a path of ids."""
    members = cycles(issues, edges) if members is None else members
    members = cut(members)
    inside = edges.join(members.select(B, F.col("id").alias("src"), "loop"), [B, "src"]) \
        .join(members.select(B, F.col("id").alias("dep"), "loop"), [B, "dep", "loop"]) \
        .select(B, "loop", "src", "dep").distinct()
    inside = cut(inside)
    starts = members.select(B, F.col("loop").alias("start")).distinct()
    walk = closure.reach(inside, starts, tenant=B, src="src", dst="dep", order=F.col("dep"), stride=1)
    closing = inside.filter("dep = loop").select(B, F.col("loop").alias("start"), F.col("src").alias("node"))
    selfish = closing.filter("start = node").select(B, F.col("start").alias("loop"),
                                                    F.array("start").alias("witness"))
    rest = walk.join(closing, [B, "start", "node"]).join(selfish.select(B, F.col("loop").alias("start")),
                                                         [B, "start"], "left_anti") \
        .groupBy(B, F.col("start").alias("loop")).agg(F.min(F.struct("depth", "path")).alias("m")) \
        .select(B, "loop", F.concat(F.array("loop"), "m.path").alias("witness"))
    return selfish.unionByName(rest)


def forced_pick(issues: DataFrame, edges: DataFrame) -> DataFrame:
    """For boards with open work and nothing ready: what to start anyway, and why."""
    can_start = ready(issues, edges).select(B).distinct()
    stuck = cut(issues.filter("status != 'done'").join(can_start, B, "left_anti"))
    boards = stuck.select(B).distinct()
    local_edges = cut(edges.join(boards, B, "left_semi"))
    local_issues = issues.join(boards, B, "left_semi")
    walk = closure.packed_reach(blocks(local_edges), stuck.select(B, F.col("id").alias("start")), tenant=B, src="id", dst="waiter")
    counts = closure.packed_counts(walk, B).select(B, F.col("start").alias("id"), F.col("total").alias("dependents"))
    picks = stuck.join(counts, [B, "id"], "left").fillna(0, ["dependents"])
    order = F.struct(X.priority_rank("priority"), -F.col("dependents"), F.coalesce(X.id_num("id"), F.lit(0)), "pos")
    picks = first_per_key(picks, [B], order)
    witness = witness_loops(local_issues, local_edges)
    named = first_per_key(witness.withColumn("_key", X.id_sort_key("loop")), [B], F.col("_key")) \
        .select(B, F.array_join("witness", " → ").alias("_loop"))
    missing = dangling(local_issues, local_edges).select(B).distinct().withColumn("_missing", F.lit(True))
    cause = F.when(F.col("_loop").isNotNull(), F.lit("loop")).when(F.col("_missing"), F.lit("missing")) \
        .otherwise(F.lit("waiting"))
    reason = F.when(F.col("_loop").isNotNull(),
                    F.format_string("every open issue is waiting on another, in a loop (%s)", "_loop")) \
        .when(F.col("_missing"), F.lit("open issues are blocked by ids that are not on the board")) \
        .otherwise(F.lit("every open issue is waiting on a blocker that is not done"))
    return picks.join(named, B, "left").join(missing, B, "left") \
        .withColumn("cause", cause).withColumn("reason", reason).drop("_loop", "_missing")


def status_counts(boards: DataFrame, issues: DataFrame) -> DataFrame:
    """Open and done issues of each board and what an empty queue means."""
    counts = issues.groupBy(B).agg(F.count(F.when(F.col("status") != "done", 1)).alias("open"),
                                   F.count(F.when(F.col("status") == "done", 1)).alias("done"))
    return boards.join(counts, B, "left").fillna(0, ["open", "done"]).withColumn(
        "state", F.when(F.col("open") + F.col("done") == 0, "empty").when(F.col("open") == 0, "all done")
        .otherwise("open"))


def duplicates(issues: DataFrame, done_log: DataFrame) -> DataFrame:
    """Holders of ids held more than once or also in the done log, in file order."""
    held = issues.groupBy(B, "id").agg(F.count(F.lit(1)).alias("holders"))
    logged = done_log.select(B, "id").distinct().withColumn("retired", F.lit(True))
    bad = held.join(logged, [B, "id"], "left").fillna(False, ["retired"]).filter("holders > 1 OR retired")
    return issues.join(bad, [B, "id"]).select(B, "id", "pos", "title", "holders", "retired")


def next_ids(boards: DataFrame, issues: DataFrame, done_log: DataFrame) -> DataFrame:
    """The next free number per board: past the counter, the board and the done log."""
    taken = issues.select(B, "id").unionByName(done_log.select(B, "id"))
    used = taken.join(boards.select(B, "prefix"), B) \
        .groupBy(B).agg(F.max(X.issue_num("id", "prefix")).alias("used"))
    return boards.join(used, B, "left").select(
        B, "prefix", F.greatest("next_id", F.coalesce("used", F.lit(0)) + F.when(F.col("used").isNull(), 0).otherwise(1),
                                F.lit(1)).alias("next_id"))


def mint_ids(boards: DataFrame, issues: DataFrame, done_log: DataFrame, requests: DataFrame) -> DataFrame:
    """Give each request (board_id, seq, ...) the next free id of its board, in ``seq`` order."""
    placed = ranked(requests, [B], [F.col("seq")], "_n")
    return placed.join(next_ids(boards, issues, done_log), B) \
        .withColumn("id", F.concat("prefix", F.lit("-"), (F.col("next_id") + F.col("_n") - 1).cast("string"))) \
        .drop("_n", "prefix", "next_id")


def renumber(boards: DataFrame, issues: DataFrame, done_log: DataFrame) -> DataFrame:
    """Moves that leave every id with its first holder: (board_id, pos, from_id, to_id, title).

    Ids in the done log are already held, so a board issue sharing one moves.
    """
    logged = done_log.select(B, "id").distinct().withColumn("_held", F.lit(True))
    # Only the first holder keeps an id; a windowless way to find the others.
    firsts = issues.groupBy(B, "id").agg(F.min("pos").alias("_first"))
    movers = issues.join(firsts, [B, "id"]).join(logged, [B, "id"], "left") \
        .filter((F.col("pos") != F.col("_first")) | F.col("_held"))
    moved = mint_ids(boards, issues, done_log,
                     movers.select(B, F.col("pos").alias("seq"), F.col("id").alias("from_id"), "title"))
    return moved.select(B, F.col("seq").alias("pos"), "from_id", F.col("id").alias("to_id"), "title")


def apply_renumber(issues: DataFrame, edges: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Issues under their new ids, and blockers that name an id no longer on the board following its first mover."""
    renamed = issues.join(moves.select(B, "pos", "to_id"), [B, "pos"], "left") \
        .withColumn("id", F.coalesce("to_id", "id")).drop("to_id")
    first_move = first_per_key(moves.select(B, "pos", F.col("from_id").alias("dep"), "to_id"), [B, "dep"], F.col("pos"))
    gone = first_move.join(renamed.select(B, F.col("id").alias("dep")), [B, "dep"], "left_anti")
    new_src = renamed.select(B, F.col("pos").alias("src_pos"), F.col("id").alias("_src"))
    followed = edges.join(gone.select(B, "dep", "to_id"), [B, "dep"], "left") \
        .withColumn("dep", F.coalesce("to_id", "dep")).drop("to_id") \
        .join(new_src, [B, "src_pos"], "left").withColumn("src", F.coalesce("_src", "src")).drop("_src")
    return renamed, followed


def archive_done(issues: DataFrame, edges: DataFrame, before: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split off done issues last touched before a cutoff: (moved, kept, kept edges).

    Blockers naming a moved issue are dropped from the issues that stay.
    """
    old = (F.col("status") == "done") & (F.col("updated_at") < before)
    moved, kept = issues.filter(old), issues.filter(~F.coalesce(old, F.lit(False)))
    gone = moved.select(B, F.col("id").alias("dep")).distinct()
    staying = edges.join(kept.select(B, F.col("pos").alias("src_pos")), [B, "src_pos"], "left_semi")
    return moved, kept, staying.join(gone, [B, "dep"], "left_anti")


def archive_report(issues: DataFrame, edges: DataFrame, before: Column) -> DataFrame:
    """Per board: how many issues an archive run moves and how many references it drops."""
    moved, kept, _ = archive_done(issues, edges, before)
    gone = moved.select(B, F.col("id").alias("dep")).distinct()
    dropped = edges.join(kept.select(B, F.col("pos").alias("src_pos")), [B, "src_pos"], "left_semi") \
        .join(gone, [B, "dep"], "left_semi").groupBy(B).agg(F.count(F.lit(1)).alias("dropped"))
    return moved.groupBy(B).agg(F.count(F.lit(1)).alias("moved")).join(dropped, B, "left").fillna(0, ["dropped"])


def show_issue(issues: DataFrame, done_log: DataFrame, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Look ids up on the board, then in the done log: one row per wanted (board_id, id) and neighbour.

    ``direction`` is blocked_by or blocks; ``note`` shows the neighbour's status or that it is missing.
    """
    cols = [B, "id", "pos", "title", "status", "priority"]
    both = issues.select(*cols, F.lit(0).alias("_src")).unionByName(done_log.select(*cols, F.lit(1).alias("_src")))
    found = first_per_key(both.join(wanted, [B, "id"], "left_semi"), [B, "id"], F.struct("_src", "pos")) \
        .withColumn("archived", F.col("_src") == 1).drop("_src")
    state = _states(issues).select(B, F.col("id").alias("other"), F.col("status").alias("_status"))
    up = edges.select(B, F.col("src_pos").alias("pos"), F.lit("blocked_by").alias("direction"),
                      F.col("dep").alias("other"))
    up = found.filter("NOT archived").select(B, "id", "pos").join(up, [B, "pos"]).drop("pos")
    down = blocks(edges).join(found.select(B, "id"), [B, "id"], "left_semi") \
        .select(B, "id", F.lit("blocks").alias("direction"), F.col("waiter").alias("other"))
    near = up.unionByName(down).join(state, [B, "other"], "left").select(
        B, "id", "direction", F.concat("other", F.lit(" ("), F.coalesce("_status", F.lit("missing")), F.lit(")")).alias("note"))
    return found.drop("pos").join(near, [B, "id"], "left")


def sync_order(issues: DataFrame, edges: DataFrame) -> DataFrame:
    """Blockers-first export order per board; what never becomes ready follows in file order."""
    passes = closure.layered_passes(issues, edges, tenant=B)
    last = F.lit(2 ** 31 - 1)
    return ranked(passes.withColumn("_pass", F.coalesce("pass", last)), [B], [F.col("_pass"), F.col("pos")], "place") \
        .select(B, F.col("node").alias("id"), "pos", "pass", "place")


def blocker_refs(issues: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """Per issue the text naming its blockers, by remote number where one is known."""
    numbers = links.select(B, F.col("id").alias("dep"), "number")
    ref = F.coalesce(F.concat(F.lit("#"), F.col("number").cast("string")), F.col("dep"))
    return edges.join(numbers, [B, "dep"], "left").groupBy(B, F.col("src_pos").alias("pos")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dep_pos", ref.alias("ref")))),
                                 lambda e: e["ref"]), ", ").alias("refs"))


def issue_body(description, refs, ident, marker: str = "board") -> Column:
    """Export text: description, blockers, and a trailing line that names the issue."""
    text = lambda c: F.coalesce(X.col(c), F.lit(""))
    return F.concat(F.when(text(description) != "", F.concat(text(description), F.lit("\n\n"))).otherwise(F.lit("")),
                    F.when(text(refs) != "", F.concat(F.lit("**Blocked by:** "), text(refs), F.lit("\n\n")))
                    .otherwise(F.lit("")),
                    F.lit(f"---\n{marker}: `"), X.col(ident), F.lit("`\n"))


def export_labels(labels, status, priority) -> Column:
    """Own labels, then doing and a non-default priority if not there yet."""
    labels = F.coalesce(X.col(labels), F.array().cast("array<string>"))
    doing = F.when(X.col(status) == "doing", F.array(F.lit("doing"))).otherwise(F.array().cast("array<string>"))
    level = X.effective_priority(priority)
    extra = F.when(level != "normal", F.array(level)).otherwise(F.array().cast("array<string>"))
    absent = lambda more, base: F.filter(more, lambda e: ~F.array_contains(base, e))
    with_doing = F.concat(labels, absent(doing, labels))
    return F.concat(with_doing, absent(extra, with_doing))


def sync_plan(issues: DataFrame, edges: DataFrame, links: DataFrame, marker: str = "board") -> DataFrame:
    """What an export would do per issue; nothing is called.

    ``links`` is (board_id, id, number, comments, state). New comments are those
    past the number already posted. ``state_change`` is close, reopen or NULL.
    """
    refs = blocker_refs(issues, edges, links)
    rows = issues.join(links.select(B, "id", "number", F.col("comments").alias("posted"), "state"), [B, "id"], "left") \
        .join(refs, [B, "pos"], "left")
    linked, closed = F.col("number").isNotNull(), F.upper(F.trim("state")) == "CLOSED"
    rows = rows.withColumn("action", F.when(linked, "update").otherwise("create")) \
        .withColumn("body", issue_body("description", "refs", "id", marker)) \
        .withColumn("state_change", F.when(linked & (F.col("status") == "done") & ~closed, "close")
                    .when(linked & (F.col("status") != "done") & closed, "reopen"))
    if "comments" in issues.columns:
        total = F.size(F.coalesce("comments", F.array()))
        done = F.least(F.coalesce("posted", F.lit(0)), total)
        rows = rows.withColumn("new_comments", F.when(linked, total - done).otherwise(0))
    return rows


def finished_issues(issues: DataFrame, done_log: DataFrame) -> DataFrame:
    """Done issues of the board together with everything archived."""
    cols = [B, "id", "title", "updated_at"]
    return issues.filter("status = 'done'").select(*cols, F.lit(False).alias("archived")) \
        .unionByName(done_log.select(*cols, F.lit(True).alias("archived")))


def set_blockers(issues: DataFrame, edges: DataFrame, proposals: DataFrame, prefix: str = "TH") -> DataFrame:
    """Judge proposed blocker lists: (board_id, id, dep, ord, verdict).

    Verdicts: ok, duplicate, unknown, self, cycle. A proposal replaces the
    issue's list; the cycle test therefore walks the current edges of every
    other issue. Each proposal is judged on the board as it stands; a batch that is entered
    in order is :func:`admit_blockers`.
    """
    want = proposals.withColumn("dep", X.normalize_id("dep", F.lit(prefix)))
    firsts = want.groupBy(B, "id", "dep").agg(F.min("ord").alias("_first"))
    known = issues.select(B, F.col("id").alias("dep")).distinct().withColumn("_known", F.lit(True))
    rows = want.join(firsts, [B, "id", "dep"]).join(known, [B, "dep"], "left")
    # dep must not already wait on id: walk what waits on id, not through id's own old list.
    waits = dependents(edges, want.select(B, F.col("id").alias("start")), ordered=False) \
        .select(B, F.col("start").alias("id"), F.col("node").alias("dep")).withColumn("_waits", F.lit(True))
    rows = rows.join(waits, [B, "id", "dep"], "left")
    verdict = (F.when(F.col("_known").isNull(), "unknown").when(F.col("dep") == F.col("id"), "self")
               .when(F.col("ord") != F.col("_first"), "duplicate").when(F.col("_waits"), "cycle").otherwise("ok"))
    return rows.select(B, "id", "dep", "ord", verdict.alias("verdict"))


def admit_blockers(issues: DataFrame, edges: DataFrame, proposals: DataFrame, prefix: str = "TH") -> DataFrame:
    """A batch of blocker lists entered in order of ``seq``: (board_id, seq, id, verdict).

    ``proposals`` is (board_id, seq, id, dep, ord), ``seq`` once per proposal of a board; a null dep is an empty list. A proposal replaces
    the issue's whole list or, if refused, changes nothing: an unknown blocker or issue, the issue itself, or a loop with
    what earlier proposals of the batch left. Verdicts: ok, unknown, self, cycle.

    A board of few issues, edges and proposals enters them one after another in its row; larger ones are settled in rounds.
    """
    want = cut(proposals.withColumn("dep", X.normalize_id("dep", F.lit(prefix))).select(B, "seq", "id", "dep").distinct())
    held = cut(issues.select(B, "id").distinct())
    first = first_holder(issues.select(B, "id", "pos")).select(B, F.col("pos").alias("src_pos"))
    old = cut(edges.join(first, [B, "src_pos"], "left_semi").select(B, F.col("src").alias("id"), "dep").dropna().distinct())
    large = closure.large_tenants(want, held, old, tenant=B)
    # A proposal without a place in the order is judged by itself.
    apart = want.filter(F.col(B).isNull() | F.col("seq").isNull()).unionByName(want.filter("seq IS NOT NULL").join(large, B, "left_semi"))
    entered = _admit_in_rows(held, old, want.filter("seq IS NOT NULL"), large)
    if apart.isEmpty():
        return entered
    boards = cut(apart.select(B).distinct())
    return entered.unionByName(_admit_in_rounds(held.join(boards, B, "left_semi"), old.join(boards, B, "left_semi"), apart))


def _admit_in_rows(held: DataFrame, old: DataFrame, want: DataFrame, large: DataFrame) -> DataFrame:
    """Verdicts of boards that are not ``large``: lists are replaced one after another inside the board's row."""
    lists = want.join(large, B, "left_anti").filter(F.col(B).isNotNull()).groupBy(B, "seq", "id").agg(F.collect_set("dep").alias("deps"))
    rows = closure.small_rows(large, tenant=B, held=held.dropna(), old=old, lists=lists).filter(F.size("lists") > 0)
    # Ids on the board come first; a list of an id that is not on it is followed but never replaced.
    named = rows.select("*", F.array_distinct(F.concat("held.id", "old.id")).alias("ids"))
    place = lambda c: F.coalesce((F.array_position("ids", c) - 1).cast("int"), F.lit(-1))
    kind = {f.name: f.dataType.simpleString() for f in want.schema}
    begun = named.select(F.col(B), F.size("held").alias("n"), F.size("ids").alias("all"),
                         F.transform("ids", lambda i: F.filter(F.transform(F.filter("old", lambda e: e["id"] == i), lambda e: place(e["dep"])), lambda x: x >= 0)).alias("next"),
                         F.transform("lists", lambda p: F.struct(p["seq"].alias("seq"), p["id"].alias("id"), place(p["id"]).alias("at"), F.transform(p["deps"], place).alias("to"))).alias("asked"))

    def enter(state: Column, p: Column) -> Column:
        off = lambda x: (x < 0) | (x >= F.col("n"))
        own = F.array().cast("array<int>")
        met = closure.queue_walk(p["to"], lambda x: F.when(x == p["at"], own).otherwise(F.get(state["next"], x)), F.col("all"))
        verdict = F.when(off(p["at"]) | F.exists(p["to"], off), "unknown").when(F.array_contains(p["to"], p["at"]), "self") \
            .when(F.array_contains(met, p["at"]), "cycle").otherwise("ok")
        # The verdict is worked out once and used twice.
        return F.get(F.transform(F.array(verdict), lambda v: F.struct(
            F.when(v == "ok", F.transform(state["next"], lambda x, i: F.when(i == p["at"], p["to"]).otherwise(x))).otherwise(state["next"]).alias("next"),
            F.concat(state["out"], F.array(F.struct(p["seq"].alias("seq"), p["id"].alias("id"), v.alias("verdict")))).alias("out"))), F.lit(0))

    none = F.array().cast(f"array<struct<seq:{kind['seq']},id:{kind['id']},verdict:string>>")
    done = F.aggregate("asked", F.struct("next", none.alias("out")), enter, lambda state: state["out"])
    return begun.select(B, F.explode(done).alias("_o")).select(B, "_o.seq", "_o.id", "_o.verdict")


def _admit_in_rounds(held: DataFrame, old: DataFrame, want: DataFrame) -> DataFrame:
    """Verdicts of boards of any size.

    Only proposals inside a loop of the joint graph of all old and proposed lists can be refused for one. Those are
    settled in rounds for all boards at once: a list that meets no path over edges that may hold at its turn enters, one that
    meets a path over edges that surely hold is refused, and each verdict makes more edges sure. The first open
    proposal of a board is settled in every round.
    """
    known = held.select(B, F.col("id").alias("dep"), F.lit(True).alias("_known"))
    there = held.withColumn("_there", F.lit(True))
    judged = cut(want.join(known, [B, "dep"], "left").join(there, [B, "id"], "left").groupBy(B, "seq", "id").agg(
        F.max(F.col("_there").isNull() | (F.col("dep").isNotNull() & F.col("_known").isNull())).alias("_unknown"), F.max(F.coalesce(F.col("dep") == F.col("id"), F.lit(False))).alias("_self"))
        .select(B, "seq", "id", F.when(F.col("_unknown"), "unknown").when(F.col("_self"), "self").alias("verdict")))
    lists = want.join(judged.filter("verdict IS NULL").select(B, "seq", "id"), [B, "seq", "id"], "left_semi").filter("dep IS NOT NULL")
    joint = cut(old.select(B, F.lit(None).cast("long").alias("seq"), "id", "dep").unionByName(lists.select(B, F.col("seq").cast("long").alias("seq"), "id", "dep")).distinct())
    members = closure.loops(joint, tenant=B, src="id", dst="dep")
    inside = cut(joint.join(members.select(B, F.col("node").alias("id"), "loop"), [B, "id"]).join(members.select(B, F.col("node").alias("dep"), "loop"), [B, "dep", "loop"])
                 .select(B, "seq", "id", "dep"))
    # Proposals without an edge inside a loop enter; they still replace what their issue waited on.
    risky = inside.filter("seq IS NOT NULL").select(B, "seq").distinct().withColumn("_risky", F.lit(True))
    state = cut(judged.join(risky, [B, "seq"], "left").select(B, "seq", "id", F.when(F.col("verdict").isNull() & F.col("_risky").isNull(), "ok").otherwise(F.col("verdict")).alias("verdict")))
    while not state.filter("verdict IS NULL").isEmpty():
        open_ = state.filter("verdict IS NULL").select(B, "seq", "id")
        may = _meets(open_, inside, state.filter("verdict = 'ok'"), state.filter("verdict IS NULL OR verdict = 'ok'"))
        sure = _meets(open_, inside, state.filter("verdict IS NULL OR verdict = 'ok'"), state.filter("verdict = 'ok'"))
        settled = open_.join(may.withColumn("_may", F.lit(True)), [B, "seq"], "left").join(sure.withColumn("_sure", F.lit(True)), [B, "seq"], "left") \
            .select(B, "seq", F.when(F.col("_may").isNull(), "ok").when(F.col("_sure"), "cycle").alias("_new"))
        state = cut(state.join(settled, [B, "seq"], "left").select(B, "seq", "id", F.coalesce("verdict", "_new").alias("verdict")))
    return state


def _meets(asked: DataFrame, edges: DataFrame, ends: DataFrame, entered: DataFrame) -> DataFrame:
    """(board, seq) of the asked proposals whose blockers lead back to their issue at their turn.

    The list of an issue holds until the next of ``ends`` (proposals that replace it); old lists and those of ``entered`` hold at all.
    """
    until = ends.select(B, "id", F.col("seq").alias("_end"))
    lists = edges.join(entered.select(B, "seq", F.lit(True).alias("_in")), [B, "seq"], "left").filter("seq IS NULL OR _in")
    spans = lists.join(until, [B, "id"], "left").groupBy(B, "seq", "id", "dep") \
        .agg(F.min(F.when(F.col("seq").isNull() | (F.col("_end") > F.col("seq")), F.col("_end"))).alias("_end"))
    step = cut(spans.select(B, F.col("seq").alias("_from"), "_end", F.col("id").alias("node"), F.col("dep").alias("_to")))
    own = edges.filter("seq IS NOT NULL").select(B, "seq", F.col("dep").alias("node"))
    frontier = cut(asked.select(B, "seq", F.col("id").alias("_goal")).join(own, [B, "seq"]).distinct())
    rounds = [frontier]
    while not frontier.isEmpty():
        holds = (F.col("_from").isNull() | (F.col("_from") < F.col("seq"))) & (F.col("_end").isNull() | (F.col("_end") >= F.col("seq")))
        found = frontier.filter("node != _goal").join(step, [B, "node"]).filter(holds).select(B, "seq", "_goal", F.col("_to").alias("node")).distinct()
        frontier = cut(found.join(closure._union(rounds).hint("merge"), [B, "seq", "_goal", "node"], "left_anti"))
        closure._remember(rounds, frontier)
    return closure._union(rounds).filter("node = _goal").select(B, "seq").distinct()


def edit_blockers(current, replace=None, add=None, remove=None) -> Column:
    """The blocker list after replacing, adding and removing, first mentions kept."""
    empty = F.array().cast("array<string>")
    base = F.coalesce(X.col(replace), X.col(current), empty) if replace is not None else F.coalesce(X.col(current), empty)
    if add is not None:
        base = F.concat(base, F.coalesce(X.col(add), empty))
    if remove is not None:
        base = F.filter(base, lambda e: ~F.array_contains(F.coalesce(X.col(remove), empty), e))
    return F.array_distinct(base)


def labels_update(labels, add, remove) -> Column:
    """Add labels that are absent, then drop the removed ones."""
    empty = F.array().cast("array<string>")
    kept = F.coalesce(X.col(labels), empty)
    extra = F.array_distinct(F.filter(F.coalesce(X.col(add), empty), lambda e: ~F.array_contains(kept, e)))
    return F.filter(F.concat(kept, extra), lambda e: ~F.array_contains(F.coalesce(X.col(remove), empty), e))


def doctor(boards: DataFrame, issues: DataFrame, edges: DataFrame, done_log: DataFrame, fix: bool = False) -> DataFrame:
    """Problem rows of every board: (board_id, problem, id, detail); a healthy board has one ``healthy`` row.

    With ``fix`` the repairable kind, duplicate ids, is moved first and each move reported.
    """
    rows = []
    if fix:
        moves = cut(renumber(boards, issues, done_log))
        issues, edges = apply_renumber(issues, edges, moves)
        issues, edges = cut(issues), cut(edges)
        rows.append(moves.select(B, F.lit("moved").alias("problem"), F.col("to_id").alias("id"),
                                 F.col("from_id").alias("detail")))
    twice = duplicates(issues, done_log).select(B, "id", "holders", "retired").distinct()
    rows.append(twice.select(B, F.lit("duplicate").alias("problem"), "id",
                             F.concat(F.col("holders").cast("string"), F.when(F.col("retired"), " and done log")
                                      .otherwise("")).alias("detail")))
    rows.append(cycles(issues, edges).select(B, F.lit("loop").alias("problem"), "id", F.col("loop").alias("detail")))
    rows.append(dangling(issues, edges).select(B, F.lit("missing").alias("problem"), F.col("src").alias("id"),
                                               F.col("dep").alias("detail")))
    found = rows[0]
    for more in rows[1:]:
        found = found.unionByName(more)
    found = cut(found)
    sick = found.filter("problem != 'moved'").select(B).distinct()
    well = boards.select(B).join(sick, B, "left_anti") \
        .select(B, F.lit("healthy").alias("problem"), F.lit("").alias("id"), F.lit("").alias("detail"))
    return found.unionByName(well)


def bulk_add(boards: DataFrame, issues: DataFrame, done_log: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insert a batch with minted ids; ``blocks`` adds the reverse edges.

    ``batch`` is (board_id, seq, title, priority, blocked_by, blocks). Returns
    the new issues and the edges they add (src, dep).
    """
    added = cut(mint_ids(boards, issues, done_log, batch)
                .withColumn("priority", X.stored_priority("priority")).withColumn("status", F.lit("todo")))
    own = added.select(B, F.col("id").alias("src"), F.explode(F.array_distinct("blocked_by")).alias("dep"))
    reverse = added.select(B, F.explode(F.array_distinct("blocks")).alias("src"), F.col("id").alias("dep"))
    return added, own.unionByName(reverse)


def validate_enums(issues: DataFrame) -> DataFrame:
    """Rows whose status or priority is not an allowed word, with the reason."""
    bad_status = ~F.col("status").isin(X.STATUSES) | F.col("status").isNull()
    bad_priority = F.coalesce("priority", F.lit("")) != ""
    bad_priority = bad_priority & ~F.col("priority").isin(X.PRIORITIES)
    reason = F.when(bad_status, F.concat(F.lit("bad status "), F.coalesce("status", F.lit("")))) \
        .when(bad_priority, F.concat(F.lit("bad priority "), F.col("priority")))
    return issues.withColumn("reason", reason).filter("reason IS NOT NULL")


def preserve_unknown(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Updated rows keep the columns this version does not know; known columns come from the update alone."""
    unknown = [c for c in old.columns if c not in new.columns]
    return new.join(old.select(*keys, *unknown), keys, "left") if unknown else new


def schema_guard(boards: DataFrame, max_version: int = 1) -> DataFrame:
    """Refuse tables written by a newer schema version."""
    message = F.format_string(f"this board is schema version %d and only {max_version} is understood", "version")
    ok = F.when(F.col("version") > max_version, F.raise_error(message)).otherwise(F.col("version"))
    return boards.withColumn("version", ok.cast("int"))

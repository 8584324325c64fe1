"""Boards: readiness, urgency, leverage, repair, archive, export."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from workgraph.functions import ids as X
from workgraph.operators import board as O

SCHEMA = "board_id string, pos long, id string, title string, status string, priority string, blocked_by array<string>"


def board(frame, *items):
    """Items are (id, status, priority, blockers)."""
    data = [("b", i, ident, f"t{i}", status, priority, blockers) for i, (ident, status, priority, blockers) in enumerate(items, 1)]
    issues = frame(data, SCHEMA)
    return issues, O.edges_of(issues)


def test_ready_needs_every_blocker_done(frame):
    issues, edges = board(frame, ("TH-1", "done", None, []), ("TH-2", "todo", None, ["TH-1"]), ("TH-3", "todo", None, ["TH-2", "TH-1"]),
                          ("TH-4", "todo", None, ["TH-99"]), ("TH-5", "done", None, ["TH-3"]))
    assert rows(O.ready(issues, edges), "id") == [("TH-2",)]
    assert rows(O.open_blockers(issues, edges), "src", "dep") == [("TH-3", "TH-2"), ("TH-4", "TH-99"), ("TH-5", "TH-3")]


def test_urgency_is_borrowed_from_what_waits(frame):
    issues, edges = board(frame, ("TH-1", "todo", "low", []), ("TH-2", "todo", None, ["TH-1"]), ("TH-3", "todo", "must", ["TH-2"]),
                          ("TH-4", "done", "must", ["TH-5"]), ("TH-5", "todo", "low", []))
    assert rows(O.leverage(issues, edges), "id", "urgency", "urgency_from", "unblocks") == [
        ("TH-1", "must", "TH-3", 2), ("TH-2", "must", "TH-3", 1), ("TH-3", "must", "", 0), ("TH-4", "must", "", 0), ("TH-5", "low", "", 0)]


def test_urgency_passes_through_done_issues(frame):
    issues, edges = board(frame, ("TH-1", "todo", None, []), ("TH-2", "done", None, ["TH-1"]), ("TH-3", "todo", "high", ["TH-2"]))
    got = {r.id: (r.urgency, r.urgency_from) for r in O.leverage(issues, edges).collect()}
    assert got["TH-1"] == ("high", "TH-3")


@pytest.mark.parametrize("waiters,high,must,expected", [(2, 3, 10, "low"), (3, 3, 10, "high"), (10, 3, 10, "must"), (10, 0, 0, "low"), (10, 3, 0, "high")])
def test_escalation_by_count(frame, waiters, high, must, expected):
    issues, edges = board(frame, ("TH-1", "todo", "low", []), *[(f"TH-{i}", "todo", "low", ["TH-1"]) for i in range(2, 2 + waiters)])
    got = {r.id: (r.urgency, r.urgency_from) for r in O.leverage(issues, edges, high=high, must=must).collect()}
    assert got["TH-1"] == (expected, "")


def test_queue_prefers_leverage_then_urgency(frame):
    issues, edges = board(frame, ("TH-1", "todo", "high", []), ("TH-2", "todo", "low", []), ("TH-3", "todo", "low", ["TH-2"]),
                          ("TH-4", "todo", "low", ["TH-3"]), ("TH-5", "doing", None, []), ("TH-6", "todo", None, []), ("TH-7", "todo", "must", []))
    queue = sorted(O.next_queue(issues, edges).collect(), key=lambda r: r.place)
    assert [r.id for r in queue] == ["TH-7", "TH-2", "TH-1", "TH-5", "TH-6"]
    assert [r.id for r in sorted(O.next_queue(issues, edges, n=2).collect(), key=lambda r: r.place)] == ["TH-7", "TH-2"]


def test_loops_and_forced_pick(frame):
    issues, edges = board(frame, ("TH-1", "todo", None, ["TH-2"]), ("TH-2", "todo", None, ["TH-3"]), ("TH-3", "todo", "high", ["TH-1"]),
                          ("TH-4", "done", None, ["TH-4"]))
    assert rows(O.cycles(issues, edges), "loop", "id") == [("TH-1", "TH-1"), ("TH-1", "TH-2"), ("TH-1", "TH-3")]
    pick = O.forced_pick(issues, edges).first()
    assert (pick.id, pick.cause, pick.reason) == (
        "TH-3", "loop", "every open issue is waiting on another, in a loop (TH-1 → TH-2 → TH-3)")


def test_duplicates_renumber_and_references(frame):
    issues, edges = board(frame, ("TH-1", "todo", None, []), ("TH-1", "todo", None, []), ("TH-2", "todo", None, ["TH-1"]),
                          ("TH-3", "todo", None, ["TH-2"]))
    log = frame([("b", "TH-2", "old")], "board_id string, id string, title string")
    boards = frame([("b", "TH", 3)], "board_id string, prefix string, next_id long")
    assert rows(O.duplicates(issues, log), "id", "pos", "holders", "retired") == [
        ("TH-1", 1, 2, False), ("TH-1", 2, 2, False), ("TH-2", 3, 1, True)]
    moves = O.renumber(boards, issues, log)
    assert rows(moves, "pos", "from_id", "to_id") == [(2, "TH-1", "TH-4"), (3, "TH-2", "TH-5")]
    fixed, followed = O.apply_renumber(issues, edges, moves)
    assert rows(fixed, "pos", "id") == [(1, "TH-1"), (2, "TH-4"), (3, "TH-5"), (4, "TH-3")]
    assert rows(followed, "src", "dep") == [("TH-3", "TH-5"), ("TH-5", "TH-1")]


def test_doctor_fix_leaves_a_healthy_board(frame):
    issues, edges = board(frame, ("TH-1", "todo", None, []), ("TH-1", "todo", None, []))
    log = frame([], "board_id string, id string, title string")
    boards = frame([("b", "TH", 2)], "board_id string, prefix string, next_id long")
    assert rows(O.doctor(boards, issues, edges, log), "problem", "id") == [("duplicate", "TH-1")]
    assert rows(O.doctor(boards, issues, edges, log, fix=True), "problem", "id", "detail") == [("healthy", "", ""), ("moved", "TH-2", "TH-1")]


def test_archive_moves_old_done_issues_and_drops_references(frame):
    day = lambda d: dt.datetime(2024, 1, d)
    data = [("b", 1, "TH-1", "done", [], day(1)), ("b", 2, "TH-2", "done", [], day(20)), ("b", 3, "TH-3", "todo", ["TH-1", "TH-2"], day(1))]
    issues = frame(data, "board_id string, pos long, id string, status string, blocked_by array<string>, updated_at timestamp")
    moved, kept, edges = O.archive_done(issues, O.edges_of(issues), F.lit(day(10)))
    assert rows(moved, "id") == [("TH-1",)] and rows(kept, "id") == [("TH-2",), ("TH-3",)] and rows(edges, "dep") == [("TH-2",)]
    report = O.archive_report(issues, O.edges_of(issues), F.lit(day(10))).first()
    assert (report.moved, report.dropped) == (1, 1)


def test_set_blockers_verdicts(frame):
    issues, edges = board(frame, ("TH-1", "todo", None, []), ("TH-2", "todo", None, ["TH-1"]), ("TH-3", "todo", None, ["TH-2"]))
    want = frame([("b", "TH-1", ["3", "th-1", "TH-9"]), ("b", "TH-3", ["TH-1", "1"])], "board_id string, id string, deps array<string>") \
        .select("board_id", "id", F.posexplode("deps").alias("ord", "dep"))
    assert rows(O.set_blockers(issues, edges, want), "id", "ord", "dep", "verdict") == [
        ("TH-1", 0, "TH-3", "cycle"), ("TH-1", 1, "TH-1", "self"), ("TH-1", 2, "TH-9", "unknown"),
        ("TH-3", 0, "TH-1", "ok"), ("TH-3", 1, "TH-1", "duplicate")]


def plain_admission(boards, proposals):
    """Lists set one after another on plain dictionaries."""
    out = []
    for b, seq, id, deps in sorted(proposals, key=lambda p: (p[0], p[1])):
        lists = boards[b]
        if id not in lists or any(d not in lists for d in deps):
            out.append((b, seq, id, "unknown"))
            continue
        if id in deps:
            out.append((b, seq, id, "self"))
            continue
        seen, left = set(), list(deps)
        while left:
            n = left.pop()
            if n not in seen:
                seen.add(n)
                left += lists.get(n, []) if n != id else []
        out.append((b, seq, id, "cycle" if id in seen else "ok"))
        if id not in seen:
            lists[id] = list(deps)
    return sorted(out)


def refuse(*args, **kw):
    raise AssertionError("a small board walks in rounds")


def random_boards(frame, loops=False):
    rng, data = random.Random(11), []
    for b in ["p", "q", "r", None]:
        for pos in range(1, 13):
            waits = [f"TH-{rng.randint(1, 14) if loops else rng.randint(0, pos - 1)}" for _ in range(rng.randint(0, 3))]
            data.append((b, pos, f"TH-{pos - 1 if pos % 5 == 0 else pos}" if pos != 7 else None, "t", rng.choice(["todo", "doing", "done", None]),
                         rng.choice(["must", "high", "low", None]), waits))
    issues = frame(data, SCHEMA)
    return issues, O.edges_of(issues)


def test_small_boards_are_walked_in_their_rows(frame, monkeypatch):
    issues, edges = random_boards(frame, loops=True)
    columns = ["board_id", "id", "unblocks", "unblocks_urgent", "urgency", "urgency_from"]
    starts = issues.filter("pos % 2 = 0").select("board_id", F.col("id").alias("start"))
    with monkeypatch.context() as m:
        m.setattr(O.closure, "best_ahead", refuse)
        m.setattr(O.closure, "packed_reach", refuse)
        small, some = rows(O.leverage(issues, edges), *columns), rows(O.leverage(issues, edges, starts), *columns)
    monkeypatch.setattr(O.closure, "SMALL", 0)
    assert small == rows(O.leverage(issues, edges), *columns)
    assert some == rows(O.leverage(issues, edges, starts), *columns)


PROPOSALS = "board_id string, seq long, id string, deps array<string>"


def admitted(frame, issues, edges, proposals):
    want = frame(proposals, PROPOSALS).select("board_id", "seq", "id", F.posexplode_outer("deps").alias("ord", "dep"))
    return sorted(tuple(r) for r in O.admit_blockers(issues, edges, want).select("board_id", "seq", "id", "verdict").collect())


def test_a_batch_cannot_close_a_loop(frame):
    issues, edges = board(frame, ("TH-1", "todo", None, []), ("TH-2", "todo", None, []), ("TH-3", "todo", None, ["TH-2"]), ("TH-4", "todo", None, []))
    assert admitted(frame, issues, edges, [("b", 1, "TH-1", ["TH-2"]), ("b", 2, "TH-2", ["1"]), ("b", 3, "TH-2", ["TH-3"]), ("b", 4, "TH-3", []), ("b", 5, "TH-2", ["TH-3"]),
                                           ("b", 6, "TH-4", ["TH-4"]), ("b", 7, "TH-4", ["TH-9"]), ("b", 8, "TH-3", ["TH-1"]), ("b", 9, "TH-4", ["TH-1", "TH-3"])]) == [
        ("b", 1, "TH-1", "ok"), ("b", 2, "TH-2", "cycle"), ("b", 3, "TH-2", "cycle"), ("b", 4, "TH-3", "ok"), ("b", 5, "TH-2", "ok"), ("b", 6, "TH-4", "self"),
        ("b", 7, "TH-4", "unknown"), ("b", 8, "TH-3", "cycle"), ("b", 9, "TH-4", "ok")]


def test_batches_match_one_list_after_another(frame):
    rng = random.Random(7)
    boards, proposals, rows_ = {}, [], []
    for b in ["p", "q", "r", "s"]:
        n = 9
        lists = {f"TH-{i}": [f"TH-{j}" for j in range(1, i) if rng.random() < 0.15] for i in range(1, n + 1)}
        boards[b] = {k: list(v) for k, v in lists.items()}
        rows_ += [(b, p, k, v) for p, (k, v) in enumerate(lists.items())]
        proposals += [(b, s, f"TH-{rng.randint(1, n)}", [f"TH-{rng.randint(1, n)}" for _ in range(rng.randint(0, 2))]) for s in range(14)]
    issues = frame(rows_, "board_id string, pos int, id string, blocked_by array<string>")
    want = plain_admission(boards, proposals)
    assert {v for *_, v in want} == {"ok", "self", "cycle"}
    assert admitted(frame, issues, O.edges_of(issues), proposals) == want


def test_small_boards_enter_batches_in_their_rows(frame, monkeypatch):
    issues, edges = random_boards(frame)
    rng = random.Random(5)
    proposals = [(b, s, f"TH-{rng.randint(1, 13)}", [f"TH-{rng.randint(1, 13)}" for _ in range(rng.randint(0, 2))]) for b in ["p", "q", "r"] for s in range(12)]
    proposals.append(("p", 12, "TH-3", ["TH-3"]))
    with monkeypatch.context() as m:
        m.setattr(O, "_meets", refuse)
        small = admitted(frame, issues, edges, proposals)
    assert {v for *_, v in small} == {"ok", "self", "cycle", "unknown"}
    # Without a board or a place in the order a proposal is judged by itself.
    odd = [(None, 1, "TH-1", ["TH-2"]), ("p", None, "TH-1", ["TH-2"])]
    want = frame(proposals + odd, PROPOSALS).select("board_id", "seq", "id", F.posexplode_outer("deps").alias("ord", "dep"))
    together = rows(O.admit_blockers(issues, edges, want))
    assert len(together) == len(small) + 2 and set(small) <= set(together)
    monkeypatch.setattr(O.closure, "SMALL", 0)
    assert together == rows(O.admit_blockers(issues, edges, want))


def test_sync_plan_texts(frame):
    issues, edges = board(frame, ("TH-1", "done", None, []), ("TH-2", "doing", "high", ["TH-1", "TH-7"]))
    issues = issues.withColumn("description", F.lit("Do it.")).withColumn("comments", F.array(F.lit("a"), F.lit("b")))
    links = frame([("b", "TH-1", 12, 1, "OPEN")], "board_id string, id string, number int, comments int, state string")
    got = {r.id: r for r in O.sync_plan(issues, edges, links, marker="tracker").collect()}
    assert (got["TH-1"].action, got["TH-1"].state_change, got["TH-1"].new_comments) == ("update", "close", 1)
    assert (got["TH-2"].action, got["TH-2"].new_comments) == ("create", 0)
    assert got["TH-2"].body == "Do it.\n\n**Blocked by:** #12, TH-7\n\n---\ntracker: `TH-2`\n"
    labels = issues.select(F.array_join(O.export_labels(F.array(), "status", "priority"), ","))
    assert rows(labels) == [("",), ("doing,high",)]


def test_unknown_columns_survive_and_newer_versions_are_refused(frame):
    old = frame([("b", "TH-1", "todo", 5), ("b", "TH-2", "todo", 8)], "board_id string, id string, status string, points int")
    new = frame([("b", "TH-1", "done")], "board_id string, id string, status string")
    assert rows(O.preserve_unknown(old, new, ["board_id", "id"])) == [("b", "TH-1", "done", 5)]
    assert O.schema_guard(frame([(1,)], "version int")).count() == 1
    with pytest.raises(Exception, match="schema version 2"):
        O.schema_guard(frame([(2,)], "version int")).collect()


def test_ids(frame):
    df = frame([("7",), ("th-07",), (" TH-7 ",), ("wo-8a",), ("",)], "r string")
    assert [r[0] for r in df.select(X.normalize_id("r", F.lit("TH"))).collect()] == ["TH-7", "TH-7", "TH-7", "WO-8A", ""]
    assert [r[0] for r in df.select(X.log_id_key("r")).collect()] == ["7", "TH-7", "TH-7", "WO-8a", ""]

"""A journal with the shapes people leave behind."""

from conftest import rows
from workgraph.operators import journal as J
from workgraph.session import cut
from workgraph.sources import files as S

LOG = """# Log

Kept by hand.

---

## 2026-09-08 — TH-01: first decision

Body one. See TH-02 and UTF-8.

---

## 2026-09-07 - a title that
## wrapped onto a second line
Body two.
**Amended:** PLAN.md section 3

## Undated heading

We amended things here.

## 2026-09-09 — canonical


"""


def journal(frame, text=LOG):
    lines = cut(S.log_lines(frame([(1, text.replace("\n", "\r\n"))], "log_id int, text string")))
    entry_lines = cut(J.entry_lines(lines))
    return entry_lines, cut(J.parse_entries(entry_lines))


def test_entries(frame):
    _, entries = journal(frame)
    assert rows(entries, "entry_no", "line", "date", "effective_date", "title", "canonical", "body_lines") == [
        (1, 7, "2026-09-08", "2026-09-08", "TH-01: first decision", True, 3),
        (2, 13, "2026-09-07", "2026-09-07", "a title that wrapped onto a second line", False, 2),
        (3, 18, None, "2026-09-07", "Undated heading", False, 2),
        (4, 22, "2026-09-09", "2026-09-09", "canonical", True, 0)]


def test_queries(frame):
    lines, entries = journal(frame)
    assert rows(J.out_of_order(entries), "entry_no", "date", "previous_date") == [(2, "2026-09-07", "2026-09-08")]
    assert rows(J.log_since(entries, "2026-09-08"), "entry_no") == [(1,), (4,)]
    assert rows(J.log_tail(entries, 2), "entry_no") == [(3,), (4,)]
    assert rows(J.log_tail(entries, 0), "entry_no") == [(1,), (2,), (3,), (4,)]
    assert rows(J.log_search(lines, "second|BODY"), "line", "in_heading") == [(9, False), (14, True), (15, False)]
    assert rows(J.log_search(lines, "plan.md", fixed=True), "line") == [(16,)]
    assert rows(J.log_amendments(lines, "plan.md"), "line") == [(16,)]
    assert rows(J.log_amendments(lines, "other")) == []
    assert rows(J.loose_amendments(lines), "loose") == [(1,)]
    assert rows(J.log_ids(lines), "prefix", "id", "line") == [("TH", "TH-01", 7), ("TH", "TH-02", 9), ("UTF", "UTF-8", 9)]


def test_issue_lookup_ignores_padding(frame):
    lines, _ = journal(frame)
    want = frame([(1, "th-1"), (1, "TH-002"), (1, "Kept"), (1, "wrapped")], "log_id int, id string")
    assert rows(J.log_issue(lines, want), "id", "entry_no", "in_heading", "place") == [
        ("TH-002", 1, False, 1), ("th-1", 1, True, 1), ("wrapped", 2, True, 1)]


def test_check_against_the_board(frame):
    lines, entries = journal(frame)
    boards = frame([(1, "b", "TH")], "log_id int, board_id string, prefix string")
    issue = "board_id string, id string, title string, status string, updated_at timestamp"
    import datetime as dt
    now = dt.datetime(2026, 9, 9)
    issues = frame([("b", "TH-1", "one", "done", now), ("b", "TH-5", "five", "done", now)], issue)
    done = frame([("b", "TH-6", "six", "done", dt.datetime(2020, 1, 1))], issue)
    found = J.log_board_check(lines, entries, boards, issues, done, since="2026-01-01", strict=True)
    assert rows(found, "kind", "id", "line", "fatal") == [
        ("no such issue", "TH-02", 9, True), ("off-format", "", 13, True), ("out-of-order", "", 13, True),
        ("undated", "", 18, True), ("unlogged", "TH-5", 0, True)]

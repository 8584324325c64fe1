"""Files in each tool's own format read as tables."""

import json

import pandas as pd

from conftest import rows
from workgraph.session import checkpoint_root, cut
from workgraph.sources import boards as SB
from workgraph.sources import files as S
from workgraph.sources import git as G
from workgraph.sources import patches as SP

BOARD = """version: 1
next_id: 3
escalate: {high: 2, must: 0}
colour: blue
issues:
  - id: TH-1
    title: one
    status: done
    created_at: 2024-01-02T03:04:05Z
    estimate: {points: 5}
    comments:
      - {at: 2024-01-02T03:04:05Z, author: ann, body: hi}
  - id: TH-2
    title: two
    status: todo
    priority: must
    blocked_by: [TH-1, TH-9]
    github: {number: 7}
"""


def test_boards(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(BOARD)
    (tmp_path / "empty.yaml").write_text("prefix: WO\n")
    (tmp_path / "broken.yaml").write_text("issues: [\n")
    records = cut(SB.read_boards(spark, str(tmp_path / "*.yaml")))
    boards, issues, errors = SB.board_tables(records)
    assert rows(boards, "prefix", "next_id", "esc_high", "esc_must") == [("TH", 3, 2, 0), ("WO", 1, None, None)]
    assert rows(issues, "pos", "id", "priority", "gh_number") == [(1, "TH-1", None, None), (2, "TH-2", "must", 7)]
    first = issues.filter("pos = 1").first()
    assert json.loads(first.extra["estimate"]) == {"points": 5} and first.comments[0].author == "ann"
    assert str(first.created_at) == "2024-01-02 03:04:05" and issues.filter("pos = 2").first().blocked_by == ["TH-1", "TH-9"]
    assert errors.count() == 1 and SB.read_done_log(spark, str(tmp_path / "none.yaml")).count() == 0


def test_git_logs(frame):
    log = ("\x1eabc\x1fAnn\x1fa@x\x1f2024-01-02T03:04:05+02:00\x1ffirst\n\nM\ta.go\nR090\told.go\tnew.go\n"
           "\x1edef\x1fBob\x1fnot a date\x1fsecond\nM\tb.go\n")
    commits, files, errors = G.parse_git_log(frame([(1, log)], "repo_id int, text string"))
    assert rows(commits, "sha", "author", "subject") == [("abc", "Ann", "first")]
    assert rows(files, "status", "path", "old_path") == [("M", "a.go", None), ("R090", "new.go", "old.go")]
    assert errors.count() == 1
    stat = "\x1eabc\n3\t1\tsrc/{a => b}/c.go\n-\t-\timg.png\nnoise\n\n\x1edef\n1\t0\told.go => new.go\n"
    assert rows(G.parse_numstat(frame([(1, stat)], "repo_id int, text string")), "sha", "path", "added", "deleted") == [
        ("abc", "img.png", 0, 0), ("abc", "src/b/c.go", 3, 1), ("def", "new.go", 1, 0)]


def test_remote_comment_pages(spark, tmp_path):
    review = [{"id": 1, "body": "a", "path": "x.go", "line": None, "original_line": 4, "side": "LEFT", "user": {"login": "ann"}},
              {"id": 2, "body": "b", "path": "x.go", "line": 9, "original_line": 4, "side": "RIGHT", "user": {"login": "bob"}}]
    for page, part in enumerate([review[:1], review[1:]]):
        (tmp_path / f"r{page}.json").write_text(json.dumps(part))
    (tmp_path / "g.json").write_text(json.dumps([{"id": 3, "body": "c", "user": {"login": "cy"}}]))
    out = S.read_remote_comments(spark, str(tmp_path / "r*.json"), str(tmp_path / "g.json"))
    assert rows(out, "id", "author", "line", "side", "outdated") == [(1, "ann", 4, "old", True), (2, "bob", 9, "new", False), (3, "cy", None, None, False)]


def test_cases_sessions_and_trees(spark, tmp_path):
    cases = tmp_path / "cases"
    cases.mkdir()
    (cases / "001.json").write_text(json.dumps({"path": "a.go", "hunk": "+x", "expected": {"kind": "test", "symbols": ["x"], "added_lines": 1, "removed_lines": 0}}, indent=1))
    (cases / "002.json").write_text(json.dumps({"id": "named", "path": "b.go"}))
    assert rows(S.read_cases(spark, str(cases)), "case_id", "expected_kind") == [("001", "test"), ("named", None)]
    home = tmp_path / "sessions" / "repo1"
    home.mkdir(parents=True)
    (home / "s1.json").write_text(json.dumps({"id": "s1", "states": {"h1": {"hunk_id": "h1", "path": "a.go", "status": "reviewed"}},
                                              "comments": [{"id": "c1", "body": "hm", "anchor": {"path": "a.go", "hunk_id": "h1", "position": 2}}]}, indent=1))
    sessions = S.read_sessions(spark, str(tmp_path / "sessions"))
    assert rows(S.session_states(sessions), "repo_key", "session_id", "hunk_id", "status") == [("repo1", "s1", "h1", "reviewed")]
    assert rows(S.session_comments(sessions), "comment_id", "anchor_hunk", "position") == [("c1", "h1", 2)]
    tree = tmp_path / "tree"
    for name in ["m.go", "vendor/v.go", "sub/n.py", "sub/notes.txt", "Makefile"]:
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_text("code\n")
    assert sorted(r.language for r in S.read_source_tree(spark, str(tree), ["go", "python"]).collect()) == ["go", "python"]


def test_is_patch_and_checkpoint_folder(spark, frame):
    df = frame([("x\n@@ -1 +1 @@",), ("--- a\n+++ b",), ("--- a",), ("prose",)], "text string")
    assert [r[0] for r in df.select(SP.is_patch("text")).collect()] == [True, True, False, False]
    assert checkpoint_root(spark) and cut(df).inputFiles()[0].replace("file://", "").startswith(checkpoint_root(spark).replace("file://", ""))


def test_boards_are_parsed_a_piece_at_a_time(monkeypatch):
    """No more than ``PIECE`` issues are loaded at once, and the records are those of the whole file, broken ones included."""
    item = "- id: TH-{0}\n  title: 'a\n\n  - b'\n  description: |\n    x\n    - y\n# note\n"
    tail = "next_id: 9\ncolour: blue\n"
    good = [f"issues:\n{''.join(item.format(i) for i in range(7))}{tail}", "issues:\n  - id: a\n\n  - id: b\n  - id: c\nprefix: Q\n"]
    odd = ["issues:\n- &x {id: 1}\n- {id: 2}\n- *x\n", "issues:\n- id: 1\n- id: 2\n- id: [\n", "issues:\n- id: 1\n- title: 'q\n- id: 2\n- id: 3'\n- id: 4\n", "issues: []\n", ""]
    whole = lambda text: [r for rows in SB._whole("b", text.encode()) for r in rows]
    loaded, load = [], SB._load

    def watched(content):
        out = load(content)
        loaded.append(len(out) if isinstance(out, list) else len((out or {}).get("issues") or []))
        return out

    def records(text):
        parts = SB._parse(iter([pd.DataFrame({"board_id": ["b"], "content": [text.encode()]})]))
        return [(r["pos"], r["id"], r["title"], r["extra"], r["prefix"], r["error"]) for part in parts for r in part.to_dict("records")]

    wants = {t: [(r.get("pos"), r.get("id"), r.get("title"), r.get("extra"), r.get("prefix"), None) for r in whole(t)] for t in [*good, *odd] if "[\n" not in t}
    monkeypatch.setattr(SB, "PIECE", 2)
    monkeypatch.setattr(SB, "_load", watched)
    for text in good:
        assert records(text) == wants[text]
    assert max(loaded) == 2
    for text in odd:
        got = records(text)
        assert got == wants[text] if text in wants else [r[:2] for r in got] == [(None, None)] and got[0][5].startswith("not a valid board")


def test_a_run_is_not_written_by_every_task(spark, tmp_path):
    events = spark.range(0, 60, 1, 6).selectExpr("id % 3 AS run_id", "'finding' AS type", "true AS accepted")
    S.write_run_log(events, str(tmp_path / "log"))
    assert len(list((tmp_path / "log").glob("run_id=*/*.json"))) == 3
    assert S.read_run_log(spark, str(tmp_path / "log")).count() == 60


def test_sessions_are_written_and_read_by_tasks_of_many_files(spark, tmp_path):
    """A file per session: what a task writes and reads follows from the number of files, not from their few bytes."""
    from datetime import datetime

    from __spark_entry__ import queries

    spark.createDataFrame([(i, datetime(2024, 1, 1, 0, i % 60), i % 450, "click", 1.0, "{}") for i in range(900)],
                          "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    out = queries()["read_sessions"](spark, str(tmp_path))
    assert len(out.inputFiles()) == 450
    assert out.rdd.getNumPartitions() <= 20
    writers = {f.rsplit("/", 1)[-1].split("-")[1] for f in out.inputFiles()}
    assert 3 <= len(writers) <= 4
    got = sorted(tuple(r) for r in out.select("session_id", "hunk_id", "path", "status").collect())
    assert got == sorted({(str(i % 450), str(i % 30), f"p{i % 30}", "reviewed") for i in range(900)})

"""Scenario files, step registrations, scoring, evidence, markdown, statistics."""

import random
import statistics

from pyspark.sql import functions as F

from conftest import rows
from workgraph.functions import text as T
from workgraph.functions import ids as X
from workgraph.operators import evaluation as E
from workgraph.operators import features as O
from workgraph.operators import markdown as M
from workgraph.operators import robust as R
from workgraph.operators.literals import literal_free, literal_matches, required_runs

FEATURE = """Feature: Accounts
  Background:
    Given a clean store
  Rule: names
    Scenario: create
      When "ann" signs up
      Then there are 2 users
    Scenario Outline: many
      Given <n> users named <who>
      Examples:
        | n | who |
        | 4 | bob |
        | 5 | eve |
"""


def feature(frame):
    lines = frame([(0, "a.feature", i, t) for i, t in enumerate(FEATURE.split("\n")[:-1], 1)], "repo_id int, path string, line int, text string")
    return lines, O.feature_outline(lines)


def test_outline_nesting(frame):
    _, outline = feature(frame)
    assert rows(outline.filter("kind != 'step'"), "start_line", "end_line", "kind", "id") == [
        (1, 13, "feature", "a.feature#Accounts"), (2, 3, "background", "a.feature#Accounts."), (4, 13, "rule", "a.feature#Accounts.names"),
        (5, 7, "scenario", "a.feature#names.create"), (8, 13, "scenario", "a.feature#names.many")]


def test_outline_in_blocks_equals_one_block(frame):
    rng = random.Random(5)
    text = ["Feature: f", "Rule: r", "Background:", "Scenario: s", "Given x", "Then y", "plain", ""]
    lines = frame([(p % 2, f"{p}.feature", i, f"  {rng.choice(text)}{i if i % 3 else ''}") for p in range(4) for i in range(1, 120)],
                  "repo_id int, path string, line int, text string")
    whole = rows(O.feature_outline(lines, block=1000))
    assert len(whole) > 200
    for block in (1, 7, 64):
        assert rows(O.feature_outline(lines, block=block)) == whole


def test_required_runs(frame):
    cases = {r"^a (\S+) does (\d+)$": ["a ", " does "], r"[Tt]he": ["he"], r"ends$": ["ends"], r"colou?r": ["colo", "r"], "ab+c": ["ab", "c"],
             r"a|bcd": [], r"(?i)TH-\.x": ["th-", "x"], r"x(?i)y": [], r"(ab|cd)+ef": ["ef"], r"((a)b(c(d)))e{0,2}f": ["f"], r"[a[bc]d]ef": [],
             r"\Qab\Ecd": [], r"\p{Lu}ab\x41c": ["ab", "c"], r"[]a]bcd": [], r"^\d+$": [], "": [], r"(?<n>a)bc\k<n>d": ["bc", "d"], r"ab*?cd": ["a", "cd"],
             None: []}
    got = frame([(c,) for c in cases], "pattern string").select("pattern", required_runs(F.col("pattern")).alias("runs")).collect()
    assert {r.pattern: r.runs for r in got} == cases


def test_literal_matches_equal_the_plain_join(frame):
    rng = random.Random(8)
    bits = ["ab", "B", "a.c", "abc", "x+", "[ab]", "(cd|e)", "c?", "^", "$", r"\d", " ", "Cab", "é", "d{0,2}", "(?:ab)*"]
    patterns = {(k, f"p{i}", "".join(rng.choice(bits) for _ in range(rng.randint(1, 4)))) for k in (0, 1) for i in range(60)}
    patterns |= {(0, "pi", "(?i)CAB"), (1, "pn", None), (0, "pe", "")}
    texts = {(k, "".join(rng.choice("abcdeBCx1 é") for _ in range(rng.randint(0, 14)))) for k in (0, 1, 2) for _ in range(80)} | {(0, None), (0, "")}
    t, p = frame(list(texts), "k int, text string"), frame(list(patterns), "k int, id string, pattern string")
    met = literal_matches(t, p, ["k"])
    plain = t.join(p, "k").filter(F.rlike("text", F.col("pattern")))
    assert rows(met, "k", "text", "id") == rows(plain, "k", "text", "id") and plain.count() > 300
    assert rows(literal_matches(t.limit(0), p, ["k"]), "id") == [] and rows(literal_matches(t, p.limit(0), ["k"]), "id") == []
    assert ("pe",) in rows(literal_free(p), "id") and ("pi",) not in rows(literal_free(p), "id")


def test_steps_match_definitions(frame):
    lines, outline = feature(frame)
    defs = frame([(0, "d1", r'^"([^"]*)" signs up$', "s.go#up"), (0, "d2", r"^there are (-?\d+) users$", ""), (0, "d3", r"users", ""),
                  (0, "d4", r"^4 users named bob$", "")], "repo_id int, def_id string, pattern string, handler_id string")
    links = O.match_steps(O.step_texts(lines, outline), defs)
    assert rows(links, "start_line", "text", "to_id", "confidence") == [
        (3, "a clean store", None, None), (6, '"ann" signs up', "s.go#up", "static"), (7, "there are 2 users", "d2", "heuristic"),
        (7, "there are 2 users", "d3", "heuristic"), (9, "4 users named bob", "d3", "heuristic"), (9, "4 users named bob", "d4", "heuristic")]
    assert rows(O.scenarios_using(links, outline), "to_id", "name") == [
        ("d2", "create"), ("d3", "create"), ("d3", "many"), ("d4", "many"), ("s.go#up", "create")]


def test_step_registrations(frame):
    go = 'package s\n\nfunc Init(ctx *C) {\n\tctx.Step(`^a (\\d+)$`, doA)\n\tctx.Given("^say \\"hi\\"$", pkg.Do)\n}\n'
    java = 'class S {\n  @When("the {int} of {word}?")\n  void go() {}\n}\n'
    js = "const x = 1\nGiven(/^b$/, async function () {})\nThen('it costs {float}', costs)\n"
    sources = frame([(0, "s.go", "go", go), (0, "S.java", "java", java), (0, "s.ts", "typescript", js)], "repo_id int, path string, language string, text string")
    symbols = frame([(0, "s.go#doA", "doA", "func", "go", "s.go", 9, 9, 0), (0, "S.java#S.go", "go", "method", "java", "S.java", 2, 3, 0),
                     (0, "s.ts#outer", "outer", "func", "typescript", "s.ts", 1, 3, 0), (0, "c.ts#costs", "costs", "func", "tsx", "c.ts", 1, 1, 0)],
                    "repo_id int, id string, name string, kind string, language string, path string, start_line int, end_line int, ord int")
    assert rows(O.extract_step_defs(sources, symbols), "path", "line", "keyword", "pattern", "handler_id") == [
        ("S.java", 2, "When", r"^the (-?\d+) of (\S+)\?$", "S.java#S.go"), ("s.go", 4, "", r"^a (\d+)$", "s.go#doA"),
        ("s.go", 5, "Given", '^say "hi"$', ""), ("s.ts", 2, "Given", "^b$", "s.ts#outer"),
        ("s.ts", 3, "Then", r"^it costs (-?\d+(?:\.\d+)?)$", "c.ts#costs")]


def test_scores(frame):
    cases = frame([("c", "pkg/a.go", "+func Load() {}", "", "behavior", ["Load", "Save"], 3, 1)],
                  "case_id string, path string, hunk string, enclosing_function string, expected_kind string, expected_symbols array<string>, added_lines int, removed_lines int")
    outs = frame([("good", "c", True, "behavior", "Load() does it, +3/-1"), ("made_up", "c", True, "test", "fooBar calls Load, +9/-9"),
                  ("plain", "c", True, "behavior", "nothing named"), ("bad", "c", False, "behavior", "Load")],
                 "out string, case_id string, json_valid boolean, kind string, what string")
    outs = outs.withColumn("inferred_why", F.lit("")).withColumn("impact", F.lit(""))
    got = {r.out: r for r in E.score_cases(cases, outs).collect()}
    assert round(got["good"].score, 4) == round(0.30 + 0.35 + 0.125 + 0.10, 4)
    assert round(got["made_up"].score, 4) == round(0.125, 4) and got["made_up"].hallucinated == ["fooBar"]
    assert round(got["plain"].score, 4) == round(0.30 + 0.35 + 0.10, 4)
    assert got["bad"].score == 0 and got["bad"].candidates == []


def test_evidence_window(frame):
    lines = frame([(r, "a.go", i, f"line number {i + 3 * r} end") for r in (0, 1) for i in range(1, 11)], "repo_id int, path string, line int, text string")
    ev = frame([("f1", 0, "a.go", 5, " number 5 "), ("f1", 1, "a.go", 5, "number 7"), ("f2", 0, "a.go", 5, "number 8"), ("f2", 1, "a.go", 5, " "),
                ("f2", 2, "no.go", 1, "x"), ("f3", 0, "a.go", 6, "line number")], "finding_id string, ev_no int, path string, line int, excerpt string").withColumn("repo_id", F.lit(0))
    findings = frame([("f1",), ("f2",), ("f3",), ("f4",)], "finding_id string")
    got = {r.finding_id: (r.verified, r.verification) for r in E.verify_evidence(findings, ev, lines).collect()}
    assert got == {"f1": (True, "verified 2/2 evidence line(s)"), "f3": (True, "verified 1/1 evidence line(s)"), "f4": (False, "rejected: no evidence"),
                   "f2": (False, "rejected: a.go:5: excerpt not found within +/-2 lines; a.go:5: empty excerpt; no.go: file not found")}
    assert rows(E.locate_evidence(ev, lines).filter("finding_id != 'f2'"), "finding_id", "ev_no", "found_line") == [("f1", 0, 5), ("f1", 1, 7), ("f3", 0, 6)]


MARKDOWN = """# Title & more
plain **bold
over** lines with `a*b*c`
- [x] done http://x.org/a_(b).
- [ ] open
1. one
2) two

```
<raw> *not*
```
see [text](https://e.org/?a=1&b=2), *end*"""


def test_markdown_html(frame):
    lines = frame([(1, i, t) for i, t in enumerate(MARKDOWN.split("\n"), 1)], "doc_id int, line int, text string")
    blocks = M.md_blocks(lines)
    html = "".join(r.html for r in sorted(M.md_html(blocks).collect(), key=lambda r: r.block_no))
    a = lambda u, t: f'<a href="{u}" target="_blank" rel="noopener noreferrer">{t}</a>'
    assert html == (
        "<h1>Title &amp; more</h1><p>plain <strong>bold over</strong> lines with <code>a*b*c</code></p>"
        '<ul><li class="task done"><input type="checkbox" disabled checked>done ' + a("http://x.org/a_(b)", "http://x.org/a_(b)") + ".</li>"
        '<li class="task"><input type="checkbox" disabled>open</li></ul><ol><li>one</li><li>two</li></ol>'
        "<pre>&lt;raw&gt; *not*</pre><p>see " + a("https://e.org/?a=1&amp;b=2", "text") + ", <em>end</em></p>")
    progress = M.task_progress(blocks).first()
    assert (progress.tasks, progress.finished, progress.ratio) == (2, 1, 0.5)
    texts = frame([("x (http://a.b/c?d=1). [t](http://e.f/g)",)], "text string")
    assert rows(M.extract_links(texts), "kind", "url") == [("bare", "http://a.b/c?d=1"), ("named", "http://e.f/g")]


def test_robust_statistics(frame):
    data = [("g", float(i % 17) ** 2, i) for i in range(101)]
    df = frame(data, "k string, x double, i int")
    out = R.robust_mad(df, ["k"], "x", k=2.0).collect()
    xs = [x for _, x, _ in data]
    mid = statistics.median(xs)
    mad = 1.4826 * statistics.median([abs(x - mid) for x in xs]) + 1e-6
    assert all(r.median == mid and abs(r.mad - mad) < 1e-9 and r.outlier == (abs(r.x - mid) > 2 * mad) for r in out)
    capped = [max(-20.0, min(20.0, x)) for x in xs]
    for wide, block in ((5, 16), (31, 4), (31, 4096)):
        rolled = {r.i: r.baseline for r in R.rolling_median(df, ["k"], [F.col("i")], "x", rows=wide, block=block).collect()}
        for i in range(101):
            window = [capped[max(0, min(100, j))] for j in range(i - wide // 2, i + wide // 2 + 1)]
            assert rolled[i] == max(0.0, min(40.0, statistics.median(window)))


def test_blank_text_is_not_json_and_ids_sort_by_number(frame):
    df = frame([("",), (" ",), ("{}",), ("{} x",)], "t string")
    assert [r[0] for r in df.select(E.is_json(F.col("t"))).collect()] == [False, False, True, False]
    ids = frame([("TH-10",), ("TH-x",), ("TH-9",), ("TH-2",), ("plain",)], "id string")
    assert [r.id for r in ids.orderBy(X.id_sort_key("id")).collect()] == ["TH-2", "TH-9", "TH-10", "TH-x", "plain"]


def test_text_helpers(frame):
    df = frame([("a\nb\nc", "```json\n{}\n```")], "t string, j string")
    assert df.select(T.text_of_range("t", F.lit(2), F.lit(9)), T.text_of_range("t", F.lit(4), F.lit(5)), T.clean_json("j")).first()[:] == ("b\nc", "", "{}")

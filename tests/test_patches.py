"""Patches: every shape parses and prints back byte for byte; numbering, pairing and marks."""

import random

import pytest

from conftest import rows
from workgraph.operators import patches as O
from workgraph.session import cut
from workgraph.sources import patches as S

SHAPES = {
    "modified": "diff --git a/m.go b/m.go\nindex 1a2b3c4..5d6e7f8 100644\n--- a/m.go\n+++ b/m.go\n@@ -1,3 +1,4 @@ func main() {\n a\n-b\n+c\n+d\n e\n",
    "added": "diff --git a/n.txt b/n.txt\nnew file mode 100644\nindex 0000000..1111111\n--- /dev/null\n+++ b/n.txt\n@@ -0,0 +1 @@\n+x\n",
    "deleted": "diff --git a/o.txt b/o.txt\ndeleted file mode 100644\nindex 1111111..0000000\n--- a/o.txt\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n",
    "renamed": "diff --git a/p q.txt b/r s.txt\nsimilarity index 91%\nrename from p q.txt\nrename to r s.txt\n",
    "copied": "diff --git a/c.txt b/d.txt\nsimilarity index 100%\ncopy from c.txt\ncopy to d.txt\n",
    "mode": "diff --git a/run.sh b/run.sh\nold mode 100644\nnew mode 100755\n",
    "binary": "diff --git a/i.png b/i.png\nindex 1111111..2222222 100644\nBinary files a/i.png and b/i.png differ\n",
    "git_binary": "diff --git a/i.bin b/i.bin\nindex 1111111..2222222 100644\nGIT binary patch\nliteral 3\nKcmZ\n\nliteral 0\nHcmV\n\ndiff --git a/z b/z\nold mode 100644\nnew mode 100755\n",
    "crlf": "diff --git a/w.txt b/w.txt\n--- a/w.txt\n+++ b/w.txt\n@@ -1,2 +1,2 @@\n a\r\n-b\r\n+c\r\n",
    "no_newline": "diff --git a/e.txt b/e.txt\n--- a/e.txt\n+++ b/e.txt\n@@ -1 +1 @@\n-a\n\\ No newline at end of file\n+b\n\\ No newline at end of file\n",
    "quoted": 'diff --git "a/caf\\303\\251\\t.txt" "b/caf\\303\\251\\t.txt"\n--- "a/caf\\303\\251\\t.txt"\n+++ "b/caf\\303\\251\\t.txt"\n@@ -1 +1 @@\n-a\n+b\n',
    "lookalike": "diff --git a/l.sql b/l.sql\n--- a/l.sql\n+++ b/l.sql\n@@ -1,3 +1,3 @@\n--- old comment\n+-- new comment\n diff --git a/x b/x\n @@ -1 +1 @@\n",
    "two_hunks": "--- a/t.txt\n+++ b/t.txt\n@@ -1,2 +1,2 @@\n a\n-b\n+B\n@@ -10,2 +10,3 @@ part\n y\n+new\n z\n",
}


def parsed(frame, texts):
    patches = frame(list(texts.items()), "review_id string, text string")
    return S.patch_tables(cut(S.parse_patches(patches)))


def test_round_trip(frame):
    files, hunks, lines, errors = parsed(frame, SHAPES)
    assert errors.count() == 0
    out = {}
    for r in sorted(S.emit_patches(files, hunks, lines).collect(), key=lambda r: (r.review_id, r.file_no, r.hunk_no, r.line_no, r.part)):
        out[r.review_id] = out.get(r.review_id, "") + r.text + "\n"
    assert out == SHAPES
    got = {(r.review_id, r.file_no): (r.status, r.old_path, r.new_path, r.path, r.binary) for r in files.collect()}
    assert got["added", 0] == ("added", "", "n.txt", "n.txt", False)
    assert got["deleted", 0] == ("deleted", "o.txt", "", "o.txt", False)
    assert got["renamed", 0] == ("renamed", "p q.txt", "r s.txt", "r s.txt", False)
    assert got["copied", 0][0] == "copied" and got["mode", 0][3] == "run.sh"
    assert got["binary", 0][4] and got["git_binary", 0][4] and got["git_binary", 1][3] == "z"
    assert got["quoted", 0][3] == "café\t.txt"
    modes = {r.review_id: (r.old_mode, r.new_mode, r.similarity) for r in files.collect()}
    assert modes["modified"] == ("100644", "100644", None) and modes["mode"][:2] == ("100644", "100755") and modes["renamed"][2] == 91


@pytest.mark.parametrize("text", ["hello\n", "diff --git a/x b/x\n--- a/x\n", "--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n a\n",
                                  "--- a/x\n+++ b/x\n@@ bad @@\n", "--- a/x\n+++ b/x\n@@ -1 +1 @@\n?what\n"])
def test_malformed_patches_are_errors(frame, text):
    files, _, _, errors = parsed(frame, {"r": text})
    assert errors.count() == 1 and files.count() == 0


def test_numbers_and_positions(frame):
    _, hunks, lines, _ = parsed(frame, {k: SHAPES[k] for k in ["two_hunks", "no_newline"]})
    numbered = O.diff_positions(O.line_numbers(lines, hunks))
    got = rows(numbered.filter("review_id = 'two_hunks'"), "hunk_no", "line_no", "old_no", "new_no", "position")
    assert got == [(0, 0, 1, 1, 1), (0, 1, 2, 0, 2), (0, 2, 0, 2, 3), (1, 0, 10, 10, 5), (1, 1, 0, 11, 6), (1, 2, 11, 12, 7)]
    assert rows(numbered.filter("review_id = 'no_newline'"), "line_no", "position") == [(0, 1), (1, 3)]
    want = frame([("two_hunks", 0, "old", 11), ("two_hunks", 0, "new", 11), ("two_hunks", 0, "old", 5)], "review_id string, file_no int, side string, line int")
    assert rows(O.line_at(numbered, want), "side", "hunk_no", "line_no", "position") == [("new", 1, 1, 6), ("old", 1, 2, 7)]


def test_hunk_id_ignores_line_numbers_and_carriage_returns(frame):
    moved = SHAPES["crlf"].replace("@@ -1,2 +1,2 @@", "@@ -7,2 +7,2 @@").replace("\r", "")
    files, _, lines, _ = parsed(frame, {"a": SHAPES["crlf"], "b": moved, "c": moved.replace("+c", "+d")})
    ids = {r.review_id: r.hunk_id for r in O.hunk_ids(lines, files).collect()}
    assert ids["a"] == ids["b"] != ids["c"]


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def test_intraline_marks_cover_what_is_not_common(frame):
    rng = random.Random(7)
    word = lambda: " ".join(rng.choice(["foo", "bar", "é_1", "(", "x1"]) for _ in range(rng.randrange(1, 9)))
    long = [rng.choice(["foo", "bar", "baz"]) for _ in range(450)]
    data = [(i, word(), word()) for i in range(60)] + [(60, " ".join(long), " ".join(x for i, x in enumerate(long) if i % 50))]
    out = O.intraline_marks(frame(data, "i int, old_text string, new_text string")).collect()
    import regex
    for r in out:
        tokens = [regex.findall(r"[_\p{L}\p{Nd}]+|[ \t]+|.", t) for t in (r.old_text, r.new_text)]
        assert r.i < 60 or r.old_marks
        kept = []
        for text, marks in ((r.old_text, r.old_marks), (r.new_text, r.new_marks)):
            raw, gone = text.encode(), set()
            for m in marks:
                gone |= set(range(m.start, m.end))
            kept.append(bytes(b for k, b in enumerate(raw) if k not in gone).decode())
        assert kept[0] == kept[1]
        assert len(regex.findall(r"[_\p{L}\p{Nd}]+|[ \t]+|.", kept[0])) <= lcs(*tokens)
        common = sum(len(t) for t in tokens) - 2 * lcs(*tokens)
        marked = sum(len(regex.findall(r"[_\p{L}\p{Nd}]+|[ \t]+|.", text.encode()[m.start:m.end].decode()))
                     for text, marks in ((r.old_text, r.old_marks), (r.new_text, r.new_marks)) for m in marks)
        assert marked == common


def test_large_comparisons_are_halved_without_losing_length(monkeypatch):
    rng = random.Random(3)
    for cells in (1, 20, 4_000_000):
        monkeypatch.setattr(O, "CELLS", cells)
        for _ in range(40):
            a, b = ([rng.choice("abc") for _ in range(rng.randrange(25))] for _ in range(2))
            kept_a, kept_b = O._common(a, b)
            assert [x for x, k in zip(a, kept_a) if k] == [x for x, k in zip(b, kept_b) if k]
            assert kept_a.sum() == lcs(a, b)

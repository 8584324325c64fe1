"""Patches to tables and back.

Whether a line belongs to a hunk depends on the counts its header declares, so
one patch text is read in order; patches are independent and spread over the
cluster. Numbering, positions, ids and pairing are left to Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from workgraph.functions import paths as P
from workgraph.functions.ids import col

NO_NEWLINE = "\\ No newline at end of file"
_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)")
_QUOTED = r'"(?:[^"\\]|\\.)*"'
_ESCAPE = re.compile(rb"\\([0-3][0-7]{2}|.)", re.S)
# Single-character escapes of a quoted path.
_ESCAPES = {b"n": b"\n", b"t": b"\t", b"r": b"\r", b"a": b"\a", b"b": b"\b", b"f": b"\f", b"v": b"\v"}
# Extended header lines and the field each fills.
_HEADERS = {"old mode ": "old_mode", "new mode ": "new_mode", "deleted file mode ": "deleted", "new file mode ": "added",
            "similarity index ": "similarity", "dissimilarity index ": "", "rename from ": "rename_from",
            "rename to ": "rename_to", "copy from ": "copy_from", "copy to ": "copy_to", "index ": "index"}

RECORD = """review_id string, rec string, file_no int, hunk_no int, line_no int, seq int, kind string, text string,
 no_newline boolean, old_start int, old_lines int, new_start int, new_lines int, section string, header array<string>,
 status string, old_path string, new_path string, old_mode string, new_mode string, similarity int, binary boolean,
 error string"""


class PatchError(ValueError):
    """A line that no patch would hold at its place."""


def unquote_path(token: str) -> str:
    """Undo the quoting of a path: C escapes and octal bytes of UTF-8."""
    if len(token) < 2 or token[0] != '"' or token[-1] != '"':
        return token
    byte = lambda m: bytes([int(m[1], 8)]) if len(m[1]) == 3 else _ESCAPES.get(m[1], m[1])
    return _ESCAPE.sub(byte, token[1:-1].encode()).decode("utf-8", "replace")


def split_git_line(rest: str) -> tuple[str, str]:
    """The two path tokens after ``diff --git ``."""
    same = re.fullmatch(r"(a/(.*)) (b/\2)", rest, re.S)
    quoted = re.fullmatch(rf"({_QUOTED}) ?({_QUOTED}(?=$)|.*)", rest, re.S) if rest.startswith('"') else None
    if quoted:
        return unquote_path(quoted[1]), unquote_path(quoted[2])
    if rest.startswith('"'):
        raise PatchError(f"unterminated path in {rest!r}")
    if same:
        return same[1], same[3]
    old, space, new = rest.partition(" ")
    if not space:
        raise PatchError(f"one path in {rest!r}")
    return old, new


def strip_side(path: str) -> str:
    return path[2:] if len(path) > 2 and path[:2] in ("a/", "b/") else path


def header_path(line: str) -> str:
    """The path of a ``---`` or ``+++`` line, '' for the null device."""
    path = unquote_path(line[4:].split("\t", 1)[0])
    return "" if path == "/dev/null" else strip_side(path)


def parse_patch(text: str) -> Iterator[dict]:
    """File, hunk and line records of one patch, in order."""
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    at, file_no = 0, 0
    while at < len(lines):
        head, tokens, seen = [], None, {}
        if lines[at].startswith("diff --git "):
            tokens = split_git_line(lines[at][11:])
            head.append(lines[at])
            at += 1
        elif not lines[at].startswith("--- "):
            raise PatchError(f"unexpected line {at + 1}: {lines[at]!r}")
        while at < len(lines):
            prefix = next((p for p in _HEADERS if lines[at].startswith(p)), None)
            if prefix is None:
                break
            seen[_HEADERS[prefix]] = lines[at][len(prefix):]
            head.append(lines[at])
            at += 1
        names, hunks, binary, count = None, [], False, 0
        if at < len(lines) and lines[at].startswith("--- "):
            if at + 1 >= len(lines) or not lines[at + 1].startswith("+++ "):
                raise PatchError(f"{lines[at]!r} is not followed by a +++ line")
            names = header_path(lines[at]), header_path(lines[at + 1])
            head += lines[at:at + 2]
            at += 2
            while at < len(lines) and lines[at].startswith("@@ "):
                at, count, found = _read_hunk(lines, at, len(hunks), count)
                hunks.append(found)
        elif at < len(lines) and (lines[at].startswith("Binary files ") or lines[at] == "GIT binary patch"):
            binary, whole = True, lines[at] == "GIT binary patch"
            head.append(lines[at])
            at += 1
            while whole and at < len(lines) and not lines[at].startswith("diff --git "):
                head.append(lines[at])
                at += 1
        yield _file_record(file_no, head, tokens, names, seen, binary)
        for hunk, body in hunks:
            yield {**hunk, "file_no": file_no}
            for line in body:
                yield {**line, "file_no": file_no}
        file_no += 1


def _read_hunk(lines: list[str], at: int, hunk_no: int, count: int):
    shape = _HUNK.fullmatch(lines[at])
    if not shape:
        raise PatchError(f"bad hunk header {lines[at]!r}")
    size = lambda group: 1 if group is None else int(group)
    old_left, new_left = size(shape[2]), size(shape[4])
    section = shape[5].removeprefix(" ")
    hunk = {"rec": "hunk", "hunk_no": hunk_no, "old_start": int(shape[1]), "old_lines": old_left,
            "new_start": int(shape[3]), "new_lines": new_left, "section": section}
    body, at = [], at + 1
    while old_left > 0 or new_left > 0:
        if at >= len(lines):
            raise PatchError("hunk ends before its declared line count")
        mark = lines[at][:1] or " "
        kind = {" ": "context", "-": "del", "+": "add"}.get(mark)
        if kind is None:
            raise PatchError(f"unexpected hunk line {lines[at]!r}")
        old_left -= kind != "add"
        new_left -= kind != "del"
        body.append({"rec": "line", "hunk_no": hunk_no, "line_no": len(body), "seq": count, "kind": kind,
                     "text": lines[at][1:], "no_newline": False})
        count, at = count + 1, at + 1
        if at < len(lines) and lines[at] == NO_NEWLINE:
            body[-1]["no_newline"] = True
            at += 1
    return at, count, (hunk, body)


def _file_record(file_no, head, tokens, names, seen, binary) -> dict:
    old, new = names if names else tuple(strip_side(t) for t in tokens or ("", ""))
    added = "added" in seen or bool(names) and not names[0]
    deleted = "deleted" in seen or bool(names) and not names[1]
    if "rename_from" in seen:
        status, old, new = "renamed", unquote_path(seen["rename_from"]), unquote_path(seen.get("rename_to", ""))
    elif "copy_from" in seen:
        status, old, new = "copied", unquote_path(seen["copy_from"]), unquote_path(seen.get("copy_to", ""))
    elif added:
        status, old = "added", ""
    elif deleted:
        status, new = "deleted", ""
    else:
        status = "modified"
    old_mode, new_mode = seen.get("old_mode") or seen.get("deleted"), seen.get("new_mode") or seen.get("added")
    both = re.fullmatch(r"[0-9a-fA-F]+\.\.[0-9a-fA-F]+ (\d+)", seen.get("index", ""))
    if both and not old_mode and not new_mode:
        old_mode = new_mode = both[1]
    alike = seen.get("similarity", "").rstrip("%")
    return {"rec": "file", "file_no": file_no, "header": head, "status": status, "old_path": old, "new_path": new,
            "old_mode": old_mode, "new_mode": new_mode, "similarity": int(alike) if alike.isdigit() else None,
            "binary": binary}


def _records(schema: pa.Schema):
    """A task function: patch texts in, record batches of bounded size out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for review, text in zip(batch.column("review_id").to_pylist(), batch.column("text").to_pylist()):
                try:
                    found = list(parse_patch(text or ""))
                except PatchError as problem:
                    found = [{"rec": "error", "error": str(problem)}]
                for row in found:
                    row["review_id"] = review
                rows += found
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def parse_patches(patches: DataFrame) -> DataFrame:
    """Records of ``patches(review_id string, text)``; a malformed patch gives one error record."""
    schema = to_arrow_schema(patches.sparkSession.createDataFrame([], RECORD).schema)
    return patches.select(F.col("review_id").cast("string"), "text").mapInArrow(_records(schema), RECORD)


def patch_tables(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(files, hunks, lines, errors) of parsed records. Write or cut ``records`` first: four reads share it."""
    files = records.filter("rec = 'file'").select(
        "review_id", "file_no", "status", "old_path", "new_path", "old_mode", "new_mode", "similarity", "binary", "header")
    path = P.file_path("status", "old_path", "new_path")
    files = files.withColumn("path", path).withColumn("file_id", P.file_id("old_path", "new_path")) \
        .withColumn("language", P.detect_language("path"))
    hunks = records.filter("rec = 'hunk'").select(
        "review_id", "file_no", "hunk_no", "old_start", "old_lines", "new_start", "new_lines", "section")
    lines = records.filter("rec = 'line'").select(
        "review_id", "file_no", "hunk_no", "line_no", "seq", "kind", "text", "no_newline")
    return files, hunks, lines, records.filter("rec = 'error'").select("review_id", "error")


def is_patch(text) -> Column:
    """Whether a text looks like a diff at all."""
    text = col(text)
    has = lambda part: F.contains(text, F.lit(part))
    return has("diff --git ") | has("@@ -") | (has("--- ") & has("+++ "))


def hunk_header(old_start="old_start", old_lines="old_lines", new_start="new_start", new_lines="new_lines",
                section="section") -> Column:
    span = lambda start, n: F.when(col(n) == 1, col(start).cast("string")) \
        .otherwise(F.concat(col(start).cast("string"), F.lit(","), col(n).cast("string")))
    tail = F.when(F.coalesce(col(section), F.lit("")) != "", F.concat(F.lit(" "), col(section))).otherwise(F.lit(""))
    return F.concat(F.lit("@@ -"), span(old_start, old_lines), F.lit(" +"), span(new_start, new_lines), F.lit(" @@"), tail)


def emit_patches(files: DataFrame, hunks: DataFrame, lines: DataFrame) -> DataFrame:
    """Patch text as ordered rows: (review_id, file_no, hunk_no, line_no, part, text).

    Sorted by those keys and joined with newlines the rows are the patch, byte
    for byte; rows rather than one value, so a patch of any size can be written
    by a range sort.
    """
    head = files.select("review_id", "file_no", F.lit(-1).alias("hunk_no"), F.posexplode("header").alias("line_no", "text")) \
        .withColumn("part", F.lit(0))
    tops = hunks.select("review_id", "file_no", "hunk_no", F.lit(-1).alias("line_no"), hunk_header().alias("text"),
                        F.lit(0).alias("part"))
    mark = F.when(F.col("kind") == "add", "+").when(F.col("kind") == "del", "-").otherwise(" ")
    keys = ["review_id", "file_no", "hunk_no", "line_no"]
    body = lines.select(*keys, F.concat(mark, "text").alias("text"), F.lit(0).alias("part"))
    ends = lines.filter("no_newline").select(*keys, F.lit(NO_NEWLINE).alias("text"), F.lit(1).alias("part"))
    return head.unionByName(tops).unionByName(body).unionByName(ends).select(*keys, "part", "text")

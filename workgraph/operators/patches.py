"""Diff lines: numbering, positions, pairing, context, identity and statistics.

``lines`` is (review_id, file_no, hunk_no, line_no, seq, kind, text,
no_newline); ``line_no`` is dense within a hunk and ``seq`` within a file. A
hunk never exceeds the patch cell it was parsed from, so a hunk's own lines may
be gathered; anything wider is scanned in blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from workgraph.functions import paths as P
from workgraph.functions import text as T
from workgraph.functions.ids import END, START, col
from workgraph.operators.scan import running_total, top_per_key

FILE = ["review_id", "file_no"]
HUNK = [*FILE, "hunk_no"]
# Fixed value: lines shown around a line nothing encloses.
FALLBACK_LINES = 15
# Cells of a token comparison that are held at once; larger ones are halved, so that memory stays bounded.
CELLS = 4_000_000
# Words never proposed as symbols.
COMMON_WORDS = ["the", "and", "for", "return", "func", "var", "const", "import", "package", "true", "false", "nil",
                "err", "error", "string", "int", "bool", "struct", "interface", "type", "if", "else", "range", "ctx",
                "context"]
# Names and extensions of files worth drawing cases from.
SOURCE_NAMES = ["makefile", "dockerfile", "go.mod", "go.sum"]
SOURCE_EXTENSIONS = ["go", "js", "mjs", "cjs", "jsx", "ts", "tsx", "py", "rs", "yaml", "yml"]


def line_numbers(lines: DataFrame, hunks: DataFrame) -> DataFrame:
    """Old and new line numbers; 0 on the side a line is absent from."""
    on_old, on_new = F.col("kind") != "add", F.col("kind") != "del"
    rows = running_total(lines, HUNK, "line_no", on_old.cast("int"), "_old", inclusive=False)
    rows = running_total(rows, HUNK, "line_no", on_new.cast("int"), "_new", inclusive=False)
    rows = rows.join(hunks.select(*HUNK, "old_start", "new_start"), HUNK)
    return rows.withColumn("old_no", F.when(on_old, F.col("old_start") + F.col("_old")).otherwise(0)) \
        .withColumn("new_no", F.when(on_new, F.col("new_start") + F.col("_new")).otherwise(0)) \
        .drop("_old", "_new", "old_start", "new_start")


def diff_positions(lines: DataFrame) -> DataFrame:
    """Position of each line in its file's diff: body lines, later hunk headers and no-newline marks all count."""
    rows = running_total(lines, FILE, "seq", 1 + F.col("no_newline").cast("int"), "_so_far", inclusive=False)
    return rows.withColumn("position", (F.col("_so_far") + 1 + F.col("hunk_no")).cast("long")).drop("_so_far")


def pair_rows(lines: DataFrame) -> DataFrame:
    """Side-by-side rows: (review_id, file_no, hunk_no, run, ordinal, kind, old_line, new_line).

    Between two context lines the i-th deletion pairs with the i-th addition
    as a change; what is left over stays a deletion or an addition.
    """
    rows = running_total(lines, HUNK, "line_no", (F.col("kind") == "context").cast("int"), "run")
    context = rows.filter("kind = 'context'").select(
        *HUNK, "run", F.lit(0).cast("long").alias("ordinal"), F.lit("context").alias("kind"),
        F.col("line_no").alias("old_line"), F.col("line_no").alias("new_line"))
    place = F.row_number().over(Window.partitionBy(*HUNK, "run", "kind").orderBy("line_no"))
    sides = rows.filter("kind != 'context'").withColumn("ordinal", place.cast("long"))
    # One aggregation pairs both sides; the key holds at most one line of each.
    paired = sides.groupBy(*HUNK, "run", "ordinal").agg(
        F.max(F.when(F.col("kind") == "del", F.col("line_no"))).alias("old_line"),
        F.max(F.when(F.col("kind") == "add", F.col("line_no"))).alias("new_line"))
    kind = F.when(F.col("new_line").isNull(), "del").when(F.col("old_line").isNull(), "add").otherwise("change")
    return context.unionByName(paired.withColumn("kind", kind).select(*context.columns))


def change_texts(lines: DataFrame) -> DataFrame:
    """Both texts of every change row."""
    pairs = pair_rows(lines).filter("kind = 'change'")
    text = lambda side, out: lines.select(*HUNK, F.col("line_no").alias(side), F.col("text").alias(out))
    return pairs.join(text("old_line", "old_text"), [*HUNK, "old_line"]).join(text("new_line", "new_text"), [*HUNK, "new_line"])


def _rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequence of ``a`` with every beginning of ``b``."""
    best = np.zeros(len(b) + 1, np.int32)
    for code in a:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + (b == code)))
    return best


def _shared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of either side lie on the longest common subsequence; halved until the table fits."""
    kept_a, kept_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    differ = np.flatnonzero(a[:min(len(a), len(b))] != b[:min(len(a), len(b))])
    same = int(differ[0]) if len(differ) else min(len(a), len(b))
    if same:
        kept_a[:same] = kept_b[:same] = True
        kept_a[same:], kept_b[same:] = _shared(a[same:], b[same:]) if same < min(len(a), len(b)) else (kept_a[same:], kept_b[same:])
        return kept_a, kept_b
    if not len(a) or not len(b):
        return kept_a, kept_b
    if len(a) * len(b) > CELLS and len(a) > 1:
        half = len(a) // 2
        place = int(np.argmax(_rows(a[:half], b) + _rows(a[half:][::-1], b[::-1])[::-1]))
        kept_a[:half], kept_b[:place] = _shared(a[:half], b[:place])
        kept_a[half:], kept_b[place:] = _shared(a[half:], b[place:])
        return kept_a, kept_b
    best = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int32)
    for i in range(len(a) - 1, -1, -1):
        row = np.maximum(best[i + 1, :-1], best[i + 1, 1:] + (b == a[i]))
        best[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            kept_a[i] = kept_b[j] = True
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return kept_a, kept_b


def _common(old: list[str], new: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of either side lie on the longest common subsequence."""
    codes = {t: i for i, t in enumerate(dict.fromkeys(old + new))}
    return _shared(np.array([codes[t] for t in old], np.int64), np.array([codes[t] for t in new], np.int64))


def _gaps(tokens: list[str], kept: np.ndarray) -> list[dict]:
    """Byte ranges of the tokens not kept, neighbours merged."""
    out, at = [], 0
    for token, same in zip(tokens, kept):
        size = len(token.encode())
        if not same and out and out[-1]["end"] == at:
            out[-1]["end"] = at + size
        elif not same:
            out.append({"start": at, "end": at + size})
        at += size
    return out


_RANGES = ST.ArrayType(ST.StructType([ST.StructField("start", ST.IntegerType()), ST.StructField("end", ST.IntegerType())]))


@F.pandas_udf(ST.StructType([ST.StructField("old", _RANGES), ST.StructField("new", _RANGES)]))
def _marks(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b in zip(old, new):
        a, b = list(a), list(b)
        if not a or not b or a == b:
            rows.append({"old": [], "new": []})
            continue
        kept_a, kept_b = _common(a, b)
        rows.append({"old": _gaps(a, kept_a), "new": _gaps(b, kept_b)})
    return pd.DataFrame(rows, columns=["old", "new"])


def intraline_marks(changes: DataFrame) -> DataFrame:
    """Changed byte ranges of paired lines, however long; a pair with an empty side gets none."""
    return changes.withColumn("marks", _marks(T.word_tokens("old_text"), T.word_tokens("new_text"))) \
        .select(*changes.columns, F.col("marks.old").alias("old_marks"), F.col("marks.new").alias("new_marks"))


def hunk_bodies(lines: DataFrame) -> DataFrame:
    """The normalised body of each hunk: marked lines without the header, trailing CR dropped."""
    mark = F.when(F.col("kind") == "add", "+").when(F.col("kind") == "del", "-").otherwise(" ")
    one = F.concat(mark, F.regexp_replace("text", r"\r$", ""), F.lit("\n"),
                   F.when(F.col("no_newline"), F.lit("\\ No newline at end of file\n")).otherwise(F.lit("")))
    rows = lines.groupBy(*HUNK).agg(F.array_sort(F.collect_list(F.struct("line_no", one.alias("t")))).alias("_l"))
    return rows.select(*HUNK, F.array_join(F.transform("_l", lambda l: l["t"]), "").alias("body"))


def hunk_ids(lines: DataFrame, files: DataFrame) -> DataFrame:
    return hunk_bodies(lines).join(files.select(*FILE, "path"), FILE) \
        .withColumn("hunk_id", P.hunk_id("path", "body"))


def diff_stats(files: DataFrame, hunks: DataFrame, lines: DataFrame) -> DataFrame:
    """Additions, deletions and hunks per file, files without any included."""
    counts = lines.groupBy(*FILE).agg(F.count(F.when(F.col("kind") == "add", 1)).alias("additions"),
                                      F.count(F.when(F.col("kind") == "del", 1)).alias("deletions"))
    per_file = hunks.groupBy(*FILE).agg(F.count(F.lit(1)).alias("hunks"))
    return files.select(*FILE).join(counts, FILE, "left").join(per_file, FILE, "left") \
        .fillna(0, ["additions", "deletions", "hunks"])


def line_at(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Where (side, line) stands in the diff: hunk, line index and position, first match.

    ``lines`` carries old_no, new_no and position; ``wanted`` is (review_id, file_no, side, line).
    """
    side = F.explode(F.array(F.struct(F.lit("old").alias("side"), F.col("old_no").alias("line")),
                             F.struct(F.lit("new").alias("side"), F.col("new_no").alias("line"))))
    numbered = lines.select(*HUNK, "line_no", "position", side.alias("_s")) \
        .select(*HUNK, "line_no", "position", "_s.side", "_s.line").filter("line != 0")
    hits = wanted.join(numbered, [*FILE, "side", "line"])
    return hits.groupBy(*FILE, "side", "line").agg(F.min(F.struct("hunk_no", "line_no", "position")).alias("_h")) \
        .select(*FILE, "side", "line", "_h.hunk_no", "_h.line_no", "_h.position")


def fallback_window(lines_per_file: Column, line: Column, around: int = FALLBACK_LINES) -> Column:
    """The range shown around a line nothing encloses, clamped to the file."""
    total, line = col(lines_per_file), F.greatest(col(line), F.lit(1))
    start = F.greatest(line - around, F.lit(1))
    return F.when(total > 0, F.struct(start.alias("start"), F.greatest(F.least(line + around, total), start).alias("end")))


def align_context(hunks: DataFrame) -> DataFrame:
    """Unchanged old/new line pairs shown before and after each hunk.

    ``hunks`` carries the enclosing range of either side as old_from, old_to,
    new_from, new_to. Ranges are clipped by the neighbouring hunks of the file,
    found by their dense number.
    """
    end = lambda side: F.col(f"{side}_start") + F.col(f"{side}_lines")
    before = hunks.select(*FILE, (F.col("hunk_no") + 1).alias("hunk_no"), end("old").alias("_po"), end("new").alias("_pn"))
    after = hunks.select(*FILE, (F.col("hunk_no") - 1).alias("hunk_no"),
                         (F.col("old_start") - 1).alias("_no"), (F.col("new_start") - 1).alias("_nn"))
    rows = hunks.join(before, HUNK, "left").join(after, HUNK, "left") \
        .filter("old_from > 0 AND old_to >= old_from AND new_from > 0 AND new_to >= new_from")
    highest = lambda a, b: F.greatest(F.col(a), F.coalesce(F.col(b), F.col(a)))
    lowest = lambda a, b: F.least(F.col(a), F.coalesce(F.col(b), F.col(a)))
    span = lambda place, o1, o2, n1, n2: F.struct(
        F.lit(place).alias("place"), o1.alias("old"), n1.alias("new"), F.least(o2 - o1 + 1, n2 - n1 + 1).alias("n"))
    spans = F.array(
        span("before", highest("old_from", "_po"), F.col("old_start") - 1, highest("new_from", "_pn"), F.col("new_start") - 1),
        span("after", end("old"), lowest("old_to", "_no"), end("new"), lowest("new_to", "_nn")))
    rows = rows.select(*HUNK, F.explode(spans).alias("s")).filter("s.n > 0") \
        .withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s.n").cast("long") - 1)))
    return rows.select(*HUNK, "s.place", (F.col("s.old") + F.col("i")).alias("old_line"),
                       (F.col("s.new") + F.col("i")).alias("new_line"))


def draft_cases(hunks: DataFrame, min_lines: int, max_lines: int, per_commit: int, total: int) -> DataFrame:
    """Hunks to label: modified source files, a size range, a cap per commit, oldest commits until ``total``.

    ``hunks`` is (repo_id, sha, ts, file_no, hunk_no, path, status, binary,
    n_lines). Every chosen commit gives at least one case, so the ``total``
    oldest candidate commits are enough to decide where to stop.
    """
    base = F.lower(P.basename("path"))
    source = base.isin(SOURCE_NAMES) | P.extension("path").isin(SOURCE_EXTENSIONS)
    fit = hunks.filter((F.col("status") == "modified") & ~F.col("binary") & source
                       & F.col("n_lines").between(min_lines, max_lines))
    taken = top_per_key(fit, ["repo_id", "sha"], [F.col("file_no"), F.col("hunk_no")], per_commit, "in_commit")
    oldest = taken.groupBy("repo_id", "sha", "ts").agg(F.count(F.lit(1)).alias("n")) \
        .orderBy("ts", "repo_id", "sha").limit(total)
    earlier = Window.orderBy("ts", "repo_id", "sha").rowsBetween(Window.unboundedPreceding, -1)
    started = oldest.withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))) \
        .filter(F.col("_before") < total).select("repo_id", "sha", "_before")
    return taken.join(started, ["repo_id", "sha"]) \
        .withColumn("case_no", F.col("_before") + F.col("in_commit")).drop("_before")


def candidate_symbols(enclosing: DataFrame, lines: DataFrame, n: int | None = None) -> DataFrame:
    """Identifiers worth labelling per hunk: the signature line and changed lines, numbered by name; the first n if given.

    ``enclosing`` is (review_id, file_no, hunk_no, text).
    """
    texts = enclosing.select(*HUNK, F.substring_index("text", "\n", 1).alias("text")) \
        .unionByName(lines.filter("kind != 'context'").select(*HUNK, "text"))
    found = F.regexp_extract_all("text", F.lit(START + "[A-Za-z_][A-Za-z0-9_]{2,}" + END), 0)
    tokens = texts.select(*HUNK, F.explode(found).alias("symbol")) \
        .filter(~F.lower("symbol").isin(COMMON_WORDS)).distinct()
    placed = tokens.withColumn("place", F.row_number().over(Window.partitionBy(*HUNK).orderBy("symbol")))
    return placed if n is None else placed.filter(F.col("place") <= n)


def changed_paths_fingerprint(files: DataFrame, hunks: DataFrame, suffix: str = ".go") -> DataFrame:
    """One key per review that changes when a changed source path or its new-side ranges do.

    Hunk digests are summed in independent lanes, so a review of any size is
    combined map-side and in any order; file contents are never read.
    """
    source = files.filter(F.endswith(F.col("path"), F.lit(suffix)) & (F.length("path") > len(suffix)))
    rows = source.join(hunks.select(*HUNK, "new_start", "new_lines"), FILE, "left")
    text = F.concat_ws("|", "path", F.coalesce(F.col("hunk_no"), F.lit(-1)).cast("string"),
                       F.concat_ws(",", F.col("new_start").cast("string"), F.col("new_lines").cast("string")))
    return rows.groupBy("review_id").agg(P.set_digest(text).alias("fingerprint"), F.count(F.lit(1)).alias("parts"))

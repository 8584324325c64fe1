"""Diff queries over document lines read as hunks of twelve lines, one file per document."""

from __future__ import annotations

from pyspark.sql import functions as F

from workgraph.functions import paths as P
from workgraph.functions import text as T
from workgraph.operators import patches as O
from workgraph.plans.registry import query
from workgraph.sources import patches as S
from workgraph.session import cut


def _lines(t):
    return t.diff_lines.withColumn("review_id", F.lit("r")).withColumn("file_no", F.col("file_id")) \
        .withColumn("seq", F.col("hunk_no") * 12 + F.col("line_no"))


def _hunks(t):
    """Twelve lines per hunk, starting 20 old and 22 new lines apart."""
    per = _lines(t).groupBy("review_id", "file_no", "hunk_no").agg(
        F.count(F.when(F.col("kind") != "add", 1)).alias("old_lines"),
        F.count(F.when(F.col("kind") != "del", 1)).alias("new_lines"))
    return per.withColumn("old_start", F.col("hunk_no") * 20 + 1).withColumn("new_start", F.col("hunk_no") * 22 + 1) \
        .withColumn("section", F.lit(""))


def _files(t):
    return t.documents.select(F.lit("r").alias("review_id"), F.col("doc_id").alias("file_no"),
                              F.concat(F.lit("d"), (F.col("doc_id") % 7).cast("string"), F.lit("/f"),
                                       F.col("doc_id").cast("string"), F.lit(".go")).alias("path"))


_HUNKS = """hk AS (SELECT file_id, hunk_no, count(CASE WHEN kind <> 'add' THEN 1 END) AS old_lines,
    count(CASE WHEN kind <> 'del' THEN 1 END) AS new_lines, hunk_no * 20 + 1 AS old_start, hunk_no * 22 + 1 AS new_start
    FROM diff_lines GROUP BY 1, 2)"""
_NUM = """nm AS (SELECT *, CASE WHEN kind = 'add' THEN 0 ELSE hunk_no * 20 + coalesce(sum(CASE WHEN kind <> 'add' THEN 1 ELSE 0 END) OVER w, 0) + 1 END AS old_no,
    CASE WHEN kind = 'del' THEN 0 ELSE hunk_no * 22 + coalesce(sum(CASE WHEN kind <> 'del' THEN 1 ELSE 0 END) OVER w, 0) + 1 END AS new_no,
    row_number() OVER f + hunk_no + coalesce(sum(CASE WHEN no_newline THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY hunk_no, line_no
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position
  FROM diff_lines WINDOW w AS (PARTITION BY file_id, hunk_no ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    f AS (PARTITION BY file_id ORDER BY hunk_no, line_no))"""


@query("line_numbers", "WITH " + _NUM + " SELECT file_id, hunk_no, line_no, CAST(old_no AS BIGINT) AS old_no, CAST(new_no AS BIGINT) AS new_no FROM nm")
def line_numbers(t):
    return O.line_numbers(_lines(t), _hunks(t)).select(
        "file_id", "hunk_no", "line_no", F.col("old_no").cast("long"), F.col("new_no").cast("long"))


@query("diff_positions", "WITH " + _NUM + " SELECT file_id, hunk_no, line_no, CAST(position AS BIGINT) AS position FROM nm")
def diff_positions(t):
    return O.diff_positions(_lines(t)).select("file_id", "hunk_no", "line_no", "position")


_PAIR = """rn AS (SELECT *, sum(CASE WHEN kind = 'context' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, hunk_no ORDER BY line_no) AS run FROM diff_lines),
sd AS (SELECT *, row_number() OVER (PARTITION BY file_id, hunk_no, run, kind ORDER BY line_no) AS ordinal FROM rn WHERE kind <> 'context'),
pr AS (SELECT coalesce(d.file_id, a.file_id) AS file_id, coalesce(d.hunk_no, a.hunk_no) AS hunk_no, coalesce(d.run, a.run) AS run,
    coalesce(d.ordinal, a.ordinal) AS ordinal, CASE WHEN a.file_id IS NULL THEN 'del' WHEN d.file_id IS NULL THEN 'add' ELSE 'change' END AS kind,
    d.line_no AS old_line, a.line_no AS new_line, d.text AS old_text, a.text AS new_text
  FROM (SELECT * FROM sd WHERE kind = 'del') d FULL JOIN (SELECT * FROM sd WHERE kind = 'add') a
    ON a.file_id = d.file_id AND a.hunk_no = d.hunk_no AND a.run = d.run AND a.ordinal = d.ordinal
  UNION ALL SELECT file_id, hunk_no, run, 0, 'context', line_no, line_no, text, text FROM rn WHERE kind = 'context')"""


@query("pair_rows", "WITH " + _PAIR + """ SELECT file_id AS file_no, hunk_no, CAST(run AS BIGINT) AS run,
    CAST(ordinal AS BIGINT) AS ordinal, kind, old_line, new_line FROM pr""")
def pair_rows(t):
    return O.pair_rows(_lines(t)).drop("review_id")


@query("word_tokens", "WITH " + _PAIR + r""" SELECT file_id AS file_no, hunk_no, old_line,
    len(regexp_extract_all(old_text, '[_\p{L}\p{Nd}]+|[ \t]+|(?s:.)')) AS old_tokens,
    array_to_string(regexp_extract_all(new_text, '[_\p{L}\p{Nd}]+|[ \t]+|(?s:.)'), '·') AS new_tokens FROM pr WHERE kind = 'change'""")
def word_tokens(t):
    return O.change_texts(_lines(t)).select(
        "file_no", "hunk_no", "old_line", F.size(T.word_tokens("old_text")).cast("long").alias("old_tokens"),
        F.array_join(T.word_tokens("new_text"), "·").alias("new_tokens"))


@query("intraline_marks")
def intraline_marks(t):
    text = lambda c: F.to_json(F.col(c))
    return O.intraline_marks(O.change_texts(_lines(t))).select(
        "file_no", "hunk_no", "old_line", "new_line", text("old_marks").alias("old_marks"), text("new_marks").alias("new_marks"))


_BODY = """bd AS (SELECT file_id, hunk_no, string_agg(CASE kind WHEN 'add' THEN '+' WHEN 'del' THEN '-' ELSE ' ' END || regexp_replace(text, '\\r$', '')
    || chr(10) || CASE WHEN no_newline THEN '\\ No newline at end of file' || chr(10) ELSE '' END, '' ORDER BY line_no) AS body
    FROM diff_lines GROUP BY 1, 2),
hid AS (SELECT *, sha1('d' || (file_id % 7) || '/f' || file_id || '.go' || chr(10) || body) AS hunk_id FROM bd)"""


@query("hunk_ids", "WITH " + _BODY + " SELECT file_id AS file_no, hunk_no, body, hunk_id FROM hid")
def hunk_ids(t):
    return O.hunk_ids(_lines(t), _files(t)).select("file_no", "hunk_no", "body", "hunk_id")


@query("diff_stats", """SELECT doc_id AS file_no, count(CASE WHEN kind = 'add' THEN 1 END) AS additions,
    count(CASE WHEN kind = 'del' THEN 1 END) AS deletions, count(DISTINCT hunk_no) AS hunks
    FROM documents LEFT JOIN diff_lines ON file_id = doc_id GROUP BY 1""")
def diff_stats(t):
    return O.diff_stats(_files(t), _hunks(t), _lines(t)).drop("review_id")


def _wanted(t):
    side = F.when(F.col("line") % 2 == 0, "old").otherwise("new")
    return t.doc_lines.select(F.lit("r").alias("review_id"), F.col("doc_id").alias("file_no"), side.alias("side"), "line")


@query("line_at", "WITH " + _NUM + """,
bothsides AS (SELECT file_id, hunk_no, line_no, position, 'old' AS side, old_no AS n FROM nm UNION ALL SELECT file_id, hunk_no, line_no, position, 'new', new_no FROM nm),
want AS (SELECT doc_id, CASE WHEN line % 2 = 0 THEN 'old' ELSE 'new' END AS side, line FROM doc_lines),
hit AS (SELECT w.doc_id AS file_no, w.side, w.line, b.hunk_no, b.line_no, CAST(b.position AS BIGINT) AS position,
    row_number() OVER (PARTITION BY w.doc_id, w.side, w.line ORDER BY b.hunk_no, b.line_no) AS rn
  FROM want w JOIN bothsides b ON b.file_id = w.doc_id AND b.side = w.side AND b.n = w.line)
SELECT file_no, side, line, hunk_no, line_no, position FROM hit WHERE rn = 1""")
def line_at(t):
    numbered = O.diff_positions(O.line_numbers(_lines(t), _hunks(t)))
    return O.line_at(numbered, _wanted(t)).drop("review_id")


@query("fallback_window", """SELECT d.doc_id, l.line, greatest(l.line - 15, 1) AS start, least(l.line + 15, d.n) AS stop
    FROM doc_lines l JOIN (SELECT doc_id, max(line) AS n FROM doc_lines GROUP BY 1) d USING (doc_id)""")
def fallback_window(t):
    totals = t.doc_lines.groupBy("doc_id").agg(F.max("line").alias("n"))
    return t.doc_lines.join(totals, "doc_id").withColumn("w", O.fallback_window(F.col("n"), F.col("line"))) \
        .select("doc_id", "line", "w.start", F.col("w.end").alias("stop"))


@query("align_context", "WITH " + _HUNKS + """,
nb AS (SELECT *, lag(old_start + old_lines) OVER w AS po, lag(new_start + new_lines) OVER w AS pn,
    lead(old_start - 1) OVER w AS no_, lead(new_start - 1) OVER w AS nn FROM hk WINDOW w AS (PARTITION BY file_id ORDER BY hunk_no)),
sp AS (SELECT file_id, hunk_no, 'before' AS place, greatest(greatest(old_start - 5, 1), coalesce(po, 0)) AS o, greatest(greatest(new_start - 4, 1), coalesce(pn, 0)) AS n,
      least(old_start - greatest(greatest(old_start - 5, 1), coalesce(po, 0)), new_start - greatest(greatest(new_start - 4, 1), coalesce(pn, 0))) AS k FROM nb
    UNION ALL SELECT file_id, hunk_no, 'after', old_start + old_lines, new_start + new_lines,
      least(least(old_start + old_lines + 9, coalesce(no_, 1000000)) - old_start - old_lines + 1, least(new_start + new_lines + 9, coalesce(nn, 1000000)) - new_start - new_lines + 1) FROM nb)
SELECT file_id AS file_no, hunk_no, place, CAST(o + i AS BIGINT) AS old_line, CAST(n + i AS BIGINT) AS new_line
FROM (SELECT *, unnest(range(0, k)) AS i FROM sp WHERE k > 0) x""")
def align_context(t):
    end = lambda side: F.col(f"{side}_start") + F.col(f"{side}_lines") + 9
    ranged = _hunks(t).withColumn("old_from", F.greatest(F.col("old_start") - 5, F.lit(1))) \
        .withColumn("new_from", F.greatest(F.col("new_start") - 4, F.lit(1))) \
        .withColumn("old_to", end("old")).withColumn("new_to", end("new"))
    return O.align_context(ranged).select("file_no", "hunk_no", "place", F.col("old_line").cast("long"), F.col("new_line").cast("long"))


def _case_hunks(t):
    sizes = _lines(t).groupBy("file_no", "hunk_no").agg(F.count(F.lit(1)).alias("n_lines"))
    docs = t.documents.select(
        F.col("doc_id").alias("file_no"), (F.col("doc_id") % 3).alias("repo_id"), (F.col("n_chars") % 500).alias("sha"),
        (F.col("n_chars") % 500).alias("ts"), F.concat(F.col("source"), F.lit("/f.py")).alias("path"),
        F.when(F.col("doc_id") % 4 == 0, "added").otherwise("modified").alias("status"), F.lit(False).alias("binary"))
    return sizes.join(docs, "file_no")


@query("draft_cases", """WITH hs AS (SELECT file_id AS file_no, hunk_no, count(*) AS n_lines FROM diff_lines GROUP BY 1, 2),
ft AS (SELECT d.doc_id % 3 AS repo_id, d.n_chars % 500 AS sha, h.file_no, h.hunk_no FROM hs h JOIN documents d ON d.doc_id = h.file_no
    WHERE d.doc_id % 4 <> 0 AND h.n_lines BETWEEN 4 AND 11),
tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, sha ORDER BY file_no, hunk_no) AS in_commit FROM ft) x WHERE in_commit <= 2),
cm AS (SELECT repo_id, sha, count(*) AS n FROM tk GROUP BY 1, 2),
rn AS (SELECT *, coalesce(sum(n) OVER (ORDER BY sha, repo_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cm)
SELECT t.repo_id, t.sha, t.file_no, t.hunk_no, CAST(r.before + t.in_commit AS BIGINT) AS case_no FROM tk t JOIN rn r USING (repo_id, sha) WHERE r.before < 60""")
def draft_cases(t):
    return O.draft_cases(_case_hunks(t), 4, 11, 2, 60).select("repo_id", "sha", "file_no", "hunk_no", "case_no")


@query("candidate_symbols", r"""WITH tx AS (SELECT file_id, hunk_no, text FROM diff_lines WHERE kind <> 'context'
    UNION ALL SELECT file_id, hunk_no, text FROM diff_lines WHERE line_no = 0),
tk AS (SELECT DISTINCT file_id, hunk_no, unnest(regexp_extract_all(text, '\b[A-Za-z_][A-Za-z0-9_]{2,}\b')) AS symbol FROM tx),
ok AS (SELECT *, row_number() OVER (PARTITION BY file_id, hunk_no ORDER BY symbol) AS place FROM tk WHERE lower(symbol) NOT IN
    ('the','and','for','return','func','var','const','import','package','true','false','nil','err','error','string','int','bool',
     'struct','interface','type','if','else','range','ctx','context'))
SELECT file_id AS file_no, hunk_no, symbol, place FROM ok""")
def candidate_symbols(t):
    lines = _lines(t)
    enclosing = lines.filter("line_no = 0").select("review_id", "file_no", "hunk_no", "text")
    return O.candidate_symbols(enclosing, lines).drop("review_id")


@query("diff_fingerprint", """WITH h AS (SELECT review_id, path, hunk_no, new_start, new_lines FROM hunks),
dg AS (SELECT review_id, sha256(path || '.go|' || hunk_no || '|' || new_start || ',' || new_lines) AS d FROM h)
SELECT review_id, sha256(concat_ws(':', CAST(sum(('0x' || substr(d, 1, 15))::BIGINT) AS VARCHAR), CAST(sum(('0x' || substr(d, 16, 15))::BIGINT) AS VARCHAR), CAST(sum(('0x' || substr(d, 31, 15))::BIGINT) AS VARCHAR), CAST(sum(('0x' || substr(d, 46, 15))::BIGINT) AS VARCHAR), CAST(count(*) AS VARCHAR))) AS fingerprint, count(*) AS parts FROM dg GROUP BY 1""")
def diff_fingerprint(t):
    hunks = t.hunks.withColumn("file_no", F.col("path"))
    files = hunks.select("review_id", "file_no", F.concat("path", F.lit(".go")).alias("path")).distinct()
    return O.changed_paths_fingerprint(files, hunks)


def _rendered(t):
    """Every document as a patch: one file, one hunk that replaces its first line and keeps the rest."""
    lines = F.split("text", "\n")
    body = F.array_join(F.transform(lines, lambda l: F.concat(F.lit(" "), l)), "\n")
    return t.documents.select(
        F.col("doc_id").cast("string").alias("review_id"),
        F.format_string("diff --git a/d/%d.txt b/d/%d.txt\n--- a/d/%d.txt\n+++ b/d/%d.txt\n@@ -1,%d +1,%d @@ top\n-old\n+new\n%s\n",
                        "doc_id", "doc_id", "doc_id", "doc_id", F.size(lines) + 1, F.size(lines) + 1, body).alias("text"))


_LINECOUNT = "len(string_split(text, chr(10)))"


@query("parse_patches", f"""SELECT CAST(doc_id AS VARCHAR) AS review_id, 'd/' || doc_id || '.txt' AS path, 'modified' AS status,
    {_LINECOUNT} + 2 AS lines, 1 AS additions, 1 AS deletions, 'top' AS section FROM documents""")
def parse_patches(t):
    files, hunks, lines, _ = S.patch_tables(cut(S.parse_patches(_rendered(t))))
    counts = lines.groupBy("review_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count(F.when(F.col("kind") == "add", 1)).alias("additions"),
        F.count(F.when(F.col("kind") == "del", 1)).alias("deletions"))
    return files.select("review_id", "path", "status").join(counts, "review_id") \
        .join(hunks.select("review_id", "section"), "review_id")


@query("emit_patches", """SELECT review_id, count(*) AS n FROM (SELECT CAST(doc_id AS VARCHAR) AS review_id,
    unnest(string_split(text, chr(10))) FROM documents) x GROUP BY 1""".replace("count(*) AS n", "count(*) + 6 AS n"))
def emit_patches(t):
    files, hunks, lines, _ = S.patch_tables(cut(S.parse_patches(_rendered(t))))
    return S.emit_patches(files, hunks, lines).groupBy("review_id").agg(F.count(F.lit(1)).alias("n"))


# One file per part, in the header shapes a patch can have: quoted paths, copies, modes alone, spaces, new and deleted files.
_SHAPES = [r"""diff --git "a/caf\303\251 %K.txt" "b/new\t%K.txt"
similarity index 90%
rename from "caf\303\251 %K.txt"
rename to "new\t%K.txt"
""", """diff --git a/o/%K.go b/c/%K.go
similarity index 100%
copy from o/%K.go
copy to c/%K.go
""", """diff --git a/m/%K.sh b/m/%K.sh
old mode 100644
new mode 100755
""", """diff --git a/two words %K b/two words %K
index ab12..cd34 100644
--- a/two words %K\t
+++ b/two words %K\t
@@ -1 +1 @@
-x
+y
""", r"""diff --git "a/q\"%K" "b/q\"%K"
new file mode 100644
index 0000..ab12
--- /dev/null
+++ "b/q\"%K"
@@ -0,0 +1 @@
+y
""", """diff --git a/d %K b/d %K
deleted file mode 100644
index ab12..0000
--- a/d %K
+++ /dev/null
@@ -1 +0,0 @@
-x
"""]


@query("patch_headers", """SELECT p_partkey, CASE k WHEN 0 THEN 'renamed' WHEN 1 THEN 'copied' WHEN 4 THEN 'added' WHEN 5 THEN 'deleted' ELSE 'modified' END AS status,
    CASE k WHEN 0 THEN 'café ' || p_partkey || '.txt' WHEN 1 THEN 'o/' || p_partkey || '.go' WHEN 2 THEN 'm/' || p_partkey || '.sh' WHEN 3 THEN 'two words ' || p_partkey WHEN 4 THEN '' ELSE 'd ' || p_partkey END AS old_path,
    CASE k WHEN 0 THEN 'new' || chr(9) || p_partkey || '.txt' WHEN 1 THEN 'c/' || p_partkey || '.go' WHEN 2 THEN 'm/' || p_partkey || '.sh' WHEN 3 THEN 'two words ' || p_partkey WHEN 4 THEN 'q"' || p_partkey ELSE '' END AS new_path,
    CASE k WHEN 2 THEN '100644' WHEN 3 THEN '100644' WHEN 5 THEN '100644' END AS old_mode, CASE k WHEN 2 THEN '100755' WHEN 3 THEN '100644' WHEN 4 THEN '100644' END AS new_mode,
    CASE k WHEN 0 THEN 90 WHEN 1 THEN 100 END AS similarity FROM (SELECT p_partkey, p_partkey % 6 AS k FROM part) x""")
def patch_headers(t):
    shape = F.get(F.array(*[F.lit(s) for s in _SHAPES]), (F.col("p_partkey") % 6).cast("int"))
    patches = t.part.select(F.col("p_partkey").cast("string").alias("review_id"), F.replace(shape, F.lit("%K"), F.col("p_partkey").cast("string")).alias("text"))
    files, _, _, _ = S.patch_tables(cut(S.parse_patches(patches)))
    return files.select(F.col("review_id").cast("long").alias("p_partkey"), "status", "old_path", "new_path", "old_mode", "new_mode", "similarity")


@query("emit_patches_bytes", """SELECT CAST(doc_id AS VARCHAR) AS review_id, sha256('diff --git a/d/' || doc_id || '.txt b/d/' || doc_id || '.txt' || chr(10) || '--- a/d/' || doc_id || '.txt' || chr(10) || '+++ b/d/' || doc_id || '.txt' || chr(10)
    || '@@ -1,' || (n + 1) || ' +1,' || (n + 1) || ' @@ top' || chr(10) || '-old' || chr(10) || '+new' || chr(10) || ' ' || replace(text, chr(10), chr(10) || ' ') || chr(10)) AS sha
    FROM (SELECT doc_id, text, len(string_split(text, chr(10))) AS n FROM documents) x""")
def emit_patches_bytes(t):
    """Each emitted patch put together again; one patch was one cell when it was read."""
    files, hunks, lines, _ = S.patch_tables(cut(S.parse_patches(_rendered(t))))
    row = F.struct("file_no", "hunk_no", "line_no", "part", "text")
    whole = S.emit_patches(files, hunks, lines).groupBy("review_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return whole.select("review_id", F.sha2(F.concat(F.array_join("rows.text", "\n"), F.lit("\n")), 256).alias("sha"))


@query("parse_numstat", """SELECT repo_id, CAST(sha AS VARCHAR) AS sha, count(*) AS files, CAST(sum(added) AS BIGINT) AS added FROM commit_files GROUP BY 1, 2""")
def parse_numstat(t):
    """Commits printed as numstat texts, then parsed back."""
    from workgraph.sources.git import parse_numstat as parse
    line = F.concat_ws("\t", F.col("added").cast("string"), F.lit("-"), "path")
    texts = t.commit_files.groupBy("repo_id", "sha").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body")).select(
        "repo_id", F.concat(F.lit("\x1e"), F.col("sha").cast("string"), F.lit("\n\n"), "body", F.lit("\n")).alias("text"))
    return parse(texts).filter("deleted = 0").groupBy("repo_id", "sha").agg(F.count(F.lit(1)).alias("files"), F.sum("added").alias("added"))


@query("is_patch", """SELECT doc_id, contains(text, 'diff --git ') OR contains(text, '@@ -') OR (contains(text, '--- ') AND contains(text, '+++ ')) AS hit,
    true AS rendered_hit FROM documents""")
def is_patch(t):
    both = t.documents.select("doc_id", S.is_patch("text").alias("hit"))
    return both.join(_rendered(t).select(F.col("review_id").cast("long").alias("doc_id"), S.is_patch("text").alias("rendered_hit")), "doc_id")


# --- scalar forms ------------------------------------------------------------
@query("file_status", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'renamed' WHEN 1 THEN 'copied' WHEN 2 THEN 'added' WHEN 3 THEN 'deleted' ELSE 'modified' END AS status,
    CASE WHEN p_partkey % 5 = 3 THEN 'old/' || p_brand ELSE 'new/' || p_brand END AS path,
    substr(sha1('old/' || p_brand || chr(0) || 'new/' || p_brand), 1, 12) AS file_id FROM part""")
def file_status(t):
    k = F.col("p_partkey") % 5
    old, new = F.concat(F.lit("old/"), "p_brand"), F.concat(F.lit("new/"), "p_brand")
    status = P.file_status(k == 0, k.isin(0, 1), k.isin(0, 1, 2), k.isin(1, 3))
    return t.part.select("p_partkey", status.alias("status"), P.file_path(status, old, new).alias("path"),
                         P.file_id(old, new).alias("file_id"))


@query("summary_key", """SELECT doc_id, sha256(strlen(lang) || ':' || lang || strlen(source) || ':' || source || strlen(text) || ':' || text || '0:') AS key FROM documents""")
def summary_key(t):
    return t.documents.select("doc_id", P.summary_key("lang", "source", "text", F.lit("")).alias("key"))


@query("text_of_range", """SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS part FROM documents""")
def text_of_range(t):
    return t.documents.select("doc_id", T.text_of_range("text", F.lit(2), F.lit(4)).alias("part"))


@query("fallback_summary", "WITH " + _BODY + r""" SELECT file_id AS file_no, hunk_no, CASE WHEN file_id % 2 = 0 THEN 'load_' || file_id ELSE 'f' || file_id || '.go' END
    || ': +' || count(CASE WHEN kind = 'add' THEN 1 END) || '/-' || count(CASE WHEN kind = 'del' THEN 1 END) || ' lines' AS what
    FROM diff_lines GROUP BY file_id, hunk_no""")
def fallback_summary(t):
    enclosing = F.when(F.col("file_no") % 2 == 0, F.concat(F.lit("func (s *Store) load_"), F.col("file_no").cast("string"), F.lit("() {")))
    rows = O.hunk_bodies(_lines(t)).join(_files(t), ["review_id", "file_no"])
    return rows.select("file_no", "hunk_no", T.fallback_summary("path", enclosing, "body").alias("what"))


# File names the path heuristics are asked about, spread over parts.
_NAMES = ["Dockerfile", "GNUmakefile", "go.sum", "a_test.go", "b.spec.ts", "test_x.py", "C.KT", "d.yaml", "e.feature",
          "f.md", "g.tf", "h.bin", "noext", "i.conf", ".gitignore", "j.rs"]
_NAME_SQL = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"


@query("path_heuristics", f"""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'src/tests/' WHEN p_partkey % 3 = 1 THEN 'src/' ELSE '' END
      || {_NAME_SQL}[1 + p_partkey % {len(_NAMES)}] AS path FROM part), q AS (SELECT *, lower(split_part(path, '/', -1)) AS base FROM p),
l AS (SELECT *, CASE WHEN base = 'dockerfile' THEN 'dockerfile' WHEN base IN ('makefile', 'gnumakefile') THEN 'make' WHEN base IN ('go.mod', 'go.sum', 'go.work') THEN 'gomod'
    WHEN base LIKE '%.go' THEN 'go' WHEN base LIKE '%.ts' THEN 'typescript' WHEN base LIKE '%.py' THEN 'python' WHEN base LIKE '%.kt' THEN 'kotlin'
    WHEN base LIKE '%.yaml' THEN 'yaml' WHEN base LIKE '%.feature' THEN 'gherkin' WHEN base LIKE '%.md' THEN 'markdown' WHEN base LIKE '%.tf' THEN 'hcl'
    WHEN base LIKE '%.rs' THEN 'rust' ELSE '' END AS language,
    contains(base, '_test.') OR contains(base, '.spec.') OR starts_with(base, 'test_') AS looks_test FROM q)
SELECT p_partkey, language, looks_test OR language = 'gherkin' AS is_test,
    CASE WHEN looks_test OR language = 'gherkin' THEN 'test' WHEN language IN ('yaml', 'hcl', 'dockerfile', 'make', 'gomod') THEN 'config' ELSE 'behavior' END AS kind,
    CASE WHEN looks_test OR base LIKE '%.feature' OR contains('/' || path, '/tests/') THEN 'test file'
      WHEN base IN ('dockerfile', 'go.sum', 'd.yaml', 'f.md', 'i.conf', '.gitignore') THEN 'config/build/docs file' ELSE 'source file' END AS category,
    CASE WHEN p_partkey % 3 = 0 THEN 'src/tests' WHEN p_partkey % 3 = 1 THEN 'src' ELSE '.' END AS dir FROM l""")
def path_heuristics(t):
    folder = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'src/tests/' WHEN 1 THEN 'src/' ELSE '' END")
    name = F.get(F.array(*[F.lit(n) for n in _NAMES]), (F.col("p_partkey") % len(_NAMES)).cast("int"))
    rows = t.part.select("p_partkey", F.concat(folder, name).alias("path"))
    return rows.select("p_partkey", P.detect_language("path").alias("language"), P.is_test_path("path").alias("is_test"),
                       P.guess_kind("path").alias("kind"), P.file_category("path").alias("category"), P.dirname("path").alias("dir"))


@query("numstat", """SELECT l_orderkey AS sha, l_linenumber, CASE WHEN l_partkey % 9 = 0 THEN 0 ELSE CAST(l_quantity AS INT) END AS added,
    l_linenumber AS deleted, 'lib/p' || l_partkey || '.go' AS path, l_suppkey FROM lineitem WHERE l_partkey % 13 <> 0""")
def numstat(t):
    from workgraph.sources.git import parse_numstat_lines
    added = F.when(F.col("l_partkey") % 9 == 0, F.lit("-")).otherwise(F.col("l_quantity").cast("int").cast("string"))
    old = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("lib/{q => p"), F.col("l_partkey").cast("string"), F.lit("}.go"))) \
        .otherwise(F.concat(F.lit("lib/p"), F.col("l_partkey").cast("string"), F.lit(".go")))
    row = F.when(F.col("l_partkey") % 13 == 0, F.lit("no tabs here")) \
        .otherwise(F.concat_ws("\t", added, F.col("l_linenumber").cast("string"), old))
    rows = t.lineitem.select(F.col("l_orderkey").alias("sha"), "l_linenumber", "l_suppkey", row.alias("text"))
    return parse_numstat_lines(rows)

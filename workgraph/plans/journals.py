"""Journal queries over log lines rendered from conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from workgraph.functions import ids as X
from workgraph.operators import journal as J
from workgraph.plans.registry import query
from workgraph.session import cut

# Lines to entries: a heading starts one unless it is an undated line right under a heading.
_LINES = r"""hd AS (SELECT *, starts_with(text, '## ') AS head, trim(substr(text, 3)) AS ht FROM log_lines),
hd2 AS (SELECT *, lag(head, 1, false) OVER (PARTITION BY log_id ORDER BY line) AS after_head FROM hd),
st AS (SELECT *, head AND NOT (after_head AND NOT regexp_matches(ht, '^\d{4}-\d{2}-\d{2}')) AS starts FROM hd2),
num AS (SELECT log_id, line, text, head AS in_heading, ht, CAST(sum(CASE WHEN starts THEN 1 ELSE 0 END)
    OVER (PARTITION BY log_id ORDER BY line) AS INT) AS entry_no FROM st),
tail AS (SELECT log_id, entry_no, max(line) AS last_line, arg_max(trim(text), line) AS last_text FROM num
    WHERE NOT in_heading AND trim(text) <> '' GROUP BY 1, 2),
ln AS (SELECT n.* FROM num n LEFT JOIN tail t ON t.log_id = n.log_id AND t.entry_no = n.entry_no
    WHERE n.in_heading OR n.line <= t.last_line - CASE WHEN regexp_matches(t.last_text, '^(-{3,}|\*{3,}|_{3,})$') THEN 1 ELSE 0 END)"""
_ENTRIES = _LINES + r""",
hh AS (SELECT log_id, entry_no, line, text, ht, row_number() OVER (PARTITION BY log_id, entry_no ORDER BY line) AS k FROM ln
    WHERE in_heading AND entry_no > 0),
en0 AS (SELECT log_id, entry_no, min(line) AS line, count(*) AS heading_lines, arg_min(text, line) AS first_text,
    nullif(regexp_extract(arg_min(ht, line), '^(\d{4}-\d{2}-\d{2})', 1), '') AS date,
    string_agg(CASE WHEN k = 1 THEN trim(regexp_replace(ht, '^\d{4}-\d{2}-\d{2} *(—|–|--|-|:)?', '')) ELSE ht END, ' ' ORDER BY line) AS title
    FROM hh GROUP BY 1, 2),
en AS (SELECT *, coalesce(last_value(date IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY entry_no), '') AS effective_date,
    last_value(date IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY entry_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_date,
    heading_lines = 1 AND date IS NOT NULL AND first_text = '## ' || coalesce(date, '') || ' — ' || title AS canonical FROM en0)"""


def _lines(t):
    return J.entry_lines(t.log_lines)


def _entries(t):
    return J.parse_entries(cut(_lines(t)))


@query("entry_lines", "WITH " + _LINES + " SELECT log_id, line, text, entry_no, in_heading FROM ln")
def entry_lines(t):
    return _lines(t).select("log_id", "line", "text", "entry_no", "in_heading")


@query("parse_entries", "WITH " + _ENTRIES + """ SELECT log_id, entry_no, line, date, title, canonical, heading_lines,
    (SELECT count(*) FROM ln WHERE ln.log_id = en.log_id AND ln.entry_no = en.entry_no AND NOT ln.in_heading) AS body_lines FROM en""")
def parse_entries(t):
    return _entries(t).select("log_id", "entry_no", "line", "date", "title", "canonical", "heading_lines", "body_lines")


@query("effective_date", "WITH " + _ENTRIES + " SELECT log_id, entry_no, effective_date FROM en")
def effective_date(t):
    return _entries(t).select("log_id", "entry_no", "effective_date")


@query("out_of_order", "WITH " + _ENTRIES + " SELECT log_id, entry_no, date, previous_date FROM en WHERE date < previous_date")
def out_of_order(t):
    return J.out_of_order(_entries(t)).select("log_id", "entry_no", "date", "previous_date")


@query("log_since", "WITH " + _ENTRIES + " SELECT log_id, entry_no, effective_date, title FROM en WHERE effective_date >= '2024-01-15'")
def log_since(t):
    return J.log_since(_entries(t), "2024-01-15").select("log_id", "entry_no", "effective_date", "title")


@query("log_tail", "WITH " + _ENTRIES + """ SELECT log_id, entry_no, title FROM
    (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY entry_no DESC) AS rn FROM en) x WHERE rn <= 2""")
def log_tail(t):
    return J.log_tail(_entries(t), 2).select("log_id", "entry_no", "title")


@query("log_search", "WITH " + _LINES + """ SELECT log_id, entry_no, line, in_heading FROM ln
    WHERE entry_no > 0 AND regexp_matches(lower(text), 'the|th-1:|user$')""")
def log_search(t):
    return J.log_search(_lines(t), "the|th-1:|user$").select("log_id", "entry_no", "line", "in_heading")


@query("log_search_fixed", "WITH " + _LINES + """ SELECT log_id, entry_no, line FROM ln
    WHERE entry_no > 0 AND contains(text, 'The')""")
def log_search_fixed(t):
    return J.log_search(_lines(t), "The", fixed=True, match_case=True).select("log_id", "entry_no", "line")


_TOKENS = _LINES + r""",
tk AS (SELECT log_id, entry_no, line, in_heading, unnest(regexp_extract_all(text, '(?i)\b([A-Z][A-Z0-9]*)-([0-9]+[a-z]?)\b')) AS id
    FROM ln WHERE entry_no > 0),
keyed AS (SELECT *, upper(split_part(id, '-', 1)) || '-' || regexp_replace(lower(split_part(id, '-', 2)), '^0+([0-9])', '\1') AS key FROM tk)"""


@query("log_issue", "WITH " + _TOKENS + """,
w AS (SELECT DISTINCT conv_id AS log_id, 'th-00' || (conv_id % 25 + 1) AS id, 'TH-' || (conv_id % 25 + 1) AS key FROM conversations),
hit AS (SELECT k.log_id, w.id, k.entry_no, max(k.in_heading) AS in_heading, count(DISTINCT k.line) AS hits
    FROM keyed k JOIN w ON w.log_id = k.log_id AND w.key = k.key GROUP BY 1, 2, 3)
SELECT *, row_number() OVER (PARTITION BY log_id, id ORDER BY CASE WHEN in_heading THEN 0 ELSE 1 END, entry_no) AS place FROM hit""")
def log_issue(t):
    wanted = t.conversations.select(F.col("conv_id").alias("log_id"),
                                    F.concat(F.lit("th-00"), (F.col("conv_id") % 25 + 1).cast("string")).alias("id")).distinct()
    return J.log_issue(_lines(t), wanted)


@query("log_amendments", "WITH " + _LINES + r""" SELECT log_id, entry_no, line FROM ln WHERE entry_no > 0 AND NOT in_heading
    AND regexp_matches(text, '(?i)^\s*(\*\*|__)?amend(ed|ment)?s?:(\*\*|__)?')""")
def log_amendments(t):
    return J.log_amendments(_lines(t)).select("log_id", "entry_no", "line")


@query("log_amendments_doc", "WITH " + _LINES + r""",
mk AS (SELECT log_id, entry_no, line, text FROM ln WHERE entry_no > 0 AND NOT in_heading
    AND regexp_matches(text, '(?i)^\s*(\*\*|__)?amend(ed|ment)?s?:(\*\*|__)?'))
SELECT log_id, entry_no, line FROM mk a WHERE EXISTS (SELECT 1 FROM mk b WHERE b.log_id = a.log_id AND b.entry_no = a.entry_no
    AND contains(lower(b.text), 'the'))""")
def log_amendments_doc(t):
    return J.log_amendments(cut(_lines(t)), "The").select("log_id", "entry_no", "line")


@query("loose_amendments", "WITH " + _LINES + r""" SELECT log_id, count(*) AS loose FROM (
    SELECT log_id, entry_no FROM ln WHERE entry_no > 0 AND NOT in_heading GROUP BY 1, 2
    HAVING max(regexp_matches(text, '(?i)\bamend(ed|ing|ment|ments|s)?\b')) AND NOT max(regexp_matches(text, '(?i)^\s*(\*\*|__)?amend(ed|ment)?s?:'))
  ) x GROUP BY 1""")
def loose_amendments(t):
    return J.loose_amendments(_lines(t))


@query("log_ids", "WITH " + _LINES + r""",
tk AS (SELECT log_id, line, unnest(regexp_extract_all(text, '\b([A-Z][A-Z0-9]*)-([0-9]+[a-z]?)\b')) AS id FROM ln WHERE entry_no > 0)
SELECT log_id, split_part(id, '-', 1) AS prefix, id, min(line) AS line FROM tk GROUP BY 1, 2, 3""")
def log_ids(t):
    return J.log_ids(_lines(t))


@query("prefix_counts", "WITH " + _LINES + r""",
tk AS (SELECT log_id, unnest(regexp_extract_all(text, '\b([A-Z][A-Z0-9]*)-([0-9]+[a-z]?)\b')) AS id FROM ln WHERE entry_no > 0)
SELECT log_id, split_part(id, '-', 1) AS prefix, count(DISTINCT id) AS ids FROM tk GROUP BY 1, 2""")
def prefix_counts(t):
    return J.prefix_counts(_lines(t))


@query("log_board_check", "WITH " + _ENTRIES + r""",
tk AS (SELECT log_id, line, unnest(regexp_extract_all(text, '\b([A-Z][A-Z0-9]*)-([0-9]+[a-z]?)\b')) AS id FROM ln WHERE entry_no > 0),
ids AS (SELECT log_id, id, min(line) AS line FROM tk WHERE starts_with(id, 'TH-') GROUP BY 1, 2)
SELECT log_id, 'off-format' AS kind, '' AS id, line, title AS note, false AS fatal FROM en WHERE date IS NOT NULL AND NOT canonical
UNION ALL SELECT log_id, 'undated', '', line, title, false FROM en WHERE date IS NULL
UNION ALL SELECT log_id, 'out-of-order', '', line, date || ' follows ' || previous_date, false FROM en WHERE date < previous_date
UNION ALL SELECT log_id, 'no such issue', id, line, 'named in the log, on neither the board nor the done log', true FROM ids
    WHERE NOT EXISTS (SELECT 1 FROM issues i WHERE i.board_id = ids.log_id AND i.id = ids.id)
UNION ALL SELECT i.board_id, 'unlogged', i.id, 0, i.title, true FROM (SELECT board_id, id, title, updated_at, status FROM issues WHERE status = 'done'
      UNION ALL SELECT board_id, id, title, updated_at, status FROM done_log) i
    WHERE substr(CAST(i.updated_at AS VARCHAR), 1, 10) >= '1997-01-01' AND i.board_id IN (SELECT log_id FROM log_lines)
    AND NOT EXISTS (SELECT 1 FROM ids WHERE ids.log_id = i.board_id AND ids.id = i.id)""")
def log_board_check(t):
    lines = cut(_lines(t))
    boards = t.log_lines.select("log_id").distinct().withColumn("board_id", F.col("log_id")).withColumn("prefix", F.lit("TH"))
    return J.log_board_check(lines, J.parse_entries(lines), boards, t.issues, t.done_log, since="1997-01-01")


# --- scalar forms ------------------------------------------------------------
@query("normalize_id", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 'MISC ' || o_orderstatus
    ELSE 'TH-' || o_custkey END AS id FROM orders""")
def normalize_id(t):
    ref = F.expr("""CASE o_orderkey % 4 WHEN 0 THEN cast(o_custkey AS string) WHEN 1 THEN concat(' th-', o_custkey)
        WHEN 2 THEN concat('TH-00', o_custkey) ELSE concat('misc ', o_orderstatus) END""")
    return t.orders.select("o_orderkey", X.normalize_id(ref, F.lit("TH")).alias("id"))


@query("id_num", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE o_custkey END AS num,
    CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS own FROM orders""")
def id_num(t):
    ident = F.expr("""CASE o_orderkey % 3 WHEN 0 THEN concat('th-', o_custkey) WHEN 1 THEN concat('foo-', o_custkey) ELSE 'TH-x' END""")
    return t.orders.select("o_orderkey", X.id_num(ident).alias("num"), X.issue_num(ident, F.lit("TH")).alias("own"))


@query("log_id_key", r"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 'A ' || o_orderstatus
    ELSE 'TH-' || o_custkey || CASE WHEN o_orderkey % 3 = 1 THEN 'b' ELSE '' END END AS key FROM orders""")
def log_id_key(t):
    ident = F.expr("""CASE o_orderkey % 3 WHEN 0 THEN concat('th-00', o_custkey) WHEN 1 THEN concat('Th-0', o_custkey, 'B')
        ELSE concat('a ', lower(o_orderstatus)) END""")
    return t.orders.select("o_orderkey", X.log_id_key(ident).alias("key"))


@query("log_id_regex", r"""SELECT o_orderkey, regexp_matches('see th-0' || o_custkey || ', done', '(?i)\bTH-0*' || (o_custkey % 50) || '\b') AS hit FROM orders""")
def log_id_regex(t):
    pattern = X.log_id_regex(F.concat(F.lit("TH-00"), (F.col("o_custkey") % 50).cast("string")))
    text = F.concat(F.lit("see th-0"), F.col("o_custkey").cast("string"), F.lit(", done"))
    return t.orders.select("o_orderkey", F.rlike(text, pattern).alias("hit"))


@query("priorities", """SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 WHEN '4' THEN 2 ELSE 4 END AS rank,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'must' WHEN '2' THEN 'high' WHEN '3' THEN 'normal' WHEN '4' THEN 'normal' ELSE 'odd' END AS effective,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'must' WHEN '2' THEN 'high' WHEN '5' THEN 'odd' END AS stored FROM orders""")
def priorities(t):
    p = F.expr("CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'must' WHEN '2' THEN 'high' WHEN '3' THEN 'normal' WHEN '5' THEN 'odd' END")
    return t.orders.select("o_orderkey", X.priority_rank(p).alias("rank"), X.effective_priority(p).alias("effective"),
                           X.stored_priority(p).alias("stored"))


@query("escalation_floor", """SELECT board_id, count(*) AS waiting, CASE WHEN count(*) >= 10 THEN 'must' WHEN count(*) >= 3 THEN 'high' END AS floor,
    CASE WHEN count(*) >= 7 THEN 'high' END AS high_only FROM issues GROUP BY 1""")
def escalation_floor(t):
    n = t.issues.groupBy("board_id").agg(F.count(F.lit(1)).alias("waiting"))
    return n.select("board_id", "waiting", X.escalation_floor("waiting").alias("floor"),
                    X.escalation_floor("waiting", 7, 0).alias("high_only"))


@query("parse_age", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN (o_custkey % 90) * 86400 WHEN 1 THEN (o_custkey % 8) * 604800
    WHEN 2 THEN (o_custkey % 72) * 3600 + 120 WHEN 3 THEN 0 END AS seconds FROM orders""")
def parse_age(t):
    text = F.expr("""CASE o_orderkey % 5 WHEN 0 THEN concat(o_custkey % 90, 'd') WHEN 1 THEN concat(o_custkey % 8, 'w')
        WHEN 2 THEN concat(o_custkey % 72, 'h2m') WHEN 3 THEN '0' ELSE 'soon' END""")
    age = X.parse_age(text)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp")
    return t.orders.select("o_orderkey", (F.unix_timestamp(epoch + age) - F.unix_timestamp(epoch)).alias("seconds"))


@query("parse_heading", """SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE substr(CAST(o_orderdate AS VARCHAR), 1, 10) END AS date,
    o_orderpriority AS title FROM orders""")
def parse_heading(t):
    day = F.substring(F.col("o_orderdate").cast("string"), 1, 10)
    dash = F.get(F.array(*[F.lit(d) for d in [" — ", " – ", " -- ", " - ", ": "]]), (F.col("o_orderkey") % 6).cast("int"))
    line = F.when(F.col("o_orderkey") % 6 == 5, F.concat(F.lit("##  "), F.col("o_orderpriority"))) \
        .otherwise(F.concat(F.lit("## "), day, dash, F.col("o_orderpriority")))
    return t.orders.select("o_orderkey", X.heading_date(line).alias("date"), X.heading_title(line).alias("title"))


@query("canonical_heading", """SELECT o_orderkey, '## ' || substr(CAST(o_orderdate AS VARCHAR), 1, 10) || ' — ' ||
    CASE WHEN o_orderkey % 2 = 0 THEN 'th-' || o_custkey || ' shipped' ELSE 'TH-' || o_custkey || ': ' || o_orderpriority END AS heading FROM orders""")
def canonical_heading(t):
    day = F.substring(F.col("o_orderdate").cast("string"), 1, 10)
    title = F.expr("CASE WHEN o_orderkey % 2 = 0 THEN concat('th-', o_custkey, ' shipped') ELSE o_orderpriority END")
    full = X.title_with_id(F.concat(F.lit("TH-"), F.col("o_custkey").cast("string")), title)
    return t.orders.select("o_orderkey", X.canonical_heading(day, full).alias("heading"))

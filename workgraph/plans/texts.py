"""Markdown and robust-statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from workgraph.functions import text as T
from workgraph.operators import markdown as M
from workgraph.operators import robust as R
from workgraph.plans.registry import query

_BLOCKS = r"""fc AS (SELECT *, starts_with(trim(text), '```') AS fence, coalesce(sum(CASE WHEN starts_with(trim(text), '```') THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM md_lines),
kd AS (SELECT *, CASE WHEN fence AND inside THEN 'close' WHEN fence THEN 'code' WHEN inside THEN 'line' WHEN regexp_matches(text, '^#{1,3}\s+') THEN 'h' || len(regexp_extract(text, '^(#{1,3})\s+', 1))
    WHEN regexp_matches(text, '^\s*[-*]\s+\[[ xX]\]\s+') THEN 'task' WHEN regexp_matches(text, '^\s*[-*]\s+') THEN 'ul' WHEN regexp_matches(text, '^\s*\d+[.)]\s+') THEN 'ol' WHEN trim(text) = '' THEN 'blank' ELSE 'p' END AS kind FROM fc),
bd AS (SELECT *, CASE WHEN kind = 'line' THEN text WHEN kind IN ('h1', 'h2', 'h3') THEN regexp_extract(text, '^#{1,3}\s+(.*)', 1) WHEN kind = 'task' THEN regexp_extract(text, '^\s*[-*]\s+\[[ xX]\]\s+(.*)', 1)
    WHEN kind = 'ul' THEN regexp_extract(text, '^\s*[-*]\s+(.*)', 1) WHEN kind = 'ol' THEN regexp_extract(text, '^\s*\d+[.)]\s+(.*)', 1) WHEN kind = 'p' THEN trim(text) ELSE '' END AS body,
    CASE WHEN kind = 'task' THEN lower(regexp_extract(text, '\[([ xX])\]', 1)) = 'x' END AS done, lag(kind) OVER (PARTITION BY doc_id ORDER BY line) AS before_kind FROM kd),
nb AS (SELECT *, sum(CASE WHEN kind IN ('h1', 'h2', 'h3', 'task', 'ul', 'ol', 'code') OR (kind = 'p' AND coalesce(before_kind, '') <> 'p') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS block_no FROM bd),
bl AS (SELECT doc_id, block_no, min(line) AS start_line, arg_min(kind, line) AS kind, max(done) AS done,
    coalesce(CASE WHEN arg_min(kind, line) = 'code' THEN string_agg(body, chr(10) ORDER BY line) FILTER (kind <> 'code') ELSE string_agg(body, ' ' ORDER BY line) END, '') AS text
    FROM nb WHERE kind NOT IN ('blank', 'close') GROUP BY 1, 2)"""


@query("md_blocks", "WITH " + _BLOCKS + " SELECT doc_id, CAST(block_no AS BIGINT) AS block_no, kind, done, text, start_line FROM bl")
def md_blocks(t):
    return M.md_blocks(t.md_lines).select("doc_id", F.col("block_no").cast("long").alias("block_no"), "kind", "done", "text", "start_line")


@query("md_tasks", "WITH " + _BLOCKS + " SELECT doc_id, CAST(block_no AS BIGINT) AS block_no, done, text FROM bl WHERE kind = 'task'")
def md_tasks(t):
    return M.md_tasks(M.md_blocks(t.md_lines)).withColumn("block_no", F.col("block_no").cast("long"))


@query("task_progress", "WITH " + _BLOCKS + """ SELECT doc_id, count(*) AS tasks, count(CASE WHEN done THEN 1 END) AS finished,
    round(count(CASE WHEN done THEN 1 END) / count(*), 6) AS ratio FROM bl WHERE kind = 'task' GROUP BY 1""")
def task_progress(t):
    return M.task_progress(M.md_blocks(t.md_lines)).withColumn("ratio", F.round("ratio", 6))


@query("md_html")
def md_html(t):
    return M.md_html(M.md_blocks(t.md_lines)).withColumn("block_no", F.col("block_no").cast("long"))


def _linked(t):
    return t.pages.select("page_id", F.format_string("see (%s). [page %d](%s), a < b; (%s_(x)) end!", "url", "page_id", "url", "url").alias("text"))


@query("extract_links", """SELECT page_id, 'named' AS kind, 0 AS n, 'page ' || page_id AS label, url FROM pages UNION ALL SELECT page_id, 'bare', 0, url, url FROM pages
    UNION ALL SELECT page_id, 'bare', 1, url || '_(x)', url || '_(x)' FROM pages""")
def extract_links(t):
    return M.extract_links(_linked(t)).drop("text")


@query("linkify", """WITH e AS (SELECT page_id, replace(url, '&', '&amp;') AS u FROM pages)
SELECT page_id, 'see (<a href="' || u || '" target="_blank" rel="noopener noreferrer">' || u || '</a>). <a href="' || u || '" target="_blank" rel="noopener noreferrer">page ' || page_id
  || '</a>, a &lt; b; (<a href="' || u || '_(x)" target="_blank" rel="noopener noreferrer">' || u || '_(x)</a>) end!' AS html FROM e""")
def linkify(t):
    return _linked(t).select("page_id", M.linkify("text").alias("html"))


@query("html_escape", """SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS safe FROM pages""")
def html_escape(t):
    return t.pages.select("page_id", T.html_escape("html").alias("safe"))


_MED = """md AS (SELECT l_suppkey, median(l_extendedprice) AS med FROM lineitem GROUP BY 1),
sp AS (SELECT l_suppkey, 1.4826 * median(abs(l_extendedprice - med)) + 1e-6 AS mad FROM lineitem JOIN md USING (l_suppkey) GROUP BY 1)"""


@query("robust_mad", "WITH " + _MED + """ SELECT l_suppkey, round(med, 6) AS median, round(mad, 6) AS mad,
    count(CASE WHEN abs(l_extendedprice - med) > greatest(1.5 * mad, 100) THEN 1 END) AS outliers FROM lineitem JOIN md USING (l_suppkey) JOIN sp USING (l_suppkey) GROUP BY 1, 2, 3""")
def robust_mad(t):
    rows = R.robust_mad(t.lineitem.select("l_suppkey", "l_extendedprice"), ["l_suppkey"], "l_extendedprice", k=1.5, floor=100.0)
    return rows.groupBy("l_suppkey", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad")) \
        .agg(F.count(F.when(F.col("outlier"), 1)).alias("outliers"))


# The edge rows are repeated seven times at either end, then a plain window has the median.
@query("rolling_median", """WITH ps AS (SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, greatest(-20, least(20, l_quantity - 25)) AS c,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice) AS p, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
ed AS (SELECT l_suppkey, p, c FROM ps UNION ALL SELECT l_suppkey, -k, c FROM ps, range(7) r(k) WHERE p = 1 UNION ALL SELECT l_suppkey, n + 1 + k, c FROM ps, range(7) r(k) WHERE p = n),
wd AS (SELECT l_suppkey, p, greatest(0, least(40, median(c) OVER (PARTITION BY l_suppkey ORDER BY p ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING))) AS base FROM ed)
SELECT ps.l_suppkey, ps.l_orderkey, ps.l_partkey, ps.l_extendedprice, round(wd.base, 6) AS baseline, round(ps.l_quantity - 25 - wd.base, 6) AS flattened FROM ps JOIN wd ON wd.l_suppkey = ps.l_suppkey AND wd.p = ps.p""")
def rolling_median(t):
    rows = t.lineitem.withColumn("_x", F.col("l_quantity") - 25)
    out = R.rolling_median(rows.select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "_x"), ["l_suppkey"],
                           [F.col(c) for c in ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice"]], "_x", rows=15)
    return out.select("l_suppkey", "l_orderkey", "l_partkey", "l_extendedprice", F.round("baseline", 6).alias("baseline"),
                      F.round("flattened", 6).alias("flattened"))

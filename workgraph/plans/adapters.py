"""Deterministic views of the star-schema tables in the library's own schemas.

Each view is SQL that Spark and the SQL check run alike; where dialects differ
a pair (Spark, check) is given. The views keep every row of the table they are
made from; what is derived beside it (edges, archived issues, inserted lines)
follows a rule on its keys. Paths and symbol ids repeat between repositories.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region nation customer supplier part orders lineitem events documents "
        "embeddings pages benchmark labels conversations").split()

VIEWS: dict[str, str | tuple[str, str]] = {}

# --- history -------------------------------------------------------------
VIEWS["commit_files"] = """
SELECT o_custkey % 5 AS repo_id, o_orderkey AS sha, max(o_orderdate) AS ts,
       'd' || CAST((l_partkey % 40) % 7 AS VARCHAR(9)) || '/f' || CAST(l_partkey % 40 AS VARCHAR(9)) || '.go' AS path,
       CAST(sum(l_quantity) AS BIGINT) AS added,
       CAST(sum(floor(l_discount * 100 + 0.5)) AS BIGINT) AS deleted
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
GROUP BY o_custkey % 5, o_orderkey, l_partkey % 40"""
VIEWS["diff_paths"] = """
SELECT DISTINCT repo_id, path, CAST(replace(substr(path, 5), '.go', '') AS INT) AS diff_pos
FROM commit_files WHERE path LIKE 'd3/%'"""

# --- boards --------------------------------------------------------------
VIEWS["issues"] = """
SELECT o_custkey AS board_id,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS pos,
       'TH-' || CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS VARCHAR(9)) AS id,
       'order ' || CAST(o_orderkey AS VARCHAR(12)) AS title,
       CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'todo' ELSE 'doing' END AS status,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'must' WHEN '2' THEN 'high' WHEN '5' THEN 'low' END AS priority,
       o_orderdate AS updated_at, o_orderkey AS okey, o_totalprice AS price
FROM orders"""
VIEWS["edges"] = """
SELECT board_id, pos AS src_pos, id AS src, 'TH-' || CAST(pos - 1 AS VARCHAR(9)) AS dep, 0 AS dep_pos
FROM issues WHERE okey % 3 <> 0 AND pos > 1
UNION ALL
SELECT board_id, pos, id, 'TH-' || CAST(pos - 4 AS VARCHAR(9)), 1 FROM issues WHERE okey % 5 = 0 AND pos > 4"""
VIEWS["edges_cyclic"] = """
SELECT * FROM edges
UNION ALL
SELECT i.board_id, i.pos, i.id, 'TH-' || CAST(i.pos + 2 AS VARCHAR(9)), 2
FROM issues i JOIN issues j ON i.board_id = j.board_id AND j.pos = i.pos + 2 WHERE i.okey % 11 = 0
UNION ALL
SELECT board_id, pos, id, 'TH-' || CAST(pos + 100 AS VARCHAR(9)), 3 FROM issues WHERE okey % 29 = 0"""
VIEWS["issues_dup"] = """
SELECT board_id, pos, 'TH-' || CAST(CASE WHEN okey % 17 = 0 AND pos > 1 THEN pos - 1 ELSE pos END AS VARCHAR(9)) AS id,
       title, status, priority, updated_at, okey FROM issues"""
VIEWS["done_log"] = """
SELECT board_id, pos, id, title, status, priority, updated_at FROM issues
WHERE status = 'done' AND pos % 4 = 0 AND board_id % 10 = 0"""
VIEWS["boards"] = """
SELECT board_id, 'TH' AS prefix, CAST(board_id % 12 AS BIGINT) AS next_id FROM issues GROUP BY board_id"""

# --- code ----------------------------------------------------------------
VIEWS["symbols"] = """
SELECT CAST(p_partkey % 5 AS INT) AS repo_id, 's' || CAST(CAST(floor(p_partkey / 5) AS BIGINT) AS VARCHAR(12)) AS id,
       replace(p_name, ' ', '_') AS name,
       CASE p_partkey % 4 WHEN 0 THEN 'func' WHEN 1 THEN 'method' WHEN 2 THEN 'type' ELSE 'interface' END AS kind,
       'f' || CAST(CAST(floor(p_partkey / 5) AS BIGINT) % 10 AS VARCHAR(9)) AS path,
       CAST(floor(p_partkey / 50) * 14 + 1 AS BIGINT) AS start_line,
       CAST(floor(p_partkey / 50) * 14 + 1 + p_size AS BIGINT) AS end_line,
       p_partkey % 3 = 0 AS exported, p_brand AS signature, p_partkey AS pk
FROM part"""
VIEWS["call_edges"] = """
SELECT CAST(p_partkey % 5 AS INT) AS repo_id, 'calls' AS kind, 's' || CAST(CAST(floor(p_partkey / 5) AS BIGINT) AS VARCHAR(12)) AS from_id,
       's' || CAST(CAST(floor(p_partkey / 10) AS BIGINT) AS VARCHAR(12)) AS to_id,
       'f' || CAST(CAST(floor(p_partkey / 5) AS BIGINT) % 10 AS VARCHAR(9)) AS site_path, p_size AS site_line,
       CASE WHEN p_partkey % 2 = 0 THEN 'static' ELSE 'interface-dispatch' END AS confidence
FROM part WHERE p_partkey >= 5"""
VIEWS["loop_edges"] = """
SELECT CAST(p_partkey % 5 AS INT) AS repo_id, 's' || CAST(CAST(floor(p_partkey / 5) AS BIGINT) AS VARCHAR(12)) AS from_id,
       's' || CAST((CAST(floor(p_partkey / 5) AS BIGINT) * 13 + 5) % (SELECT CAST(floor(count(*) / 5) AS BIGINT) FROM part) AS VARCHAR(12)) AS to_id
FROM part"""
VIEWS["hunks"] = """
SELECT review_id, repo_id, path, new_start, new_lines,
       row_number() OVER (PARTITION BY review_id, repo_id, path ORDER BY new_start, new_lines) AS hunk_no
FROM (SELECT DISTINCT l_suppkey AS review_id, CAST(l_suppkey % 5 AS INT) AS repo_id, 'f' || CAST(CAST(floor(l_partkey / 5) AS BIGINT) % 10 AS VARCHAR(9)) AS path,
             CAST(l_quantity AS BIGINT) * 14 AS new_start, l_linenumber AS new_lines FROM lineitem) h"""
VIEWS["review_symbols"] = """
SELECT DISTINCT l_suppkey AS review_id, CAST(l_suppkey % 5 AS INT) AS repo_id,
       's' || CAST(CAST(floor(l_partkey / 5) AS BIGINT) AS VARCHAR(12)) AS id FROM lineitem"""
VIEWS["order_symbols"] = """
SELECT l_orderkey AS review_id, CAST(l_orderkey % 5 AS INT) AS repo_id,
       's' || CAST(CAST(floor(l_partkey / 5) AS BIGINT) AS VARCHAR(12)) AS id, min(l_partkey) AS ord
FROM lineitem GROUP BY l_orderkey, floor(l_partkey / 5)"""
VIEWS["imports"] = """
SELECT DISTINCT 0 AS repo_id, 'p' || CAST(a AS VARCHAR(12)) AS pkg, 'p' || CAST(b AS VARCHAR(12)) AS imported FROM (
  SELECT s_suppkey AS a, CAST(floor(s_suppkey / 2) AS BIGINT) AS b FROM supplier WHERE s_suppkey > 0 UNION ALL
  SELECT s_suppkey, (s_suppkey * 3 + 1) % (SELECT count(*) FROM supplier) FROM supplier) x"""
VIEWS["changed_paths"] = """
SELECT c_custkey AS review_id, 0 AS repo_id,
       'src/d' || CAST(c_custkey % (SELECT count(*) FROM supplier) AS VARCHAR(12)) || '/x.go' AS path FROM customer"""
VIEWS["methods"] = """
SELECT DISTINCT CAST(l_orderkey % 3 AS INT) AS repo_id, l_suppkey AS type_id, l_partkey AS method FROM lineitem"""
VIEWS["interfaces"] = """
SELECT DISTINCT r AS repo_id, n_nationkey AS iface_id, CASE WHEN r = 0 THEN m ELSE m + r * 11 END AS method FROM (
  SELECT n_nationkey, n_nationkey % 48 AS m FROM nation UNION ALL
  SELECT n_nationkey, (n_nationkey * 5 + 3) % 48 FROM nation UNION ALL
  SELECT n_nationkey, (n_nationkey * 7 + 1) % 48 FROM nation) x CROSS JOIN (SELECT 0 AS r UNION ALL SELECT 1 UNION ALL SELECT 2) y"""

# --- reviews -------------------------------------------------------------
VIEWS["review_events"] = """
SELECT user_id AS session_id, event_id AS seq, ts, event_id % 30 AS hunk, value,
       CASE event_type WHEN 'click' THEN 'mark' WHEN 'signup' THEN 'mark' WHEN 'view' THEN 'unmark'
            WHEN 'purchase' THEN 'upsert' ELSE 'delete' END AS op
FROM events"""

# --- journals ------------------------------------------------------------
VIEWS["log_lines"] = (
    """
SELECT log_id, CAST(row_number() OVER (PARTITION BY log_id ORDER BY turn, part, sub) AS INT) AS line, text FROM (
  SELECT log_id, turn, part, sub, text FROM (
    SELECT conv_id AS log_id, turn, 0 AS part, 0 AS sub,
      concat('## ', CASE WHEN turn % 5 = 3 THEN '' ELSE concat('2024-01-', lpad(CAST((conv_id * 3 + turn * 5) % 28 + 1 AS STRING), 2, '0'),
        CASE WHEN turn % 5 = 1 THEN ' - ' ELSE ' — ' END) END, 'TH-', CAST(conv_id % 25 + 1 AS STRING), ': ', role) AS text FROM conversations
    UNION ALL SELECT conv_id, turn, 1, 0, '## and the rest of the title' FROM conversations WHERE turn % 7 = 2
    UNION ALL SELECT conv_id, turn, 2, 0, '' FROM conversations
    UNION ALL SELECT conv_id, turn, 3, p, CASE WHEN p = 0 AND turn % 4 = 1 THEN concat('**Amended:** ', t) ELSE t END
      FROM conversations LATERAL VIEW posexplode(split(text, '\\n')) x AS p, t
    UNION ALL SELECT conv_id, turn, 3, 9999, 'This was amended after review.' FROM conversations WHERE turn % 8 = 4
    UNION ALL SELECT conv_id, turn, 4, 0, '---' FROM conversations WHERE turn % 3 = 0) a) b""",
    """
SELECT log_id, CAST(row_number() OVER (PARTITION BY log_id ORDER BY turn, part, sub) AS INT) AS line, text FROM (
    SELECT conv_id AS log_id, turn, 0 AS part, 0 AS sub,
      concat('## ', CASE WHEN turn % 5 = 3 THEN '' ELSE concat('2024-01-', lpad(CAST((conv_id * 3 + turn * 5) % 28 + 1 AS VARCHAR), 2, '0'),
        CASE WHEN turn % 5 = 1 THEN ' - ' ELSE ' — ' END) END, 'TH-', CAST(conv_id % 25 + 1 AS VARCHAR), ': ', role) AS text FROM conversations
    UNION ALL SELECT conv_id, turn, 1, 0, '## and the rest of the title' FROM conversations WHERE turn % 7 = 2
    UNION ALL SELECT conv_id, turn, 2, 0, '' FROM conversations
    UNION ALL SELECT conv_id, turn, 3, p, CASE WHEN p = 0 AND turn % 4 = 1 THEN concat('**Amended:** ', t) ELSE t END
      FROM (SELECT conv_id, turn, unnest(range(len(string_split(text, chr(10))))) AS p, unnest(string_split(text, chr(10))) AS t FROM conversations) x
    UNION ALL SELECT conv_id, turn, 3, 9999, 'This was amended after review.' FROM conversations WHERE turn % 8 = 4
    UNION ALL SELECT conv_id, turn, 4, 0, '---' FROM conversations WHERE turn % 3 = 0) a""")

# --- patches and texts ---------------------------------------------------
VIEWS["doc_lines"] = (
    "SELECT doc_id, CAST(p AS INT) + 1 AS line, t AS text FROM documents LATERAL VIEW posexplode(split(text, '\\n')) x AS p, t",
    "SELECT doc_id, CAST(p AS INT) + 1 AS line, t AS text FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS p, "
    "unnest(string_split(text, chr(10))) AS t FROM documents) x")
VIEWS["diff_lines"] = """
SELECT doc_id AS file_id, CAST(floor((line - 1) / 12) AS INT) AS hunk_no, CAST((line - 1) % 12 AS INT) AS line_no, text,
       CASE (doc_id + line) % 5 WHEN 0 THEN 'add' WHEN 1 THEN 'del' WHEN 3 THEN 'add' ELSE 'context' END AS kind,
       (doc_id + line) % 41 = 0 AS no_newline
FROM doc_lines"""
VIEWS["md_lines"] = """
SELECT doc_id, line, CASE line % 9 WHEN 0 THEN '# ' || text WHEN 1 THEN '- ' || text WHEN 2 THEN '- [x] ' || text
    WHEN 3 THEN '- [ ] ' || text WHEN 4 THEN '1. ' || text WHEN 5 THEN '```' WHEN 7 THEN '```' ELSE text END AS text
FROM doc_lines"""

# --- scenario files ------------------------------------------------------
VIEWS["steps"] = """
SELECT CAST(user_id % 7 AS INT) AS repo_id, event_id AS step_id,
       'Given user "u' || CAST(user_id AS VARCHAR(12)) || '" does ' || event_type || ' ' || CAST(event_id % 9 AS VARCHAR(2)) AS text
FROM events"""

VIEWS["feature_lines"] = """
SELECT 0 AS repo_id, 'd' || CAST(doc_id AS VARCHAR(12)) || '.feature' AS path, line,
  CASE WHEN line = 1 THEN 'Feature: ' || text WHEN line % 23 = 0 THEN 'Rule: ' || text WHEN line % 13 = 0 THEN 'Background:'
    WHEN line % 7 = 0 THEN '  Scenario: ' || text WHEN line % 11 = 2 THEN 'Scenario Outline: ' || text
    WHEN line % 11 = 3 THEN '    Given a <who> does <n>' WHEN line % 11 = 4 THEN 'Examples:' WHEN line % 11 = 5 THEN '| who | n |'
    WHEN line % 11 = 6 THEN '| u' || CAST(doc_id AS VARCHAR(12)) || ' | 3 |' WHEN line % 11 = 10 THEN 'Then <missing> ends'
    WHEN line % 3 = 0 THEN 'When ' || text WHEN line % 3 = 1 THEN 'And ' || text ELSE '# ' || text END AS text
FROM doc_lines"""

# --- evaluation ----------------------------------------------------------
VIEWS["eval_outputs"] = """
SELECT doc_id AS output_id, doc_id % (SELECT count(*) FROM benchmark) AS case_id, source AS model, lang AS variant,
  doc_id % 11 <> 0 AS json_valid,
  CASE doc_id % 5 WHEN 0 THEN 'behavior' WHEN 1 THEN 'refactor' WHEN 2 THEN 'rename' WHEN 3 THEN 'test' ELSE 'config' END AS kind,
  text || ' load_doc() and Ab.cd calls' || CASE doc_id % 3 WHEN 0 THEN ' +3/-1' WHEN 1 THEN ' +4 / −1' ELSE '' END AS what,
  n_chars AS latency_ms, CAST(floor(n_chars / 4) AS BIGINT) AS completion_tokens
FROM documents"""

def _needs(sql: str, engine: int) -> list[str]:
    """Views named by ``sql``, in the order they must be defined."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+([a-z_]+)", text):
            if name in VIEWS and name not in found:
                visit(_text(name, engine))
                if name not in found:
                    found.append(name)

    visit(sql)
    return found


def _text(name: str, engine: int) -> str:
    view = VIEWS[name]
    return view if isinstance(view, str) else view[engine]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a view as a DataFrame."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    body = _text(name, 0)
    parts = [f"{v} AS ({_text(v, 0)})" for v in _needs(body, 0)]
    text = ("WITH " + ", ".join(parts) + " " if parts else "") + body
    for base in BASE:
        text = re.sub(rf"\b(FROM|JOIN)\s+{base}\b", rf"\1 parquet.`{sf_dir}/{base}.parquet`", text)
    return spark.sql(text)


def check_sql(body: str) -> str:
    """Prefix ``body`` with the views it names, for the SQL check."""
    parts = [f"{v} AS ({_text(v, 1).strip()})" for v in _needs(body, 1)]
    body = body.strip()
    if body.upper().startswith("WITH "):
        rest = re.sub(r"^WITH\s+(RECURSIVE\s+)?", "", body, flags=re.I)
        return "WITH RECURSIVE " + ", ".join([*parts, rest])
    return ("WITH RECURSIVE " + ", ".join(parts) + " " if parts else "") + body

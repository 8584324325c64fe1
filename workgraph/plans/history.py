"""History queries over commits derived from orders and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from workgraph.functions import paths as P
from workgraph.operators import history as H
from workgraph.plans.registry import query

MIN_CONFIDENCE = 0.12


# All commits of every repository.
_WINDOW = "small AS (SELECT * FROM commit_files)"
_STATS = _WINDOW + """,
stats AS (SELECT repo_id, path, count(*) AS commits, CAST(sum(added) AS BIGINT) AS added,
    CAST(sum(deleted) AS BIGINT) AS deleted FROM small GROUP BY repo_id, path)"""
_PAIRS = _STATS + """,
pairs AS (SELECT x.repo_id, x.path AS a, y.path AS b, count(*) AS support FROM small x
    JOIN small y ON x.repo_id = y.repo_id AND x.sha = y.sha AND x.path < y.path GROUP BY 1, 2, 3)"""
_HOT = """raw AS (SELECT *, added + deleted AS churn, ln(1 + commits) * ln(1 + added + deleted) AS r FROM stats),
span AS (SELECT repo_id, min(r) AS lo, max(r) AS hi FROM raw GROUP BY repo_id),
hot AS (SELECT repo_id, path, commits, churn, CASE WHEN hi > lo THEN (r - lo) / (hi - lo) ELSE 0 END AS score
    FROM raw JOIN span USING (repo_id))"""
_COMP = """both_ways AS (SELECT repo_id, a AS of, b AS path, support FROM pairs UNION ALL SELECT repo_id, b, a, support FROM pairs),
cand AS (SELECT w.repo_id, w.path, w.of, w.support, w.support / s.commits AS confidence, d.diff_pos
    FROM both_ways w JOIN diff_paths d ON d.repo_id = w.repo_id AND d.path = w.of
    JOIN stats s ON s.repo_id = w.repo_id AND s.path = w.of
    WHERE w.support >= 5 AND NOT EXISTS (SELECT 1 FROM diff_paths e WHERE e.repo_id = w.repo_id AND e.path = w.path)),
comp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY confidence DESC, diff_pos, of) AS rn
    FROM cand WHERE confidence >= """ + str(MIN_CONFIDENCE) + """) c WHERE rn = 1)"""


@query("commit_window", """SELECT repo_id, sha, count(*) AS files, false AS mechanical, false AS degraded FROM commit_files GROUP BY repo_id, sha""")
def commit_window(t):
    return H.commit_window(t.commit_files).select("repo_id", "sha", "files", "mechanical", "degraded")


# A window that the caller bounds: every row says whether its repository was cut and whether the commit is mechanical.
@query("commit_window_capped", """WITH win AS (
  SELECT * FROM (SELECT repo_id, sha, max(ts) AS ts, count(*) AS files, row_number() OVER (PARTITION BY repo_id ORDER BY max(ts) DESC, sha) AS rn,
      count(*) OVER (PARTITION BY repo_id) AS n
      FROM commit_files WHERE ts >= TIMESTAMP '1997-01-01 00:00:00' GROUP BY repo_id, sha) w WHERE rn <= 100)
  SELECT repo_id, sha, files, files > 3 AS mechanical, n > 100 AS degraded FROM win""")
def commit_window_capped(t):
    since = F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")
    return H.commit_window(t.commit_files, since, max_commits=100, max_files=3).select("repo_id", "sha", "files", "mechanical", "degraded")


@query("file_stats", "WITH " + _STATS + " SELECT * FROM stats")
def file_stats(t):
    return H.file_stats(t.commit_files)


@query("co_change_pairs", "WITH " + _PAIRS + " SELECT * FROM pairs")
def co_change_pairs(t):
    return H.co_change_pairs(t.commit_files)


@query("hotspots", "WITH " + _STATS + ", " + _HOT + " SELECT repo_id, path, commits, churn, round(score, 6) AS score FROM hot")
def hotspots(t):
    return H.hotspots(H.file_stats(t.commit_files)).withColumn("score", F.round("score", 6))


def _companions(t):
    stats, pairs = H.mine(t.commit_files)
    return stats, H.companions(stats, pairs, t.diff_paths, min_confidence=MIN_CONFIDENCE)


@query("companions", "WITH " + _PAIRS + ", " + _COMP +
       " SELECT repo_id, path, of, support, round(confidence, 6) AS confidence FROM comp")
def companions(t):
    return _companions(t)[1].withColumn("confidence", F.round("confidence", 6))


@query("companion_hotspots", "WITH " + _PAIRS + ", " + _COMP + ", " + _HOT + """
    SELECT c.repo_id, c.path, c.of, c.support, round(c.confidence, 6) AS confidence, h.commits, h.churn,
      round(h.score, 6) AS score FROM comp c JOIN hot h ON h.repo_id = c.repo_id AND h.path = c.path""")
def companion_hotspots(t):
    stats, found = _companions(t)
    return found.join(H.hotspots(stats), ["repo_id", "path"]) \
        .withColumn("confidence", F.round("confidence", 6)).withColumn("score", F.round("score", 6))


@query("renamed_path", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'src/' || p_type || '/' || replace(p_name, ' ', '_')
      WHEN p_partkey % 3 = 1 THEN replace(p_name, ' ', '_') ELSE p_name END AS path FROM part""")
def renamed_path(t):
    raw = F.expr("""CASE p_partkey % 3
        WHEN 0 THEN concat('src/{', p_brand, ' => ', p_type, '}/', replace(p_name, ' ', '_'))
        WHEN 1 THEN concat(p_type, ' => ', replace(p_name, ' ', '_')) ELSE p_name END""")
    return t.part.select("p_partkey", P.renamed_path(raw).alias("path"))

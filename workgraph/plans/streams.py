"""Streaming jobs run to completion over the events and order tables, and report queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from workgraph.operators import code as O
from workgraph.operators import evaluation as E
from workgraph.operators import flow as W
from workgraph.operators import reports as R
from workgraph.plans import code as code_plans
from workgraph.plans import evaluation as eval_plans
from workgraph.plans import reviews as review_plans
from workgraph.plans.registry import query
from workgraph.session import checkpoint_root, cut
from workgraph.sources import files as S
from workgraph.streaming import jobs as J


def _place(t):
    return f"{checkpoint_root(t.spark)}/{t.spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"


def _split(t, df, order):
    """Write ``df`` as three appends in ``order``, then read them as a stream, one append per batch."""
    path = _place(t) + "/in"
    rows = df.withColumn("_o", F.col(order).cast("double"))
    low, high = rows.approxQuantile("_o", [1 / 3, 2 / 3], 0.01)
    for part in [F.col("_o") <= low, (F.col("_o") > low) & (F.col("_o") <= high), F.col("_o") > high]:
        rows.filter(part).drop("_o").coalesce(1).write.mode("append").parquet(path)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(t, stream, mode):
    """Run a stream over what is there and return everything it emitted."""
    place = _place(t)
    out = f"{place}/out"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
    writer.foreachBatch(J.export_batch(out)).start().awaitTermination()
    return t.spark.read.parquet(out)


@query("stream_fold", """WITH le AS (SELECT session_id, hunk, arg_max(op, seq) AS op, max(seq) AS seq FROM review_events WHERE op IN ('mark', 'unmark') GROUP BY 1, 2)
SELECT session_id, hunk, seq FROM le WHERE op = 'mark'""")
def stream_fold(t):
    events = _split(t, t.review_events.select("session_id", "hunk", "seq", "op"), "seq")
    return J.live_states(_run(t, J.stream_review_states(events), "update"))


def _shuffled_and_repeated(t, events):
    """Appends in an order that has nothing to do with the event number, a third of the events twice."""
    mixed = events.withColumn("_mix", F.pmod(F.xxhash64("seq"), F.lit(1_000_003)))
    again = mixed.filter("seq % 3 = 0").withColumn("_mix", F.lit(1_000_003) - F.col("_mix"))
    return _split(t, mixed.unionByName(again), "_mix")


@query("stream_comments", review_plans.FOLD_COMMENTS)
def stream_comments(t):
    events = review_plans._comment_events(t).withColumn("ts", F.col("ts").cast("timestamp"))
    live = J.live_comments(_run(t, J.stream_comments(_shuffled_and_repeated(t, events)), "update"))
    return live.select("session_id", "comment_id", "body", F.col("created_at").cast("string").alias("created_at"))


@query("stream_issues", review_plans.FOLD_ISSUES)
def stream_issues(t):
    J.use_rocksdb(t.spark)
    events = review_plans._issue_events(t).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("id", F.col("id").cast("string"))
    live = J.live_issues(_run(t, J.stream_issues(_shuffled_and_repeated(t, events)), "append"))
    return live.select("board_id", F.col("id").cast("long").alias("id"), "title", "status", "priority", "comments")


@query("stream_hotspots", """SELECT user_id % 5 AS repo_id, 'f' || (event_id % 40) AS path, count(*) AS commits, CAST(sum(floor(value)) AS BIGINT) AS added, count(*) AS deleted
FROM events WHERE ts < TIMESTAMP '2024-01-08 00:00:00' AND ts >= TIMESTAMP '2024-01-03 00:00:00' GROUP BY 1, 2""")
def stream_hotspots(t):
    rows = t.events.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 5).alias("repo_id"),
                           F.concat(F.lit("f"), (F.col("event_id") % 40).cast("string")).alias("path"),
                           F.floor("value").alias("added"), F.lit(1).cast("long").alias("deleted"))
    # A last event far in the future closes every day.
    ending = t.events.agg(F.max("ts").cast("timestamp").alias("m")).select(
        (F.col("m") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("repo_id"), F.lit("").alias("path"),
        F.lit(0).cast("long").alias("added"), F.lit(0).cast("long").alias("deleted"))
    daily = _run(t, J.stream_daily_stats(_split(t, rows.unionByName(ending), "ts")), "append")
    return J.recent_stats(daily, "2024-01-07 00:00:00", 5)


@query("stream_comment_export", """SELECT user_id AS session_id, event_id % 30 AS hunk, count(*) AS times FROM (SELECT DISTINCT user_id, event_id % 30 AS event_id FROM events WHERE event_type = 'purchase') x GROUP BY 1, 2""")
def stream_comment_export(t):
    rows = t.review_events.filter("op = 'upsert'").select("session_id", "hunk", "seq", F.col("ts").cast("timestamp").alias("ts"))
    # The window outlasts the table's own span.
    out = _run(t, J.stream_exports(_split(t, rows, "seq"), ["session_id", "hunk"], "900 days"), "append")
    return out.groupBy("session_id", "hunk").agg(F.count(F.lit(1)).alias("times"))


@query("stream_journal", """WITH e AS (SELECT conv_id AS log_id, turn AS entry_no, CASE WHEN turn % 5 = 3 THEN '' ELSE '2024-01-' || lpad(CAST((conv_id * 3 + turn * 5) % 28 + 1 AS VARCHAR), 2, '0') END AS date FROM conversations)
SELECT log_id, entry_no, coalesce(last_value(nullif(date, '') IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY entry_no), '') AS effective_date FROM e""")
def stream_journal(t):
    J.use_rocksdb(t.spark)
    day = F.lpad(((F.col("conv_id") * 3 + F.col("turn") * 5) % 28 + 1).cast("string"), 2, "0")
    rows = t.conversations.select(F.col("conv_id").alias("log_id"), F.col("turn").alias("entry_no"),
                                  F.when(F.col("turn") % 5 == 3, "").otherwise(F.concat(F.lit("2024-01-"), day)).alias("date"))
    return _run(t, J.stream_journal(_split(t, rows, "entry_no")), "append").select("log_id", "entry_no", "effective_date")


@query("stream_archive", """WITH e AS (SELECT user_id AS board_id, 'i' || (event_id % 9) AS id, event_id AS seq, ts, CASE WHEN event_type = 'click' THEN 'done' ELSE 'todo' END AS status FROM events),
n AS (SELECT *, lead(ts) OVER (PARTITION BY board_id, id ORDER BY seq) AS next_ts FROM e)
SELECT board_id, id, seq FROM n WHERE status = 'done' AND next_ts IS NULL""")
def stream_archive(t):
    J.use_rocksdb(t.spark)
    rows = t.events.select(F.col("user_id").alias("board_id"), F.concat(F.lit("i"), (F.col("event_id") % 9).cast("string")).alias("id"),
                           F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
                           F.when(F.col("event_type") == "click", "done").otherwise("todo").alias("status"))
    # A last event far in the future lets every timer run out; the age outlasts the table's own span.
    ending = t.events.agg(F.max("ts").cast("timestamp").alias("m")).select(
        F.lit(-1).cast("long").alias("board_id"), F.lit("").alias("id"), F.lit(-1).cast("long").alias("seq"),
        (F.col("m") + F.expr("INTERVAL 900 DAYS")).alias("ts"), F.lit("todo").alias("status"))
    out = _run(t, J.stream_archive(_split(t, rows.unionByName(ending), "ts"), 400 * 86_400_000), "append")
    return out.select("board_id", "id", "seq")


@query("stream_summary_requests", """SELECT DISTINCT doc_id % 400 AS hunk_id FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'en' AND doc_id % 97 = 0)""")
def stream_summary_requests(t):
    rows = t.documents.select((F.col("doc_id") % 400).alias("hunk_id"), F.col("source").alias("key"), "doc_id", F.timestamp_seconds("doc_id").alias("ts"))
    cache = t.documents.filter("lang = 'en' AND doc_id % 97 = 0").select(F.col("source").alias("key"))
    stream = J.stream_summary_requests(_split(t, rows, "doc_id"), cache, "900 days")
    return _run(t, stream, "append").select("hunk_id")


# --- reports -----------------------------------------------------------------
@query("model_report")
def model_report(t):
    results = E.score_cases(eval_plans._cases(t), eval_plans._outputs(t))
    return R.model_report(E.summarize_models(results, ["model", "variant"]), results)


@query("flow_report")
def flow_report(t):
    return R.flow_report(cut(code_plans._flow(t)))


@query("radius_report", "WITH " + code_plans._RADIUS + """,
pn AS (SELECT * FROM (VALUES ('caller', 1, '  unchanged callers (', '    '), ('site', 2, '  call sites (', '    '), ('impl', 3, '  implementers (', '    ')) v(part, part_no, title, lead))
SELECT review_id, repo_id, id AS symbol, 0 AS part_no, NULL AS other, NULL AS path, CAST(NULL AS BIGINT) AS line, id || ' (' || kind || ')' || CASE WHEN signature_changed THEN ' [signature changed]' ELSE '' END AS text FROM me
UNION ALL SELECT review_id, repo_id, symbol, part_no, NULL, NULL, NULL, title || count(*) || '):' FROM rad JOIN pn USING (part) GROUP BY review_id, repo_id, symbol, part_no, title
UNION ALL SELECT review_id, repo_id, symbol, part_no, other, path, line, lead || other || CASE WHEN path IS NOT NULL THEN ' (' || path || ':' || line || ')' ELSE '' END
    || CASE WHEN in_diff THEN ' [in diff]' ELSE ' [not in diff]' END FROM rad JOIN pn USING (part)""")
def radius_report(t):
    changes, radius = code_plans._radius(t)
    mine = changes.filter("change <> 'deleted' AND kind IN ('func', 'method')")
    return R.radius_report(mine.select("review_id", "repo_id", F.col("id").alias("symbol"), "kind", "signature_changed"), cut(radius))


@query("reach_report", "WITH " + code_plans._TOP + ", " + code_plans._RUNS + """,
rc AS (SELECT w.review_id, w.repo_id, w.id, count(tp.test) > 0 AS reached, string_agg(tp.test, ', ' ORDER BY tp.place) AS tests FROM w
    LEFT JOIN tp ON tp.review_id = w.review_id AND tp.repo_id = w.repo_id AND tp.id = w.id GROUP BY 1, 2, 3)
SELECT review_id, repo_id, 0 AS part_no, '' AS id, 0 AS n, 'Test reach: ' || count(CASE WHEN reached THEN 1 END) || '/' || count(*) || ' changed functions reached by a test' AS text FROM rc GROUP BY 1, 2
UNION ALL SELECT review_id, repo_id, 1, id, 0, '  [' || CASE WHEN reached THEN 'x' ELSE ' ' END || '] ' || id FROM rc UNION ALL SELECT review_id, repo_id, 1, id, 1, '        by ' || tests FROM rc WHERE reached
UNION ALL SELECT DISTINCT review_id, repo_id, 2, '', 0, 'Suggested:' FROM cm
UNION ALL SELECT review_id, repo_id, 3, dir, 0, '  ' || command FROM cm""")
def reach_report(t):
    asked = code_plans._review_functions(t)
    hits = O.nearest_tests(code_plans._graph(t), code_plans._tests(t), asked)
    return R.reach_report(cut(O.test_reach(asked, hits).drop("path")), code_plans._commands(t, asked))


@query("context_report", """WITH s AS (SELECT repo_id, id FROM symbols WHERE kind IN ('func', 'method')),
e AS (SELECT c.repo_id, c.to_id AS id, 1 AS section, c.from_id AS other, c.confidence, c.site_path AS path, CAST(c.site_line AS BIGINT) AS line FROM call_edges c JOIN s ON s.repo_id = c.repo_id AND s.id = c.to_id
  UNION ALL SELECT c.repo_id, c.from_id, 2, c.to_id, c.confidence, c.site_path, c.site_line FROM call_edges c JOIN s ON s.repo_id = c.repo_id AND s.id = c.from_id),
n AS (SELECT s.repo_id, s.id, x.section, x.title, (SELECT count(*) FROM e WHERE e.repo_id = s.repo_id AND e.id = s.id AND e.section = x.section) AS k
  FROM s, (VALUES (1, 'Callers'), (2, 'Callees'), (3, 'Implementations')) x(section, title))
SELECT repo_id, id, 0 AS section, 0 AS confidence_no, NULL AS other, id AS text FROM s UNION ALL SELECT repo_id, id, section, 0, NULL, title || ' (' || k || '):' FROM n
UNION ALL SELECT repo_id, id, section, 1, NULL, '  none' FROM n WHERE k = 0
UNION ALL SELECT DISTINCT repo_id, id, section, CASE confidence WHEN 'static' THEN 1 ELSE 2 END, NULL, '  [' || confidence || ']' FROM e
UNION ALL SELECT repo_id, id, section, CASE confidence WHEN 'static' THEN 1 ELSE 2 END, other, '    ' || other || ' (' || path || ':' || line || ')' FROM e""")
def context_report(t):
    wanted = O.navigable(t.symbols).select("repo_id", "id")
    calls = t.call_edges
    into = calls.join(wanted.withColumnRenamed("id", "to_id"), ["repo_id", "to_id"], "left_semi").select(
        "repo_id", F.col("to_id").alias("id"), F.lit(1).alias("section"), F.col("from_id").alias("other"), "confidence", F.col("site_path").alias("path"), F.col("site_line").alias("line"))
    out = calls.join(wanted.withColumnRenamed("id", "from_id"), ["repo_id", "from_id"], "left_semi").select(
        "repo_id", F.col("from_id").alias("id"), F.lit(2).alias("section"), F.col("to_id").alias("other"), "confidence", F.col("site_path").alias("path"), F.col("site_line").alias("line"))
    return R.context_report(wanted, into.unionByName(out)).drop("path", "line")


@query("log_lines", r"""WITH x AS (SELECT doc_id AS log_id, unnest(range(len(string_split(regexp_replace(text, '\n+$', ''), chr(10))))) + 1 AS line,
    unnest(string_split(regexp_replace(text, '\n+$', ''), chr(10))) AS text FROM documents WHERE regexp_replace(text, '\n+$', '') <> '') SELECT log_id, CAST(line AS INT) AS line, text FROM x""")
def log_lines(t):
    crlf = F.concat(F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit("\r\n\n"))
    return S.log_lines(t.documents.select(F.col("doc_id").alias("log_id"), crlf.alias("text")))


@query("read_logs", """SELECT conv_id AS log_id, count(*) * 2 AS n, sum(length(text)) + sum(length(role)) + 3 * count(*) AS chars FROM (SELECT conv_id, role, replace(text, chr(10), ' ') AS text FROM conversations) x GROUP BY 1""")
def read_logs(t):
    """Conversations written as one journal file each, then read as a folder of journals."""
    place = _place(t)
    entry = F.concat(F.lit("## "), "role", F.lit("\r\n"), F.replace("text", F.lit("\n"), F.lit(" ")))
    whole = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", entry.alias("e")))).alias("es"))
    whole.select("conv_id", F.array_join("es.e", "\n").alias("text")).write.partitionBy("conv_id").text(place)
    lines = S.read_logs(t.spark, f"{place}/*")
    number = F.regexp_extract("log_id", r"conv_id=(\d+)", 1).cast("long")
    return lines.groupBy(number.alias("log_id")).agg(F.max("line").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("git_log", """SELECT repo_id, CAST(sha AS VARCHAR) AS sha, count(*) AS files, count(CASE WHEN added > 25 THEN 1 END) AS renames FROM commit_files GROUP BY 1, 2""")
def git_log(t):
    """Commits printed as a log text per commit, then parsed back."""
    from workgraph.sources.git import parse_git_log
    line = F.when(F.col("added") > 25, F.concat(F.lit("R100\told/"), "path", F.lit("\t"), "path")).otherwise(F.concat(F.lit("M\t"), "path"))
    texts = t.commit_files.groupBy("repo_id", "sha").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body")).select(
        "repo_id", F.concat(F.lit("\x1e"), F.col("sha").cast("string"), F.lit("\x1fAnn\x1fann@example.org\x1f2024-01-02T03:04:05+02:00\x1fsubject\n"), "body", F.lit("\n")).alias("text"))
    commits, files, _ = parse_git_log(texts)
    per = files.groupBy("repo_id", "sha").agg(F.count(F.lit(1)).alias("files"), F.count("old_path").alias("renames"))
    return commits.filter("author = 'Ann'").select("repo_id", "sha").join(per, ["repo_id", "sha"])


@query("manifest_hash", """WITH d AS (SELECT source, sha256(source || '/' || doc_id || ':' || n_chars || ':' || (doc_id * 1000000)) AS h FROM documents)
    SELECT source AS module, sha256(concat_ws(':', CAST(sum(('0x' || substr(h, 1, 15))::BIGINT) AS VARCHAR), CAST(sum(('0x' || substr(h, 16, 15))::BIGINT) AS VARCHAR), CAST(sum(('0x' || substr(h, 31, 15))::BIGINT) AS VARCHAR), CAST(sum(('0x' || substr(h, 46, 15))::BIGINT) AS VARCHAR), CAST(count(*) AS VARCHAR))) AS key, count(*) AS files FROM d GROUP BY 1""")
def manifest_hash(t):
    return S.manifest_hash(t.documents.select(F.col("source").alias("module"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
                                              F.col("n_chars").alias("size"), F.timestamp_seconds(F.col("doc_id")).alias("modified")))

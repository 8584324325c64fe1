"""Review queries over marks and drafts derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from workgraph.functions import paths as P
from workgraph.operators import changelog as C
from workgraph.operators import reviews as O
from workgraph.plans.registry import query

S = "session_id"


def _hunks(t):
    """The current diff of each session: the hunks it ever touched whose number is not a multiple of three."""
    return t.review_events.filter("hunk % 3 <> 0").select(
        S, (F.col("hunk") % 10).alias("file_no"), F.concat(F.lit("p"), (F.col("hunk") % 10).cast("string")).alias("path"),
        F.col("hunk").alias("hunk_id"), F.col("hunk").alias("hunk_no")).distinct()


def _states(t):
    return C.fold_review_states(t.review_events).select(
        S, F.col("hunk").alias("hunk_id"), F.concat(F.lit("p"), (F.col("hunk") % 10).cast("string")).alias("path"), "status")


def _comments(t):
    kind = F.when(F.col("seq") % 4 == 0, "published").when(F.col("seq") % 4 == 1, "failed").otherwise("draft")
    return t.review_events.filter("op IN ('upsert', 'delete')").select(
        S, F.col("seq").alias("comment_id"), F.when(F.col("seq") % 5 != 0, F.col("hunk")).alias("anchor_hunk"),
        kind.alias("status"), (F.col("seq") % 7 != 0).alias("publishable"),
        F.concat(F.lit("note "), F.col("seq").cast("string")).alias("body"), F.col("seq").alias("created_at"))


_BASE = """hk AS (SELECT DISTINCT session_id, hunk % 10 AS file_no, 'p' || (hunk % 10) AS path, hunk AS hunk_id FROM review_events WHERE hunk % 3 <> 0),
le AS (SELECT session_id, hunk, arg_max(op, seq) AS op, max(seq) AS seq FROM review_events WHERE op IN ('mark', 'unmark') GROUP BY 1, 2),
stt AS (SELECT session_id, hunk AS hunk_id, 'p' || (hunk % 10) AS path FROM le WHERE op = 'mark'),
cm AS (SELECT session_id, seq AS comment_id, CASE WHEN seq % 5 <> 0 THEN hunk END AS anchor_hunk,
    CASE seq % 4 WHEN 0 THEN 'published' WHEN 1 THEN 'failed' ELSE 'draft' END AS status, seq % 7 <> 0 AS publishable, 'note ' || seq AS body
    FROM review_events WHERE op IN ('upsert', 'delete')),
rc AS (SELECT *, anchor_hunk IS NOT NULL AND NOT EXISTS (SELECT 1 FROM hk WHERE hk.session_id = cm.session_id AND hk.hunk_id = cm.anchor_hunk) AS lost FROM cm),
pf AS (SELECT *, CASE WHEN anchor_hunk IS NULL THEN 'general' WHEN lost OR NOT publishable THEN 'excluded' ELSE 'inline' END AS lane,
    CASE WHEN lost THEN 'stale' ELSE status END AS now_status FROM rc WHERE CASE WHEN lost THEN 'stale' ELSE status END <> 'published')"""


@query("fold_review_states", "WITH " + _BASE + " SELECT session_id, hunk, 'reviewed' AS status, seq FROM le WHERE op = 'mark'")
def fold_review_states(t):
    return C.fold_review_states(t.review_events).drop("reviewed_at")


@query("refresh_states", "WITH " + _BASE + """ SELECT session_id, hunk_id, CASE
    WHEN EXISTS (SELECT 1 FROM hk WHERE hk.session_id = s.session_id AND hk.hunk_id = s.hunk_id) THEN 'reviewed'
    WHEN EXISTS (SELECT 1 FROM hk WHERE hk.session_id = s.session_id AND hk.path = s.path) THEN 'needs-re-review' ELSE 'stale' END AS status,
    NOT EXISTS (SELECT 1 FROM hk WHERE hk.session_id = s.session_id AND hk.hunk_id = s.hunk_id) AS changed FROM stt s""")
def refresh_states(t):
    return O.refresh_states(_states(t), _hunks(t)).drop("path")


@query("refresh_comments", "WITH " + _BASE + """ SELECT session_id, comment_id, CASE WHEN lost THEN 'stale' ELSE status END AS status, lost AS changed FROM rc""")
def refresh_comments(t):
    return O.refresh_comments(_comments(t), _hunks(t)).select(S, "comment_id", "status", "changed")


@query("eligible_to_publish", "WITH " + _BASE + " SELECT session_id, comment_id FROM cm WHERE status <> 'published' AND comment_id % 2 = 1")
def eligible_to_publish(t):
    wanted = t.review_events.filter("seq % 2 = 1").select(S, F.col("seq").alias("comment_id"))
    return O.eligible_to_publish(_comments(t), wanted).select(S, "comment_id")


@query("preflight", "WITH " + _BASE + """ SELECT session_id, comment_id, lane, CASE WHEN lane = 'excluded' AND lost THEN 'this' WHEN lane = 'excluded' THEN 'not' END AS reason FROM pf""")
def preflight(t):
    return O.preflight(_comments(t), _hunks(t)).select(S, "comment_id", "lane", F.substring_index("reason", " ", 1).alias("reason"))


@query("publish_retry", "WITH " + _BASE + """ SELECT session_id, count(CASE WHEN lane = 'general' THEN 1 END) = 0 AND count(CASE WHEN lane = 'inline' THEN 1 END) > 0
    AND count(CASE WHEN lane = 'inline' AND now_status <> 'failed' THEN 1 END) = 0 AS retry FROM pf GROUP BY 1""")
def publish_retry(t):
    return O.publish_retry(O.preflight(_comments(t), _hunks(t)))


@query("pending_review", """SELECT s.session_id, r.url IS NOT NULL AS blocked, r.url AS pending_url FROM (SELECT DISTINCT user_id AS session_id FROM events) s
    LEFT JOIN (SELECT o_custkey AS c, min('u/' || o_orderkey) AS url FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 2 = 0 GROUP BY 1) r ON r.c = s.session_id""")
def pending_review(t):
    sessions = t.events.select(F.col("user_id").alias(S)).distinct().withColumn("pr", F.col(S)).withColumn("user", F.lit("me"))
    reviews = t.orders.select(F.col("o_custkey").alias("pr"), F.when(F.col("o_orderkey") % 2 == 0, "me").otherwise("you").alias("author"),
                              F.when(F.col("o_orderstatus") == "P", "PENDING").otherwise("COMMENTED").alias("state"),
                              F.concat(F.lit("u/"), F.col("o_orderkey").cast("string")).alias("url"))
    return O.pending_review(sessions, reviews).select(S, "blocked", "pending_url")


@query("apply_publish_results", "WITH " + _BASE + """,
rs AS (SELECT session_id, comment_id, 1 AS seq, true AS ok FROM cm WHERE comment_id % 3 = 0 UNION ALL SELECT session_id, comment_id, 2, false FROM cm WHERE comment_id % 6 = 0
    UNION ALL SELECT session_id, -comment_id, 1, true FROM cm),
ls AS (SELECT session_id, comment_id, arg_max(ok, seq) AS ok, max(seq) AS seq FROM rs GROUP BY 1, 2)
SELECT cm.session_id, cm.comment_id, CASE WHEN ls.ok THEN 'published' WHEN NOT ls.ok THEN 'failed' ELSE cm.status END AS status,
    CASE WHEN ls.seq IS NOT NULL THEN 'r' || ls.seq END AS remote_id FROM cm LEFT JOIN ls USING (session_id, comment_id)""")
def apply_publish_results(t):
    comments = _comments(t)
    result = lambda rows, ident, seq, ok: rows.select(
        S, ident.alias("comment_id"), F.lit(seq).alias("seq"), F.lit(ok).alias("ok"), F.lit(f"r{seq}").alias("remote_id"),
        F.lit("").alias("url"), F.lit("").alias("error"))
    ident = F.col("comment_id")
    results = result(comments.filter("comment_id % 3 = 0"), ident, 1, True) \
        .unionByName(result(comments.filter("comment_id % 6 = 0"), ident, 2, False)).unionByName(result(comments, -ident, 1, True))
    return O.apply_publish_results(comments, results).select(S, "comment_id", "status", "remote_id")


@query("compose_review_body", "WITH " + _BASE + """, gn AS (SELECT session_id, body, row_number() OVER (PARTITION BY session_id ORDER BY comment_id) AS part_no FROM pf WHERE lane = 'general'),
bs AS (SELECT DISTINCT user_id AS session_id, CASE WHEN user_id % 2 = 0 THEN 'Looks fine' ELSE '' END AS body FROM events)
SELECT session_id, 0 AS part_no, body AS text FROM bs WHERE body <> ''
UNION ALL SELECT g.session_id, g.part_no, CASE WHEN bs.body = '' AND g.part_no = 1 THEN '' ELSE chr(10) || chr(10) || '---' || chr(10) || chr(10) END || g.body FROM gn g JOIN bs USING (session_id)""")
def compose_review_body(t):
    sessions = t.events.select(F.col("user_id").alias(S)).distinct() \
        .withColumn("body", F.when(F.col(S) % 2 == 0, "Looks fine").otherwise(""))
    return O.compose_review_body(sessions, O.preflight(_comments(t), _hunks(t)))


_FILES = """fl AS (SELECT DISTINCT session_id, hunk % 10 AS file_no FROM review_events),
fp AS (SELECT f.session_id, f.file_no, count(h.hunk_id) AS hunks, count(s.hunk_id) AS reviewed FROM fl f
    LEFT JOIN hk h ON h.session_id = f.session_id AND h.file_no = f.file_no LEFT JOIN stt s ON s.session_id = h.session_id AND s.hunk_id = h.hunk_id GROUP BY 1, 2)"""


def _files(t):
    return t.review_events.select(S, (F.col("hunk") % 10).alias("file_no")).distinct()


@query("file_progress", "WITH " + _BASE + ", " + _FILES + " SELECT *, hunks > 0 AND hunks = reviewed AS done FROM fp")
def file_progress(t):
    return O.file_progress(_files(t), _hunks(t), _states(t))


@query("progress", "WITH " + _BASE + ", " + _FILES + """ SELECT session_id, count(*) AS total_files,
    count(CASE WHEN hunks > 0 AND hunks = reviewed THEN 1 END) AS reviewed_files, CAST(sum(hunks) AS BIGINT) AS total_hunks, CAST(sum(reviewed) AS BIGINT) AS reviewed_hunks FROM fp GROUP BY 1""")
def progress(t):
    return O.progress(_files(t), _hunks(t), _states(t))


def _sources(rows):
    kind = F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'pr' WHEN 1 THEN 'patch' WHEN 2 THEN 'worktree' WHEN 3 THEN 'range' ELSE 'commit' END")
    n = (F.col("o_custkey") % 20).cast("string")
    return rows.select("o_orderkey", (F.col("o_custkey") % 3).alias("repo_key"), kind.alias("kind"), F.lit("Git.example").alias("host"),
                       F.when(F.col("o_orderkey") % 2 == 0, "Acme").otherwise("acme").alias("owner"), F.lit("widgets").alias("repo"),
                       (F.col("o_custkey") % 20).alias("number"), F.concat(F.lit("p/"), n, F.lit(".diff")).alias("patch_path"),
                       F.lit("/src").alias("repo_path"), F.concat(F.lit("v"), n, F.lit("..main")).alias("ref"),
                       F.col("o_orderdate").alias("updated_at"))


@query("resume_session", """WITH sr AS (SELECT o_orderkey, o_custkey % 3 AS repo_key, o_orderkey % 5 AS k, CASE WHEN o_orderkey % 5 = 2 THEN 0 ELSE o_custkey % 20 END AS n, o_orderdate, o_orderstatus FROM orders),
ss AS (SELECT *, row_number() OVER (PARTITION BY repo_key, k, n ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM sr WHERE o_orderstatus = 'F')
SELECT s.o_orderkey, f.o_orderkey AS session_id FROM sr s LEFT JOIN ss f ON f.rn = 1 AND f.repo_key = s.repo_key AND f.k = s.k AND f.n = s.n WHERE s.o_orderstatus = 'O'""")
def resume_session(t):
    sessions = _sources(t.orders.filter("o_orderstatus = 'F'")).withColumnRenamed("o_orderkey", S)
    return O.resume_session(sessions, _sources(t.orders.filter("o_orderstatus = 'O'"))).select("o_orderkey", S)


def _wanted(t):
    return t.documents.select(F.col("doc_id").alias("hunk_id"), P.summary_key("source", "text").alias("key"))


def _cache(t):
    return t.documents.filter("lang = 'en'").select(P.summary_key("source", "text").alias("key"), F.col("n_chars").alias("summary")) \
        .dropDuplicates(["key"])


_KEYS = """ky AS (SELECT doc_id AS hunk_id, source, text, lang FROM documents), ch AS (SELECT DISTINCT source, text FROM documents WHERE lang = 'en')"""


@query("ready_summaries", "WITH " + _KEYS + " SELECT hunk_id, length(text) AS summary FROM ky JOIN ch USING (source, text)")
def ready_summaries(t):
    return O.pending_summaries(_wanted(t), _cache(t))[0].select("hunk_id", "summary")


@query("pending_summaries", "WITH " + _KEYS + " SELECT hunk_id FROM ky WHERE (source, text) NOT IN (SELECT (source, text) FROM ch)")
def pending_summaries(t):
    return O.pending_summaries(_wanted(t), _cache(t))[1].select("hunk_id")


@query("prefetch_order", "WITH " + _BASE + """ SELECT session_id, hunk_id, row_number() OVER (PARTITION BY session_id ORDER BY
    CASE WHEN file_no < 5 THEN 0 ELSE 1 END, CASE WHEN file_no < 5 THEN 9 - file_no ELSE file_no END, file_no, hunk_id) AS place FROM hk""")
def prefetch_order(t):
    flow = _files(t).filter("file_no < 5").withColumn("place", 9 - F.col("file_no"))
    return O.prefetch_order(_files(t), _hunks(t), flow).select(S, "hunk_id", "place")


@query("work_queue", """WITH r AS (SELECT user_id % 10 AS queue_id, event_id % 30 AS hunk_id, event_id AS seq, CAST(floor(value) AS BIGINT) % 7 + CASE WHEN event_type = 'view' THEN 1048576 ELSE 0 END AS p FROM events),
g AS (SELECT queue_id, hunk_id, min(p) AS priority, min(seq) AS seq FROM r GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY queue_id ORDER BY priority, seq) AS place FROM g""")
def work_queue(t):
    requests = t.events.select((F.col("user_id") % 10).alias("queue_id"), (F.col("event_id") % 30).alias("hunk_id"),
                               F.col("event_id").alias("seq"), (F.floor("value") % 7).alias("priority"),
                               (F.col("event_type") == "view").alias("background"))
    return O.work_queue(requests)


@query("all_comments", """SELECT event_id AS id, 'u' || user_id AS author, CASE WHEN event_type <> 'error' THEN CASE WHEN event_id % 4 = 0 THEN 7 ELSE event_id % 50 END END AS line,
    CASE WHEN event_type <> 'error' THEN CASE WHEN event_type = 'view' THEN 'old' ELSE 'new' END END AS side,
    event_type <> 'error' AND event_id % 4 = 0 AS outdated FROM events""")
def all_comments(t):
    rows = t.events.withColumn("user", F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("login")))
    common = [F.col("event_id").alias("id"), "user", F.col("props").alias("body"), F.col("ts").alias("created_at"), F.lit("").alias("html_url")]
    inline = rows.filter("event_type <> 'error'").select(
        *common, F.lit("a.go").alias("path"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 50).alias("line"),
        F.lit(7).cast("long").alias("original_line"), F.when(F.col("event_type") == "view", "LEFT").otherwise("RIGHT").alias("side"),
        F.lit("c").alias("commit_id"), F.lit(None).cast("long").alias("in_reply_to_id"))
    plain = rows.filter("event_type = 'error'").select(*common)
    return O.remote_comments(inline, plain).select("id", "author", "line", "side", "outdated")


def _comment_events(t):
    return t.review_events.filter("op IN ('upsert', 'delete')").select(
        S, F.col("hunk").alias("comment_id"), "seq", "ts", "op", F.concat(F.lit("v"), F.col("seq").cast("string")).alias("body"))


FOLD_COMMENTS = """WITH e AS (SELECT session_id, hunk AS comment_id, seq, op FROM review_events WHERE op IN ('upsert', 'delete')),
b AS (SELECT session_id, comment_id, min(seq) AS born, max(seq) AS latest FROM e WHERE op = 'upsert' GROUP BY 1, 2)
SELECT b.session_id, b.comment_id, 'v' || b.latest AS body, CAST(f.ts AS VARCHAR) AS created_at FROM b JOIN events f ON f.event_id = b.born
WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.session_id = b.session_id AND e.comment_id = b.comment_id AND e.op = 'delete' AND e.seq > b.born)"""


@query("fold_comments", FOLD_COMMENTS)
def fold_comments(t):
    return C.fold_comments(_comment_events(t)).select(S, "comment_id", "body", F.col("created_at").cast("string").alias("created_at"))


@query("apply_draft_rules", """SELECT event_id AS comment_id, event_id % 5 = 0 OR CAST(floor(value) AS BIGINT) % 3 > 0 AS publishable FROM events WHERE event_type <> 'view'""")
def apply_draft_rules(t):
    requests = t.events.select(
        F.col("event_id").alias("comment_id"), F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("anchor_hunk"),
        (F.floor("value") % 3).alias("position"), F.when(F.col("event_type") == "view", " \n ").otherwise(F.col("props")).alias("body"))
    return C.apply_draft_rules(requests)[0].select("comment_id", "publishable")


def _issue_events(t):
    first = F.col("event_id") % 4 == 0
    op = F.when(first, "add").when(F.col("event_type") == "purchase", "comment").otherwise("update")
    return t.events.select(
        F.col("user_id").alias("board_id"), (F.col("event_id") % 9).alias("id"), F.col("event_id").alias("seq"), "ts", op.alias("op"),
        F.when(op != "comment", F.col("props")).alias("title"), F.lit(None).cast("string").alias("description"),
        F.when(op == "add", "todo").when(F.col("event_type") == "click", "done").alias("status"),
        F.when(F.col("event_type") == "error", "must").when(F.col("event_type") == "signup", "normal").alias("priority"),
        F.col("props").alias("body"), F.lit("me").alias("author"))


FOLD_ISSUES = """WITH e AS (SELECT user_id AS board_id, event_id % 9 AS id, event_id AS seq, CASE WHEN event_id % 4 = 0 THEN 'add' WHEN event_type = 'purchase' THEN 'comment' ELSE 'update' END AS op, props, event_type FROM events),
v AS (SELECT *, CASE WHEN op <> 'comment' THEN props END AS title, CASE WHEN op = 'add' THEN 'todo' WHEN event_type = 'click' THEN 'done' END AS status,
    CASE event_type WHEN 'error' THEN 'must' WHEN 'signup' THEN 'normal' END AS priority, min(CASE WHEN op = 'add' THEN seq END) OVER (PARTITION BY board_id, id) AS born FROM e)
SELECT board_id, id, arg_max(title, seq) FILTER (title IS NOT NULL) AS title, arg_max(status, seq) FILTER (status IS NOT NULL) AS status,
    nullif(arg_max(priority, seq) FILTER (priority IS NOT NULL), 'normal') AS priority, count(CASE WHEN op = 'comment' THEN 1 END) AS comments FROM v WHERE seq >= born GROUP BY 1, 2"""


@query("fold_issues", FOLD_ISSUES)
def fold_issues(t):
    return C.fold_issues(_issue_events(t)).select("board_id", "id", "title", "status", "priority", "comments")


# --- scalar forms ------------------------------------------------------------
@query("repo_key", """SELECT s_suppkey, substr(sha1('git.example.org/team' || s_nationkey || '/' || lower(replace(s_name, '#', '-'))), 1, 16) AS key FROM supplier""")
def repo_key(t):
    name = F.concat(F.lit("team"), F.col("s_nationkey").cast("string"), F.lit("/"), F.replace("s_name", F.lit("#"), F.lit("-")))
    remote = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("git@Git.example.org:"), name, F.lit(".git"))) \
        .when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("https://git.example.org/"), name, F.lit("/"))) \
        .otherwise(F.concat(F.lit(" ssh://me@git.example.org/"), name, F.lit(".git ")))
    return t.supplier.select("s_suppkey", P.repo_key(remote).alias("key"))


@query("session_ids", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'pr-acme-widgets-' || (o_custkey % 20) WHEN 1 THEN 'patch-' || substr(sha1('p/' || (o_custkey % 20) || '.diff'), 1, 8)
    WHEN 2 THEN 'worktree' WHEN 3 THEN 'range-' || substr(sha1('v' || (o_custkey % 20) || '..main'), 1, 8) ELSE 'commit-' || substr(sha1('v' || (o_custkey % 20) || '..main'), 1, 8) END AS id,
  CASE o_orderkey % 5 WHEN 0 THEN 'PR #' || (o_custkey % 20) || ' ' || CASE WHEN o_orderkey % 2 = 0 THEN 'Acme' ELSE 'acme' END || '/widgets' WHEN 1 THEN 'Patch ' || (o_custkey % 20) || '.diff' WHEN 2 THEN 'Worktree'
    WHEN 3 THEN 'Diff v' || (o_custkey % 20) || '..main' ELSE 'Commit v' || (o_custkey % 20) || '..main' END AS title,
  CASE o_orderkey % 5 WHEN 0 THEN 'pr ' || CASE WHEN o_orderkey % 2 = 0 THEN 'Acme' ELSE 'acme' END || '/widgets#' || (o_custkey % 20) WHEN 1 THEN 'patch ' || (o_custkey % 20) || '.diff' WHEN 2 THEN 'worktree'
    WHEN 3 THEN 'range v' || (o_custkey % 20) || '..main' ELSE 'commit v' || (o_custkey % 20) || '..main' END AS summary FROM orders""")
def session_ids(t):
    rows = _sources(t.orders)
    return rows.select("o_orderkey", P.session_id("kind", "owner", "repo", "number", "ref", "patch_path").alias("id"),
                       P.session_title("kind", "ref", "patch_path", F.lit(""), "owner", "repo", "number").alias("title"),
                       P.source_summary("kind", "ref", "patch_path", "owner", "repo", "number").alias("summary"))


@query("split_range_ref", """SELECT o_orderkey, 'v' || o_custkey AS "left", 'main' AS "right", o_orderkey % 2 = 0 AS merge_base,
    CASE WHEN o_orderkey % 2 = 0 THEN 'base' ELSE 'v' || o_custkey END AS old_rev, 'main' AS new_rev FROM orders""")
def split_range_ref(t):
    ref = F.concat(F.lit("v"), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "...").otherwise(".."), F.lit("main"))
    rows = t.orders.select("o_orderkey", P.split_range_ref(ref).alias("p"),
                           P.side_revisions(F.lit("range"), ref, F.lit(""), F.lit(""), F.lit("base")).alias("r"))
    return rows.select("o_orderkey", "p.left", "p.right", "p.merge_base", "r.old_rev", "r.new_rev")


@query("parse_pr_ref", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'git.example.org' WHEN 3 THEN NULL ELSE 'github.com' END AS host,
    CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN 'team' ELSE 'acme' END AS owner, CASE WHEN o_orderkey % 4 <> 3 THEN 'widgets' END AS repo,
    CASE WHEN o_orderkey % 4 <> 3 THEN o_custkey END AS number FROM orders""")
def parse_pr_ref(t):
    n = F.col("o_custkey").cast("string")
    text = F.expr("o_orderkey % 4")
    ref = F.when(text == 0, F.concat(F.lit("https://git.example.org/acme/widgets.git/pull/"), n, F.lit("/files"))) \
        .when(text == 1, F.concat(F.lit(" acme/widgets#"), n)).when(text == 2, F.concat(F.lit("#"), n)).otherwise(F.lit("not a ref"))
    rows = t.orders.select("o_orderkey", P.parse_pr_ref(ref, F.lit("git@host.example:team/widgets.git")).alias("r"))
    return rows.select("o_orderkey", "r.host", "r.owner", "r.repo", "r.number")

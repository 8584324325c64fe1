"""Review sessions: refresh after an update, publishing plans, progress, summary requests.

``states`` is (session_id, hunk_id, path, status), ``comments`` is (session_id,
comment_id, anchor_hunk, anchor_path, position, status, publishable, body,
created_at), ``hunks`` is (session_id, file_no, path, hunk_id) of the current
diff.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workgraph.functions.ids import col
from workgraph.operators.scan import first_per_key, ranked

S = "session_id"
# The offset that sorts prefetched work after anything asked for.
BACKGROUND = 1 << 20


def refresh_states(states: DataFrame, hunks: DataFrame) -> DataFrame:
    """Marks after an update: a vanished hunk needs re-review while its path has hunks, else it is stale.

    ``changed`` says whether the refresh changed the status; nothing is deleted.
    """
    here = hunks.select(S, "hunk_id").distinct().withColumn("_here", F.lit(True))
    alive = hunks.select(S, "path").distinct().withColumn("_alive", F.lit(True))
    rows = states.join(here, [S, "hunk_id"], "left").join(alive, [S, "path"], "left")
    new = F.when(F.col("_here"), F.col("status")).when(F.col("_alive"), F.lit("needs-re-review")).otherwise(F.lit("stale"))
    return rows.withColumn("_new", new).withColumn("changed", F.col("_new") != F.col("status")) \
        .withColumn("status", F.col("_new")).drop("_new", "_here", "_alive").select(*states.columns, "changed")


def refresh_comments(comments: DataFrame, hunks: DataFrame) -> DataFrame:
    """Comments anchored to a vanished hunk become stale."""
    here = hunks.select(S, F.col("hunk_id").alias("anchor_hunk")).distinct().withColumn("_here", F.lit(True))
    rows = comments.join(here, [S, "anchor_hunk"], "left")
    lost = F.col("anchor_hunk").isNotNull() & F.col("_here").isNull() & (F.col("status") != "stale")
    return rows.withColumn("changed", lost).withColumn("status", F.when(lost, F.lit("stale")).otherwise(F.col("status"))) \
        .drop("_here").select(*comments.columns, "changed")


def eligible_to_publish(comments: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Drafts not published yet and, when ids are given, among them."""
    rows = comments.filter("status != 'published'")
    return rows if wanted is None else rows.join(wanted.select(S, "comment_id"), [S, "comment_id"], "left_semi")


def preflight(comments: DataFrame, hunks: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Where each eligible draft goes after a refresh: general, excluded (with reason) or inline."""
    rows = eligible_to_publish(refresh_comments(comments, hunks), wanted)
    stale = "this comment's anchor no longer matches the current diff (the file or hunk changed since it was drafted)"
    loose = "not anchored to a line in the diff (e.g. expanded context), so it cannot be published"
    general, is_stale, closed = F.col("anchor_hunk").isNull(), F.col("status") == "stale", ~F.col("publishable")
    return rows.withColumn("lane", F.when(general, "general").when(is_stale | closed, "excluded").otherwise("inline")) \
        .withColumn("reason", F.when(general, F.lit(None).cast("string")).when(is_stale, F.lit(stale)).when(closed, F.lit(loose)))


def publish_retry(plan: DataFrame) -> DataFrame:
    """Per session whether the plan only retries: no general drafts, some inline, all of them failed."""
    inline = F.col("lane") == "inline"
    return plan.groupBy(S).agg(
        (F.count(F.when(F.col("lane") == "general", 1)) == 0).alias("_none"),
        (F.count(F.when(inline, 1)) > 0).alias("_some"),
        (F.count(F.when(inline & (F.col("status") != "failed"), 1)) == 0).alias("_all")) \
        .select(S, (F.col("_none") & F.col("_some") & F.col("_all")).alias("retry"))


def pending_review(sessions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Sessions whose own user has an unsubmitted review on the pull request; a failed check blocks nothing.

    ``sessions`` is (session_id, pr, user); ``reviews`` is (pr, author, state, url).
    """
    open_ = reviews.filter("state = 'PENDING'").groupBy("pr", F.col("author").alias("user")) \
        .agg(F.min("url").alias("pending_url"))
    return sessions.join(open_, ["pr", "user"], "left").withColumn("blocked", F.col("pending_url").isNotNull())


def apply_publish_results(comments: DataFrame, results: DataFrame) -> DataFrame:
    """Merge results (session_id, comment_id, seq, ok, remote_id, url, error) into drafts, the last one per id."""
    last = first_per_key(results, [S, "comment_id"], -F.col("seq"))
    got = last.select(S, "comment_id", F.struct(
        F.when(F.col("ok"), "published").otherwise("failed").alias("status"), "remote_id", "url", "error").alias("_r"))
    rows = comments.join(got, [S, "comment_id"], "left")
    out = rows.withColumn("status", F.coalesce("_r.status", "status"))
    for name in ["remote_id", "url", "error"]:
        old = F.col(name) if name in comments.columns else F.lit(None)
        out = out.withColumn(name, F.when(F.col("_r").isNotNull(), F.col(f"_r.{name}")).otherwise(old))
    return out.drop("_r")


def compose_review_body(sessions: DataFrame, plan: DataFrame) -> DataFrame:
    """The review text as ordered parts: (session_id, part_no, text); joined without separator they are the body.

    ``sessions`` is (session_id, body). Parts, not one value, so a session with
    any number of drafts is numbered by a range sort.
    """
    general = plan.filter("lane = 'general'")
    numbered = ranked(general.select(S, "created_at", "comment_id", F.col("body").alias("text")), [S],
                      [F.col("created_at"), F.col("comment_id")], "part_no")
    opening = sessions.select(S, F.lit(0).cast("long").alias("part_no"), F.coalesce("body", F.lit("")).alias("text"))
    rows = numbered.join(opening.select(S, (F.col("text") == "").alias("_bare")), S)
    bare = F.col("_bare") & (F.col("part_no") == 1)
    text = F.concat(F.when(bare, F.lit("")).otherwise(F.lit("\n\n---\n\n")), "text")
    return opening.filter("text != ''").unionByName(rows.select(S, "part_no", text.alias("text")))


def file_progress(files: DataFrame, hunks: DataFrame, states: DataFrame) -> DataFrame:
    """Hunks and reviewed hunks per file; a file is done with at least one hunk and all reviewed."""
    reviewed = states.filter("status = 'reviewed'").select(S, "hunk_id").distinct().withColumn("_r", F.lit(1))
    per = hunks.join(reviewed, [S, "hunk_id"], "left").groupBy(S, "file_no").agg(
        F.count(F.lit(1)).alias("hunks"), F.count("_r").alias("reviewed"))
    return files.select(S, "file_no").join(per, [S, "file_no"], "left").fillna(0, ["hunks", "reviewed"]) \
        .withColumn("done", (F.col("hunks") > 0) & (F.col("hunks") == F.col("reviewed")))


def progress(files: DataFrame, hunks: DataFrame, states: DataFrame) -> DataFrame:
    return file_progress(files, hunks, states).groupBy(S).agg(
        F.count(F.lit(1)).alias("total_files"), F.count(F.when(F.col("done"), 1)).alias("reviewed_files"),
        F.sum("hunks").alias("total_hunks"), F.sum("reviewed").alias("reviewed_hunks"))


def identity_key() -> Column:
    """What makes two review sources the same, ignoring revisions that move."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kind = F.col("kind")
    pull = F.when(F.col("number").isNotNull(), F.concat_ws("\x1f", kind, low("host"), low("owner"), low("repo"), part("number")))
    return F.when(kind == "pr", pull).when(kind == "patch", F.concat_ws("\x1f", kind, part("patch_path"))) \
        .when(kind == "worktree", F.concat_ws("\x1f", kind, part("repo_path"))) \
        .when(kind.isin("range", "commit"), F.concat_ws("\x1f", kind, part("repo_path"), part("ref")))


def resume_session(sessions: DataFrame, sources: DataFrame) -> DataFrame:
    """The session each source continues: the most recently updated one of the same identity, or NULL."""
    keyed = sessions.withColumn("_key", identity_key()).filter("_key IS NOT NULL")
    newest = first_per_key(keyed.select("repo_key", "_key", S, "updated_at"), ["repo_key", "_key"],
                           F.struct(-F.unix_micros(F.col("updated_at").cast("timestamp")), S))
    return sources.withColumn("_key", identity_key()) \
        .join(newest.select("repo_key", "_key", S), ["repo_key", "_key"], "left").drop("_key")


def pending_summaries(wanted: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ready, pending) of wanted (hunk_id, key) against cached summaries by key."""
    ready = wanted.join(cache, "key")
    return ready, wanted.join(cache.select("key"), "key", "left_anti")


def prefetch_order(files: DataFrame, hunks: DataFrame, flow: DataFrame) -> DataFrame:
    """Hunks by their file's first place in the flow order, what it missed in diff order.

    ``files`` is (session_id, file_no), ``hunks`` has hunk_no, ``flow`` is
    (session_id, file_no, place).
    """
    placed = flow.groupBy(S, "file_no").agg(F.min("place").alias("_place"))
    rows = hunks.join(files.select(S, "file_no"), [S, "file_no"], "left_semi").join(placed, [S, "file_no"], "left") \
        .withColumn("_late", F.when(F.col("_place").isNull(), 1).otherwise(0)) \
        .withColumn("_place", F.coalesce(F.col("_place").cast("long"), F.col("file_no").cast("long")))
    return ranked(rows, [S], [F.col("_late"), F.col("_place"), F.col("file_no"), F.col("hunk_no")], "place") \
        .drop("_late", "_place")


def work_queue(requests: DataFrame) -> DataFrame:
    """Outstanding requests in the order to serve them: best priority, then arrival.

    ``requests`` is (queue_id, hunk_id, seq, priority, background); background
    work sorts after anything asked for, and asking again keeps the better
    priority and the first arrival.
    """
    level = F.col("priority") + F.when(F.col("background"), BACKGROUND).otherwise(0)
    one = requests.withColumn("_p", level).groupBy("queue_id", "hunk_id").agg(
        F.min("_p").alias("priority"), F.min("seq").alias("seq"))
    return ranked(one, ["queue_id"], [F.col("priority"), F.col("seq")], "place")


def remote_comments(review_comments: DataFrame, general_comments: DataFrame) -> DataFrame:
    """Review and conversation comments in one relation.

    A review comment without a current line keeps its original one and is
    outdated; LEFT is the old side.
    """
    line = F.coalesce("line", "original_line")
    inline = review_comments.select(
        "id", F.col("user.login").alias("author"), "body", "path", line.alias("line"),
        F.when(F.lower("side") == "left", "old").otherwise("new").alias("side"), "commit_id",
        F.col("in_reply_to_id").alias("in_reply_to"), "created_at", F.col("html_url").alias("url"),
        F.col("line").isNull().alias("outdated"))
    plain = general_comments.select("id", F.col("user.login").alias("author"), "body", "created_at",
                                    F.col("html_url").alias("url"), F.lit(False).alias("outdated"))
    return inline.unionByName(plain, allowMissingColumns=True)

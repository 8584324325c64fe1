"""Change logs folded to current rows: issue events, review marks, comment drafts.

Every fold is one aggregation on the row's key with the event number deciding,
so input order does not matter and partial results combine map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workgraph.functions import ids as X


def _latest(column: str):
    """The value of the last event that gave one."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("seq"))).alias(column)


def fold_issues(events: DataFrame) -> DataFrame:
    """Issue rows from (board_id, id, seq, ts, op, title, description, status, priority) events.

    An update changes only the fields it gives; the default priority is stored
    as nothing. Events before or without an add are ignored.
    """
    added = events.groupBy("board_id", "id").agg(F.min(F.when(F.col("op") == "add", F.col("seq"))).alias("_born"))
    live = events.join(added.filter("_born IS NOT NULL"), ["board_id", "id"]).filter("seq >= _born")
    out = live.groupBy("board_id", "id").agg(
        *[_latest(c) for c in ["title", "description", "status", "priority"]],
        F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"),
        F.count(F.when(F.col("op") == "comment", 1)).alias("comments"))
    return out.withColumn("priority", X.stored_priority("priority"))


def issue_comments(events: DataFrame) -> DataFrame:
    """Comment events as rows in order; empty bodies are rejected."""
    return events.filter((F.col("op") == "comment") & (F.trim(F.coalesce("body", F.lit(""))) != "")) \
        .select("board_id", "id", "seq", "ts", "author", "body")


def fold_review_states(events: DataFrame) -> DataFrame:
    """Marks that stand: the last mark or unmark per (session_id, hunk), unmarked ones dropped."""
    last = events.filter(F.col("op").isin("mark", "unmark")).groupBy("session_id", "hunk").agg(
        F.max(F.struct("seq", "op", "ts")).alias("e"))
    return last.filter("e.op = 'mark'").select(
        "session_id", "hunk", F.lit("reviewed").alias("status"), F.col("e.seq").alias("seq"), F.col("e.ts").alias("reviewed_at"))


def fold_comments(events: DataFrame) -> DataFrame:
    """Drafts that stand after upserts and deletes per (session_id, comment_id).

    An upsert after a delete names an id that no longer exists and is rejected,
    so the first delete ends a draft; replacing keeps the creation time.
    """
    writes, gone = F.col("op") == "upsert", F.col("op") == "delete"
    edges = events.groupBy("session_id", "comment_id").agg(
        F.min(F.when(writes, F.col("seq"))).alias("_born"), F.max(F.when(writes, F.struct("seq", "ts", "body"))).alias("_last"),
        F.min(F.when(writes, F.struct("seq", "ts"))).alias("_first"))
    # A delete counts only after the draft exists.
    ended = events.filter(gone).join(edges.select("session_id", "comment_id", "_born"), ["session_id", "comment_id"]) \
        .filter("seq > _born").select("session_id", "comment_id").distinct()
    return edges.filter("_born IS NOT NULL").join(ended, ["session_id", "comment_id"], "left_anti").select(
        "session_id", "comment_id", F.col("_first.ts").alias("created_at"), F.col("_last.ts").alias("updated_at"),
        F.col("_last.body").alias("body"))


def apply_draft_rules(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) drafts: an empty body is rejected; publishable without anchor or at a diff position."""
    empty = F.trim(F.regexp_replace(F.coalesce("body", F.lit("")), r"\s+", " ")) == ""
    open_ = F.col("anchor_hunk").isNull() | (F.coalesce("position", F.lit(0)) > 0)
    accepted = requests.filter(~empty).withColumn("status", F.lit("draft")).withColumn("publishable", open_)
    return accepted, requests.filter(empty).withColumn("reason", F.lit("body is required"))

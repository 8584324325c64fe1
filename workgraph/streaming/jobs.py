"""Incremental forms of the folds, statistics and exports as Structured Streaming jobs.

State grows only with live keys or is bounded by a watermark; sinks are
idempotent per batch, so a restart repeats no effect.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from workgraph.functions import ids as X

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Arbitrary state and timers need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stream_review_states(events: DataFrame) -> DataFrame:
    """The last mark or unmark per (session_id, hunk), for update mode.

    The event number decides, so arrival order does not matter; unmarks stay as
    tombstones and are dropped by :func:`live_states` on read.
    """
    return events.filter(F.col("op").isin("mark", "unmark")).groupBy("session_id", "hunk") \
        .agg(F.max(F.struct("seq", "op")).alias("e")).select("session_id", "hunk", "e.seq", "e.op")


def live_states(updates: DataFrame) -> DataFrame:
    """Marks that stand, from everything the stream has emitted."""
    last = updates.groupBy("session_id", "hunk").agg(F.max(F.struct("seq", "op")).alias("e"))
    return last.filter("e.op = 'mark'").select("session_id", "hunk", "e.seq")


def stream_comments(events: DataFrame) -> DataFrame:
    """What decides each draft of (session_id, comment_id, seq, ts, op, body) events, for update mode.

    Smallest and largest events only, so shuffled, repeated and late appends
    give the same rows and state is one row per draft.
    """
    write, gone = F.col("op") == "upsert", F.col("op") == "delete"
    return events.filter(write | gone).groupBy("session_id", "comment_id").agg(
        F.min(F.when(write, F.struct("seq", "ts"))).alias("first"), F.max(F.when(write, F.struct("seq", "ts", "body"))).alias("last"),
        F.max(F.when(gone, F.col("seq"))).alias("gone"))


def live_comments(updates: DataFrame) -> DataFrame:
    """Drafts that stand, from everything :func:`stream_comments` has emitted; the rows of ``changelog.fold_comments``."""
    now = updates.groupBy("session_id", "comment_id").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("gone").alias("gone"))
    return now.filter("first IS NOT NULL AND (gone IS NULL OR gone < first.seq)").select(
        "session_id", "comment_id", F.col("first.ts").alias("created_at"), F.col("last.ts").alias("updated_at"), F.col("last.body").alias("body"))


FIELDS = ["title", "description", "status", "priority"]
ISSUE_OUT = ST.StructType([ST.StructField("board_id", ST.LongType()), ST.StructField("id", ST.StringType()), ST.StructField("folded", ST.LongType())]
                          + [ST.StructField(c, ST.StringType()) for c in FIELDS]
                          + [ST.StructField("created_us", ST.LongType()), ST.StructField("updated_us", ST.LongType()), ST.StructField("comments", ST.LongType())])
_EVENT = ["seq", "us", "op", *FIELDS]
_ROW = ["born", "folded", "created", "updated", "comments", *FIELDS, *[f"{c}_seq" for c in FIELDS]]
_NAMED = [ST.StructField("board_id", ST.LongType()), ST.StructField("id", ST.StringType())]
_ROWS = ST.ArrayType(ST.StructType(_NAMED + [ST.StructField(c, ST.StringType() if c in FIELDS else ST.LongType()) for c in _ROW]))
_EARLY = ST.ArrayType(ST.StructType(_NAMED + [ST.StructField(c, ST.LongType() if c in ("seq", "us") else ST.StringType()) for c in _EVENT] + [ST.StructField("until", ST.LongType())]))
_ISSUE_STATE = ST.StructType([ST.StructField("rows", _ROWS), ST.StructField("early", _EARLY)])
#: Groups that issues are dealt to by hash. The issues of a group are one state, so a batch costs a call per group and none per issue or event.
GROUPS = 4096


def _none(values: tuple) -> list:
    """The values of a pandas row with None for what is missing."""
    return [None if pd.isna(v) else v for v in values]


def _by_group(rows: DataFrame, groups: int):
    return rows.withColumn("_group", F.pmod(F.xxhash64("board_id", "id"), F.lit(groups))).groupBy("_group")


def _take(row: dict, event: tuple) -> None:
    seq, at, op = event[:3]
    row["folded"] += 1
    row["created"] = at if row["created"] is None else min(row["created"], at)
    row["updated"] = at if row["updated"] is None else max(row["updated"], at)
    row["comments"] += op == "comment"
    for name, value in zip(FIELDS, event[3:7]):
        if value is not None and (row[f"{name}_seq"] is None or seq > row[f"{name}_seq"]):
            row[name], row[f"{name}_seq"] = value, seq


def _fold_issues(ttl_ms: int | None):
    """The rows of a group's issues, and the events they cannot take yet: those before the earliest add of their issue seen so far.

    ``born`` only falls, so an event at or after it is folded for good; earlier
    ones wait for an earlier add; those older than ``ttl_ms`` go when their group next has rows.
    """
    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, early = state.get if state.exists else ([], [])
        now = state.getCurrentProcessingTimeMs() if ttl_ms else 0
        issues = {(r[0], r[1]): dict(zip(_ROW, r[2:])) for r in held}
        waiting = [((e[0], e[1]), tuple(e[2:])) for e in early if e[-1] is None or e[-1] > now]
        until = now + ttl_ms if ttl_ms else None
        for chunk in chunks:
            for seq, us, *rest in chunk[[*_EVENT, "board_id", "id"]].itertuples(index=False, name=None):
                *rest, board, name = _none(rest)
                waiting.append(((None if board is None else int(board), name), (int(seq), int(us), *rest, until)))
        for issue, event in waiting:
            if event[2] == "add":
                row = issues.setdefault(issue, dict.fromkeys(_ROW) | {"folded": 0, "comments": 0})
                row["born"] = event[0] if row["born"] is None else min(row["born"], event[0])
        changed, early = {}, []
        for issue, event in waiting:
            row = issues.get(issue)
            if row is None or event[0] < row["born"]:
                early.append((*issue, *event))
            else:
                _take(row, event)
                changed[issue] = row
        state.update(([(*issue, *row.values()) for issue, row in issues.items()], early))
        if changed:
            yield pd.DataFrame([[*issue, row["folded"], *[row[c] for c in FIELDS], row["created"], row["updated"], row["comments"]] for issue, row in changed.items()],
                               columns=ISSUE_OUT.names)

    return run


def stream_issues(events: DataFrame, ttl_ms: int | None = None, groups: int = GROUPS) -> DataFrame:
    """Issue rows as their events arrive, for append mode: a row per issue and batch, numbered by the events ``folded``.

    ``events`` is what ``changelog.fold_issues`` reads. Order is free and a
    repeated append changes nothing, as long as an event is not repeated, and
    its add does not arrive, later than ``ttl_ms`` after it (None: ever). Numbers seen
    are remembered by Spark's own deduplication, for ``ttl_ms`` of processing time at least.
    """
    keys = ["board_id", "id", "seq"]
    timed = events.select(*keys, F.unix_micros("ts").alias("us"), "op", *FIELDS)
    if ttl_ms:
        timed = timed.withColumn("_at", F.current_timestamp()).withWatermark("_at", f"{ttl_ms} milliseconds").dropDuplicatesWithinWatermark(keys).drop("_at")
    else:
        timed = timed.dropDuplicates(keys)
    return _by_group(timed, groups).applyInPandasWithState(
        _fold_issues(ttl_ms), ISSUE_OUT, _ISSUE_STATE, "append", GroupStateTimeout.NoTimeout)


def live_issues(updates: DataFrame) -> DataFrame:
    """Current issue rows, from everything :func:`stream_issues` has emitted; the rows of ``changelog.fold_issues``."""
    rest = [c for c in ISSUE_OUT.names if c not in ("board_id", "id")]
    last = updates.groupBy("board_id", "id").agg(F.max_by(F.struct(*rest), "folded").alias("r"))
    return last.select("board_id", "id", *[f"r.{c}" for c in FIELDS[:3]], X.stored_priority("r.priority").alias("priority"),
                       F.timestamp_micros("r.created_us").alias("created_at"), F.timestamp_micros("r.updated_us").alias("updated_at"), "r.comments")


def stream_daily_stats(commit_files: DataFrame, lateness: str = "2 days") -> DataFrame:
    """File statistics per day, for append mode; rows later than ``lateness`` are dropped and counted by Spark.

    One-day windows copy each row once; a window of N days sliding by one would
    copy it N times.
    """
    return commit_files.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day").alias("w"), "repo_id", "path").agg(
        F.count(F.lit(1)).alias("commits"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted")) \
        .select(F.col("w.start").alias("day"), "repo_id", "path", "commits", "added", "deleted")


def recent_stats(daily: DataFrame, until, days: int) -> DataFrame:
    """File statistics of the last ``days`` days up to and including ``until``."""
    until = F.lit(until).cast("timestamp")
    inside = daily.filter((F.col("day") <= until) & (F.col("day") > until - F.make_dt_interval(F.lit(days))))
    return inside.groupBy("repo_id", "path").agg(*[F.sum(c).alias(c) for c in ["commits", "added", "deleted"]])


def stream_exports(comments: DataFrame, keys: list[str], repeat_within: str = "30 days") -> DataFrame:
    """Rows whose keys were not exported before, for append mode; ``comments`` has an event time ``ts``.

    Exported keys are state, kept for ``repeat_within`` of event time; nothing
    exported is read again. A row older than that behind the newest is dropped
    and counted by Spark, so a repetition cannot pass as new by being late.
    """
    return comments.withWatermark("ts", repeat_within).dropDuplicatesWithinWatermark(keys)


def export_batch(path: str):
    """A foreachBatch function: each batch owns the folder of its number and overwrites it when replayed."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run


def stream_summary_requests(requests: DataFrame, cache: DataFrame, repeat_within: str = "30 days") -> DataFrame:
    """One outstanding request per hunk, for append mode, leaving out keys already summarised.

    A hunk is asked for again only once ``repeat_within`` of event time ``ts``
    has passed, after which its state is gone; requests later than that are dropped.
    """
    known = cache.select("key").distinct().withColumn("_known", F.lit(True))
    fresh = requests.withWatermark("ts", repeat_within).join(known, "key", "left").filter("_known IS NULL").drop("_known")
    return fresh.dropDuplicatesWithinWatermark(["hunk_id"])


JOURNAL_OUT = ST.StructType([
    ST.StructField("log_id", ST.LongType()), ST.StructField("entry_no", ST.LongType()), ST.StructField("date", ST.StringType()),
    ST.StructField("effective_date", ST.StringType())])


class _CarryDate(StatefulProcessor):
    """Remembers the last date of a journal between batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", ST.StructType([ST.StructField("date", ST.StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Chunks of one append; they are put in entry order before dates are carried.
        batch = pd.concat(list(rows)).sort_values("entry_no")
        seen = self._last.get()[0] if self._last.exists() else ""
        carried = batch["date"].replace("", None).ffill().fillna(seen)
        self._last.update((carried.iloc[-1],))
        yield pd.DataFrame({"log_id": key[0], "entry_no": batch["entry_no"], "date": batch["date"], "effective_date": carried})

    def close(self) -> None:
        pass


def stream_journal(entries: DataFrame) -> DataFrame:
    """Entries with the last date carried across batches; ``entries`` is (log_id, entry_no, date), appended in order."""
    return entries.groupBy("log_id").transformWithStateInPandas(
        statefulProcessor=_CarryDate(), outputStructType=JOURNAL_OUT, outputMode="Append", timeMode="None")


ARCHIVE_OUT = ST.StructType([ST.StructField("board_id", ST.LongType()), ST.StructField("id", ST.StringType()),
                             ST.StructField("seq", ST.LongType())])


def _archive_after(age_ms: int):
    """Holds the last change of a group's issues; a timeout hands out those that have been done long enough."""
    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        issues = {(r[0], r[1]): (r[2], r[3]) for r in state.get[0]} if state.exists else {}
        if not state.hasTimedOut:
            for chunk in chunks:
                for row in chunk[["board_id", "id", "seq", "ts_ms", "status"]].itertuples(index=False, name=None):
                    board, name, seq, at, status = _none(row)
                    issue = (None if board is None else int(board), name)
                    if issue not in issues or seq > issues[issue][0]:
                        issues[issue] = (int(seq), int(at) + age_ms if status == "done" else -1)
        now = state.getCurrentWatermarkMs()
        over = {issue: seq for issue, (seq, due) in issues.items() if 0 < due < now}
        left = [(*issue, seq, due) for issue, (seq, due) in issues.items() if issue not in over]
        if left:
            state.update((left,))
            dues = [due for *_, due in left if due > 0]
            if dues:
                state.setTimeoutTimestamp(min(dues))
        else:
            state.remove()
        if over:
            yield pd.DataFrame([(*issue, seq) for issue, seq in over.items()], columns=ARCHIVE_OUT.names)

    return run


def stream_archive(changes: DataFrame, age_ms: int, lateness: str = "1 hour", groups: int = GROUPS) -> DataFrame:
    """Issues leaving the board once done for ``age_ms``; ``changes`` is (board_id, id, seq, ts, status)."""
    timed = changes.withWatermark("ts", lateness).withColumn("ts_ms", F.unix_millis("ts"))
    return _by_group(timed, groups).applyInPandasWithState(
        _archive_after(age_ms), ARCHIVE_OUT, "issues array<struct<board_id: long, id: string, seq: long, due: long>>", "append", GroupStateTimeout.EventTimeTimeout)

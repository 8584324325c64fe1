"""Streams of events in any order, repeated, against the folds of the whole."""

import datetime as dt
import random

from conftest import rows
from workgraph.operators import changelog as C
from workgraph.streaming import jobs as J

DAY = dt.datetime(2024, 1, 1)


def run(spark, appends, schema, build, mode, place):
    """Every append a batch of one stream; the last two are read after a restart from the checkpoint."""
    for until in (len(appends) - 2, len(appends)):
        for i in range(until):
            if not (place / f"in/{i}").exists():
                spark.createDataFrame(appends[i], schema).coalesce(1).write.parquet(f"{place}/in/{i}")
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in/*")
        build(source).writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True) \
            .foreachBatch(J.export_batch(f"{place}/out")).start().awaitTermination()
    return spark.read.parquet(f"{place}/out")


def appends_of(events, seed):
    """Four appends of shuffled events, a third of them given again elsewhere."""
    rng = random.Random(seed)
    mixed = events + rng.sample(events, len(events) // 3)
    rng.shuffle(mixed)
    return [mixed[i::4] for i in range(4)]


def test_issues_in_any_order(spark, tmp_path):
    rng, pick = random.Random(3), lambda *values: rng.choice(values)
    schema = "board_id long, id string, seq long, ts timestamp, op string, title string, description string, status string, priority string"
    events = []
    for seq in range(160):
        op = pick("add", "update", "update", "comment")
        field = lambda *values: None if op == "comment" else pick(None, *values)
        events.append((seq % 2, f"i{rng.randrange(8)}", seq, DAY + dt.timedelta(seconds=rng.randrange(10_000), microseconds=rng.randrange(10 ** 6)), op,
                       field("a", "b"), field("d"), field("todo", "done"), field("normal", "must", "")))
    events.append((0, "never", 200, DAY, "update", "x", None, None, None))
    J.use_rocksdb(spark)
    live = J.live_issues(run(spark, appends_of(events, 1), schema, J.stream_issues, "append", tmp_path))
    whole = C.fold_issues(spark.createDataFrame(events, schema))
    columns = ["board_id", "id", "title", "description", "status", "priority", "created_at", "updated_at", "comments"]
    assert rows(live, *columns) == rows(whole, *columns) and whole.count() > 8


def test_comments_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    schema = "session_id long, comment_id long, seq long, ts timestamp, op string, body string"
    events = [(seq % 3, rng.randrange(12), seq, DAY + dt.timedelta(seconds=rng.randrange(9999)), rng.choice(["upsert"] * 4 + ["delete", "mark"]), f"b{seq}")
              for seq in range(120)]
    live = J.live_comments(run(spark, appends_of(events, 2), schema, J.stream_comments, "update", tmp_path))
    whole = C.fold_comments(spark.createDataFrame(events, schema))
    columns = ["session_id", "comment_id", "created_at", "updated_at", "body"]
    assert rows(live, *columns) == rows(whole, *columns) and whole.count() > 5


def test_exports_go_out_once_over_a_restart(spark, tmp_path):
    schema = "k long, seq long, ts timestamp"
    appends = [[(i % 7, 10 * a + i, DAY + dt.timedelta(hours=a)) for i in range(9)] for a in range(4)] + [[(9, 99, DAY + dt.timedelta(hours=5))]]
    out = run(spark, appends, schema, lambda s: J.stream_exports(s, ["k"], "30 days"), "append", tmp_path)
    assert rows(out, "k") == [(k,) for k in [*range(7), 9]]


CHANGES = "board_id long, id string, seq long, ts timestamp, status string"
HOUR = 3_600_000


def test_issues_leave_once_they_have_been_done_long_enough(spark, tmp_path):
    """All issues share one state; the last change by number decides, whatever the order of arrival."""
    at = lambda hours: DAY + dt.timedelta(hours=hours)
    appends = [[(1, "done", 1, at(1), "todo"), (1, "done", 2, at(2), "done"), (1, "again", 3, at(2), "done"), (2, "done", 4, at(3), "todo")],
               [(1, "again", 5, at(4), "todo"), (None, "shared", 6, at(4), "done"), (1, "older", 8, at(5), "done"), (1, "older", 7, at(6), "todo")],
               [(9, "clock", 9, at(60), "todo")], [(9, "clock", 10, at(61), "todo"), (2, "done", 11, at(61), "done")]]
    out = run(spark, appends, CHANGES, lambda s: J.stream_archive(s, 24 * HOUR, groups=1), "append", tmp_path)
    assert rows(out, "board_id", "id", "seq") == rows(spark.createDataFrame([(1, "done", 2), (None, "shared", 6), (1, "older", 8)], "board_id long, id string, seq long"))


def test_issues_of_one_group_with_a_time_to_live(spark, tmp_path):
    schema = "board_id long, id string, seq long, ts timestamp, op string, title string, description string, status string, priority string"
    event = lambda board, name, seq, op, title: (board, name, seq, DAY + dt.timedelta(seconds=seq), op, title, None, None, None)
    events = [event(None, "a", 1, "update", "early"), event(None, "a", 2, "add", "first"), event(None, "a", 3, "comment", None), event(1, "a", 4, "add", "x"),
              event(1, "a", 5, "update", "y"), event(1, "never", 6, "update", "z")]
    appends = [[events[i] for i in chosen] for chosen in ([4, 0], [2, 5, 4], [3], [1, 3])]
    live = J.live_issues(run(spark, appends, schema, lambda s: J.stream_issues(s, 3_600_000, groups=1), "append", tmp_path))
    assert sorted((str(r["board_id"]), r["title"], r["comments"]) for r in live.collect()) == [("1", "y", 0), ("None", "first", 1)]

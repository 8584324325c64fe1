"""Journals, cases, run logs, sessions, host comments and source trees read as tables; outputs written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workgraph.functions import paths as P
from workgraph.operators.reviews import remote_comments

CASE = """id string, repo_path string, commit string, path string, hunk string, enclosing_function string,
 expected struct<kind:string,symbols:array<string>,added_lines:int,removed_lines:int,facts:array<string>>"""
FINDING = """struct<id:string,severity:string,title:string,explanation:string,evidence:array<struct<path:string,line:int,excerpt:string>>,
 confidence:double,suggested_comment:string,verification:string,provider:string>"""
RUN = f"type string, time timestamp, provider string, accepted boolean, reason string, finding {FINDING}, emitted int, rejected int, duration_ms long, error string"
COMMENT = """id long, body string, path string, line long, original_line long, side string, commit_id string, in_reply_to_id long,
 created_at timestamp, html_url string, user struct<login:string>"""
REVIEW = "id long, body string, state string, commit_id string, submitted_at timestamp, html_url string, user struct<login:string>"
_ANCHOR = "struct<path:string,side:string,line:int,hunk_id:string,head_sha:string,position:int>"
SESSION = f"""id string, repo_key string, title string, created_at timestamp, updated_at timestamp,
 source struct<kind:string,repo_path:string,ref:string,patch_path:string,base_sha:string,head_sha:string,pr:struct<host:string,owner:string,repo:string,number:int,title:string>>,
 states map<string,struct<hunk_id:string,path:string,status:string,body:string,reviewed_at:timestamp,reviewed_head:string>>,
 comments array<struct<id:string,anchor:{_ANCHOR},body:string,status:string,publishable:boolean,remote_id:string,remote_url:string,error:string,created_at:timestamp,updated_at:timestamp>>"""
# Directories a source tree is read without.
SKIPPED = ["vendor", "node_modules", ".git"]


def log_lines(texts: DataFrame) -> DataFrame:
    """Numbered lines of ``texts(log_id, text)``: CRLF made LF, trailing newlines dropped, empty texts without lines."""
    clean = F.regexp_replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), r"\n+$", "")
    return texts.select("log_id", clean.alias("_t")).filter("_t != ''") \
        .select("log_id", F.posexplode(F.split("_t", "\n")).alias("_i", "text")) \
        .select("log_id", (F.col("_i") + 1).alias("line"), "text")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Lines of every journal under ``path``, named by its file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("log_id"), F.col("value").alias("text"))
    return log_lines(files)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases, one JSON file each; the id defaults to the file's stem. Order by file_name for a repeatable run."""
    rows = spark.read.schema(CASE).json(path, multiLine=True, pathGlobFilter="*.json") \
        .withColumn("file_name", F.col("_metadata.file_name"))
    ident = F.when(F.coalesce("id", F.lit("")) != "", F.col("id")).otherwise(F.regexp_replace("file_name", r"\.json$", ""))
    return rows.select(ident.alias("case_id"), "repo_path", "commit", "path", "hunk", F.coalesce("enclosing_function", F.lit("")).alias("enclosing_function"),
                       F.col("expected.kind").alias("expected_kind"), F.coalesce("expected.symbols", F.array().cast("array<string>")).alias("expected_symbols"),
                       "expected.added_lines", "expected.removed_lines", "expected.facts", "file_name")


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """Start, finding and end lines of review runs; ``run_id`` is the file's stem."""
    return spark.read.schema(RUN).json(path).withColumn("run_id", F.regexp_replace(F.col("_metadata.file_name"), r"\.jsonl?$", ""))


def write_run_log(events: DataFrame, path: str) -> None:
    """Append run events as JSON lines, a folder per run.

    Rows of a run are brought together first, so a write makes about one file a run and not one a run and task;
    a run with very many rows is split over several tasks.
    """
    events.hint("rebalance", "run_id").write.mode("append").partitionBy("run_id").json(path)


def read_remote_comments(spark: SparkSession, review_path: str, general_path: str) -> DataFrame:
    """Review and conversation comments of recorded pages in one relation."""
    read = lambda path: spark.read.schema(COMMENT).json(path, multiLine=True)
    return remote_comments(read(review_path), read(general_path))


def read_reviews(spark: SparkSession, path: str, pages: bool = False) -> DataFrame:
    """Submitted reviews: (id, author, body, state, commit_id, submitted_at, url); ``pages`` reads files that hold one JSON array."""
    rows = spark.read.schema(REVIEW).json(path, multiLine=pages)
    return rows.select("id", F.col("user.login").alias("author"), "body", "state", "commit_id", "submitted_at", F.col("html_url").alias("url"))


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Every session under ``path/<repo>/<id>.json``; sort by updated_at descending to list them."""
    rows = spark.read.schema(SESSION).option("recursiveFileLookup", "true").json(path, multiLine=True, pathGlobFilter="*.json")
    return rows.withColumn("repo_key", F.coalesce("repo_key", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)))


def session_states(sessions: DataFrame) -> DataFrame:
    """Marks as rows."""
    return sessions.select("repo_key", F.col("id").alias("session_id"), F.explode("states").alias("hunk_id", "s")) \
        .select("repo_key", "session_id", "hunk_id", "s.path", "s.status", "s.reviewed_at", "s.reviewed_head")


def session_comments(sessions: DataFrame) -> DataFrame:
    """Drafts as rows."""
    return sessions.select("repo_key", F.col("id").alias("session_id"), F.explode("comments").alias("c")).select(
        "repo_key", "session_id", F.col("c.id").alias("comment_id"), F.col("c.anchor.hunk_id").alias("anchor_hunk"),
        F.col("c.anchor.path").alias("anchor_path"), F.col("c.anchor.position").alias("position"), "c.body", "c.status",
        "c.publishable", "c.created_at", "c.updated_at")


def read_source_tree(spark: SparkSession, path: str, languages: Sequence[str] | None = None) -> DataFrame:
    """Source files by language: (path, language, size, modified, text); vendored and repository folders are skipped.

    File names are filtered by the listing and folders before the content is
    decoded; unreadable files are left out.
    """
    wanted = list(languages) if languages else list(P.EXTENSIONS) + list(P.WHOLE_NAMES)
    names = [f"*.{e}" for lang in wanted for e in P.EXTENSIONS.get(lang, [])] + [n for lang in wanted for n in P.WHOLE_NAMES.get(lang, [])]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true") \
        .option("ignoreCorruptFiles", "true").option("pathGlobFilter", "{" + ",".join(names) + "}").load(path)
    inside = F.col("path").rlike("/(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/")
    return files.filter(~inside).select("path", P.detect_language("path").alias("language"), F.col("length").alias("size"),
                                        F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text"))


def manifest_hash(files: DataFrame) -> DataFrame:
    """One key per module (module, path, size, modified) that changes when any source file does.

    Per-file digests are summed in independent lanes, so files combine map-side in
    any order and no content is read.
    """
    stamp = F.concat_ws(":", "path", F.col("size").cast("string"), F.unix_micros(F.col("modified").cast("timestamp")).cast("string"))
    return files.groupBy("module").agg(P.set_digest(stamp).alias("key"), F.count(F.lit(1)).alias("files"))


def dump_outputs(outputs: DataFrame, path: str) -> None:
    """One JSON line per (model, variant, case), a folder per model."""
    outputs.write.mode("overwrite").partitionBy("model").json(path)


def write_text(lines: DataFrame, path: str, order: Sequence[str]) -> None:
    """Write report lines as text parts that read in order."""
    columns = [F.col(c) for c in order]
    lines.repartitionByRange(*columns).sortWithinPartitions(*columns).select("text").write.mode("overwrite").text(path)

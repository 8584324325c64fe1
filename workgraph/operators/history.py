"""Change-history mining: windows of commits, co-change pairs, hotspots, companions.

``commit_files`` is (repo_id, sha, ts, path, added, deleted), one row per file
of a commit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workgraph.operators.scan import first_per_key, top_per_key
from workgraph.session import cut

# Defaults of the mining window and of companion search.
SINCE_DAYS = 365
MIN_SUPPORT, MIN_CONFIDENCE = 5, 0.5

R = "repo_id"


def commit_window(commit_files: DataFrame, since: Column | None = None, max_commits: int | None = None,
                  max_files: int | None = None) -> DataFrame:
    """Commits in the window: (repo_id, sha, ts, files, mechanical, degraded).

    All commits stay unless the caller bounds the window: ``max_commits`` keeps
    the newest of each repository, and ``degraded`` says on every row of a
    repository that older ones were cut. A commit touching more than ``max_files``
    files is mechanical: counted, but left out of file and pair statistics.
    """
    rows = commit_files if since is None else commit_files.filter(F.col("ts") >= since)
    commits = rows.groupBy(R, "sha").agg(F.max("ts").alias("ts"), F.count(F.lit(1)).alias("files"))
    mechanical = F.lit(False) if max_files is None else F.col("files") > max_files
    if max_commits is None:
        return commits.withColumn("degraded", F.lit(False)).withColumn("mechanical", mechanical)
    commits = cut(commits)
    sizes = commits.groupBy(R).agg((F.count(F.lit(1)) > max_commits).alias("degraded"))
    age = -F.unix_micros(F.col("ts").cast("timestamp"))
    newest = top_per_key(commits, [R], [age, F.col("sha")], max_commits, "_place").drop("_place")
    return newest.join(sizes, R).withColumn("mechanical", mechanical)


def window_files(commit_files: DataFrame, window: DataFrame) -> DataFrame:
    """File rows of the non-mechanical commits in a window."""
    return commit_files.join(window.filter("NOT mechanical").select(R, "sha"), [R, "sha"], "left_semi")


def file_stats(files: DataFrame) -> DataFrame:
    return files.groupBy(R, "path").agg(F.count(F.lit(1)).alias("commits"), F.sum("added").alias("added"),
                                        F.sum("deleted").alias("deleted"))


def mine(commit_files: DataFrame, since: Column | None = None, max_commits: int | None = None,
         max_files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(file_stats, co_change_pairs) of a window, written once: companions and hotspots read only these."""
    files = commit_files if since is None else commit_files.filter(F.col("ts") >= since)
    files = cut(files)
    if max_commits is not None or max_files is not None:
        files = cut(window_files(files, commit_window(files, None, max_commits, max_files)))
    return cut(file_stats(files)), cut(co_change_pairs(files, max_files))


def write_mined(stats: DataFrame, pairs: DataFrame, path: str, head: str, parameters: str) -> None:
    """Keep mined statistics under (head, parameters), so that a later run with the same ones reads them."""
    for name, rows in (("stats", stats), ("pairs", pairs)):
        rows.write.mode("overwrite").parquet(f"{path}/head={head}/parameters={parameters}/{name}")


def read_mined(spark: SparkSession, path: str, head: str, parameters: str) -> tuple[DataFrame, DataFrame]:
    """What :func:`write_mined` kept for (head, parameters)."""
    stats, pairs = (spark.read.parquet(f"{path}/head={head}/parameters={parameters}/{name}") for name in ("stats", "pairs"))
    return stats, pairs


def co_change_pairs(files: DataFrame, max_files: int | None = None) -> DataFrame:
    """Support of unordered path pairs.

    Where ``max_files`` has bounded the commits, the paths of a commit are
    gathered once and paired inside the row: one shuffle on the commit, counted
    map-side. Without a bound the files of a commit meet in a join, which spills
    and splits where a commit is very large; a commit of n files has n * (n - 1) / 2 pairs.
    """
    if max_files is None:
        one = files.select(R, "sha", "path").distinct()
        left, right = one.withColumnRenamed("path", "a"), one.withColumnRenamed("path", "b")
        pairs = left.join(right, [R, "sha"]).filter("a < b")
        return pairs.groupBy(R, "a", "b").agg(F.count(F.lit(1)).alias("support"))
    paths = files.groupBy(R, "sha").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    left = paths.select(R, "paths", F.posexplode("paths").alias("i", "a"))
    pairs = left.select(R, "a", F.explode(F.expr("slice(paths, i + 2, size(paths))")).alias("b"))
    return pairs.groupBy(R, "a", "b").agg(F.count(F.lit(1)).alias("support"))


def _raw(stats: DataFrame) -> DataFrame:
    return stats.withColumn("churn", F.col("added") + F.col("deleted")) \
        .withColumn("raw", F.log1p("commits") * F.log1p("churn"))


def hotspots(stats: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Score 0..1 per path from how often and how much it changes, scaled per repository.

    ``paths`` asks about given (repo_id, path) rows; one never seen scores 0.
    """
    scored = _raw(stats)
    span = scored.groupBy(R).agg(F.min("raw").alias("_lo"), F.max("raw").alias("_hi"))
    if paths is not None:
        scored = paths.join(scored, [R, "path"], "left").fillna(0, ["commits", "churn", "raw"])
    scaled = (F.col("raw") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    score = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled))).otherwise(F.lit(0.0))
    return scored.join(span, R, "left").select(R, "path", "commits", "churn", score.alias("score"))


def companions(stats: DataFrame, pairs: DataFrame, diff_paths: DataFrame, min_support: int = MIN_SUPPORT,
               min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Files that usually change with the diff's files but are not in it: (repo_id, path, of, support, confidence).

    ``diff_paths`` is (repo_id, path, diff_pos). Each file keeps its most
    confident pairing, the earlier diff file on ties, then the smaller name.
    """
    strong = pairs.filter(F.col("support") >= min_support)
    both = strong.select(R, F.col("a").alias("of"), F.col("b").alias("path"), "support") \
        .unionByName(strong.select(R, F.col("b").alias("of"), F.col("a").alias("path"), "support"))
    named = diff_paths.select(R, F.col("path").alias("of"), "diff_pos") \
        .join(stats.select(R, F.col("path").alias("of"), "commits"), [R, "of"])
    rows = both.join(named, [R, "of"]).join(diff_paths.select(R, "path"), [R, "path"], "left_anti") \
        .withColumn("confidence", F.col("support") / F.col("commits")) \
        .filter(F.col("confidence") >= min_confidence)
    best = first_per_key(rows.select(R, "path", "of", "support", "confidence", "diff_pos"), [R, "path"],
                         F.struct(-F.col("confidence"), "diff_pos", "of"))
    return best.drop("diff_pos")

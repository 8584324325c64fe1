"""Session settings and lineage cuts shared by every iterative operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_FORGOTTEN: set[str] = set()
_SCOPES: list["Scratch"] = []
#: Shuffle files of a finished action go at once: what a loop needs later it has written down with :func:`cut`.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What a task scans, and what adaptive execution joins shuffle partitions up to, compressed: so what a task sorts or groups does
#: not grow with its table. Rows of numbers take ten to twenty times that in memory.
SCAN, PIECE = "16MB", "8MB"
#: What opening a file counts as, so that a task reads up to 256 small files and not four.
OPEN = "64KB"


def build_session(app: str = "workgraph", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume.

    On a cluster leave ``shuffle_partitions`` unset: adaptive execution starts
    from a high count and coalesces to the advisory partition size.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        CLEAN_SHUFFLES: "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on, for a session built elsewhere.

    A hot key is split even where the split costs a further shuffle.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", PIECE)
    spark.conf.set("spark.sql.files.maxPartitionBytes", SCAN)
    spark.conf.set("spark.sql.files.openCostInBytes", OPEN)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder on this machine; on a cluster
    such a folder would vanish with its executor, so its absence is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="workgraph-")
    return _LOCAL_DIRS[app]


def _forget_at_end(spark: SparkSession, folder: str) -> None:
    """Have the file system delete what an application cut when its session ends."""
    if folder not in _FORGOTTEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
        _FORGOTTEN.add(folder)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back; the folder goes with its :func:`scratch`, or when the session ends.

    The result has no lineage, survives the loss of any executor and carries
    real file sizes, so joins on it are planned from what was written rather
    than from estimates that grow with every round of a loop.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}"
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _forget_at_end(spark, folder)
    result = spark.read.schema(df.schema).parquet(path)
    result._cut_path = path
    if _SCOPES:
        _SCOPES[-1].made.append(result)
    return result


def release(*frames: DataFrame) -> None:
    """Delete what :func:`cut` wrote for these results; nothing may read them any more."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """What :func:`cut` wrote inside a :func:`scratch` block."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, a result of :func:`cut`, outlives the block."""
        self.made = [x for x in self.made if x._cut_path != df._cut_path]
        outer = _SCOPES[:_SCOPES.index(self)]
        if outer:
            outer[-1].made.append(df)
        return df


@contextmanager
def scratch() -> Iterator[Scratch]:
    """A block whose cuts are deleted at its end, but for those it keeps: the disk of finished steps is free for the next.

    Whatever leaves the block must be written down in it: ``return held.keep(cut(result))``.
    """
    scope = Scratch()
    _SCOPES.append(scope)
    try:
        yield scope
    finally:
        _SCOPES.remove(scope)
        release(*scope.made)

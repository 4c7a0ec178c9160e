"""Session builder and the two session-wide conventions: UTC and reliable checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidewatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow.

    On a cluster, leave ``master`` unset and let spark-submit name it; nothing here fixes
    memory, cores or the number of shuffle partitions for a cluster.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local[") or context.master == "local":
        folder = tempfile.mkdtemp(prefix="tidewatch-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder and drop its lineage.

    The files are on shared storage, so a lost executor costs nothing but a re-read. A
    machine-local folder is only ever chosen for a single-machine master.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """Folder of this application's checkpoints, which all executors share."""
    _ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def written_table(df: DataFrame) -> DataFrame:
    """Like ``cut_lineage``, as a compressed table in the shared checkpoint folder: smaller for wide rows, and columns can be left out on reading."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session is set to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

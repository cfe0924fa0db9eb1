"""Session settings and the one place that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

ROWS_PER_SPLIT = "spark.chronoweave.split.rows"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("chronoweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def rows_per_split(spark: SparkSession) -> int:
    """Rows one task may hold for one entity before that entity is cut into parts."""
    return int(spark.conf.get(ROWS_PER_SPLIT, "5000000"))


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read: the session's checkpoint folder."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="chronoweave-"))
        shared = spark.sparkContext.getCheckpointDir()
    return shared


_pinned: list[str] = []


def release(spark: SparkSession) -> int:
    """Delete the tables that `pin` has stored from this process so far; frames that read them are of no use afterwards."""
    conf, path_of = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    gone = 0
    while _pinned:
        path = path_of(_pinned.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def pin(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write `df` as a table in the shared folder and go on from the stored copy; `codec` is for a table smaller than by the session's.

    Used where a later step reads the same rows more than once, or depends on how they were laid out
    (partition number, position): a recomputed task could lay them out differently, a stored file cannot.
    """
    path = f"{shared_folder(df.sparkSession)}/pinned-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    _pinned.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pin_measured(df: DataFrame, codec: str | None = None, **measures: Column) -> tuple[DataFrame, dict]:
    """`pin`, and aggregates of the stored rows that come with the write instead of a job of their own."""
    seen = Observation()
    stored = pin(df.observe(seen, *[c.alias(n) for n, c in measures.items()]), codec)
    return stored, seen.get

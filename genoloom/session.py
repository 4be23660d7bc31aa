"""Session helpers: where shared intermediate tables live, and how they are written and dropped."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_SCRATCH: list[str] | None = None  # paths of the tables that the running step writes, while one is running
_FINISHED: list[str] = []  # those of earlier steps


def get_session(app: str = "genoloom", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that the operators expect (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: a table of a few small files is dealt again, a large one is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Only a local[...] session may go without one and gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _LOCAL_DIRS[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/genoloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCRATCH is not None:
        _SCRATCH.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._genoloom_path = path
    return out


def drop_materialized(df: DataFrame) -> None:
    """Deletes the files behind a table that ``materialize`` returned, once nothing reads it any more."""
    path = getattr(df, "_genoloom_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def step(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Wraps a step (spark, docs, sf_dir) of a pipeline whose steps write their results before the next one begins.

    When a step begins, the scratch tables of earlier steps are deleted, unless its docs still read from one of them.
    """

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _SCRATCH
        if _FINISHED:
            read = " ".join(docs.inputFiles())
            if not any(p.rpartition("/")[2] in read for p in _FINISHED):
                for p in _FINISHED:
                    _delete(spark, p)
                _FINISHED.clear()
        _SCRATCH = []
        try:
            return function(spark, docs, sf_dir)
        finally:
            _FINISHED.extend(_SCRATCH)
            _SCRATCH = None

    return run

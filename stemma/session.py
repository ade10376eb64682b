"""Session helpers: a local session, lineage cuts, literal dimension tables."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for one machine. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


#: Most bytes of an Arrow batch, where the session has Spark's own default: texts are long rows, and a batch is held several times over.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m")


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where it lies beside the driver's program and is not installed; keep Arrow batches small."""
    key, default, small = BATCH
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, small)
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows of a table in as many partitions as there are cores, where a scan gives less than half as many.

    For maps that cost far more than moving their input once: a file of one row group is one task otherwise. Only
    for scans, whose partitions are known without running anything.
    """
    cores = importable(rows.sparkSession).sparkContext.defaultParallelism
    return rows.repartition(cores) if 2 * rows.rdd.getNumPartitions() <= cores else rows


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; where it is unset and everything runs in one process (tests), a temporary one."""
    sc = importable(spark).sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write as Parquet in the shared folder and read again: as ``cut``, but compressed, and readers take the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table given in code; its size is that of the literal."""
    return spark.createDataFrame(rows, schema)

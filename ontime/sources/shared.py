"""Where intermediate tables go: the folder that all executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints.

    A session in local mode may name none; it then gets a temporary folder,
    which it keeps. On a cluster the setting is required.
    """
    context = spark.sparkContext
    folder = spark.conf.get(_SETTING, None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder that all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="ontime-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is not in use."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(table: DataFrame, name: str = "table") -> DataFrame:
    """The table written to the shared folder and read back.

    What follows neither recomputes it nor depends on the executors that made
    it, and still reads only the columns it needs.
    """
    path = new_folder(table.sparkSession, name)
    table.write.parquet(path)
    return table.sparkSession.read.parquet(path)

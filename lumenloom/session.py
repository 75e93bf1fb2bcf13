"""Session set-up and lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "lumenloom", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that the engine expects of a cluster as well."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LUMENLOOM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


_OWN: list[str] = []
_DELETED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. A local session without the setting gets a temporary folder, removed at the end; a cluster without it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="lumenloom-checkpoint-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there; partitions and their order stay."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    own = context._jsc.sc().getCheckpointDir().get()  # a folder of this context's own
    if own not in _DELETED:
        _DELETED.add(own)
        _delete_at_end(df.sparkSession, own)
    return df.checkpoint(eager=True)


def _delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete a folder of this application's own when it ends."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    url = urlparse(path)
    if url.scheme in ("", "file"):  # the JVM of a session that is not stopped ends without its hooks
        atexit.register(shutil.rmtree, url.path, ignore_errors=True)


def written(df: DataFrame) -> DataFrame:
    """Write df as a compressed table to the shared folder and read it from there, so that each later use reads only its columns; the table is deleted when the JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)

"""Session construction and the shared work folder.

Everything that must survive an executor loss (upsert targets, staged copies,
landing files of the streaming jobs) is written under the folder the cluster
names in ``spark.checkpoint.dir``.  Only when that setting is absent *and* the
master is local (tests, the bench) do we create one ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on.  Shuffle partitions are sized by the caller:
# at cluster scale start high and let AQE coalesce, locally use the cores.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Parquet row-group skipping and vectorised reads are on by default; keep
    # partition overwrites scoped to the partitions a job actually writes.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


# Settings for a large cluster (100 TB inputs, ~1000 executors).  Shuffle
# partitions start high and AQE coalesces them to ~256 MB; scans split files
# into 256 MB pieces; the static broadcast threshold stays modest because
# AQE re-plans joins from runtime sizes; skewed partitions (5x median and
# above 512 MB) are split; output files are capped in rows.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.files.maxRecordsPerFile": "20000000",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def build_session(master: str | None = None, app: str = "civitas",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None,
                  profile: str = "local") -> SparkSession:
    """``profile="cluster"`` adds CLUSTER_CONF; ``extra`` overrides both."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if profile == "cluster":
        conf.update(CLUSTER_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for durable intermediate data.

    Read from the session; set a private one only for local masters (tests),
    never on a cluster where a machine-local folder would be lost with the
    executor that wrote it.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/ABFS) so staged tables survive executor loss")
    root = tempfile.mkdtemp(prefix="civitas-ckpt-")
    sc.setCheckpointDir(root)
    return sc.getCheckpointDir().rstrip("/")


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh, unique sub-folder of the shared checkpoint root."""
    path = f"{checkpoint_root(spark)}/{purpose}-{uuid.uuid4().hex[:12]}"
    if path.startswith("/") or path.startswith("file:"):
        os.makedirs(path.removeprefix("file:"), exist_ok=True)
    return path


def materialize_table(df, purpose: str):
    """Write ``df`` once as Parquet under the shared checkpoint folder and
    return a DataFrame reading it: for intermediates read by several
    branches of a plan (each would otherwise recompute the input).  Lineage
    is cut and the data survives the loss of the executors that computed it."""
    return materialize_table_at(df, work_dir(df.sparkSession, purpose))


def materialize_table_at(df, path: str):
    """``materialize_table`` in a folder the caller names, and may remove."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a dataset folder exists, asked of the cluster's file system
    (works for HDFS/S3/ABFS/local alike) instead of provoking a failed read."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p))


def remove_path(spark: SparkSession, path: str) -> None:
    """Removes a folder of this module's own (a staged copy) from its store."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def plain_names(spark: SparkSession, uris) -> list[str]:
    """File names of ``_metadata.file_path`` or ``inputFiles()`` as readers take
    them (white space and the like not escaped)."""
    jvm = spark.sparkContext._jvm
    return [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(u)).toString() for u in uris]

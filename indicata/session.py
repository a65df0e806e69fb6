"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "indicata",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """A session tuned for these jobs.

    On a cluster, ``master`` and the checkpoint folder come from the
    submitter; locally (tests, bench) they default to ``local[*]`` and a
    scratch folder.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.showConsoleProgress": "false",
        # Broadcast only from a measured size (AQE, at run time) or where a
        # bound is proven (explicit hints); file-size estimates of joins can
        # make a fact table look small.
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and derived tables.

    Uses ``spark.checkpoint.dir`` when the cluster names one.  Only a local
    session gets a scratch folder instead; on a cluster executors and driver
    would each see a folder of their own, so an unset setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get(_CKPT_KEY, None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="indicata-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def derived_table_dir(spark: SparkSession, name: str) -> str:
    """Folder for a derived table inside the shared checkpoint folder.

    Keyed at the configured root (not the per-application subfolder Spark
    adds for RDD checkpoints) so later applications find a table that was
    already written; callers put an input signature into ``name``.
    """
    root = spark.sparkContext.getConf().get(_CKPT_KEY, None) or checkpoint_dir(spark)
    root = root.rstrip("/")
    return f"{root}/indicata/tables/{name}"


@contextmanager
def session_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """SQL settings for what runs inside; afterwards those of before."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Delete the folder ``path``, which holds an intermediate result, when the driver's JVM ends."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(target)

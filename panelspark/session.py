"""Session defaults. On a cluster the submitter's settings win; only unset ones are filled in."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that the operators rely on (UTC) or profit from (AQE).
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(name: str = "panelspark", cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.driver.memory", memory)
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where the master is local.

    On a cluster without the setting this raises rather than fall back to a machine-local folder.
    """
    sc = spark.sparkContext
    d = sc._jsc.sc().getCheckpointDir()
    if d.isDefined():
        return d.get()
    d = sc.getConf().get("spark.checkpoint.dir")
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = os.path.join(os.environ.get("TMPDIR", "/tmp"), "panelspark-checkpoints")
    sc.setCheckpointDir(d)
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df):
    """df as a checkpoint in the shared folder: computed once, survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)

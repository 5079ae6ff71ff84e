"""Session helpers: building a local session for tests/bench and materialising
intermediate results into the cluster's shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "custlytics", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app_name)
    conf = dict(_DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("CUSTLYTICS_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by the session.

    On a cluster ``spark.checkpoint.dir`` must point at shared storage and is
    used as is.  Only when nothing is configured *and* the master is local
    (tests, the bench) do we create a private folder."""
    try:
        sc = spark.sparkContext
    except Exception:  # a Spark Connect session: only the configuration
        conf_dir = spark.conf.get("spark.checkpoint.dir", None)
        if conf_dir:
            return conf_dir
        raise RuntimeError("spark.checkpoint.dir is not set; point it at shared storage")
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a folder on shared "
            "storage (HDFS/S3/ABFS) so intermediate results survive executor loss")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="custlytics-ckpt-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and cut its lineage.

    Used before a result is scanned several times (counts, quantiles, sorts)
    so the upstream shuffle/aggregation runs once and a lost executor only
    costs a re-read.  Stored as Parquet, so later scans prune columns."""
    return materialize_table(df, "stage")


#: Scratch folders by application id (a session object's id may be reused).
_WRITTEN: dict[str, list[str]] = {}


def track(spark: SparkSession, path: str) -> None:
    """Remember a scratch folder for :func:`release_scratch`."""
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)


def scratch_mark(spark: SparkSession) -> int:
    """How many scratch folders there are now: what ``release_scratch`` may
    be told to leave."""
    return len(_WRITTEN.get(spark.sparkContext.applicationId, []))


#: Called before scratch folders go: holders of frames read from them let go.
ON_RELEASE: list[Callable[[], None]] = []


def release_scratch(spark: SparkSession, since: int = 0) -> int:
    """Delete the scratch folders this application wrote (and only those; from
    a ``scratch_mark`` on if given), e.g. at the end of a long-running job.
    DataFrames read from them must not be used afterwards.  Returns the number
    of folders removed."""
    for forget in ON_RELEASE:
        forget()
    paths = _WRITTEN.get(spark.sparkContext.applicationId, [])
    _WRITTEN[spark.sparkContext.applicationId], paths = paths[:since], paths[since:]
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        if hp.getFileSystem(conf).delete(hp, True):
            removed += 1
    return removed


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete one scratch folder that nothing reads any more."""
    paths = _WRITTEN.get(spark.sparkContext.applicationId, [])
    if path in paths:
        paths.remove(path)
        hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hp, True)


def materialize_table(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: lineage is cut, later scans prune columns, and rows computed with a
    position id keep it (it is data now)."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    track(df.sparkSession, path)
    # the schema is known: no footer/schema-inference pass on read-back
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for artefacts (models)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    import uuid
    return f"{base}/custlytics-{name}-{uuid.uuid4().hex[:12]}"

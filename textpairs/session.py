"""Session construction, shared folders and size-checked broadcasts."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job here relies on. AQE re-plans joins and coalesces small
# shuffle partitions at run time; the window-group-limit threshold lets a
# head-n cap (L1) pre-limit on the map side for caps up to this size.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # long texts: keep Arrow batches handed to Python workers small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
}

# Largest number of rows we broadcast when the caller can prove a bound
# (vocabulary size, split mapping, shard-count tables).
MAX_BROADCAST_ROWS = 2_000_000


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "textpairs", extra: dict | None = None) -> SparkSession:
    master = master or os.environ.get("TEXTPAIRS_MASTER", "local[*]")
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf.setdefault("spark.ui.enabled", "false")
    conf.setdefault("spark.driver.memory", os.environ.get("TEXTPAIRS_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    apply_job_conf(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``textpairs`` importable in the Python workers of this application.

    UDFs defined in the package are pickled by reference, so executors need the
    package itself; ``addPyFile`` hands a zip of it to every executor through
    Spark's own file server (once per application)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="textpairs-pkg-"), "textpairs.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _subdirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def apply_job_conf(spark: SparkSession) -> None:
    """Set the SQL settings the operators rely on, on an existing session."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "0")) <= int(DEFAULT_CONF[key]):
        spark.conf.set(key, DEFAULT_CONF[key])
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    if int(spark.conf.get(key, "0")) < int(DEFAULT_CONF[key]):
        spark.conf.set(key, DEFAULT_CONF[key])
    # Oracle comparisons and time columns assume UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_base(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session. Only a local-mode session (tests, bench) without the
    setting gets a fresh folder of its own; on a cluster the setting is
    required, since a machine-local folder is not visible to other executors.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder on the cluster")
        base = tempfile.mkdtemp(prefix="textpairs-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written tables."""
    return f"{checkpoint_base(spark)}/textpairs-scratch/{uuid.uuid4().hex}/{name}"


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Remove a table written at ``path`` (a ``scratch_path``) that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of tables that are out of use now, not when the driver's memory fills."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (survives executor loss)."""
    checkpoint_base(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_bounded(df: DataFrame, bound_rows: int | None) -> DataFrame:
    """Broadcast ``df`` only when its row count has a proven bound.

    ``bound_rows`` comes from a parameter that limits the table (vocabulary
    size, number of splits, number of shards), never from a guess. Beyond the
    bound the plain DataFrame is returned and AQE picks the join at run time.
    """
    if bound_rows is not None and bound_rows <= MAX_BROADCAST_ROWS:
        return F.broadcast(df)
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder. The number of scan tasks follows the files'
    row groups and ``spark.sql.files.maxPartitionBytes``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

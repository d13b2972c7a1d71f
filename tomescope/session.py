"""Session helpers: a local session for tests and benches, and the shared scratch folder.

Index tables and lineage cuts are written under the folder the cluster names in
``spark.checkpoint.dir``. We only invent one when it is unset *and* the master is local
(tests, benches); on a cluster an unset checkpoint dir is an error, because a
machine-local folder would not survive the loss of an executor.
"""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # top-k per query up to the first cut (5,000) plans as partial + final WindowGroupLimit
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "tomescope") -> SparkSession:
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    b = SparkSession.builder.master(master).appName(app)
    for k, v in SESSION_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("TOMESCOPE_DRIVER_MEMORY", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_session_conf(spark: SparkSession) -> None:
    """Runtime-settable SQL confs the operators rely on (safe on a shared session)."""
    for k in (
        "spark.sql.optimizer.windowGroupLimitThreshold",
        "spark.sql.execution.arrow.pyspark.enabled",
        "spark.sql.adaptive.enabled",
        "spark.sql.adaptive.skewJoin.enabled",
    ):
        try:
            spark.conf.set(k, SESSION_CONF[k])
        except Exception:  # pragma: no cover - conf may be locked on managed clusters
            pass


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written tables and checkpoints (``spark.checkpoint.dir``)."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if d:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(d)
        return str(sc.getCheckpointDir() or d)
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) before running")
    d = tempfile.mkdtemp(prefix="tomescope-ckpt-", dir="/tmp")
    sc.setCheckpointDir(d)
    return str(sc.getCheckpointDir() or d)


_WRITTEN: list[str] = []  # paths handed out by this driver, newest last


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the scratch folder for one written table."""
    path = f"{scratch_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.append(path)
    return path


@contextlib.contextmanager
def written_tables(spark: SparkSession) -> Iterator[None]:
    """Removes, on leaving, the tables written inside (through Spark's own file system, wherever the
    scratch folder is). Use the results before leaving: they read these tables."""
    mark = len(_WRITTEN)
    try:
        yield
    finally:
        conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
        for path in _WRITTEN[mark:]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        del _WRITTEN[mark:]


def freed(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more, and has the driver let go of the shuffle files of finished jobs, which stay on the
    executors' disks until its garbage is collected."""
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    for path in {os.path.dirname(f) for t in tables for f in t.inputFiles()}:
        if any(w.rstrip("/").endswith(path.rsplit("/tables/", 1)[-1]) for w in _WRITTEN):
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
    gc.collect()
    jvm.System.gc()


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tomescope`` importable in the Python workers (``addPyFile`` of a zip built
    once per driver). Arrow UDFs defined in the package are pickled by reference."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="tomescope-pkg-"), "tomescope.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a Parquet table under the shared folder and read it back.

    Computes the input once (``checkpoint()`` on an unpersisted frame computes it twice),
    survives the loss of any executor, and the re-read gets file splits, column pruning
    and filter pushdown. Never ``localCheckpoint``."""
    spark = df.sparkSession
    path = new_table_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)

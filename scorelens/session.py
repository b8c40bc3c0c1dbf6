"""Session helpers: build a session for tests / benches, resolve the shared
checkpoint folder from the session (never a machine-local default on a cluster)."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "scorelens", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``scorelens`` importable on the executors' Python workers (pandas
    UDFs and ``mapInPandas`` functions are pickled by module reference): the
    package is zipped on the driver and added with ``addPyFile`` once per
    SparkContext, the same as ``--py-files`` on a cluster."""
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import scorelens
    root = os.path.dirname(os.path.abspath(scorelens.__file__))
    fd, path = tempfile.mkstemp(suffix=".zip", prefix="scorelens-pkg-")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only on a local master (one machine, as in tests) an unset folder is replaced by
    a scratch folder of this process; on a cluster an unset folder is an error, since
    executors could not read each other's files.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            configured = None
    if not configured:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="scorelens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def tables_root(spark: SparkSession) -> str:
    """Where this application writes its intermediate tables."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/scorelens-tables/{spark.sparkContext.applicationId}"


ON_RELEASE: list = []  # what forgets the paths of released tables


def release_tables(spark: SparkSession) -> None:
    """Delete all that this application has written for itself: intermediate tables,
    views, outputs without a path of their own, the tables of ``llm``. To be called
    when no result that reads them is needed any more (end of a job, bench or test)."""
    for forget in ON_RELEASE:
        forget()
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(tables_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

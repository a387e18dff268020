"""Session construction and the few session-level settings the operators rely on."""

from __future__ import annotations

import atexit
import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "revforge", shuffle_partitions: int | None = None) -> SparkSession:
    """A session tuned for the operators in this package.

    On a cluster the master, memory and ``spark.checkpoint.dir`` come from the launcher; locally
    (tests, bench) we pick ``local[*]`` and a shuffle width that matches the cores.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    parts = shuffle_partitions or os.environ.get("REVFORGE_SHUFFLE_PARTITIONS")
    if not parts and master and master.startswith("local"):
        parts = 8
    if parts:  # on a cluster the launcher's width holds
        builder = builder.config("spark.sql.shuffle.partitions", str(parts))
    builder = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    event_dir = os.environ.get("REVFORGE_EVENT_LOG_DIR")
    if event_dir:  # stage and task times for later reading, without the web UI
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_dir)
    if master and master.startswith("local"):
        builder = builder.config("spark.driver.memory", os.environ.get("REVFORGE_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory, honouring ``spark.checkpoint.dir`` when the cluster sets it.

    Only when nothing is configured (local tests) do we create a private scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key raises on some versions
            configured = None
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="revforge-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_WRITTEN: dict[str, list[str]] = {}


def materialize(df):
    """Write ``df`` once as Parquet under the checkpoint folder and return the scan of it.

    This cuts the lineage (a lost executor re-reads the files instead of recomputing the plan) and,
    unlike an eager RDD checkpoint, computes the plan exactly once. The tables last as long as the
    application, since results are lazy; ``drop_written`` removes them, at the latest when Python exits.
    """
    import uuid

    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/revforge-table-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_drop_at_exit)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def drop_written(spark: SparkSession) -> int:
    """Remove the tables that ``materialize`` wrote for this application; results that read them must be done."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


def _drop_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        drop_written(spark)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``revforge`` importable in Python workers (pandas UDFs, stateful stream functions).

    Equivalent to ``--py-files``: the package is zipped once per application and added with
    ``addPyFile``, which Spark copies to every executor. A no-op when already shipped.
    """
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="revforge-pyfiles-"), "revforge.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)

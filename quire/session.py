"""Session helpers.

Library code never creates a session on its own; callers pass one in. The
helpers here are used by tests, the bench and the entry module.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC session zone (timestamps leave Spark as
# naive UTC values), AQE for runtime coalescing and skew-join splitting, Arrow
# for pandas functions.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Starting points for large clusters (about 1,000 executors, about 100 TB);
# see the README's "Cluster settings" for the reasoning.
SCALE_CONF = {
    **BASE_CONF,
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def cluster_session(app: str = "quire", checkpoint_dir: str | None = None) -> SparkSession:
    """A session with ``SCALE_CONF`` for a cluster (master from the launcher).
    ``checkpoint_dir`` must name a shared folder when the launcher sets none."""
    b = SparkSession.builder.appName(app)
    for k, v in SCALE_CONF.items():
        b = b.config(k, v)
    if checkpoint_dir:
        b = b.config("spark.checkpoint.dir", checkpoint_dir)
    spark = b.getOrCreate()
    if not spark.conf.get("spark.checkpoint.dir", None):
        raise ValueError("set spark.checkpoint.dir to a shared folder on a cluster")
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "quire") -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "16g"))
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the operator names a shared folder in that setting and it is
    used as is. Only when it is unset (local tests) a fresh scratch folder is
    created and registered.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not d:
        d = getattr(spark.sparkContext, "_quire_ckpt", None) or tempfile.mkdtemp(prefix="quire-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # noqa: BLE001 - core conf read-only at runtime
            pass
        spark.sparkContext._quire_ckpt = d
    spark.sparkContext.setCheckpointDir(d)
    return d


def checkpoint_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared checkpoint folder (for state and lineage cuts)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, *parts)


def ship_package(spark: SparkSession) -> None:
    """Make ``quire`` importable in Python workers (pandas functions pickle
    their helpers by module reference).

    When the checkpoint folder is a plain filesystem path the package is
    zipped there once per session and added with ``addPyFile``; on clusters
    whose shared folder is remote, deploy with ``--py-files`` instead.
    """
    import hashlib
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_quire_shipped", False):
        return
    import quire
    pkg = os.path.dirname(os.path.abspath(quire.__file__))
    base = ensure_checkpoint_dir(spark)
    if "://" in base and not base.startswith("file:"):
        sc._quire_shipped = True
        return
    base = base.replace("file://", "").replace("file:", "")
    files = []
    for dirpath, _, names in os.walk(pkg):
        for n in sorted(names):
            if n.endswith(".py"):
                files.append(os.path.join(dirpath, n))
    h = hashlib.sha1()
    for f in sorted(files):
        with open(f, "rb") as fh:
            h.update(f.encode() + fh.read())
    out_dir = os.path.join(base, "pyfiles")
    os.makedirs(out_dir, exist_ok=True)
    target = os.path.join(out_dir, f"quire-{h.hexdigest()[:12]}.zip")
    if not os.path.exists(target):
        tmp = f"{target}.{os.getpid()}.part"
        with zipfile.ZipFile(tmp, "w", zipfile.ZIP_DEFLATED) as z:
            for f in files:
                z.write(f, os.path.relpath(f, os.path.dirname(pkg)))
        os.replace(tmp, target)
    sc.addPyFile(target)
    sc._quire_shipped = True

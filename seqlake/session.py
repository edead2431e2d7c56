"""Session helpers: building a session for local runs and finding the shared scratch folder.

On a cluster the session is created by the platform and ``spark.checkpoint.dir`` names a
shared folder (HDFS, object store, ...). Everything this package writes between stages
(checkpoints, BED/FASTA files it derives, idempotent stores) goes below that folder. Only
when the setting is missing -- local runs and tests -- do we pick a folder ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "seqlake") -> SparkSession:
    """Session for local runs and tests. Cluster jobs should use their own builder."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_scratch(spark)
    ship_package(spark)
    return spark


def ensure_scratch(spark: SparkSession) -> str:
    """Return the shared scratch root, taken from ``spark.checkpoint.dir``.

    The setting is only filled in when it is unset (local runs, tests); on a cluster the
    value configured by the operator is always used as is.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a shared folder: executors must be "
                               "able to read what another executor wrote")
        root = tempfile.mkdtemp(prefix="seqlake-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, root)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``seqlake`` importable by the Python workers (the FASTA pass and the UDFs are
    pickled by reference): zip the package once per application and add it with
    ``SparkContext.addPyFile`` -- what ``--py-files`` does at submit time."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile
    from pathlib import Path
    pkg = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="seqlake-pyfiles-")) / "seqlake.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(pkg.rglob("*.py")):
            z.write(f, f.relative_to(pkg.parent).as_posix())
    sc.addPyFile(str(out))
    _SHIPPED.add(sc.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared scratch root."""
    return f"{ensure_scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"

"""Session and scratch-location helpers.

Nothing here changes the settings of a session handed in by a caller, except
that a checkpoint directory is created when a local session has none (tests).
On a cluster ``spark.checkpoint.dir`` must name a shared folder, which is used
as is: a folder on one machine would lose what the others write.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def get_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "tablescope") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TABLESCOPE_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def runs_in_one_process(master: str) -> bool:
    """Whether driver and executors share one process, and so every folder."""
    return master == "local" or master.startswith("local[")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Read from ``spark.checkpoint.dir`` (or a directory already set on the
    context).  When neither is set, a session that runs in one process gets a
    fresh local folder; any other raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        try:
            conf_dir = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            conf_dir = None
    if not conf_dir and not runs_in_one_process(sc.master):
        raise RuntimeError(f"spark.checkpoint.dir is not set; master {sc.master!r} needs a folder that all machines share")
    if not conf_dir:
        conf_dir = tempfile.mkdtemp(prefix="tablescope-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unique path under the shared checkpoint folder for written tables."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/tablescope-{label}-{uuid.uuid4().hex[:12]}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch table written under the checkpoint folder (any file system)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(hpath, True)


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, once a session, so that they find it from any folder.

    An archive of its modules goes to the shared scratch folder and from there
    to every worker.  Where the package is installed on the workers this is not needed.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tablescope_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    target = scratch_path(spark, "package") + ".zip"
    hpath = sc._jvm.org.apache.hadoop.fs.Path(target)
    out = hpath.getFileSystem(sc._jsc.hadoopConfiguration()).create(hpath)
    out.write(bytearray(held.getvalue()))
    out.close()
    sc.addPyFile(target)
    sc._tablescope_shipped = True

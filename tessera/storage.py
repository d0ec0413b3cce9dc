"""Tables written to a folder that driver and executors share, to cut lineage or to round-trip a format."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local master may go without the setting (tests); then a temporary folder of the driver stands in.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _OWN_DIR.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="tessera-"))


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of any store, if the session still runs."""
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended; the folder belongs to the cluster
        pass


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path

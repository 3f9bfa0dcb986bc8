"""Where written intermediate tables go."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary one for a single machine, and an error on a cluster, whose machines would not share it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = f"file://{tempfile.mkdtemp(prefix='rowmill-')}"
        root = _LOCAL[app]
    return root.rstrip("/")

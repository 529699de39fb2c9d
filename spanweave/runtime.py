"""What Python workers need: the package itself, and Arrow batches of bounded size."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


#: Bounds of an Arrow batch, for sessions that keep Spark's defaults: rows with whole texts are large.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, "16777216")}


_SCRATCH: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Where that setting is unset on a single machine, as in tests, a temporary folder takes its place; on a cluster that is
    an error, as its executors share no such folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if "local" not in _SCRATCH:
            folder = tempfile.TemporaryDirectory(prefix="spanweave-", ignore_cleanup_errors=True)
            atexit.register(folder.cleanup)
            _SCRATCH["local"] = "file://" + folder.name
        base = _SCRATCH["local"]
    return f"{base.rstrip('/')}/spanweave-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors once for each application (some hundred KB); bound Arrow batches."""
    for name, (usual, ours) in BATCH.items():
        if usual is None or spark.conf.get(name, usual) == usual:
            spark.conf.set(name, ours)
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    root = Path(__file__).resolve().parent
    if root.parent.is_dir():  # else the package runs from an archive that was sent already
        path = Path(tempfile.mkdtemp(prefix="spanweave-")) / "spanweave.zip"
        with zipfile.ZipFile(path, "w") as archive:
            for file in sorted(x for kind in ("*.py", "*.txt") for x in root.rglob(kind)):
                archive.write(file, file.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(path))
    _SENT.add(app)

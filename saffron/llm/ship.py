"""What Python workers need: batches of bounded size, and this package where they can't import it."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from .durable import app_dir

_SENT: set[str] = set()
#: Rows and bytes of text that Spark hands to a Python worker at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's batches to Python to the sizes above, for texts may be long.

    Spark and the worker each hold a batch or two, and double their buffers as they fill.
    """
    rows, size = (f"spark.sql.execution.arrow.{n}" for n in ("maxRecordsPerBatch", "maxBytesPerBatch"))
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if not 0 < int(spark.conf.get(size).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(size, f"{BATCH_BYTES}b")


def ship(spark: SparkSession) -> None:
    """Bound batches, and add the package as a file of the application, unless workers find it by their path.

    Workers inherit PYTHONPATH and the working folder. The archive is written to the
    shared folder, from which Spark hands it to executors, also to later ones.
    """
    bound_batches(spark)
    app = spark.sparkContext.applicationId
    root = Path(__file__).resolve().parents[2]
    paths = [Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if app in _SENT or root in paths or Path.cwd() == root:
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((root / "saffron").rglob("*.py")):
            z.write(p, str(p.relative_to(root)))
    name = f"{app_dir(spark)}/saffron-{uuid.uuid4().hex[:8]}.zip"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(name)
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    try:
        stream.write(bytearray(packed.getvalue()))
    finally:
        stream.close()
    spark.sparkContext.addPyFile(name)
    _SENT.add(app)

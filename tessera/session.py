"""Sessions, and the package's way to the Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: What the engine's semantics and plans rely on; anything else is the cluster's.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("tessera").config(map=SETTINGS | settings)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers, where PYTHONPATH doesn't already."""
    context = spark.sparkContext
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if context.applicationId in _shipped or str(_PACKAGE.parent) in map(os.path.realpath, filter(None, paths)):
        return
    name = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera_package.zip"
    with zipfile.ZipFile(name, "w") as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(_PACKAGE.parent))
    context.addPyFile(str(name))
    _shipped.add(context.applicationId)

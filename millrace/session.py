"""A session with the settings this engine is tuned for."""

from __future__ import annotations

import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's source to the Python workers, once per application, so that they can import it wherever
    the driver found it. Operators that run Python call it before they build their plan."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="millrace-")) / "millrace.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def carry(*names: str) -> None:
    """Classes of these modules travel with their code. Streams plan Python sources and start stateful processors in
    processes beside the driver, which don't get what ``ship`` sends."""
    for name in names:
        cloudpickle.register_pickle_by_value(sys.modules[name])


def session(master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution with skew handling, Arrow transfer and UTC; further settings by keyword, dots as ``__``."""
    builder = SparkSession.builder.appName("millrace")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()

"""Sessions and shipping of this package to executors."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def get_spark(app: str = "tidemark", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; `conf` adds or replaces settings."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        **conf,
    }
    return SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give executors this package's source, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tidemark-src-")) / "tidemark_src.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def together(spark: SparkSession, *work: Callable[[], Any]) -> list[Any]:
    """The results of independent pieces of work whose jobs share the cores: one's short jobs run while another waits."""
    with ThreadPoolExecutor(len(work)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(w)) for w in work]]

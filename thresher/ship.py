"""Gives this package to Python workers that can't import it from where they run."""

from __future__ import annotations

import functools
import hashlib
import io
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's modules to the application, once; Spark serves them to executors, later ones too."""
    sc = spark.sparkContext
    if sc.applicationId in _DONE:
        return
    root, out = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(f"{root.name}/{p.relative_to(root)}"), p.read_bytes())
    name = f"{root.name}-{hashlib.sha256(out.getvalue()).hexdigest()[:16]}.zip"
    path = Path(tempfile.mkdtemp()) / name
    path.write_bytes(out.getvalue())
    sc.addPyFile(str(path))
    _DONE.add(sc.applicationId)


def shipped(f: Callable) -> Callable:
    """f, whose first argument is a session, with the package shipped before it runs."""

    @functools.wraps(f)
    def run(spark: SparkSession, *args, **options):
        ship(spark)
        return f(spark, *args, **options)

    return run

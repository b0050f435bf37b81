"""Making the package importable on executors."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[tuple[str, str]] = set()


def _remove(path: str) -> None:
    with contextlib.suppress(OSError):
        os.unlink(path)


def ship(spark: SparkSession, *folders: str) -> None:
    """Send this package, and other package ``folders``, to the executors of a session once."""
    app = spark.sparkContext.applicationId
    every = (os.path.dirname(os.path.abspath(__file__)), *map(os.path.abspath, folders))
    folders = [f for f in every if (app, f) not in _shipped]
    if not folders:
        return
    handle, path = tempfile.mkstemp(prefix="scatterloom-", suffix=".zip")
    os.close(handle)
    atexit.register(_remove, path)  # executors fetch it from the driver while the session lasts
    with zipfile.ZipFile(path, "w") as z:
        for folder in folders:
            above = os.path.dirname(os.path.abspath(folder))
            for at, _, names in os.walk(folder):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(at, name)
                        z.write(full, os.path.relpath(full, above))
    spark.sparkContext.addPyFile(path)
    _shipped.update((app, f) for f in folders)

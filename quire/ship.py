"""The package's own code for executors that don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def to_executors(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once, unless workers will find it by themselves."""
    context = spark.sparkContext
    there = {os.path.realpath(p) for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p}
    if ROOT in there and context.master.startswith("local") or getattr(context, "_quire_sent", False):
        return
    if ROOT in {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}:
        return
    path = os.path.join(os.path.realpath(tempfile.mkdtemp()), "quire_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "quire")):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), ROOT))
    context.addPyFile(path)
    context._quire_sent = True

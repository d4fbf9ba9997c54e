"""Sending the package to the workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import provena

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver found it: as a zip, once for an application."""
    app = spark.sparkContext.applicationId
    root = os.path.dirname(os.path.abspath(provena.__file__))
    if app in _sent or not os.path.isdir(root):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="provena-"), "provena.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("provena", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _sent.add(app)

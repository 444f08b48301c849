"""Sends this package to executors that don't have it, and builds sessions from JSON settings."""

from __future__ import annotations

import json
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def archive(folder: str | None = None) -> str:
    """A zip file of the package's sources."""
    root = Path(__file__).resolve().parents[1]
    out = Path(folder or tempfile.mkdtemp(prefix="pathloom-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    return str(out)


def ship(spark: SparkSession) -> str | None:
    """Off a local master, has the driver serve the package to all executors; returns the archive."""
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return None
    path = archive()
    spark.sparkContext.addPyFile(path)
    return path


def session(name: str = "pathloom", master: str | None = None, settings: str | None = None) -> SparkSession:
    """A session of a master with the settings (names and values) of a JSON file, the package sent along."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    if settings:
        for key, value in json.loads(Path(settings).read_text()).items():
            builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark

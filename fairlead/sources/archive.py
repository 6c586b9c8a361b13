"""Files that a build needs on the driver: archives unpacked whole or not at all, and downloads that replace nothing half."""

from __future__ import annotations

import os
import shutil
import tempfile
import urllib.request
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def unpack(archive: str, folder: str) -> Path:
    """Unpacks a zip's files into the folder, without their paths; does nothing if the folder has a .shp already.

    Files go to a folder beside it that is renamed when all are there, so a broken entry leaves nothing.
    """
    target = Path(folder)
    if any(target.glob("*.shp")):
        return target
    target.parent.mkdir(parents=True, exist_ok=True)
    held = Path(tempfile.mkdtemp(dir=target.parent, prefix=f".{target.name}-"))
    try:
        with zipfile.ZipFile(archive) as z:
            for entry in z.infolist():
                if not entry.is_dir():
                    with z.open(entry) as source, (held / Path(entry.filename).name).open("wb") as out:
                        shutil.copyfileobj(source, out)
        if target.exists():
            shutil.rmtree(target)
        held.rename(target)
    finally:
        shutil.rmtree(held, ignore_errors=True)
    return target


def ensure(path: str, url: str | None = None) -> Path:
    """The file, fetched first if it isn't there."""
    target = Path(path)
    if target.exists():
        return target
    if not url:
        raise FileNotFoundError(f"{path} isn't there and no url is given")
    target.parent.mkdir(parents=True, exist_ok=True)
    held = target.with_name(f".{target.name}.part")
    try:
        with urllib.request.urlopen(url) as source, held.open("wb") as out:  # noqa: S310
            shutil.copyfileobj(source, out)
        os.replace(held, target)
    finally:
        held.unlink(missing_ok=True)
    return target


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a file from the driver to any store that Spark reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        out.write(bytearray(data))
    finally:
        out.close()

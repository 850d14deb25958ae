"""A folder of sample files that are checked by digest."""

from __future__ import annotations

import hashlib
import os
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def download_sample(asset: dict[str, str], folder: str, force: bool = False, fetch: Callable[[str, str], object] = urllib.request.urlretrieve) -> str:
    """The path of ``asset`` (url, filename, sha256) in ``folder``, fetched if it isn't there or ``force`` says so.

    A digest that begins with PLACEHOLDER isn't checked; another that doesn't
    match removes the file.
    """
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, asset["filename"])
    if force or not os.path.exists(path):
        fetch(asset["url"], path)
    if not asset["sha256"].startswith("PLACEHOLDER") and sha256(path) != asset["sha256"]:
        os.remove(path)
        raise ValueError(f"{asset['filename']} isn't the file that was meant")
    return path


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files, by Spark."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))

"""Files as tables: blobs through Spark's own readers, and how they are named."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """Path, time, length and content of every file; a query that leaves the content out doesn't read it."""
    return spark.read.format("binaryFile").load(path)


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder where driver and executors meet, by ``spark.checkpoint.dir``; a temporary one where all run in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and (not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(named or 'file://' + tempfile.mkdtemp(prefix='quillgrade-')).rstrip('/')}/quillgrade/{label}-{uuid.uuid4().hex}"


def blob_key(folder: Column, ident: Column, name: Column) -> Column:
    """Where a file is kept: folder, id, and the extension in lower case."""
    ext = F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)
    return F.concat(folder, F.lit("/"), ident, F.when(ext != "", F.concat(F.lit("."), F.lower(ext))).otherwise(F.lit("")))


def stale(files: DataFrame, now: str, older_than_s: int = 3600) -> DataFrame:
    """Debug crops past their age; all other files stay."""
    age = F.timestamp_diff("SECOND", F.col("modified"), F.lit(now).cast("timestamp_ntz"))
    return files.where(F.col("name").startswith("debug_") & (age > older_than_s))

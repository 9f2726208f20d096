"""A tree of files as a table of nodes, by Spark's binaryFile source; contents are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.paths import excluded


def scan(spark: SparkSession, root: str, excludes: list[str] | None = None) -> DataFrame:
    """path, parent, name, type, size, mtime of all files below a root and of the folders above them.

    Paths are absolute, without a scheme.  What a pattern excludes is left out, and so is all below an
    excluded folder.  Folders have size 0 and no time; empty ones aren't seen, and links are followed, since
    stores that Spark reads have neither.
    """
    base = root.split("://", 1)[-1].rstrip("/")
    base = base if base.startswith("/") else f"/{base.partition('/')[2]}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?", ""), "^/+", "/")
    files = found.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    names = F.split(F.substring("path", len(base) + 2, F.length("path")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.concat(F.lit(f"{base}/"), F.array_join(F.slice(names, 1, k), "/")))
    kept = files.withColumn("above", above).where(~F.exists("above", lambda p: excluded(p, excludes or [], base)))
    folders = kept.select(F.explode(F.slice("above", 1, F.size("above") - 1)).alias("path")).distinct()
    rows = kept.select("path", F.lit("file").alias("type"), "size", "mtime").unionByName(folders.select("path", F.lit("dir").alias("type"), F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("timestamp").alias("mtime")))
    return rows.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("parent"), F.substring_index("path", "/", -1).alias("name"), "type", "size", "mtime")

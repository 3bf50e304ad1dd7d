"""Source trees: which files are read, and under which names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directory names that are pruned, and the files that are read: fixed values.
PRUNED = ("graphify-out", ".codegraph", "node_modules", "vendor", "dist", "build", "coverage", ".git", ".cursor", ".next", ".turbo")
ADMITTED, REFUSED = r"\.(ts|js|tsx|jsx)$", r"(\.d\.ts|\.min\.jsx?|\.(test|spec)\.[^/]*)$"


def admitted(path: Column) -> Column:
    """Whether a path below the root is read: no pruned segment, a source file, no declaration, bundle or test."""
    pruned = F.exists(F.split(path, "/"), lambda s: s.isin(*PRUNED))
    return path.rlike(ADMITTED) & ~path.rlike(REFUSED) & ~pruned


def grammar(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.rlike(r"\.[tj]sx$"), "tsx").when(low.endswith(".ts"), "typescript").otherwise("javascript")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """file ("src/" and the path below root), content, grammar of the admitted files."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    below = F.url_decode(F.regexp_replace(F.substring_index("path", base + "/", -1), r"\+", "%2B"))
    return files.withColumn("below", below).where(admitted(F.col("below"))).select(F.concat(F.lit("src/"), "below").alias("file"), "content", grammar(F.col("below")).alias("grammar"))

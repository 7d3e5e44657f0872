"""Snapshots of trees of files: one hash for the whole, hashes of folders, and what changed between two trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialize


def _parent(c: Column) -> Column:
    """The folder of a path; the root, which has none of its own, is the empty path."""
    return F.when(F.contains(c, F.lit("/")), F.regexp_replace(c, "/[^/]*$", "")).otherwise("")


def _empty_files(spark: SparkSession, folders: Sequence[str]) -> list[str]:
    """Files without bytes, which Spark's file sources pass over."""
    jvm, conf, found = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for folder in folders:
        place = jvm.org.apache.hadoop.fs.Path(folder)
        files = place.getFileSystem(conf).listFiles(place, True)
        while files.hasNext():
            if not (f := files.next()).getLen():
                found.append(f.getPath().toString())
    return found


def tree_files(spark: SparkSession, root: str, within: Sequence[str] = ("",), skip: str = "__pycache__") -> DataFrame:
    """``path`` below ``root``, ``bytes`` and ``sha256`` of every file in the folders or files ``within``, none below a folder named ``skip``."""
    places = [f"{root.rstrip('/')}/{w}".rstrip("/") for w in within]
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(places).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    empty = spark.createDataFrame([(p,) for p in _empty_files(spark, places)], "path string").select("path", F.lit(0).cast("long").alias("bytes"), F.sha2(F.lit(""), 256).alias("sha256"))
    plain = (root.split(":", 1)[-1] if ":/" in root else root).strip("/")
    files = read.unionByName(empty).withColumn("path", F.regexp_replace("path", rf"^.*?\Q{plain}\E/", "")).dropDuplicates(["path"])
    return files.filter(~F.array_contains(F.split("path", "/"), skip))


def tree_snapshot(files: DataFrame) -> DataFrame:
    """``tree_sha256`` and ``file_count``, one row: the hash of the canonical JSON of all paths with their bytes and hashes."""
    entry = F.concat(F.substr(F.to_json(F.struct(F.col("path").alias("p"))), F.lit(6), F.length(F.to_json(F.struct(F.col("path").alias("p")))) - 6), F.lit(":"), F.to_json(F.struct("bytes", "sha256")))
    one = files.agg(F.array_sort(F.collect_list(F.struct("path", entry.alias("entry")))).alias("rows"), F.count("*").alias("file_count"))  # a code tree is small
    return one.select(F.sha2(F.concat(F.lit("{"), F.array_join(F.transform("rows", lambda r: r["entry"]), ","), F.lit("}")), 256).alias("tree_sha256"), "file_count")


def folder_hashes(files: DataFrame) -> DataFrame:
    """``path`` and ``sha256`` of every folder, the root as the empty path: a hash of the names and hashes of what is in it.

    Folders are hashed level by level, the deepest first, each from its files and the folders below it, so two
    trees of the same files have the same hashes however they were listed. ``files`` has ``path`` and ``sha256``.
    """
    level = lambda p: F.when(p == "", 0).otherwise(F.size(F.split(p, "/")))
    nodes = materialize(files.select(_parent(F.col("path")).alias("folder"), F.substring_index("path", "/", -1).alias("name"), F.concat(F.lit("file:"), "sha256").alias("mark")).withColumn("depth", level(F.col("folder"))))
    deepest, made, below = nodes.agg(F.max("depth")).first()[0], None, None
    for depth in range(deepest, -1, -1) if deepest is not None else ():
        here = nodes.filter(F.col("depth") == depth).select("folder", "name", "mark")
        if below is not None:
            here = here.unionByName(below.select(_parent(F.col("path")).alias("folder"), F.substring_index("path", "/", -1).alias("name"), F.concat(F.lit("folder:"), "sha256").alias("mark")))
        listing = F.array_join(F.array_sort(F.collect_list(F.concat("name", F.lit("\n"), "mark"))), "\n")
        below = materialize(here.groupBy(F.col("folder").alias("path")).agg(F.sha2(listing, 256).alias("sha256")))
        made = below if made is None else made.unionByName(below)
    return made if made is not None else files.select("path", "sha256").limit(0)


def tree_changes(before: DataFrame, after: DataFrame, folders_before: DataFrame, folders_after: DataFrame) -> DataFrame:
    """``path`` and ``change`` (added, removed, changed) of every file that differs; only files of unequal folders are compared."""
    both = folders_before.select("path", F.col("sha256").alias("a")).join(folders_after.select("path", F.col("sha256").alias("b")), "path", "full")
    unequal = materialize(both.filter(~F.col("a").eqNullSafe(F.col("b"))).select(F.col("path").alias("folder")))
    side = lambda df, name: df.withColumn("folder", _parent(F.col("path"))).join(unequal, "folder", "left_semi").select("path", F.col("sha256").alias(name))
    joined = side(before, "a").join(side(after, "b"), "path", "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    return joined.select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))

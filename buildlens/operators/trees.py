"""Directory trees: listings, recursive signatures and sizes.

entries: (path, mode, info): one row for each file or directory below a tree's top, info
being any string that changes when the entry does. Signatures go bottom-up, one round
for each depth; a directory's children are reduced to (name, signature) pairs, so what
meets is one directory's own listing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name, fold_hash, glob_match, parent, under
from ..shared import written

#: What stands for the signature of a tree without anything to sign.
EMPTY = "empty"


def listing(entries: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(directory, names): sorted names. links: (path, target): a symbolic link to a
    directory that holds it is left out."""
    rows = entries
    if links is not None:
        upward = links.where(under(F.col("path"), F.col("target"))).select("path")
        rows = rows.join(upward, "path", "left_anti")
    rows = rows.select(parent(F.col("path")).alias("directory"), base_name(F.col("path")).alias("name")).where("name <> ''").distinct()
    return rows.groupBy("directory").agg(F.array_sort(F.collect_list("name")).alias("names"))


def filtered_listing(entries: DataFrame, patterns: list[str]) -> DataFrame:
    """listing() without the names that one of the shell patterns matches."""
    drop = F.lit(False)
    for p in patterns:
        drop = drop | glob_match(base_name(F.col("path")), F.lit(p))
    return listing(entries.where(~drop))


def with_directories(files: DataFrame) -> DataFrame:
    """(path, is_directory, info): files and all directories above them."""
    from ..functions.text import ancestors

    above = files.select(F.explode(ancestors(parent(F.col("path")))).alias("path")).distinct()
    return files.select("path", F.lit(False).alias("is_directory"), "info").unionByName(above.select("path", F.lit(True).alias("is_directory"), F.lit("").alias("info")))


def _signed(entries: DataFrame, own) -> DataFrame:
    depth = F.when(F.col("path") == "/", 0).otherwise(F.size(F.split("path", "/")) - 1)
    rows = written(entries.select("path", "is_directory", own.alias("own"), depth.alias("depth"), parent(F.col("path")).alias("up"), base_name(F.col("path")).alias("name")))
    deepest = rows.agg(F.coalesce(F.max("depth"), F.lit(-1))).first()[0]
    below = done = None
    for level in range(deepest, -1, -1):
        here = rows.where(F.col("depth") == level)
        if below is None:
            signed = here.withColumn("children", F.lit(None).cast("array<string>"))
        else:
            lists = below.groupBy(F.col("up").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("name", "signature"))), lambda c: F.concat_ws("=", c["name"], c["signature"])).alias("children"))
            signed = here.join(lists, "path", "left")
        parts = F.concat(F.array("own"), F.coalesce("children", F.array().cast("array<string>")))
        signature = F.when(F.col("is_directory"), F.when(F.coalesce(F.size("children"), F.lit(0)) == 0, F.lit(EMPTY)).otherwise(fold_hash(parts))).otherwise(F.md5(F.col("own").cast("binary")))
        below = written(signed.select("path", "is_directory", "up", "name", signature.alias("signature")))
        done = below if done is None else done.unionByName(below)
    if done is None:
        return entries.select("path", F.lit("").alias("signature")).where("false")
    return done.select("path", "is_directory", "signature")


def tree_signature(entries: DataFrame) -> DataFrame:
    """(path, is_directory, signature): of a directory over its names and all that lies below."""
    return _signed(entries, F.coalesce("info", F.lit("")))


def structure_signature(entries: DataFrame) -> DataFrame:
    """As tree_signature, from names and kinds alone: a file's content counts for nothing."""
    return _signed(entries, F.when(F.col("is_directory"), "d").otherwise("f"))


def total_sizes(files: DataFrame) -> DataFrame:
    """(path, size, files): of each directory, over all files below it. Each file counts
    for its ancestors in one shuffle, combined before it."""
    from ..functions.text import ancestors

    return files.select(F.explode(ancestors(parent(F.col("path")))).alias("path"), "size").groupBy("path").agg(F.sum("size").alias("size"), F.count("*").alias("files"))


def tree_entries(entries: DataFrame) -> DataFrame:
    """(directory, entries): structs by name, as a stored tree has them."""
    return entries.groupBy("directory").agg(F.array_sort(F.collect_list(F.struct("name", "type", "size", "id"))).alias("entries"))

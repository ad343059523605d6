"""The link graph: targets to files, and links back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators.references import link_references, percent_decoded, resolved_path  # noqa: F401
from inkwell.operators.skew import lookup


def resolve(links: DataFrame, files: DataFrame) -> DataFrame:
    """Adds target_rel and target_file_id: the file whose rel_path is the target, or else the
    target below the source's folder, taken literally; of several versions the smallest id.

    Two equi-joins instead of one join on either path; adaptive execution splits hot targets."""
    by_path = files.where("rel_path is not null").groupBy("rel_path").agg(F.min("file_id").alias("fid"))
    dirs = files.groupBy("file_id").agg(F.min("dir").alias("src_dir")).withColumnRenamed("file_id", "src_file_id")
    base = links.drop("target_rel", "target_file_id")
    out = lookup(base, dirs, "src_file_id")
    out = out.withColumn("k1", F.col("target_path")).withColumn("k2", F.concat(F.coalesce("src_dir", F.lit("")), F.lit("/"), F.col("target_path")))
    out = lookup(out, by_path.select(F.col("rel_path").alias("k1"), F.col("fid").alias("f1")), "k1")
    out = lookup(out, by_path.select(F.col("rel_path").alias("k2"), F.col("fid").alias("f2")), "k2")
    hit = F.col("kind").isin("md", "wiki") & (F.col("target_path") != "")
    rel = F.when(F.col("f1").isNotNull(), F.col("k1")).when(F.col("f2").isNotNull(), F.col("k2"))
    return out.select(*base.columns, F.when(hit, rel).alias("target_rel"), F.when(hit, F.coalesce("f1", "f2")).alias("target_file_id"))


def backlinks(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """(target_rel, src_rel, title, anchor): for every file the links to it."""
    sources = files.groupBy(F.col("file_id").alias("src_file_id")).agg(F.min("rel_path").alias("src_rel"), F.min("title").alias("title"))
    some = resolved.where("target_rel is not null").select("target_rel", "src_file_id", "anchor")
    return lookup(some, sources, "src_file_id", how="inner").select("target_rel", "src_rel", "title", "anchor")

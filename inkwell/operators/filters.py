"""Structured predicates on files, each a Column or a semi-join; all are joined by AND."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG_KEYS = ("tags", "tag")


def with_frontmatter(files: DataFrame, frontmatter: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """Files with a front-matter pair of one of the keys (lower case) and exactly this value."""
    pairs = frontmatter.where(F.lower("key").isin(*keys) & (F.col("value") == value)).select("file_id")
    return files.join(pairs, "file_id", "left_semi")


def with_path(files: DataFrame, part: str) -> DataFrame:
    """rel_path LIKE %part%, case aside; % and _ of the user act as wildcards."""
    return files.where(F.col("rel_path").ilike(f"%{part}%"))


def with_dates(files: DataFrame, after: float | None, before: float | None) -> DataFrame:
    """after <= doc_date < before; without a date the file's mtime counts."""
    date = F.when(F.col("doc_date") > 0, F.col("doc_date")).otherwise(F.col("mtime"))
    out = files if after is None else files.where(date >= after)
    return out if before is None else out.where(date < before)


def matching(files: DataFrame, f, frontmatter: DataFrame, tasks: DataFrame | None = None, code_blocks: DataFrame | None = None) -> DataFrame:
    """The files that a plans.query.Filters admits."""
    out = files
    for tag in f.tags:
        out = with_frontmatter(out, frontmatter, TAG_KEYS, tag)
    for status in f.status:
        out = with_frontmatter(out, frontmatter, ("status",), status)
    for key, value in f.frontmatter:
        out = with_frontmatter(out, frontmatter, (key,), value)
    for part in f.paths:
        out = with_path(out, part)
    if f.exts:  # the only filter whose values are alternatives
        out = out.where(F.col("ext").isin(*f.exts))
    for lang in f.langs:
        out = out.join(code_blocks.where(F.col("lang") == lang).select("file_id"), "file_id", "left_semi")
    out = with_dates(out, f.after, f.before)
    if f.task:
        some = tasks if f.task == "any" else tasks.where(F.col("checked") == (f.task == "done"))
        out = out.join(some.select("file_id"), "file_id", "left_semi")
    return out


def first_chunks(chunks: DataFrame) -> DataFrame:
    """The first chunk of every file by start_line, ties by chunk_id."""
    rest = [c for c in chunks.columns if c != "file_id"]
    top = F.min_by(F.struct(*rest), F.struct("start_line", "chunk_id")).alias("c")
    return chunks.groupBy("file_id").agg(top).select("file_id", "c.*")


def structured(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files, newest first, with their first chunk; a file without chunk keeps a null one."""
    own = first_chunks(chunks).select("file_id", "chunk_id", "heading_slug", "heading_path", "text")
    return files.select("file_id", "path", "rel_path", "title", "mtime").join(own, "file_id", "left")

"""The stored index of a vault: relations as versioned parts, kept current by differences.

A version is a set of parts for each relation plus the file ids that no longer hold; an
update parses and writes only new and changed files (equal hashes are skipped), so its cost
follows the change and not the vault. Ids are hashes of paths and lines and stay the same.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.text import index_string
from inkwell.operators.links import resolve
from inkwell.operators.commits import get, latest, put
from inkwell.operators.markdown import DATE_KEYS, parsed, segmented
from inkwell.sources.tables import shared_dir

SCHEMA_VERSION = 2
RELATIONS = ("files", "frontmatter", "headings", "links", "tasks", "code_blocks", "chunks", "segments")
SCHEMAS = {
    "files": "file_id bigint, path string, rel_path string, dir string, ext string, mtime double, size bigint, content_hash string, title string, indexed_at double, doc_date double",
    "frontmatter": "file_id bigint, pos int, key string, value string",
    "headings": "file_id bigint, level int, text string, slug string, line int, path_text string",
    "links": "src_file_id bigint, target_path string, anchor string, kind string",
    "tasks": "file_id bigint, checked boolean, text string, line int",
    "code_blocks": "file_id bigint, lang string",
    "chunks": "chunk_id bigint, file_id bigint, heading_slug string, heading_path string, text string, ngram string, start_line int, end_line int",
    "segments": "chunk_id bigint, file_id bigint, seg int, text string, vec array<float>",
}


@dataclass(frozen=True)
class Changes:
    added: int
    updated: int
    removed: int
    skipped: int


def snapshot_diff(indexed: DataFrame, scanned: DataFrame) -> DataFrame:
    """(path, status): new, changed, same or gone; both sides have (path, content_hash), each
    path once. Letter case of hashes doesn't matter."""
    a = indexed.select("path", F.lower("content_hash").alias("old"), F.lit(True).alias("was"))
    b = scanned.select("path", F.lower("content_hash").alias("new"), F.lit(True).alias("is"))
    status = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "gone").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def document_date(frontmatter: DataFrame, key: str = "file_id") -> DataFrame:
    """(file_id, doc_date): seconds of the first pair whose key names a date, if it can be read
    as y-M-d, y/M/d, y-M or y."""
    first = frontmatter.where(F.lower("key").isin(*DATE_KEYS)).groupBy(key).agg(F.min_by("value", "pos").alias("v"))
    s = F.substring("v", 1, 10)
    day = F.coalesce(*(F.try_to_timestamp(s, F.lit(form)) for form in ("y-M-d", "y/M/d", "y-M", "y")))
    return first.select(key, F.unix_timestamp(day).cast("double").alias("doc_date"))


class Vault:
    """Relations of a vault below a folder; one writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or shared_dir(spark)

    def state(self) -> dict:
        """The latest version: its number, parts and meta values."""
        n = latest(self.spark, f"{self.folder}/versions")
        last = get(self.spark, f"{self.folder}/versions/{n}.json") if n >= 0 else {"version": -1, "parts": [], "gone": [], "meta": {"schema_version": SCHEMA_VERSION}}
        if last["meta"].get("schema_version") != SCHEMA_VERSION:
            return {"version": last["version"], "parts": [], "gone": [], "meta": {"schema_version": SCHEMA_VERSION}}
        return last

    def read(self, relation: str, state: dict | None = None) -> DataFrame:
        """A relation of the latest version."""
        s = state or self.state()
        out = self.spark.createDataFrame([], SCHEMAS[relation])
        key = "src_file_id" if relation == "links" else "file_id"
        for n in s["parts"]:
            if relation == "segments" and n < s["meta"].get("vectors_from", 0):
                continue  # of another model
            part = self.spark.read.schema(SCHEMAS[relation]).parquet(f"{self.folder}/parts/{n}/{relation}")
            later = [m for m in s["gone"] if m >= n]
            if later:
                # Ids that a later update replaced or removed; deleted in its own part only before writing.
                gone = self.spark.read.schema("file_id bigint, part int").parquet(*(f"{self.folder}/gone/{m}" for m in later)).where(F.col("part") > n).select(F.col("file_id").alias(key)).distinct()
                part = part.join(gone, key, "left_anti")
            out = out.unionByName(part)
        return out

    def hashes(self) -> DataFrame:
        return self.read("files").select("path", "content_hash")

    def counts(self) -> dict[str, int]:
        """Files, chunks, chunks with vectors and chunks without."""
        chunks = self.read("chunks")
        done = self.read("segments").where(F.size("vec") > 0).select("chunk_id").distinct()
        n = chunks.count()
        with_vec = chunks.join(done, "chunk_id", "left_semi").count()
        return {"files": self.read("files").count(), "chunks": n, "vectors": with_vec, "pending": n - with_vec}

    def reconcile(self, scanned: DataFrame, now: float | None = None, complete: bool = True) -> Changes:
        """Brings the index to `scanned` (path, rel_path, mtime, size, content). With
        complete=False files that weren't scanned stay (a batch of upserts)."""
        now = time.time() if now is None else now
        state = self.state()
        n = state["version"] + 1
        full = scanned.withColumn("content_hash", F.md5(F.coalesce(F.col("content"), F.lit("")).cast("binary")))
        status = snapshot_diff(self.read("files", state).select("path", "content_hash"), full.select("path", "content_hash"))
        status.write.mode("overwrite").parquet(f"{self.folder}/status/{n}")
        status = self.spark.read.parquet(f"{self.folder}/status/{n}")
        count = {r.status: r.n for r in status.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        touched = status.where("status in ('new', 'changed')").select("path")
        self._write(full.join(touched, "path", "left_semi"), n, now)
        gone = status.where("status in ('changed', 'gone')" if complete else "status = 'changed'").select("path")
        self._commit(state, n, gone)
        return Changes(count.get("new", 0), count.get("changed", 0), count.get("gone", 0) if complete else 0, count.get("same", 0))

    def remove(self, paths: DataFrame) -> None:
        """Deletes files (path) with everything that belongs to them."""
        state = self.state()
        n = state["version"] + 1
        self._commit(state, n, paths.select("path").distinct(), parts=False)

    def set_meta(self, **values) -> None:
        state = self.state()
        put(self.spark, f"{self.folder}/versions/{state['version'] + 1}.json", state | {"version": state["version"] + 1, "meta": state["meta"] | values})

    def use_model(self, name: str) -> bool:
        """Remembers the embedding model; with another one than before all vectors go."""
        before = self.state()["meta"].get("embed_model")
        if before == name:
            return False
        self.set_meta(embed_model=name, vectors_from=self.state()["version"] + 1)
        return True

    def _commit(self, state: dict, n: int, gone: DataFrame, parts: bool = True) -> None:
        ids = gone.select(F.xxhash64("path").alias("file_id"), F.lit(n).alias("part"))
        ids.write.mode("overwrite").parquet(f"{self.folder}/gone/{n}")
        new = {"version": n, "parts": state["parts"] + [n] * parts, "gone": state["gone"] + [n], "meta": state["meta"]}
        put(self.spark, f"{self.folder}/versions/{n}.json", new)

    def _write(self, files: DataFrame, n: int, now: float) -> None:
        at = f"{self.folder}/parts/{n}"
        base = files.withColumn("file_id", F.xxhash64("path")).withColumn("ext", F.lower(F.regexp_extract("rel_path", r"\.([^./]*)$", 1)))
        docs = parsed(base, "file_id", "content", "rel_path")
        docs.write.mode("overwrite").parquet(f"{at}/docs")
        docs = self.spark.read.parquet(f"{at}/docs")
        put = lambda df, name: df.select(*[c.strip().split(" ")[0] for c in SCHEMAS[name].split(", ")]).write.mode("overwrite").parquet(f"{at}/{name}")
        rel = lambda name: docs.select("file_id", F.inline(f"doc.{name}"))
        dates = document_date(rel("frontmatter"))
        put(
            base.drop("content").join(docs.select("file_id", F.col("doc.title").alias("title")), "file_id").join(dates, "file_id", "left")
            .withColumns({"dir": F.regexp_replace("rel_path", r"/?[^/]*$", ""), "indexed_at": F.lit(now), "doc_date": F.when(F.col("doc_date") > 0, F.col("doc_date")).otherwise(F.col("mtime"))}),
            "files",
        )
        for name in ("frontmatter", "headings", "tasks"):
            put(rel(name), name)
        put(rel("links").withColumnRenamed("file_id", "src_file_id"), "links")
        put(docs.select("file_id", F.explode("doc.code_langs").alias("lang")), "code_blocks")
        chunks = rel("chunks").withColumn("chunk_id", F.xxhash64("file_id", "start_line")).withColumn("ngram", index_string(F.col("text")))
        put(chunks, "chunks")
        self.spark.createDataFrame([], SCHEMAS["segments"]).write.mode("overwrite").parquet(f"{at}/segments")

    def resolved_links(self) -> DataFrame:
        """Links with their targets, resolved anew from the current files."""
        return resolve(self.read("links"), self.read("files"))

    def embed_missing(self, embedder, most: int | None = None) -> int:
        """Vectors for chunks that have none: segments, embedded in Arrow batches. A chunk
        without segments gets a marker with an empty vector, so it isn't tried again. most:
        chunks of this round, any of those that wait; the others are left for the next."""
        from inkwell.operators.embed import embedded

        state = self.state()
        self.use_model(embedder.identifier)
        chunks, files = self.read("chunks"), self.read("files").select("file_id", "title")
        todo = chunks.join(self.read("segments").select("chunk_id").distinct(), "chunk_id", "left_anti")
        if most is not None:
            # Which rows a limit takes may differ from job to job, so they are laid down.
            waiting = f"{shared_dir(self.spark)}/waiting"
            todo.limit(most).write.parquet(waiting)
            todo = self.spark.read.schema(todo.schema).parquet(waiting)
        segs = segmented(todo)
        context = F.concat_ws(" ▸ ", F.nullif("title", F.lit("")), F.nullif("heading_path", F.lit("")))
        full = segs.join(todo.select("chunk_id", "file_id", "heading_path"), "chunk_id").join(files, "file_id", "left")
        vectors = embedded(full.select("chunk_id", "file_id", "seg", F.col("segment").alias("text"), F.concat_ws("\n", context, F.col("segment")).alias("input")), embedder)
        marks = todo.join(segs.select("chunk_id").distinct(), "chunk_id", "left_anti").select("chunk_id", "file_id", F.lit(0).alias("seg"), F.lit(None).cast("string").alias("text"), F.array().cast("array<float>").alias("vec"))
        state = self.state()
        n = state["version"] + 1
        at = f"{self.folder}/parts/{n}"
        vectors.unionByName(marks).write.mode("overwrite").parquet(f"{at}/segments")
        for name in RELATIONS:
            if name != "segments":
                self.spark.createDataFrame([], SCHEMAS[name]).write.mode("overwrite").parquet(f"{at}/{name}")
        self._commit(state, n, self.spark.createDataFrame([], "path string"))
        return self.spark.read.parquet(f"{at}/segments").select("chunk_id").distinct().count()

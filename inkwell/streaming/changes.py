"""Change feeds: debounced paths, micro-batches into a vault, references and arrivals."""

from __future__ import annotations

import threading
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkwell.operators.commits import latest, put
from inkwell.operators.vault import Vault
from inkwell.sources.files import wanted

T = TypeVar("T")


def latest_per_path(batch: DataFrame, order: str = "seen_at") -> DataFrame:
    """The last operation of each path in a batch: (path, op)."""
    return batch.where("path is not null").groupBy("path").agg(F.max_by("op", order).alias("op"))


def sessions(events: DataFrame, key: str, at: str, gap_s: float) -> DataFrame:
    """(key, start_at, end_at, n) of runs of events that are at most a gap apart."""
    t = F.col(at).cast("double")
    w = Window.partitionBy(key).orderBy(at)
    fresh = (F.lag(t).over(w).isNull() | (t - F.lag(t).over(w) > gap_s)).cast("int")
    numbered = events.where(F.col(at).isNotNull()).withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min(at).alias("start_at"), F.max(at).alias("end_at"), F.count(F.lit(1)).alias("n")).drop("session")


def debounced(stream: DataFrame, key: str = "path", at: str = "seen_at", gap: str = "300 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Session windows of a stream: one row for each burst of events of a key, when it is over."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap), F.col(key)).agg(F.count(F.lit(1)).alias("n"), F.max_by("op", at).alias("op"))


def indexable(path: Column) -> Column:
    """wanted() for a column of relative paths, in the JVM."""
    from inkwell.sources.files import IGNORED, INDEXABLE

    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    fine = ~F.exists(folders, lambda p: p.startswith(".") | p.isin(*sorted(IGNORED))) & ~F.element_at(parts, -1).startswith(".")
    return fine & F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)).isin(*sorted(INDEXABLE))


def apply_batch(vault: Vault, batch: DataFrame, read: Callable[[DataFrame], DataFrame], now: float | None = None) -> None:
    """One micro-batch of (path, rel_path, op, seen_at): the last operation of each path counts;
    removed files go, the others are read by `read` (paths to scanned rows) and brought in."""
    last = latest_per_path(batch.where(indexable(F.col("rel_path"))))
    vault.remove(last.where("op = 'remove'").select("path"))
    vault.reconcile(read(last.where("op <> 'remove'").select("path")), now, complete=False)


def follow(stream: DataFrame, vault: Vault, read: Callable[[DataFrame], DataFrame], checkpoint: str, seconds: float | None = 0.3) -> StreamingQuery:
    """Keeps a vault current from a stream of changes; seconds=None ends when all is read."""
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{int(seconds * 1000)} milliseconds"}
    return stream.writeStream.foreachBatch(lambda df, _: apply_batch(vault, df, read)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def embed_continuously(vault: Vault, embedder, batch: int | None = 32, most_rounds: int | None = None, progress: Callable[[int, int], None] | None = None) -> int:
    """Vectors for whatever lacks them, `batch` chunks a round, until none waits (or after
    most_rounds); progress is told (done, total) after each. Returns how many chunks were done."""
    counts = vault.counts()
    done, total, rounds = 0, counts["pending"], 0
    while most_rounds is None or rounds < most_rounds:
        n = vault.embed_missing(embedder, batch)
        done, rounds = done + n, rounds + 1
        if progress:
            progress(done, total)
        if not n:
            break
    return done


def snapshot_changes(before: DataFrame, now: DataFrame, seen_at: Column) -> DataFrame:
    """(path, rel_path, op, seen_at): what happened between two listings (path, rel_path, mtime,
    size) of a folder. Edits and removals show, which a source of new files can't see."""
    a = before.select("path", F.col("rel_path").alias("old_rel"), F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"))
    both = now.select("path", "rel_path", "mtime", "size").join(a, "path", "full_outer")
    same = F.col("mtime").eqNullSafe(F.col("old_mtime")) & F.col("size").eqNullSafe(F.col("old_size"))
    op = F.when(F.col("rel_path").isNull(), "remove").when(F.col("old_rel").isNull(), "create").when(~same, "upsert")
    return both.select("path", F.coalesce("rel_path", "old_rel").alias("rel_path"), op.alias("op"), seen_at.alias("seen_at")).where("op is not null")


class ChangeLog:
    """A change log of a folder: each poll lists it, appends what changed since the last poll to
    `log` as one file that a stream reads, and keeps the listing for the next."""

    def __init__(self, spark: SparkSession, log: str):
        self.spark, self.log = spark, log

    SCHEMA = "path string, rel_path string, op string, seen_at timestamp"
    LISTED = "path string, rel_path string, mtime double, size bigint"

    def poll(self, listing: DataFrame) -> int:
        """One poll; returns its number. A poll that fails leaves no commit and is repeated."""
        n = latest(self.spark, f"{self.log}/commits") + 1
        at = f"{self.log}/listings/{n}"
        listing.select("path", "rel_path", "mtime", "size").write.mode("overwrite").parquet(at)
        now = self.spark.read.schema(self.LISTED).parquet(at)
        before = self.spark.read.schema(self.LISTED).parquet(f"{self.log}/listings/{n - 1}") if n else self.spark.createDataFrame([], self.LISTED)
        snapshot_changes(before, now, F.current_timestamp()).write.mode("overwrite").parquet(f"{self.log}/changes/poll={n}")
        put(self.spark, f"{self.log}/commits/{n}.json", {"poll": n})
        return n

    def stream(self) -> DataFrame:
        """The changes as a stream."""
        return self.spark.readStream.schema(self.SCHEMA).parquet(f"{self.log}/changes/*")


def tree_changes(events: DataFrame, gap_s: float = 0.2) -> DataFrame:
    """Bursts of events that change the tree of folders (create, remove, rename), whatever the
    path; edits of contents don't count. One burst asks for one new listing."""
    some = events.where("op in ('create', 'remove', 'rename')").withColumn("tree", F.xxhash64(F.regexp_extract("path", "^(/?[^/]*)", 1)))
    return sessions(some, "tree", "seen_at", gap_s)


class LatestOnly:
    """Runs searches of which only the newest counts: starting one cancels what still runs."""

    def __init__(self, spark: SparkSession, name: str = "search"):
        self.spark, self.name, self.n = spark, name, 0
        self._lock = threading.Lock()

    def run(self, work: Callable[[], T]) -> T | None:
        """work() under this search's tag; None if a newer search took over meanwhile. Jobs of
        the older one that run are cancelled; one it starts later ends by itself, unused."""
        with self._lock:
            self.n += 1
            mine, tag = self.n, f"{self.name}-{self.n}"
            if mine > 1:
                self.spark.sparkContext.cancelJobsWithTag(f"{self.name}-{mine - 1}")
        self.spark.sparkContext.addJobTag(tag)
        try:
            out = work()
        except Exception:
            if mine != self.n:
                return None
            raise
        finally:
            self.spark.sparkContext.removeJobTag(tag)
        return out if mine == self.n else None


__all__ = ["ChangeLog", "LatestOnly", "apply_batch", "debounced", "embed_continuously", "follow", "indexable", "latest_per_path", "sessions", "snapshot_changes", "tree_changes", "wanted"]

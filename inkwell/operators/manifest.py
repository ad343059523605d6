"""Processing only new or changed records (problem 6).

Method: diff of immutable table versions. A table's version is a manifest: a list of data
files, each with its deletion vector, the keys of that file that no longer hold. A commit
writes files only for buckets of keys whose content changed: added records go into a new
file, replaced and removed ones into deletion vectors; other files are taken over by name.
The records that changed between two versions follow from the manifests: files and deletion
vectors that the later one has and the earlier has not. Nothing else is read.

After `COMPACTED` data files a commit is followed by a rewrite, a version of the same content
in one file; a diff over rewrites is put together from the stretches between them.

A run's output and the version it processed are one commit: the output lies in a folder that
counts from the moment its commit is written last. A run that fails leaves no commit, so its
records come again; a run that ended is never repeated. Two writers of one version have
folders of their own, and only one of them can commit it.

Buckets are hashes of the key, so a hot folder of paths is spread. Copies of a record count
once. Defined results: null keys identify nothing and are left out; equal hashes in other
letter case are equal; an empty table gives no records; further columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.operators.commits import get, latest, put
from inkwell.sources.tables import shared_dir, table

BUCKETS, COMPACTED = 64, 8
RECORD = "key string, hash string, bucket int"
VECTOR = "key string, part string, bucket int"


class VersionedTable:
    """(key, hash) records in immutable versions below a folder of the shared storage."""

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder or shared_dir(spark), buckets

    def manifest(self, version: int) -> dict | None:
        return get(self.spark, f"{self.folder}/manifests/{version}.json")

    def latest(self) -> int:
        return latest(self.spark, f"{self.folder}/manifests")

    def _data(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        """(key, hash, bucket, part): records of a version, of some buckets; its data parts
        less the deletion vectors, all vectors in one anti join."""
        out = self.spark.createDataFrame([], RECORD + ", part string")
        for part in manifest["data"]:
            out = out.unionByName(self.spark.read.schema(RECORD).parquet(part).withColumn("part", F.lit(part)))
        if buckets is not None:
            out = out.where(F.col("bucket").isin(buckets))
        if manifest["deleted"]:
            gone = self.spark.read.schema(VECTOR).parquet(*manifest["deleted"])
            if buckets is not None:
                gone = gone.where(F.col("bucket").isin(buckets))
            out = out.join(gone.select("key", "part"), ["key", "part"], "left_anti")
        return out

    def records(self, version: int) -> DataFrame:
        return self._data(self.manifest(version)).select("key", "hash")

    def commit(self, records: DataFrame) -> int:
        """The next version, holding exactly `records` (key, hash; each key once)."""
        v = self.latest() + 1
        before = self.manifest(v - 1) if v else {"data": [], "deleted": [], "digests": {}}
        own = f"{v}-{uuid.uuid4().hex}"  # a rival writer of this version has other folders
        bucket = F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")
        digest = F.sum(F.xxhash64("key", "hash").cast("decimal(38,0)")).cast("string")
        records.where("key is not null").select("key", "hash", bucket.alias("bucket")).write.parquet(f"{self.folder}/staged/{own}")
        staged = self.spark.read.schema(RECORD).parquet(f"{self.folder}/staged/{own}")
        # A number and a sum for each bucket: that many rows come to the driver.
        now = {str(r.bucket): f"{r.n}:{r.d}" for r in staged.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), digest.alias("d")).collect()}
        old = before["digests"]
        changed = sorted(int(b) for b in {*now, *old} if now.get(b) != old.get(b))
        manifest = {"data": list(before["data"]), "deleted": list(before["deleted"]), "digests": now}
        if changed and not before["data"]:
            manifest["data"].append(f"{self.folder}/staged/{own}")
        elif changed:
            # Every data part carries which part a record lies in, for the deletion vectors.
            mine = staged.where(F.col("bucket").isin(changed))
            theirs = self._data(before, changed).select(F.col("key").alias("key2"), F.col("hash").alias("hash2"), "part", F.col("bucket").alias("bucket2"))
            both = mine.join(theirs, F.col("key") == F.col("key2"), "full_outer").where(~F.coalesce(F.expr("key <=> key2 and hash <=> hash2"), F.lit(False)))
            both.select("key", "hash", "bucket", "key2", "part", "bucket2").write.parquet(f"{self.folder}/delta/{own}")
            delta = self.spark.read.parquet(f"{self.folder}/delta/{own}")
            delta.where("key is not null").select("key", "hash", "bucket").write.parquet(f"{self.folder}/data/{own}")
            delta.where("key2 is not null").select(F.col("key2").alias("key"), "part", F.col("bucket2").alias("bucket")).write.parquet(f"{self.folder}/deleted/{own}")
            manifest["data"].append(f"{self.folder}/data/{own}")
            manifest["deleted"].append(f"{self.folder}/deleted/{own}")
        put(self.spark, f"{self.folder}/manifests/{v}.json", manifest)
        if len(manifest["data"]) > COMPACTED:
            v += 1
            path = f"{self.folder}/data/{v}-{uuid.uuid4().hex}"
            self._data(manifest).select("key", "hash", "bucket").write.parquet(path)
            put(self.spark, f"{self.folder}/manifests/{v}.json", {"data": [path], "deleted": [], "digests": now, "rewritten": True})
        return v

    def changes(self, since: int, until: int) -> DataFrame:
        """(key, hash, change) between two versions: added, changed or removed. Reads the data
        parts and deletion vectors that only the later manifest has."""
        stretches, a = [], since
        for v in range(since + 1, until + 1):
            if self.manifest(v).get("rewritten"):
                if v - 1 > a:
                    stretches.append((a, v - 1))
                a = v
        if until > a or not stretches:
            stretches.append((a, until))
        found = [self._stretch(a, b).withColumn("at", F.lit(n)) for n, (a, b) in enumerate(stretches)]
        if len(found) == 1:
            return found[0].drop("at")
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        ends = every.groupBy("key").agg(F.min_by("change", "at").alias("first"), F.max_by(F.struct("change", "hash"), "at").alias("last"))
        was, there = F.col("first") != "added", F.col("last.change") != "removed"
        change = F.when(was & there, "changed").when(there, "added").when(was, "removed")
        return ends.select("key", F.when(there, F.col("last.hash")).alias("hash"), change.alias("change")).where("change is not null")

    def _stretch(self, since: int, until: int) -> DataFrame:
        """changes() between versions without a rewrite after the first of them. A key that went
        from one hash to another and back comes out as changed."""
        a = self.manifest(since) if since >= 0 else {"data": [], "deleted": []}
        b = self.manifest(until)
        added = [p for p in b["data"] if p not in a["data"]]
        vectors = [p for p in b["deleted"] if p not in a["deleted"]]
        new = self._data({"data": added, "deleted": vectors}).select("key", "hash")
        gone = self.spark.createDataFrame([], "key string")
        if vectors and a["data"]:
            gone = self.spark.read.schema(VECTOR).parquet(*vectors).where(F.col("part").isin(a["data"])).select("key").distinct()
        both = new.withColumn("new", F.lit(1)).join(gone.withColumn("old", F.lit(1)), "key", "full_outer")
        change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
        return both.select("key", "hash", change.alias("change"))


class Consumer:
    """Processes each change of a table once; its outputs carry the processed version."""

    def __init__(self, source: VersionedTable, folder: str):
        self.source, self.folder, self.spark = source, folder, source.spark

    def _last(self) -> tuple[int, int]:
        """(number of the last finished output, the version it covers)."""
        n = latest(self.spark, f"{self.folder}/commits")
        return n, get(self.spark, f"{self.folder}/commits/{n}.json")["version"] if n >= 0 else -1

    def processed(self) -> int:
        """The version that the last finished output covers; -1 before the first."""
        return self._last()[1]

    def skip_to(self, version: int) -> None:
        """Counts what is in `version` as processed before, without output."""
        n, done = self._last()
        if version > done:
            put(self.spark, f"{self.folder}/commits/{n + 1}.json", {"version": version, "output": None})

    def run(self, work=lambda changes: changes) -> DataFrame | None:
        """Applies `work` to what changed since the last finished run and commits the output
        together with the version; None if nothing is new. Safe to repeat after a failure."""
        (n, done), now = self._last(), self.source.latest()
        if now <= done:
            return None
        out = f"{self.folder}/outputs/{n + 1}-{uuid.uuid4().hex}"
        work(self.source.changes(done, now)).write.parquet(out)
        put(self.spark, f"{self.folder}/commits/{n + 1}.json", {"version": now, "output": out})
        return self.spark.read.parquet(out)


def runs_of(files: DataFrame, runs: DataFrame) -> DataFrame:
    """files with the status of the run that wrote each row: the run with the greatest
    started_at not after indexed_at. An as-of join by day: a run is entered for each day
    until the next run starts, so both sides meet on equal days and no side is broadcast.
    Runs are ordered within their day, and days (a row each: 366 a year) among each other."""
    day = lambda c: F.floor(c / 86_400).cast("bigint")
    r = runs.where("started_at is not null").groupBy("started_at").agg(F.max_by("status", "run_id").alias("status")).withColumn("d0", day(F.col("started_at")))
    last = files.agg(F.max("indexed_at")).first()[0] or 0.0
    days = r.groupBy("d0").agg(F.min("started_at").alias("first")).withColumn("after", F.lead("first").over(Window.partitionBy(F.lit(0)).orderBy("d0"))).select("d0", "after")
    within = F.lead("started_at").over(Window.partitionBy("d0").orderBy("started_at"))
    ends = r.withColumn("next", within).join(days, "d0").withColumn("next", F.coalesce("next", "after"))
    spans = ends.withColumn("d", F.explode(F.sequence("d0", F.greatest("d0", day(F.coalesce("next", F.lit(float(last))))))))
    f = files.withColumn("d", day(F.col("indexed_at")))
    hit = (F.col("indexed_at") >= F.col("started_at")) & (F.col("next").isNull() | (F.col("indexed_at") < F.col("next")))
    return f.join(spans.select("d", "started_at", "next", "status"), "d").where(hit).drop("d", "next", "started_at")


def indexed(files: DataFrame, runs: DataFrame) -> DataFrame:
    """(key, hash): of every path the newest row that an ok run wrote."""
    some = files.where("path is not null and indexed_at is not null").select("path", "indexed_at", "content_hash", "file_id")
    return runs_of(some, runs).where("status = 'ok'").groupBy("path").agg(F.max_by(F.lower("content_hash"), F.struct("indexed_at", "file_id")).alias("hash")).select(F.col("path").alias("key"), "hash")


def watched(changes: DataFrame) -> DataFrame:
    """(key, hash): of every path the newest row of the feed, if that is an upsert. Upserts
    without hash say nothing about content and don't count."""
    rows = changes.where("path is not null and seen_at is not null and (op = 'remove' or (op = 'upsert' and content_hash is not null))")
    newest: Column = F.max_by(F.struct("op", F.lower("content_hash").alias("hash")), F.struct("seen_at", "change_id"))
    return rows.groupBy("path").agg(newest.alias("n")).where("n.op = 'upsert'").select(F.col("path").alias("key"), "n.hash")


def pending_files(files: DataFrame, runs: DataFrame, changes: DataFrame, folder: str | None = None) -> DataFrame:
    """(key, hash, change): what the next indexing run must process.

    What the ok runs left is the version processed so far, what the watcher saw the next one;
    a Consumer works off the difference of their manifests and commits it with the version.
    folder: where versions and outputs are kept between calls, of which only the changed
    buckets are written and read again.
    """
    t = VersionedTable(files.sparkSession, folder)
    c = Consumer(t, f"{t.folder}/consumer")
    c.skip_to(t.commit(indexed(files, runs)))
    t.commit(watched(changes))
    out = c.run()
    if out is None:
        return files.sparkSession.createDataFrame([], "key string, hash string, change string")
    return out.where("change <> 'removed'")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    some = pending_files(table(spark, folder, "files"), table(spark, folder, "index_runs"), table(spark, folder, "file_changes"))
    return some.select(F.col("key").alias("path"))


P6_SQL = """
with r as (select run_id, started_at, status, lead(started_at) over (order by started_at) as next from (select distinct * from index_runs)),
f as (select f.path, lower(f.content_hash) as hash, row_number() over (partition by f.path order by f.indexed_at desc, f.file_id desc) as n
      from (select distinct * from files) f join r on f.indexed_at >= r.started_at and (r.next is null or f.indexed_at < r.next) where r.status = 'ok'),
c as (select path, op, lower(content_hash) as hash, row_number() over (partition by path order by seen_at desc, change_id desc) as n
      from (select distinct * from file_changes) where op = 'remove' or (op = 'upsert' and content_hash is not null))
select c.path from c left join (select * from f where n = 1) f on c.path = f.path
where c.n = 1 and c.op = 'upsert' and (f.path is null or f.hash is distinct from c.hash)
"""

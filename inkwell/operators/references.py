"""References to records that do not exist (problem 3).

Method: keyed pending-orphan state, kept incrementally. A reference waits for any of some
keys (`wants`); a parent record offers keys. `OrphanState.apply` takes one batch of new
references, arriving parents and deleted parents:

1. new references probe the parent index; those that find none of their keys are pending;
2. arriving parents resolve the pending references that want their keys;
3. deletions reopen the references whose last parent they were.

The parent index and the references by wanted key lie in `BUCKETS` folders by the key's
hash; a batch reads only the buckets of its keys, and of those the part files that later
compactions left (after `COMPACTED` batches a relation is written anew as one part). Only
the batch, the pending set and those buckets are joined, never references with references.

A batch counts from the moment its commit is written, last; the commit names every part that
belongs to the state. A driver that is lost in between leaves the state as it was: whoever
opens the folder again goes on after the last commit, and the batch can be applied again.
`pending` is the snapshot after the last batch, `counts` its number for each table and month.

A hot key (a page that a third of all links want) is split by adaptive execution in joins and
by a hash of the row id where its bucket is written. Defined results: null keys want nothing
and are no references; copies of a row (same table and id) are one reference; order of
arrival inside a batch doesn't matter (keys that arrive and are deleted in one batch are
there), and any division of the same rows into batches ends in the same pending set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.commits import get, latest, put
from inkwell.operators.skew import lookup
from inkwell.sources.tables import shared_dir, table

REFERENCES = "tab string, row_id bigint, loaded_at timestamp, wants array<string>"
PARENTS = "key string"
#: Folders by hash of the key; parts after which a relation is written anew; tasks of a bucket.
BUCKETS, COMPACTED, SALTS = 16, 8, 4
EVENTS = "key string, batch int, there boolean, bucket int"
WANTED = "key string, tab string, row_id bigint, loaded_at timestamp, wants array<string>, bucket int"


def bucket_of(key: str = "key") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


class OrphanState:
    """The references seen so far, the keys that exist, and the references without parent."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or shared_dir(spark)

    @property
    def version(self) -> int:
        """The last finished batch, as the folder says; -1 before the first."""
        return latest(self.spark, f"{self.folder}/commits")

    def _state(self) -> dict:
        n = self.version
        return get(self.spark, f"{self.folder}/commits/{n}.json") if n >= 0 else {"parents": [], "wanted": [], "pending": None}

    def _parts(self, paths: list[str], schema: str, buckets: list[int] | None = None) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        # Parts have different roots, so each is read by itself for its bucket folders.
        out = None
        for p in paths:
            df = self.spark.read.schema(schema).parquet(p)
            out = df if out is None else out.unionByName(df)
        return out if buckets is None else out.where(F.col("bucket").isin(buckets))

    def pending(self) -> DataFrame:
        """(tab, row_id, loaded_at, wants) of the references that have no parent now."""
        path = self._state()["pending"]
        return self.spark.read.schema(REFERENCES).parquet(path) if path else self.spark.createDataFrame([], REFERENCES)

    def counts(self) -> DataFrame:
        """(tab, month, orphans) of the pending set."""
        month = F.date_format(F.date_trunc("month", "loaded_at"), "yyyy-MM")
        return self.pending().groupBy("tab", month.alias("month")).agg(F.count(F.lit(1)).alias("orphans"))

    def apply(self, references: DataFrame | None = None, arriving: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
        """One batch; returns the pending references after it."""
        spark, n, state = self.spark, self.version + 1, self._state()
        part = lambda name: f"{self.folder}/{name}/batch={n}"
        parents, wanted = list(state["parents"]), list(state["wanted"])
        events = None
        for some, there in ((arriving, True), (deleted, False)):
            if some is not None:
                some = some.where("key is not null").select("key", F.lit(there).alias("there"))
                events = some if events is None else events.unionByName(some)
        if events is not None:
            events = events.groupBy("key").agg(F.max("there").alias("there"))  # arrived and deleted: there
            self._bucketed(events.select("key", F.lit(n).alias("batch"), "there", bucket_of().alias("bucket")), part("parents"))
            events = self._parts([part("parents")], EVENTS)
        waiting = []
        if references is not None:
            rows = references.where(F.size("wants") > 0).select("tab", "row_id", "loaded_at", "wants")
            rows = rows.select(F.explode("wants").alias("key"), "*").where("key is not null")
            # Written as it comes, a file a bucket and task; compaction gathers them.
            rows.select("*", bucket_of().alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(part("wanted"))
            came = [*parents, *([part("parents")] if events is not None else [])]
            waiting.append(self._without_parent(self._parts([part("wanted")], WANTED), came))
        old = self.pending()
        if events is not None and state["pending"]:
            freed = old.select("tab", "row_id", F.explode("wants").alias("key")).join(events.where("there").select("key"), "key", "left_semi").select("tab", "row_id").distinct()
            old = old.join(freed, ["tab", "row_id"], "left_anti")
        if state["pending"]:
            waiting.append(old)
        if deleted is not None and wanted:
            gone = events.where("not there").select("key", "bucket")
            touched = [r.bucket for r in gone.select("bucket").distinct().collect()]  # at most BUCKETS
            rows = self._parts(wanted, WANTED, touched).join(gone.select("key"), "key", "left_semi")
            again = rows.groupBy("tab", "row_id").agg(F.first("loaded_at").alias("loaded_at"), F.first("wants").alias("wants"))
            again = again.select(F.explode("wants").alias("key"), "*").where("key is not null").withColumn("bucket", bucket_of())
            waiting.append(self._without_parent(again, [*parents, part("parents")]))
        out = spark.createDataFrame([], REFERENCES) if not waiting else waiting[0]
        for more in waiting[1:]:
            out = out.unionByName(more)
        if len(waiting) > 1:
            out = out.dropDuplicates(["tab", "row_id"])
        out.write.mode("overwrite").parquet(part("pending"))
        parents += [part("parents")] if events is not None else []
        wanted += [part("wanted")] if references is not None else []
        if len(parents) > COMPACTED:
            last = self._existing(self._parts(parents, EVENTS))
            self._bucketed(last.select("key", F.lit(n).alias("batch"), F.lit(True).alias("there"), bucket_of().alias("bucket")), part("parents-whole"))
            parents = [part("parents-whole")]
        if len(wanted) > COMPACTED:
            self._bucketed(self._parts(wanted, WANTED).dropDuplicates(["key", "tab", "row_id"]), part("wanted-whole"), F.pmod(F.xxhash64("tab", "row_id"), F.lit(SALTS)))
            wanted = [part("wanted-whole")]
        put(spark, f"{self.folder}/commits/{n}.json", {"parents": parents, "wanted": wanted, "pending": part("pending")})
        return self.pending()

    @staticmethod
    def _bucketed(df: DataFrame, path: str, salt: Column | None = None) -> None:
        """Writes a folder a bucket, a file each (SALTS files where a hot key may lie)."""
        by = [F.col("bucket")] if salt is None else [F.col("bucket"), salt]
        df.repartition(*by).write.mode("overwrite").partitionBy("bucket").parquet(path)

    @staticmethod
    def _existing(events: DataFrame) -> DataFrame:
        """Keys whose last event is an arrival."""
        return events.groupBy("key").agg(F.max_by("there", "batch").alias("there")).where("there").select("key")

    def _without_parent(self, wanted: DataFrame, parents: list[str]) -> DataFrame:
        """References, given a row for each key they want, none of whose keys exists. Of each
        wanted key's events only are looked at; every reference comes out once."""
        events = self._parts(parents, EVENTS)
        if len(parents) > 1:
            events = self._existing(events)
        else:
            events = events.where("there").select("key")  # each key once in a part
        # A row's keys come together again here, so they needn't travel along with each of them.
        flagged = lookup(wanted.select("key", "tab", "row_id", "loaded_at"), events.withColumn("there", F.lit(True)), "key")
        unmet = F.when(F.col("there").isNull(), F.col("key"))
        rows = flagged.groupBy("tab", "row_id").agg(F.max("there").alias("there"), F.first("loaded_at").alias("loaded_at"), F.collect_set(unmet).alias("wants"))
        return rows.where("there is null").select("tab", "row_id", "loaded_at", "wants")


def percent_decoded(c: Column) -> Column:
    """Percent escapes decoded as UTF-8, "+" kept; a malformed text stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def resolved_path(base: Column, target: Column) -> Column:
    """target seen from the folder `base`; "/" begins at the root; "." and ".." are resolved,
    and ".." at the root stays there."""
    full = F.when(target.startswith("/"), target).otherwise(F.concat(F.coalesce(base, F.lit("")), F.lit("/"), target))
    empty = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done)
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.array_append(done, part))

    return F.array_join(F.aggregate(F.split(full, "/"), empty, step), "/")


def link_references(links: DataFrame, files: DataFrame) -> DataFrame:
    """References of links. A link wants the key of its file; with an anchor the key of a
    heading of that file instead, which is only there if the file is."""
    key = lambda kind, *parts: F.concat_ws("\x1f", F.lit(kind), *parts)
    sources = files.where("file_id is not null").groupBy("file_id").agg(F.min("rel_path").alias("src_rel"), F.min("dir").alias("src_dir"))
    some = links.where(F.col("kind").isin("md", "wiki") & F.col("link_id").isNotNull()).select("link_id", F.col("src_file_id").alias("file_id"), "target_path", "anchor", "kind", "loaded_at")
    joined = lookup(some, sources, "file_id")
    md = F.col("kind") == "md"
    target = F.coalesce("target_path", F.lit(""))
    path = F.when(target == "", F.col("src_rel")).when(md, resolved_path(F.col("src_dir"), percent_decoded(target))).otherwise(target)
    anchor = F.when(md, percent_decoded(F.col("anchor"))).otherwise(F.col("anchor"))
    has = F.coalesce(F.col("anchor") != "", F.lit(False))
    # A source that is in no row of files has no path: its references to itself want a key
    # that nothing offers.
    joined = joined.select("link_id", "loaded_at", "kind", F.coalesce(path, F.lit("\x00")).alias("p"), anchor.alias("a"), has.alias("has"))
    p, a, other = F.col("p"), F.col("a"), F.concat("p", F.lit(".md"))
    wants = (
        F.when(~F.col("has"), F.when(md, F.array(key("file", p))).otherwise(F.array(key("file", p), key("file", other))))
        .when(md, F.array(key("slug", p, a)))
        .otherwise(F.array(key("slug", p, a), key("slug", other, a), key("text", p, a), key("text", other, a)))
    )
    return joined.select(F.lit("links").alias("tab"), F.col("link_id").alias("row_id"), "loaded_at", wants.alias("wants"))


def frontmatter_references(frontmatter: DataFrame) -> DataFrame:
    some = frontmatter.where("file_id is not null and fm_id is not null")
    return some.select(F.lit("frontmatter").alias("tab"), F.col("fm_id").alias("row_id"), "loaded_at", F.array(F.concat(F.lit("id\x1f"), F.col("file_id").cast("string"))).alias("wants"))


def vault_parents(files: DataFrame, headings: DataFrame) -> DataFrame:
    """(key, at): the keys that files and headings offer, and when they were written."""
    key = lambda kind, *parts: F.concat_ws("\x1f", F.lit(kind), *parts)
    at = F.timestamp_micros((F.coalesce("indexed_at", F.lit(0.0)) * 1_000_000).cast("bigint")).alias("at")
    named = files.where("rel_path is not null")
    own = files.select(F.explode(F.array(F.concat(F.lit("id\x1f"), F.col("file_id").cast("string")), key("file", F.col("rel_path")))).alias("key"), at).where("key is not null")
    of_file = named.where("file_id is not null").groupBy("file_id").agg(F.min("rel_path").alias("rel_path"), F.min("indexed_at").alias("indexed_at"))
    # A file has few headings on the whole, but a hot one may not: the files' side is unique.
    h = lookup(headings.where("file_id is not null").select("file_id", "slug", "text"), of_file, "file_id", "inner")
    keys = F.array_compact(F.array(F.when(F.col("slug").isNotNull(), key("slug", F.col("rel_path"), F.col("slug"))), F.when(F.col("text").isNotNull(), key("text", F.col("rel_path"), F.col("text")))))
    return own.unionByName(h.select(F.explode(keys).alias("key"), at))


def vault_orphans(spark: SparkSession, folder: str, batches: int = 2, state: OrphanState | None = None) -> OrphanState:
    """The orphan state of a vault's tables, its rows applied in `batches` periods of equal
    length in the order in which they were written. A state that holds some of these batches
    already (a run that was lost) gets the others only."""
    files, headings = table(spark, folder, "files"), table(spark, folder, "headings")
    links, front = table(spark, folder, "links"), table(spark, folder, "frontmatter")
    refs = link_references(links, files).unionByName(frontmatter_references(front))
    parents = vault_parents(files, headings)
    state = state or OrphanState(spark)
    # The tables' keys are worked out once and laid down; the batches read from there.
    refs.write.mode("overwrite").parquet(f"{state.folder}/input/references")
    parents.groupBy("key").agg(F.min("at").alias("at")).write.mode("overwrite").parquet(f"{state.folder}/input/parents")
    refs = spark.read.schema(REFERENCES).parquet(f"{state.folder}/input/references")
    parents = spark.read.schema("key string, at timestamp").parquet(f"{state.folder}/input/parents")
    span = refs.agg(F.min("loaded_at").alias("a"), F.max("loaded_at").alias("b")).first()
    if span.a is None:
        batches = 1
    edges = [None, *(span.a + (span.b - span.a) * k / batches for k in range(1, batches)), None]
    for n, (lo, hi) in enumerate(zip(edges, edges[1:])):
        if n <= state.version:
            continue

        def within(c: str) -> Column:
            ok = F.lit(True)
            if lo is not None:
                ok = ok & (F.col(c) >= F.lit(lo))
            if hi is not None:
                ok = ok & (F.col(c) < F.lit(hi))
            # Rows without time belong to the first batch.
            return F.coalesce(ok, F.lit(lo is None))

        state.apply(refs.where(within("loaded_at")), parents.where(within("at")).select("key"))
    return state


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return vault_orphans(spark, folder).pending().select("tab", "row_id")


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans for each table and month of loaded_at."""
    return vault_orphans(spark, folder).counts()


P3_SQL = r"""
with f as (select distinct * from files), l as (select distinct * from links where kind in ('md', 'wiki')), h as (select distinct * from headings),
src as (select file_id, min(rel_path) as src_rel, min(dir) as src_dir from f group by 1),
raw as (
  select link_id, kind, case when kind = 'md' then url_decode(coalesce(target_path, '')) else coalesce(target_path, '') end as t,
         case when kind = 'md' then url_decode(anchor) else anchor end as a, src_rel, src_dir
  from l left join src on l.src_file_id = src.file_id),
joined as (
  select link_id, kind, t, a, case when t = '' then src_rel when kind = 'wiki' then t when t like '/%' then t else src_dir || '/' || t end as full_path from raw),
parts as (
  select link_id, kind, a, t, full_path,
    case when kind = 'wiki' or t = '' then full_path else
      array_to_string(list_reduce(list_prepend([]::varchar[], list_transform(string_split(full_path, '/'), lambda x: [x])),
        lambda acc, x: case when x[1] in ('', '.') then acc when x[1] = '..' then acc[1:greatest(len(acc) - 1, 0)] else list_append(acc, x[1]) end), '/') end as p
  from joined),
files_of as (select distinct rel_path from f),
heads as (select distinct f.rel_path, h.slug, h.text from h join f on h.file_id = f.file_id),
alt as (select link_id, kind, a, p as q from parts union all select link_id, kind, a, p || '.md' from parts where kind = 'wiki'),
fine as (
  select link_id from alt join files_of on alt.q = files_of.rel_path where coalesce(a, '') = ''
  union select link_id from alt join heads on alt.q = heads.rel_path and alt.a = heads.slug where coalesce(a, '') <> ''
  union select link_id from alt join heads on alt.q = heads.rel_path and alt.a = heads.text where kind = 'wiki' and coalesce(a, '') <> '')
select 'links' as tab, link_id as row_id from parts where link_id not in (select link_id from fine)
union all
select distinct 'frontmatter', fm_id from frontmatter where file_id is not null and fm_id is not null and file_id not in (select file_id from f where file_id is not null)
"""

P3_COUNTS_SQL = f"""
with found as ({P3_SQL}),
rows as (select distinct 'links' as tab, link_id as row_id, loaded_at from links union all select distinct 'frontmatter', fm_id, loaded_at from frontmatter)
select tab, strftime(date_trunc('month', loaded_at), '%Y-%m') as month, count(*) as orphans from found join rows using (tab, row_id) group by all
"""

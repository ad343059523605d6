import collections
import datetime as dt

from pyspark.sql import functions as F

from inkwell.operators.references import OrphanState, frontmatter_references, link_references, percent_decoded, resolved_path, vault_parents
from inkwell.operators.skew import lookup

T = dt.datetime(2025, 1, 1)
FILES = "file_id long, rel_path string, dir string, indexed_at double"
LINKS = "link_id long, src_file_id long, target_path string, anchor string, kind string, loaded_at timestamp"


def refs(spark, rows):
    return spark.createDataFrame([("t", i, T, [k] if isinstance(k, str) else k) for i, k in rows], "tab string, row_id long, loaded_at timestamp, wants array<string>")


def keys(spark, some):
    return spark.createDataFrame([(k,) for k in some], "key string")


def pending(state):
    return sorted(r.row_id for r in state.pending().collect())


def test_arrivals_resolve_and_deletions_reopen(spark):
    s = OrphanState(spark)
    assert pending(s) == [] and s.counts().count() == 0
    s.apply(refs(spark, [(1, "a"), (2, "b"), (3, ["x", "a"]), (3, ["x", "a"])]), keys(spark, ["b", None]))
    assert pending(s) == [1, 3]
    s.apply(refs(spark, [(4, "a"), (5, [])]), keys(spark, ["a"]))
    assert pending(s) == []
    s.apply(deleted=keys(spark, ["a", "never"]))
    assert pending(s) == [1, 3, 4]
    s.apply(arriving=keys(spark, ["x"]))
    assert pending(s) == [1, 4]
    s.apply(refs(spark, [(6, "b")]), deleted=keys(spark, ["x"]))
    assert pending(s) == [1, 3, 4]
    assert [tuple(r) for r in s.counts().collect()] == [("t", "2025-01", 3)]


def test_division_into_batches_does_not_matter(spark):
    rows = [(i, f"k{i % 17}") for i in range(120)]
    parents = [f"k{i}" for i in range(0, 17, 3)]
    one = OrphanState(spark)
    one.apply(refs(spark, rows), keys(spark, parents))
    two = OrphanState(spark)
    two.apply(refs(spark, rows[:70]), keys(spark, parents[:2]))
    two.apply(refs(spark, rows[70:]), keys(spark, parents[2:]))
    assert pending(one) == pending(two)


def test_paths(spark):
    df = spark.createDataFrame([("a/b", "../x%20y.md"), ("a", "/r/./s.md"), ("", "../../z.md"), ("a", "50%.md"), ("a", "a+b.md"), (None, "n.md")], "d string, t string")
    assert [r[0] for r in df.select(resolved_path(F.col("d"), percent_decoded(F.col("t")))).collect()] == ["a/x y.md", "r/s.md", "z.md", "a/50%.md", "a/a+b.md", "n.md"]


def test_links_of_every_kind(spark):
    files = spark.createDataFrame([(1, "d/a.md", "d", 1.0), (1, "d/a.md", "d", 1.0), (2, "b.md", "", 1.0), (3, None, None, None)], FILES)
    headings = spark.createDataFrame([(1, "intro-x", "Intro X"), (2, None, "Only text"), (9, "s", "s")], "file_id long, slug string, text string")
    links = spark.createDataFrame(
        [
            (1, 1, "../b.md", None, "md", T), (2, 1, "b.md", None, "md", T), (3, 1, "", "intro-x", "md", T), (4, 1, "", "Intro X", "md", T),
            (5, 1, "b", None, "wiki", T), (6, 1, "d/a", "Intro X", "wiki", T), (7, 1, "d/a.md", "nope", "wiki", T), (8, 1, "zz", None, "external", T),
            (9, 1, "../b.md", "", "md", T), (10, 99, "", None, "md", T), (11, 1, "b", "Only text", "wiki", T), (2, 1, "b.md", None, "md", T),
            (12, 1, "/d/%61.md", "intro%2Dx", "md", T), (13, 1, "%61", None, "wiki", T), (14, None, None, None, "md", None), (15, 1, "B.md", None, "wiki", T),
        ],
        LINKS,
    )
    fm = spark.createDataFrame([(1, 1, T), (2, 7, T), (3, None, T), (2, 7, T)], "fm_id long, file_id long, loaded_at timestamp")
    s = OrphanState(spark)
    s.apply(link_references(links, files).unionByName(frontmatter_references(fm)), vault_parents(files, headings).select("key"))
    got = sorted((r.tab, r.row_id) for r in s.pending().collect())
    assert got == [("frontmatter", 2)] + [("links", n) for n in (2, 4, 7, 10, 13, 14, 15)]


def test_hot_key_lookup(spark):
    """Adaptive execution splits the rows of a hot key over several tasks."""
    left = spark.range(30_000).selectExpr("case when id % 3 = 0 then 'hot' else concat('k', id) end as key", "id as i", "sha2(cast(id as string), 256) as pad").repartition(8)
    right = spark.createDataFrame([("hot", 1), ("k1", 2)], "key string, v long")
    kept = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in kept}
    for k, v in kept.items():
        spark.conf.set(k, v)
    try:
        got = lookup(left, right, "key")
        rows = got.collect()
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert collections.Counter(r.v for r in rows) == {1: 10_000, 2: 1, None: 19_999}
    assert "skew=true" in plan


def test_a_state_opened_again_goes_on_after_the_last_commit(spark, monkeypatch):
    from inkwell.operators import references

    s = OrphanState(spark)
    s.apply(refs(spark, [(1, "a"), (2, "b")]), keys(spark, ["c"]))

    def lost(*_):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(references, "put", lost)
    for _ in range(2):
        try:
            s.apply(refs(spark, [(3, "d")]), keys(spark, ["a"]))
        except RuntimeError:
            pass
        assert s.version == 0 and pending(s) == [1, 2]
    monkeypatch.undo()
    again = OrphanState(spark, s.folder)  # a new driver
    assert again.version == 0 and pending(again) == [1, 2]
    again.apply(refs(spark, [(3, "d")]), keys(spark, ["a"]))
    assert OrphanState(spark, s.folder).version == 1 and pending(s) == [2, 3]


def test_parts_are_compacted_and_untouched_buckets_not_read(spark, monkeypatch):
    from inkwell.operators import references

    monkeypatch.setattr(references, "COMPACTED", 2)
    s = OrphanState(spark)
    want = set()
    for n in range(5):
        gone = keys(spark, [f"k{n - 1}"]) if n else None
        s.apply(refs(spark, [(10 * n + i, f"k{n + i}") for i in range(3)]), keys(spark, [f"k{n}"]), gone)
    there = {"k4"}
    want = {10 * n + i for n in range(5) for i in range(3) if f"k{n + i}" not in there}
    assert set(pending(s)) == want
    state = s._state()
    assert len(state["parents"]) <= 2 and len(state["wanted"]) <= 2
    one = s._parts(state["wanted"], references.WANTED, [3]).inputFiles()
    plan = s._parts(state["wanted"], references.WANTED, [3])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters", 1)[1][:200], one

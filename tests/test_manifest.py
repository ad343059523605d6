import datetime as dt

import pytest

from inkwell.operators.manifest import Consumer, VersionedTable, indexed, pending_files, watched


def records(spark, d):
    return spark.createDataFrame(list(d.items()), "key string, hash string")


def changed(df):
    return {r.key: (r.change, r.hash) for r in df.collect()}


def test_versions_and_their_differences(spark):
    t = VersionedTable(spark, buckets=4)
    a = {f"k{i}": "x" for i in range(20)}
    b = {k: v for k, v in a.items() if k != "k3"} | {"k5": "y", "new": "z", "null": None}
    c = dict(b) | {"k5": "x", "k3": "x"}
    for v, s in enumerate((a, b, b, c, {})):
        assert t.commit(records(spark, s) if s else records(spark, a).limit(0)) == v
    for v, s in enumerate((a, b, b, c, {})):
        assert {r.key: r.hash for r in t.records(v).collect()} == s
    assert changed(t.changes(0, 1)) == {"k3": ("removed", None), "k5": ("changed", "y"), "new": ("added", "z"), "null": ("added", None)}
    assert changed(t.changes(1, 2)) == {}
    assert t.manifest(1)["data"] == t.manifest(2)["data"] and len(t.manifest(1)["data"]) == 2  # nothing rewritten
    assert set(changed(t.changes(-1, 0))) == set(a)
    assert {k: v[0] for k, v in changed(t.changes(3, 4)).items()} == {k: "removed" for k in c}


def test_consumer_neither_skips_nor_repeats(spark):
    t = VersionedTable(spark, buckets=2)
    out = Consumer(t, t.folder + "-out")
    assert out.run() is None
    t.commit(records(spark, {"a": "1", "b": "1"}))

    def fails(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        out.run(fails)
    assert out.processed() == -1
    assert set(changed(out.run())) == {"a", "b"}
    assert out.run() is None and out.processed() == 0
    t.commit(records(spark, {"a": "1", "b": "2"}))
    t.commit(records(spark, {"a": "1", "b": "2", "c": "1"}))
    assert {k: v[0] for k, v in changed(out.run()).items()} == {"b": "changed", "c": "added"}


def test_pending_files(spark):
    at = lambda s: dt.datetime(2025, 1, 1) + dt.timedelta(seconds=s)
    runs = spark.createDataFrame([(1, 100.0, 200.0, "ok"), (2, 300.0, None, "aborted"), (3, 200_000.0, 200_100.0, "ok")], "run_id long, started_at double, finished_at double, status string")
    files = spark.createDataFrame(
        [(1, "a", "AA", 150.0), (2, "a", "bb", 350.0), (3, "b", "cc", 120.0), (3, "b", "cc", 120.0), (4, "c", "dd", 50.0), (5, "d", "ee", 900_000.0), (6, None, "x", 1.0), (7, "e", "x", None)],
        "file_id long, path string, content_hash string, indexed_at double",
    )
    feed = spark.createDataFrame(
        [
            (1, "a", "upsert", "aa", at(1)), (2, "b", "upsert", "cc", at(1)), (3, "b", "upsert", None, at(2)), (4, "c", "upsert", "DD", at(1)),
            (5, "d", "upsert", "EE", at(1)), (6, "d", "remove", None, at(2)), (7, "f", "upsert", "q", at(5)), (7, "f", "upsert", "q", at(5)), (8, "f", "upsert", "p", at(4)), (9, "e", "upsert", "x", at(1)),
        ],
        "change_id long, path string, op string, content_hash string, seen_at timestamp",
    )
    assert {r.key: r.hash for r in indexed(files, runs).collect()} == {"a": "aa", "b": "cc", "d": "ee"}
    assert {r.key: r.hash for r in watched(feed).collect()} == {"a": "aa", "b": "cc", "c": "dd", "f": "q", "e": "x"}
    assert {r.key: r.change for r in pending_files(files, runs, feed).collect()} == {"c": "added", "f": "added", "e": "added"}
    assert pending_files(files.limit(0), runs.limit(0), feed.limit(0)).count() == 0


def test_rewrites_and_differences_over_them(spark, monkeypatch):
    from inkwell.operators import manifest

    monkeypatch.setattr(manifest, "COMPACTED", 2)
    t = VersionedTable(spark, buckets=2)
    states, at = [{"a": "1", "b": "1", "z": "1"}], []
    states += [{"a": "2", "b": "1", "z": "1"}, {"a": "2", "c": "1", "z": "1"}, {"a": "2", "c": "2"}, {"a": "3", "b": "1"}]
    for s in states:
        at.append(t.commit(records(spark, s)))
    assert any(t.manifest(v).get("rewritten") for v in range(t.latest() + 1)) and len(t.manifest(t.latest())["data"]) <= 2
    for v, s in zip(at, states):
        assert {r.key: r.hash for r in t.records(v).collect()} == s
    assert changed(t.changes(at[0], at[-1])) == {"a": ("changed", "3"), "b": ("changed", "1"), "z": ("removed", None)}
    assert changed(t.changes(at[1], at[3])) == {"b": ("removed", None), "c": ("added", "2"), "z": ("removed", None)}


def test_only_one_of_two_writers_commits(spark):
    from inkwell.operators.commits import get, latest, put

    t = VersionedTable(spark, buckets=2)
    t.commit(records(spark, {"a": "1"}))
    path = f"{t.folder}/manifests/1.json"
    put(spark, path, {"first": True})
    with pytest.raises(OSError, match="another run"):
        put(spark, path, {"second": True})
    assert get(spark, path) == {"first": True} and latest(spark, f"{t.folder}/manifests") == 1
    assert get(spark, f"{t.folder}/manifests/7.json") is None and latest(spark, f"{t.folder}/none") == -1


def test_a_lost_run_is_repeated_whole(spark, monkeypatch):
    from inkwell.operators import manifest

    t = VersionedTable(spark, buckets=2)
    t.commit(records(spark, {"a": "1", "b": "1"}))
    c = Consumer(t, t.folder + "/c")

    def lost(*_):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(manifest, "put", lost)
    with pytest.raises(RuntimeError):
        c.run()  # output written, commit not
    monkeypatch.undo()
    again = Consumer(VersionedTable(spark, t.folder, 2), c.folder)
    assert again.processed() == -1 and set(changed(again.run())) == {"a", "b"} and again.run() is None

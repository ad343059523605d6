import threading
import time

import duckdb
import numpy as np
import pytest

from inkwell import composed
from inkwell.functions import text as T
from inkwell.operators import semantic
from inkwell.operators.embed import HashingEmbedder, Prefixed, TokenMean, first_usable
from inkwell.streaming.changes import ChangeLog, LatestOnly, embed_continuously, snapshot_changes, tree_changes
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", ["query_parse", "query_plan", "query_facets", "query_aliases", "section_landing", "alerts_in_texts", "openapi_in_texts"])
def test_composed_inputs(spark, name):
    got = composed.QUERIES[name](spark, "")
    want = duckdb.sql(composed.SQL[name])
    key = lambda r: tuple(str(v) for v in r)
    assert got.columns == want.columns and sorted((tuple(r) for r in got.collect()), key=key) == sorted(want.fetchall(), key=key)


def test_steps_go_around(spark):
    df = spark.createDataFrame([([4, 9, 11],), ([],)], "at array<int>")
    rows = df.select(*(T.stepped(F.col("at"), F.lit(c), f).alias(f"{c}{f}") for c in (0, 2) for f in (True, False))).collect()
    assert tuple(rows[0]) == (1, 2, 0, 1) and tuple(rows[1]) == (None,) * 4


def test_batches_of_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 8)).round(1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[5].tolist()), (100, None), (101, [0.0] * 8), (102, [float("nan")] * 8), (103, [1.0] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for block in (2048, 16):
        got = {(r.query_id, r.rank): (r.id, r.sim) for r in semantic.batch_topk(df.where("id % 30 = 0").withColumnRenamed("id", "query_id"), df, 4, block).collect()}
        assert len(got) == 12
        for q in (0, 30, 60):
            s = np.round(unit @ unit[q], 9)
            for rank, i in enumerate(np.lexsort((np.arange(90), -s))[:4], 1):
                assert got[q, rank][0] == i and abs(got[q, rank][1] - s[i]) < 1e-8
    assert semantic.batch_topk(df.where("id < 0").withColumnRenamed("id", "query_id"), df).count() == 0


def test_embedders():
    e = HashingEmbedder(16)
    m = TokenMean(lambda t: np.array([1.0, 0]) if t == "a" else np.array([0, 1.0]), 2)
    assert np.allclose(m.embed(["a b", "a", ""]), [[0.5**0.5, 0.5**0.5], [1, 0], [0, 0]])
    p = Prefixed(e, str.split, " ".join, window=4)
    assert np.allclose(p.embed(["x"], "query"), e.embed(["query: x"])) and not np.allclose(p.embed(["x"], "query"), p.embed(["x"], "passage"))
    assert np.allclose(p.embed(["x y z w v"], "passage"), e.embed(["passage: x y v"]))

    def missing():
        raise OSError("no model")

    assert first_usable(missing, lambda: e) is e
    with pytest.raises(RuntimeError):
        first_usable(missing)


def test_change_log(spark, tmp_path):
    listing = lambda rows: spark.createDataFrame(rows, "path string, rel_path string, mtime double, size long")
    log = ChangeLog(spark, f"file://{tmp_path}/log")
    first = [("/v/a.md", "a.md", 1.0, 1), ("/v/b.md", "b.md", 1.0, 1)]
    assert log.poll(listing(first)) == 0 and log.poll(listing(first)) == 1
    assert log.poll(listing([("/v/a.md", "a.md", 2.0, 1), ("/v/c.md", "c.md", 1.0, 1)])) == 2
    q = log.stream().writeStream.format("memory").queryName("seen_changes").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    seen = sorted((r.op, r.rel_path) for r in spark.table("seen_changes").collect())
    assert seen == [("create", "a.md"), ("create", "b.md"), ("create", "c.md"), ("remove", "b.md"), ("upsert", "a.md")]
    assert snapshot_changes(listing(first), listing(first), F.current_timestamp()).count() == 0


def test_changes_of_the_tree(spark):
    rows = [("/v/a", "create", 0.0), ("/v/b", "upsert", 0.05), ("/v/c", "remove", 0.1), ("/v/a", "rename", 5.0)]
    df = spark.createDataFrame(rows, "path string, op string, s double").withColumn("seen_at", F.timestamp_micros((F.col("s") * 1e6).cast("long")))
    assert sorted(r.n for r in tree_changes(df).collect()) == [1, 2]


def test_only_the_latest_search_counts(spark):
    latest, got = LatestOnly(spark), {}

    def slow():
        latest_started.set()

        def waiting(batches):
            for b in batches:
                time.sleep(1)
                yield b

        return spark.range(0, 80, 1, 80).mapInArrow(waiting, "id long").count()

    latest_started = threading.Event()
    t = threading.Thread(target=lambda: got.update(old=latest.run(slow)))
    t.start()
    latest_started.wait(10)
    time.sleep(4)
    began = time.perf_counter()
    got["new"] = latest.run(lambda: spark.range(7).count())
    t.join(60)
    assert got == {"old": None, "new": 7}
    assert time.perf_counter() - began < 12  # the old one would take 20 seconds


def test_vectors_in_batches_with_progress():
    class Fake:
        left = 70

        def counts(self):
            return {"pending": self.left}

        def embed_missing(self, embedder, most):
            n = min(self.left, most)
            self.left -= n
            return n

    told = []
    assert embed_continuously(Fake(), None, 32, progress=lambda d, t: told.append((d, t))) == 70
    assert told == [(32, 70), (64, 70), (70, 70), (70, 70)]

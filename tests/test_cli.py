import io
import json

from pyspark.sql import functions as F

from inkwell.cli import gold_rank, main, read_queries, serve, warehouse
from inkwell.functions import text as T
from inkwell.operators import evaluate


def test_text_functions(spark):
    df = spark.createDataFrame([("aXbxx. A note\n> [!TIP]\n > [!WARNING] x",), (None,), ("",)], "t string")
    r = df.select(T.positions(F.col("t"), "x").alias("p"), T.alerts(F.col("t")).alias("a"), T.occurrences(F.col("t"), "x").alias("n"), T.slug(F.lit(" Hello  - Wörld! ")).alias("s")).collect()
    assert r[0].p == [1, 3, 4, 37] and r[0].a == ["TIP", "WARNING"] and r[0].n == 4 and r[1].p == [] and r[2].n == 0
    assert r[0].s == "hello-wörld"
    t = spark.createDataFrame([("Résumé ABC の 検索語 ét x_y",)], "t string").select(T.tokens(F.col("t")).alias("k"), T.snippet(F.col("t"), ["zz", "abc"], 8).alias("s"), T.landing_phrase(F.lit("a `long enough text here` b")).alias("l")).first()
    assert t.k == ["resume", "abc", "の", "検索", "索語", "et", "x", "y"] and t.s == "…umé ABC …" and t.l == "long enough text here"


def test_evaluation(spark):
    ranks = spark.createDataFrame([("a", "x", 1), ("a", "y", 7), ("a", "y", None)], "mode string, type string, gold_rank int")
    got = {(r.mode, r.type): (r.n, r.r1, r.r10, r.mrr) for r in evaluate.recall_table(ranks, ["mode", "type"]).collect()}
    assert got["a", "x"] == (1, 1.0, 1.0, 1.0) and got["a", "ALL"] == (3, 0.333333, 0.666667, 0.380952)
    a = spark.createDataFrame([(1, "p"), (1, "q"), (2, "p")], "query_id int, item string")
    b = spark.createDataFrame([(1, "p"), (1, "p"), (2, "p"), (3, "z")], "query_id int, item string")
    pr = {r.query_id: (r.precision, r.recall, r.exact) for r in evaluate.precision_recall(a, b).collect()}
    assert pr == {1: (0.5, 1.0, False), 2: (1.0, 1.0, True), 3: (0.0, 0.0, False)}
    assert evaluate.mutual_neighbours(["ab", "abc", "x", "y"], [[1, 0.1], [1, 0], [-1, 1], [-1, 0.9]], 0.5) == [("x", "y", evaluate.mutual_neighbours(["ab", "abc", "x", "y"], [[1, 0.1], [1, 0], [-1, 1], [-1, 0.9]], 0.5)[0][2])]


def test_gold_and_server(spark, tmp_path):
    hits = spark.createDataFrame([("a/x.md",), ("a/x.md",), ("b/y.md",)], "rel_path string")
    assert gold_rank(hits, "y.md") == 2 and gold_rank(hits, "b/y.md") == 2 and gold_rank(hits, "no") is None
    out = io.StringIO()
    serve(None, io.StringIO('{"id": 1, "method": "ping"}\n\n{"method": "x"}\n{"id": 2, "method": "tools/list"}\n'), out)
    assert [json.loads(x)["id"] for x in out.getvalue().splitlines()] == [1, 2]
    (tmp_path / "q.json").write_text('[{"query": "a", "gold": "b.md"}]')
    assert read_queries(str(tmp_path / "q.json"))[0]["gold"] == "b.md"
    assert warehouse(str(tmp_path), "file:///w/").startswith("file:///w/") and main([]) == 2

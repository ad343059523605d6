import os

from pyspark.sql import functions as F

from inkwell.operators.embed import HashingEmbedder
from inkwell.operators.service import SearchService, handle, tool_filters
from inkwell.operators.vault import Changes, Vault
from inkwell.plans.query import Clock
from inkwell.sources.files import bundle, decoded, default_file, delimited, pretty_json, scan, tree, wanted
from inkwell.streaming.changes import apply_batch, follow, indexable


def write(root, name, text):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


def make(root):
    write(root, "login.md", "---\ntags: [api]\nstatus: draft\ndate: 2026-05-02\n---\n# 認証の流れ\nトークン認証を使う login flow\n- [ ] rest\n```swift\nx\n```\nsee [other](sub/other.md) and [[sub/other.md#Kept]]")
    write(root, "sub/other.md", "---\ntags: [api, old]\nstatus: done\n---\n# Other\nlogin flow of the archive\n## Kept\nmore text [up](login.md)")
    write(root, "config.yaml", "login: flow\nkind: yaml")
    write(root, ".hidden/no.md", "login flow")
    write(root, "build/no.md", "login flow")
    write(root, "picture.png", "x")


def service(v, **more):
    names = ("files", "chunks", "frontmatter", "tasks", "code_blocks", "segments")
    return SearchService({n: v.read(n).cache() for n in names} | {"links": v.resolved_links().cache()}, **more).cache()


def paths(df):
    return [r.rel_path for r in df.collect()]


def test_index_search_update(spark, tmp_path):
    root = str(tmp_path)
    make(root)
    v = Vault(spark)
    assert v.reconcile(scan(spark, root), 1.0) == Changes(3, 0, 0, 0)
    assert v.reconcile(scan(spark, root), 2.0) == Changes(0, 0, 0, 3)
    s = service(v)
    assert set(paths(s.search("login flow", mode="lexical"))) == {"login.md", "sub/other.md", "config.yaml"}
    found = paths(s.search("認証"))  # few hits: other words of the meaning join in, behind
    assert found[0] == "login.md" and set(found) == {"login.md", "sub/other.md", "config.yaml"}
    assert set(paths(s.search("login tag:api status:done"))) == {"sub/other.md"} and paths(s.search("tag:api lang:swift")) == ["login.md"]
    assert paths(s.search("is:todo date:2026-05")) == ["login.md"] and paths(s.search("")) == []
    top = s.search("認証 is:todo", mode="lexical").first()
    assert top.kinds == ["lexical", "structured"] and top.bm25 < 0 and "認証" in top.snippet and top.heading_slug == "認証の流れ"
    assert s.section("sub/other.md", "kept").first().section.startswith("# Other > Kept\n\n## Kept") and s.section("none.md").count() == 0
    assert [tuple(r) for r in s.backlinks("sub/other.md").collect()] == [("login.md", "認証の流れ", None), ("login.md", "認証の流れ", "Kept")]
    assert '"relPath": "login.md"' in handle(s, '{"id": 1, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "認証 is:todo"}}}').replace('\\"', '"')
    assert "-32601" in handle(s, '{"id": 1, "method": "x"}') and "-32602" in handle(s, '{"id": 1, "method": "tools/call", "params": {"name": "search"}}')
    assert handle(s, '{"method": "ping"}') is None and handle(s, "{") is None and '"tools"' in handle(s, '{"id": 2, "method": "tools/list"}')
    f = tool_filters({"tags": "a", "ext": ["md"], "modified_before": "2026-01-02", "is_task": "todo"}, Clock.at(0))
    assert f.tags == ("a",) and f.before == 1767312000.0 and f.task == "todo"

    os.remove(os.path.join(root, "config.yaml"))
    write(root, "login.md", "# Only\nfresh words")
    assert v.reconcile(scan(spark, root), 3.0) == Changes(0, 1, 1, 1)
    s = service(v)
    assert paths(s.search("認証", mode="lexical")) == [] and paths(s.search("fresh", mode="lexical")) == ["login.md"]

    emb = HashingEmbedder(64)
    assert v.embed_missing(emb) == 3 and v.embed_missing(emb) == 0 and v.counts() == {"files": 2, "chunks": 3, "vectors": 3, "pending": 0}
    hit = service(v, embedder=emb).search("fresh words", mode="semantic").first()
    assert hit.rel_path == "login.md" and hit.kinds == ["semantic"] and hit.best_passage and hit.semantic_score > 0.3
    assert v.use_model("other") and v.counts()["vectors"] == 0


def test_change_feed(spark, tmp_path):
    root, feed = str(tmp_path / "vault"), str(tmp_path / "feed")
    make(root)
    v = Vault(spark)
    v.reconcile(scan(spark, root), 1.0)
    read = lambda p: scan(spark, root).join(p, "path", "left_semi")
    row = lambda name, op, t: (os.path.join(os.path.realpath(root), name), name, op, t)
    schema = "path string, rel_path string, op string, seen_at long"
    write(root, "login.md", "# New\nchanged words")
    apply_batch(v, spark.createDataFrame([row("login.md", "remove", 1), row("login.md", "upsert", 2), row("sub/other.md", "upsert", 1), row("config.yaml", "remove", 3), row(".hidden/no.md", "upsert", 4)], schema), read)
    assert sorted(r.rel_path for r in v.read("files").collect()) == ["login.md", "sub/other.md"]
    write(root, "more.md", "# More\nstreamed")
    spark.createDataFrame([row("more.md", "upsert", 5)], schema).write.json(feed)
    follow(spark.readStream.schema(schema).json(feed), v, read, str(tmp_path / "cp"), seconds=None).awaitTermination()
    assert paths(service(v).search("streamed")) == ["more.md"] and v.read("files").count() == 3


def test_paths(spark):
    names = ["a.md", ".x/a.md", "build/a.md", "a/.b.md", "a/b.CSV", "x/y.YAML", "n"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "p string").select(indexable(F.col("p"))).collect()]
    assert got == [wanted(n) for n in names] == [True, False, False, False, False, True, False]


def test_files(tmp_path):
    make(str(tmp_path))
    rows = tree(str(tmp_path))
    assert ("sub", "", True) in rows and ("sub/other.md", "sub", False) in rows and not any("build" in r[0] for r in rows)
    assert default_file(rows) == "login.md" and default_file([("a/x.csv", "a", False), ("b/ReadMe.txt", "b", False)]) == "b/ReadMe.txt" and default_file([]) is None
    assert decoded("日本".encode("cp932")) == decoded("日本".encode()) == "日本" and decoded(b"\xff\xff\x81") == ""
    assert pretty_json('{"a":1}') == '{\n  "a": 1\n}' and pretty_json("{") == "{" and pretty_json("{\n}") == "{\n}"


def test_delimited():
    text = 'id,name\r\n1,"a ""q"", x\ny"\n\n2,b"c,extra\r3'
    assert delimited(text) == ([["id", "name"], ["1", 'a "q", x\ny'], ["2", 'b"c', "extra"], ["3"]], False)
    assert delimited("a\tb\n" * 6000, "\t")[1] and len(delimited("a\n" * 6000)[0]) == 5001 and delimited("") == ([], False)


def test_bundle():
    files = {
        "api/main.yaml": {"paths": {"x": {"$ref": "../lib/c.yaml#/defs/A"}, "y": {"$ref": "#/own"}, "z": {"$ref": "https://q/r"}, "w": {"$ref": "none.yaml#/q"}}, "own": 1},
        "lib/c.yaml": {"defs": {"A": {"b": {"$ref": "#/defs/B"}}, "B": {"a": {"$ref": "#/defs/A"}, "m": {"$ref": "../api/main.yaml#/own"}}}},
    }
    out = bundle("api/main.yaml", files)
    assert out["paths"]["x"] == {"$ref": "#/components/x-bundled/A"} and out["paths"]["y"] == {"$ref": "#/own"} and out["paths"]["w"] == {"$ref": "none.yaml#/q"}
    assert out["components"]["x-bundled"] == {"A": {"b": {"$ref": "#/components/x-bundled/B"}}, "B": {"a": {"$ref": "#/components/x-bundled/A"}, "m": {"$ref": "#/own"}}}


def test_scan_ends_below_the_twelfth_folder(tmp_path):
    from inkwell.sources.files import walk

    folder = tmp_path
    for n in range(14):
        (folder / f"f{n}.md").write_text("x")
        folder = folder / "d"
        folder.mkdir()
    assert [p.rsplit("/", 1)[-1] for p in walk(str(tmp_path))] == sorted((f"f{n}.md" for n in range(12)), key=lambda f: int(f[1:-3]))
    assert list(walk(str(tmp_path), 1)) == ["f0.md"]


def test_shared_folder_needs_a_setting_on_a_cluster(spark, monkeypatch):
    import pytest

    from inkwell.sources.tables import shared_dir

    class Away:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://there:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Away)
    assert shared_dir(spark) != shared_dir(spark)


def test_one_query_and_a_batch_give_the_same_scores(spark):
    from inkwell.operators import bm25

    rows = [(1, "a b a c"), (2, "b c"), (3, "a"), (4, None), (5, ""), (6, "d d a b")]
    df = spark.createDataFrame(rows, "chunk_id long, text string")
    laid, built = bm25.lay(df, "chunk_id", "text"), bm25.build(df, "chunk_id", "text")
    key = lambda d: {r.id: round(r.bm25, 9) for r in d.collect()}
    for text in ("a b", "a a", "zz a", "d", "", "c b a x"):
        q = spark.createDataFrame([(0, text)], "query_id int, query string")
        for strict in (True, False):
            one = key(bm25.search_text(laid, text, strict))
            assert one == key(bm25.search(laid, bm25.query_terms(q, not strict), strict)) == key(bm25.search_text(built, text, strict)), (text, strict)
    keep = spark.createDataFrame([(1,), (6,)], "id long")
    whole, some = key(bm25.search_text(laid, "a b")), key(bm25.search_text(laid, "a b", keep=keep))
    assert some == {i: v for i, v in whole.items() if i in (1, 6)} and laid.numbers()[0] == 6
    assert bm25.search_text(bm25.lay(df.limit(0), "chunk_id", "text"), "a b").count() == 0

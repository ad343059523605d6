"""Queries over composed inputs: search strings, places in sections, alerts, API documents.

The tables hold no search strings, so these queries bring their inputs along; their twins
state the results by the rules of the search language, as literal rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import filters, markdown
from inkwell.plans import query as plans
from inkwell.sources.files import is_openapi
from inkwell.sources.tables import table

#: Tuesday, 30 June 2026, 15:00 UTC.
NOW = datetime(2026, 6, 30, 15, tzinfo=timezone.utc).timestamp()
UNDERSTOOD = "n int, terms string, tags string, status string, paths string, exts string, langs string, pairs string, after string, before string, task string"


def _rows(*values: tuple) -> str:
    lit = lambda v: "null" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(lit, row)) + ")" for row in values)


def _texts(spark: SparkSession, some: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(some, 1)), "n int, text string")


def understood(strings: DataFrame, how: Callable, now: float = NOW) -> DataFrame:
    """What parse() or plan() makes of search strings (n, text), one row each: lists joined by
    "|", times to the minute."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clock = plans.Clock.at(now)
        at = lambda t: None if t is None else datetime.fromtimestamp(t, timezone.utc).strftime("%Y-%m-%d %H:%M")
        for batch in batches:
            out = []
            for n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                q = how(raw, clock)
                f = q.filters
                pairs = "|".join(f"{k}={v}" for k, v in f.frontmatter)
                out.append((n, "|".join(q.terms), *("|".join(x) for x in (f.tags, f.status, f.paths, f.exts, f.langs)), pairs, at(f.after), at(f.before), f.task))
            names = [c.split()[0] for c in UNDERSTOOD.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.string()) for k, c in enumerate(zip(*out))], names=names)

    return strings.mapInArrow(run, UNDERSTOOD)


#: (search string, terms, tags, status, paths, exts, langs, pairs, after, before, task)
PARSED = [
    ("tag:api status:draft flow", "flow", "api", "draft", "", "", "", "", None, None, None),
    ("tags:a tag:b", "", "a|b", "", "", "", "", "", None, None, None),
    ('"two words" x', "two words|x", "", "", "", "", "", "", None, None, None),
    ("https://a.b/c:d", "https://a.b/c:d", "", "", "", "", "", "", None, None, None),
    ("path:docs in:notes ext:.MD ext:yaml", "", "", "", "docs|notes", "md|yaml", "", "", None, None, None),
    ("lang:Swift code:PY", "", "", "", "", "", "swift|py", "", None, None, None),
    ("owner:Ann prio:1", "", "", "", "", "", "", "owner=Ann|prio=1", None, None, None),
    ("is:open", "", "", "", "", "", "", "", None, None, "todo"),
    ("is:checked", "", "", "", "", "", "", "", None, None, "done"),
    ("is:task", "", "", "", "", "", "", "", None, None, "any"),
    ("is:nothing", "", "", "", "", "", "", "", None, None, None),
    ("date:>2026-06-01", "", "", "", "", "", "", "", "2026-06-01 00:00", None, None),
    ("modified:<2026-06-01", "", "", "", "", "", "", "", None, "2026-06-02 00:00", None),
    ("date:2026-02", "", "", "", "", "", "", "", "2026-02-01 00:00", "2026-03-01 00:00", None),
    ("updated:2024", "", "", "", "", "", "", "", "2024-01-01 00:00", "2025-01-01 00:00", None),
    ("date:soon word", "word", "", "", "", "", "", "", None, None, None),
    ("a: :b c-d:e", "a:|:b|c-d:e", "", "", "", "", "", "", None, None, None),
    ("", "", "", "", "", "", "", "", None, None, None),
    ("mtime:>=2026-06-15 mtime:<=2026-06-20", "", "", "", "", "", "", "", "2026-06-15 00:00", "2026-06-21 00:00", None),
]
#: (search string, terms, after, before, task)
PLANNED = [
    ("先月 議事録", "議事録", "2026-05-01 00:00", "2026-06-01 00:00", None),
    ("notes yesterday", "notes", "2026-06-29 00:00", "2026-06-30 00:00", None),
    ("this week plan", "plan", "2026-06-28 00:00", None, None),
    ("last week", "", "2026-06-21 00:00", "2026-06-28 00:00", None),
    ("今日", "", "2026-06-30 00:00", None, None),
    ("去年 まとめ", "まとめ", "2025-01-01 00:00", "2026-01-01 00:00", None),
    ("過去7日 x", "x", "2026-06-23 15:00", None, None),
    ("last 30 days y", "y", "2026-05-31 15:00", None, None),
    ("todo list", "todo|list", None, None, "todo"),
    ("完了済 報告", "完了済|報告", None, None, "done"),
    ("todo 完了済", "todo|完了済", None, None, "todo"),
    ("todo is:done", "todo", None, None, "done"),
    ("先月 date:>2026-01-01", "", "2026-01-01 00:00", "2026-06-01 00:00", None),
    ("recently changed", "changed", "2026-06-23 15:00", None, None),
    ("ただの言葉", "ただの言葉", None, None, None),
    ("今年 tag:api", "", "2026-01-01 00:00", None, None),
]
#: (search string, facets taken back, facets shown)
FACETS = [
    ("先月 tag:api todo flow k:v", [], ["時間軸:2026-05", "タグ:api", "タスク:未完了", "k:v", "全文+意味:todo flow"]),
    ("先月 tag:api todo flow k:v", ["タスク:未完了"], ["時間軸:2026-05", "タグ:api", "k:v", "全文+意味:todo flow"]),
    ("先月 tag:api todo flow k:v", ["時間軸:2026-05", "タグ:api", "k:v"], ["タスク:未完了", "全文+意味:todo flow"]),
    ("date:>2026-06-01 x", [], ["時間軸:2026-06-01 以降", "全文+意味:x"]),
    ("status:draft path:docs ext:md lang:py is:done", [], ["状態:draft", "パス:docs", "拡張子:md", "言語:py", "タスク:完了"]),
    ("", [], []),
]
#: (search string, words of one meaning)
MEANT = [
    ("login page", ["ログイン", "サインイン", "認証", "auth"]),
    ("cache", ["キャッシュ"]),
    ("blue", []),
    ("plain", ["生成AI", "LLM", "エージェント"]),  # a word counts wherever its letters stand: pl-AI-n
    ("検索 速い", ["サーチ", "search", "高速化", "パフォーマンス", "performance", "最適化"]),
    ("foo x", ["bar"]),
]
SECTIONS = [
    ("# Head\nnothing here\nthe Watcher and a note", "watcher", None, "term", 2, 4, 7),
    ("# Watcher\nno term below", "watcher", None, "heading", 0, 0, 9),
    ("# Watcher", "watcher", None, "term", 0, 2, 7),
    ("## Part\nsome passage with words\nmore", "watcher", "With words", "phrase", 1, 13, 10),
    ("## Part\nnote then watcher", "watcher|note", None, "term", 1, 0, 4),
    ("## Part\nx", "", "", "heading", 0, 0, 7),
    ("", "a", None, "heading", 0, 0, 0),
]
ALERTS = [("> [!NOTE]\n> x", ["NOTE"]), ("text\n  > [!WARNING] y\n> [!TIP]", ["WARNING", "TIP"]), ("[!NOTE]", []), ("> [!note]", []), ("> [!CAUTION]\n\n>[!IMPORTANT]", ["CAUTION", "IMPORTANT"])]
API = [('{"openapi": "3.1.0"}', True), ("swagger: '2.0'\ninfo:", True), ("info:\nopenapi : 3.0.0", True), (" openapi: 3", False), ('{"openapi": 3}', False), ("x" * 4096 + "\nopenapi: 3", False), ("", False)]


def query_parse(spark: SparkSession, folder: str) -> DataFrame:
    return understood(_texts(spark, [p[0] for p in PARSED]), plans.parse)


def query_plan(spark: SparkSession, folder: str) -> DataFrame:
    return understood(_texts(spark, [p[0] for p in PLANNED]), plans.plan).select("n", "terms", "after", "before", "task")


def query_facets(spark: SparkSession, folder: str) -> DataFrame:
    clock = plans.Clock.at(NOW)
    rows = [(n, k, f.id) for n, (raw, back, _) in enumerate(FACETS, 1) for k, f in enumerate(plans.interpret(plans.without(plans.plan(raw, clock), set(back), clock), clock), 1)]
    return spark.createDataFrame(rows, "n int, pos int, facet string")


def query_aliases(spark: SparkSession, folder: str) -> DataFrame:
    rows = [(n, k, w) for n, (raw, _) in enumerate(MEANT, 1) for k, w in enumerate(plans.expand(raw, [["foo", "bar"]]), 1)]
    return spark.createDataFrame(rows, "n int, pos int, word string")


def section_landing(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for n, (section, terms, phrase, *_) in enumerate(SECTIONS, 1):
        df = spark.createDataFrame([(n, section, phrase)], "n int, section string, phrase string")
        got = df.select("n", T.landing(F.col("section"), [t for t in terms.split("|") if t], F.col("phrase")).alias("x")).select("n", "x.*")
        out = got if out is None else out.unionByName(got)
    return out


def alerts_in_texts(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, [a for a, _ in ALERTS]).select("n", F.posexplode(T.alerts(F.col("text"))).alias("pos", "alert"))


def openapi_in_texts(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, [a for a, _ in API]).select("n", F.coalesce(is_openapi(F.col("text")), F.lit(False)).alias("openapi"))


def find_steps(spark: SparkSession, folder: str) -> DataFrame:
    """In every chunk with the term: the occurrence after the last and before the first."""
    at = T.positions(F.col("text"), "the")
    rows = table(spark, folder, "chunks").dropDuplicates(["chunk_id"]).select("chunk_id", at.alias("at")).where(F.size("at") > 0)
    return rows.select("chunk_id", T.stepped(F.col("at"), F.size("at") - 1).alias("after_last"), T.stepped(F.col("at"), F.lit(0), False).alias("before_first"), T.stepped(F.col("at"), F.lit(0)).alias("after_first"))


def _documents(spark: SparkSession, folder: str, f: plans.Filters) -> DataFrame:
    """Documents as files that a filter on tasks or code admits."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("file_id"), "text")
    doc = markdown.parsed(docs, "file_id", "text")
    files = docs.select("file_id", F.lit(None).cast("double").alias("doc_date"), F.lit(0.0).alias("mtime"))
    code = doc.select("file_id", F.explode("doc.code_langs").alias("lang"))
    pairs = spark.createDataFrame([], "file_id bigint, key string, value string")
    return filters.matching(files, f, pairs, markdown.relation(doc, "file_id", "tasks"), code).select(F.col("file_id").alias("doc_id"))


def filter_code_lang(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder, plans.parse("lang:Python", plans.Clock.at(NOW)).filters)


def filter_open_task(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder, plans.parse("is:open", plans.Clock.at(NOW)).filters)


def filter_any_task_and_lang(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder, plans.parse("is:task lang:yaml", plans.Clock.at(NOW)).filters)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (query_parse, query_plan, query_facets, query_aliases, section_landing, alerts_in_texts, openapi_in_texts, find_steps, filter_code_lang, filter_open_task, filter_any_task_and_lang)
}


def _sql() -> dict[str, str]:
    from inkwell.catalogue import LINES

    listed = lambda names, rows: f"select * from (values {rows}) v({names})"
    lang = f"select doc_id from (select doc_id, lower(regexp_extract(trim(substring(bare, 4)), '^([^ \\t]+)', 1)) as lang from opens where trim(substring(bare, 4)) <> '')"
    task = "select doc_id from free where regexp_matches(bare, '^[-*+] *\\[{0}\\]') and length(bare) >= 5"
    return {
        "query_parse": listed("n, terms, tags, status, paths, exts, langs, pairs, after, before, task", _rows(*((n, *p[1:]) for n, p in enumerate(PARSED, 1)))),
        "query_plan": listed("n, terms, after, before, task", _rows(*((n, *p[1:]) for n, p in enumerate(PLANNED, 1)))),
        "query_facets": listed("n, pos, facet", _rows(*((n, k, f) for n, (_, _, shown) in enumerate(FACETS, 1) for k, f in enumerate(shown, 1)))),
        "query_aliases": listed("n, pos, word", _rows(*((n, k, w) for n, (_, some) in enumerate(MEANT, 1) for k, w in enumerate(some, 1)))),
        "section_landing": listed('n, "by", line, "at", length', _rows(*((n, *s[3:]) for n, s in enumerate(SECTIONS, 1)))),
        "alerts_in_texts": listed("n, pos, alert", _rows(*((n, k, a) for n, (_, some) in enumerate(ALERTS, 1) for k, a in enumerate(some)))),
        "openapi_in_texts": "select n, b = 1 as openapi from (values " + _rows(*((n, int(yes)) for n, (_, yes) in enumerate(API, 1))) + ") v(n, b)",
        "find_steps": """with c as (select distinct chunk_id, lower(text) as t from chunks), p as (select chunk_id, (len(string_split(t, 'the')) - 1)::int as n from c where contains(t, 'the'))
select chunk_id, 0 as after_last, n - 1 as before_first, case when n > 1 then 1 else 0 end as after_first from p""",
        "filter_code_lang": f"with {LINES} select distinct doc_id from ({lang} where lang = 'python')",
        "filter_open_task": f"with {LINES} select distinct doc_id from ({task.format(' ')})",
        "filter_any_task_and_lang": f"with {LINES} select distinct doc_id from ({task.format('[ xX]')}) where doc_id in ({lang} where lang = 'yaml')",
    }


SQL = _sql()

from datetime import datetime, timezone

from inkwell.plans.query import Clock, Filters, date_range, expand, interpret, load_aliases, parse, plan, without, words

NOW = datetime(2026, 6, 30, 15, 0, tzinfo=timezone.utc).timestamp()  # a Tuesday
CLOCK = Clock.at(NOW)


def at(*ymd):
    return datetime(*ymd, tzinfo=timezone.utc).timestamp()


def test_fields_terms_and_quotes():
    q = parse('tag:api status:draft "two words" flow ext:.MD lang:Swift path:docs k_1:V', CLOCK)
    assert q.filters == Filters(tags=("api",), status=("draft",), exts=("md",), langs=("swift",), paths=("docs",), frontmatter=(("k_1", "V"),))
    assert q.terms == ("two words", "flow")
    assert words('a "b c"d  e') == ["a", "b cd", "e"]


def test_what_is_no_field():
    q = parse("https://x.y/z :a b: c-d:e is:nonsense 10:30", CLOCK)
    assert q.terms == ("https://x.y/z", ":a", "b:", "c-d:e") and q.filters == Filters(frontmatter=(("10", "30"),))


def test_dates():
    f = lambda s: (parse(s, CLOCK).filters.after, parse(s, CLOCK).filters.before)
    assert f("date:>2026-06-01") == f("date:>=2026-06-01") == (at(2026, 6, 1), None)
    assert f("modified:<2026-06-01") == (None, at(2026, 6, 2))
    assert f("updated:2026-02") == (at(2026, 2, 1), at(2026, 3, 1))
    assert f("mtime:2024") == (at(2024, 1, 1), at(2025, 1, 1))
    assert f("date:2026-13-01") == (at(2027, 1, 1), at(2027, 1, 2)) and f("date:soon") == (None, None)
    assert date_range("", timezone.utc) is None


def test_tasks_in_fields_and_words():
    assert [parse(f"is:{w}", CLOCK).filters.task for w in ("task", "open", "DONE")] == ["any", "todo", "done"]
    q = plan("todo list", CLOCK)
    assert q.filters.task == "todo" and q.terms == ("todo", "list")
    assert plan("todo is:done", CLOCK).filters.task == "done" and plan("やること", CLOCK).filters.task is None


def test_the_first_list_of_task_words_decides():
    assert plan("todo リストの 完了済 を見る", CLOCK).filters.task == "todo"
    assert plan("完了済の報告", CLOCK).filters.task == "done"
    assert plan("未完了と対応済", CLOCK).filters.task == "todo"


def test_periods():
    f = lambda s: (plan(s, CLOCK).filters.after, plan(s, CLOCK).filters.before, plan(s, CLOCK).text)
    assert f("先月 議事録") == (at(2026, 5, 1), at(2026, 6, 1), "議事録")
    assert f("notes yesterday") == (at(2026, 6, 29), at(2026, 6, 30), "notes")
    assert f("this week") == (at(2026, 6, 28), None, "")
    assert f("last week x") == (at(2026, 6, 21), at(2026, 6, 28), "x")
    assert f("去年") == (at(2025, 1, 1), at(2026, 1, 1), "")
    assert f("過去7日 x") == (NOW - 7 * 86400, None, "x") == f("Last 7 days x")
    assert f("recently") == (NOW - 7 * 86400, None, "")
    assert f("今日 先週")[:2] == (at(2026, 6, 30), at(2026, 6, 28))
    assert f("先月 date:>2026-01-01")[:2] == (at(2026, 1, 1), at(2026, 6, 1))
    assert Clock.at(NOW, first_weekday=0).week().day == 29


def test_facets_and_taking_them_back():
    q = plan("先月 tag:api todo flow k:v", CLOCK)
    assert [f.id for f in interpret(q, CLOCK)] == ["時間軸:2026-05", "タグ:api", "タスク:未完了", "k:v", "全文+意味:todo flow"]
    assert without(q, {"タスク:未完了"}, CLOCK).filters.task is None
    rest = without(q, {"時間軸:2026-05", "タグ:api", "k:v"}, CLOCK).filters
    assert rest == Filters(task="todo")
    assert interpret(plan("date:>2026-06-01", CLOCK), CLOCK)[0].value == "2026-06-01 以降"


def test_aliases(tmp_path):
    assert "login" in expand("認証の流れ") and "認証" not in expand("認証の流れ")
    assert expand("zzz", [["zzz", "yyy"]]) == ["yyy"] and expand("zzz") == []
    (tmp_path / ".inkwell").mkdir()
    (tmp_path / ".inkwell/aliases.json").write_text('[["a", "b"], ["c"]]')
    assert load_aliases(str(tmp_path)) == [["a", "b"]]
    (tmp_path / ".inkwell/aliases.json").write_text("{")
    assert load_aliases(str(tmp_path)) == []


def test_batch_queries_keep_all_terms(spark):
    from inkwell.operators.bm25 import query_terms

    queries = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(90)))], "query_id int, query string")
    assert query_terms(queries, relaxed=True, most=None).count() == 90 and query_terms(queries, relaxed=True).count() == 32


def test_registered_batch_uses_whole_items(spark, tmp_path):
    from inkwell import catalogue

    text = " ".join(f"word{i}" for i in range(90))
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(str(tmp_path / "eval_items.parquet"))
    spark.createDataFrame([(5, 1, 0, "about word80 only")], "chunk_id long, file_id long, pos int, text string").write.parquet(str(tmp_path / "chunks.parquet"))
    assert catalogue.QUERIES["bm25_batch_topk"](spark, str(tmp_path)).count() == 1

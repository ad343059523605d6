"""All core queries by name, with their SQL twins. Every query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import bm25, evaluate, filters, fusion, links, manifest, markdown, references, semantic, vault
from inkwell.plans import query as plans
from inkwell.sources.files import is_openapi
from inkwell.sources.tables import once, table
from inkwell.streaming.changes import sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


QUERIES["p3_found"], SQL["p3_found"] = references.p3_found, references.P3_SQL
QUERIES["p3_counts"], SQL["p3_counts"] = references.p3_counts, references.P3_COUNTS_SQL
QUERIES["p6_found"], SQL["p6_found"] = manifest.p6_found, manifest.P6_SQL

# --- parts of SQL that several twins share --------------------------------------------------

C, NOT_C = T.CJK, "\\p{L}\\p{N}"
RUNS = f"""
runs as (select id, unnest(regexp_extract_all(regexp_replace(lower(text), '([{C}]+)', ' \\1 ', 'g'), '[{C}]+|(?:[{NOT_C}]\\p{{M}}*)+')) as run from texts where text is not null),
toks as (select id, unnest(case when regexp_matches(run, '^[{C}]') and length(run) > 1 then list_transform(range(1, length(run)), lambda i: substring(run, i, 2))
                                when regexp_matches(run, '^[{C}]') then [run] else [strip_accents(run)] end) as term from runs)"""
CHUNK_TEXTS = "texts as (select distinct chunk_id as id, text from chunks)"
BM25 = """
tf as (select term, id, count(*) as tf from toks group by all),
dl as (select t.id, count(k.term) as dl from texts t left join toks k on t.id = k.id group by t.id),
n as (select term, count(*) as n from tf group by term),
st as (select count(*) as big_n, avg(dl) as avgdl from dl),
sc as (select q.query_id, tf.id, count(*) as got, any_value(q.wanted) as wanted,
  -sum(case when ln((big_n - n + 0.5) / (n + 0.5)) <= 0 then 1e-6 else ln((big_n - n + 0.5) / (n + 0.5)) end
       * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) * q.mult) as bm25
  from tf join q on tf.term = q.term join n on tf.term = n.term join dl on tf.id = dl.id cross join st group by q.query_id, tf.id)"""
UNITS = """
seg as (select distinct on (seg_id) seg_id, chunk_id, file_id, seg, vec::double[] as v from segments where len(vec) = 64 and len(list_filter(vec, lambda x: isnan(x) or isinf(x) or x is null)) = 0),
u as (select seg_id, chunk_id, file_id, seg, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as u from seg where list_dot_product(v, v) > 0)"""
QUERY_VECTOR = "qv as (select u as q from u order by seg_id limit 1)"


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return once(table(spark, folder, "chunks"), "chunk_id")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return once(table(spark, folder, "files"), "file_id")


def _index(spark: SparkSession, folder: str) -> bm25.Index:
    return bm25.lay(_chunks(spark, folder), "chunk_id", "text")


def _terms(spark: SparkSession, text: str, relaxed: bool = False) -> DataFrame:
    return bm25.query_terms(spark.createDataFrame([(1, text)], "query_id int, query string"), relaxed)


def _q(text: str) -> str:
    words: dict[str, int] = {}
    for w in text.lower().split():
        words[w] = words.get(w, 0) + 1
    rows = ", ".join(f"(1, '{w}', {n}, {len(words)})" for w, n in words.items())
    return f"q as (select * from (values {rows}) as v(query_id, term, mult, wanted))"


# --- text and index ----------------------------------------------------------------------


@query(f"with {CHUNK_TEXTS}, {RUNS} select id as chunk_id, term, count(*) as tf from toks group by all")
def postings(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).postings.select(F.col("id").alias("chunk_id"), "term", F.col("tf").cast("bigint").alias("tf"))


@query(f"with {CHUNK_TEXTS}, {RUNS} select term, count(distinct id) as n from toks group by term")
def token_document_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).df.select("term", "n")


@query(f"with {CHUNK_TEXTS}, {RUNS}, d as (select t.id, count(k.term) as dl from texts t left join toks k on t.id = k.id group by t.id) select count(*) as n_records, round(avg(dl), 6) as avgdl from d")
def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).stats().select("n_records", F.round("avgdl", 6).alias("avgdl"))


def _top(scored: DataFrame, k: int = 20) -> DataFrame:
    return bm25.best(scored.withColumn("bm25", F.round("bm25", 6)), F.col("bm25"), k).select("query_id", F.col("id").alias("chunk_id"), "bm25", "rank")


def _first(scored: DataFrame, k: int = 20) -> DataFrame:
    """_top() of one query: the best are taken before they are numbered."""
    top = scored.select(F.lit(1).alias("query_id"), "id", F.round("bm25", 6).alias("bm25")).orderBy("bm25", "id").limit(k)
    return bm25.best(top, F.col("bm25"), k).select("query_id", F.col("id").alias("chunk_id"), "bm25", "rank")


TOP = "select query_id, id as chunk_id, bm25, rank from (select query_id, id, bm25, row_number() over (partition by query_id order by bm25, id)::int as rank from (select query_id, id, round(bm25, 6) as bm25 from sc {0})) where rank <= 20"
TEXT = "team review review watcher"


@query(f"with {CHUNK_TEXTS}, {RUNS}, {_q(TEXT)}, {BM25} {TOP.format('where got = wanted')}")
def bm25_strict_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _first(bm25.search_text(_index(spark, folder), TEXT))


@query(f"with {CHUNK_TEXTS}, {RUNS}, {_q('team review watcher')}, {BM25} {TOP.format('')}")
def bm25_relaxed_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _first(bm25.search_text(_index(spark, folder), TEXT, strict=False))


@query(
    f"with {CHUNK_TEXTS}, {RUNS}, {_q('the review')}, {BM25}, keep as (select chunk_id from chunks where file_id in (select file_id from files where rel_path ilike '%inbox%' and ext in ('md'))) {TOP.format('where got = wanted and id in (select chunk_id from keep)')}"
)
def bm25_filtered_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of the corpus stay those of all chunks under a filter."""
    files = filters.matching(_files(spark, folder), plans.Filters(paths=("inbox",), exts=("md",)), table(spark, folder, "frontmatter"))
    keep = _chunks(spark, folder).join(files.select("file_id"), "file_id", "left_semi").select(F.col("chunk_id").alias("id"))
    return _top(bm25.search(_index(spark, folder), _terms(spark, "the review"), keep=keep))


_ASKED = "itexts as (select item_id as id, text from eval_items)"
_ASKED_RUNS = RUNS.replace("texts", "itexts").replace("runs", "iruns").replace("toks", "itoks")


@query(f"with {CHUNK_TEXTS}, {RUNS}, {_ASKED}, {_ASKED_RUNS}, q as (select id as query_id, term, 1 as mult, 0 as wanted from itoks group by all), {BM25} {TOP.format('')}")
def bm25_batch_topk(spark: SparkSession, folder: str) -> DataFrame:
    """All evaluation items as relaxed queries in one plan, with all of their terms."""
    items = table(spark, folder, "eval_items").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return _top(bm25.search(_index(spark, folder), bm25.query_terms(items, relaxed=True, most=None), strict=False))


@query(
    """with d as (select distinct chunk_id, text from chunks), t as (select distinct chunk_id, lower(unnest(regexp_extract_all(text, '[\\p{Katakana}ー]{3,}|[A-Za-z][A-Za-z0-9.+-]{2,}'))) as term from d where text is not null),
n as (select term, count(*) as n from t group by term)
select term, n from n where n >= 2 and n <= greatest(2, floor((select count(*) from d) * 0.4)) order by n desc, term limit 400"""
)
def df_band_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.vocabulary(_chunks(spark, folder))


@query("select doc_id, md5(text) as content_hash from documents")
def md5_content_hash(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("content_hash"))


# --- snapshots ---------------------------------------------------------------------------

DIFF = """
a as (select path, lower(content_hash) as h from (select *, row_number() over (partition by path order by indexed_at desc, file_id desc) as n from files) where n = 1),
b as (select path, lower(content_hash) as h from (select *, row_number() over (partition by path order by seen_at desc, change_id desc) as n from file_changes where op = 'remove' or content_hash is not null) where n = 1 and op = 'upsert'),
d as (select coalesce(a.path, b.path) as path, case when a.path is null then 'new' when b.path is null then 'gone' when a.h is not distinct from b.h then 'same' else 'changed' end as status from a full join b on a.path = b.path)"""


def _diff(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "files").where("path is not null").groupBy("path").agg(F.max_by("content_hash", F.struct("indexed_at", "file_id")).alias("content_hash"))
    seen = manifest.watched(table(spark, folder, "file_changes")).select(F.col("key").alias("path"), F.col("hash").alias("content_hash"))
    return vault.snapshot_diff(f, seen)


@query(f"with {DIFF} select path, status from d")
def snapshot_diff_status(spark: SparkSession, folder: str) -> DataFrame:
    return _diff(spark, folder)


@query(f"with {DIFF} select status, count(*) as n from d group by status")
def reconcile_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _diff(spark, folder).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# --- filters -----------------------------------------------------------------------------

F_SQL = "select distinct file_id from files f where "


def _filtered(f: plans.Filters) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: filters.matching(_files(spark, folder), f, table(spark, folder, "frontmatter")).select("file_id")


for _name, _filter, _where in [
    ("filter_tag_semi", plans.Filters(tags=("howto",)), "exists (select 1 from frontmatter m where m.file_id = f.file_id and lower(m.key) in ('tags', 'tag') and m.value = 'howto')"),
    ("filter_status_semi", plans.Filters(status=("draft",)), "exists (select 1 from frontmatter m where m.file_id = f.file_id and lower(m.key) = 'status' and m.value = 'draft')"),
    ("filter_generic_key", plans.Filters(frontmatter=(("status", "published"), ("tags", "archive"))), "exists (select 1 from frontmatter m where m.file_id = f.file_id and lower(m.key) = 'status' and m.value = 'published') and exists (select 1 from frontmatter m where m.file_id = f.file_id and lower(m.key) = 'tags' and m.value = 'archive')"),
    ("filter_ext_in", plans.Filters(exts=("yaml", "json", "mmd")), "ext in ('yaml', 'json', 'mmd')"),
    ("filter_path_ilike", plans.Filters(paths=("NOTE", "1_")), "rel_path ilike '%NOTE%' and rel_path ilike '%1_%'"),
    ("filter_date_range", plans.Filters(after=1735689600.0, before=1767225600.0), "case when doc_date > 0 then doc_date else mtime end >= 1735689600 and case when doc_date > 0 then doc_date else mtime end < 1767225600"),
]:
    QUERIES[_name], SQL[_name] = _filtered(_filter), F_SQL + _where


@query("select distinct chunk_id from chunks where chunk_id is not null and chunk_id not in (select chunk_id from segments where len(vec) > 0 and chunk_id is not null)")
def filter_missing_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that have no vector yet."""
    done = table(spark, folder, "segments").where(F.size("vec") > 0).select("chunk_id")
    return _chunks(spark, folder).where("chunk_id is not null").join(done, "chunk_id", "left_anti").select("chunk_id")


@query("select (select count(distinct file_id) from files) as files, (select count(distinct chunk_id) from chunks) as chunks, (select count(distinct chunk_id) from segments where len(vec) > 0) as with_vectors")
def index_counts(spark: SparkSession, folder: str) -> DataFrame:
    n = lambda df, c, name: df.agg(F.count_distinct(c).alias(name))
    a, b = n(table(spark, folder, "files"), "file_id", "files"), n(table(spark, folder, "chunks"), "chunk_id", "chunks")
    c = n(table(spark, folder, "segments").where(F.size("vec") > 0), "chunk_id", "with_vectors")
    return a.join(F.broadcast(b)).join(F.broadcast(c))  # one row each


@query(
    """with c as (select file_id, chunk_id, heading_slug, row_number() over (partition by file_id order by start_line, chunk_id) as n from (select distinct * from chunks))
select f.file_id, f.rel_path, c.chunk_id, c.heading_slug from (select distinct * from files) f left join c on c.file_id = f.file_id and c.n = 1 where lower(f.ext) in ('md')"""
)
def structured_first_chunk(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder).where(F.lower("ext").isin("md"))
    return filters.structured(files, _chunks(spark, folder)).select("file_id", "rel_path", "chunk_id", "heading_slug")


# --- Markdown structure ------------------------------------------------------------------

LINES = r"""
raw as (select doc_id, replace(unnest(string_split(text, chr(10))), chr(13), '') as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents where text is not null),
fm as (select doc_id, min(n) as fm_end from raw r where n > 1 and line = '---' and exists (select 1 from raw x where x.doc_id = r.doc_id and x.n = 1 and x.line = '---') group by doc_id),
body as (select r.doc_id, r.n, r.line, trim(r.line, ' ' || chr(9)) as bare from raw r left join fm on r.doc_id = fm.doc_id where n > coalesce(fm_end, 0)),
marks as (select doc_id, n, left(bare, 3) as m from body where left(bare, 3) in ('```', '~~~')),
fence as (select b.*, left(bare, 3) in ('```', '~~~') as is_mark, sum(case when left(bare, 3) in ('```', '~~~') then 1 else 0 end) over (partition by doc_id order by n) as k from body b),
free as (select doc_id, n, line, bare from fence where k % 2 = 0 and not is_mark),
opens as (select doc_id, n, bare from fence where is_mark and k % 2 = 1)"""
WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(12288)"
STRIP = r"trim(regexp_replace(regexp_replace({0}, '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[*_`]|~~', '', 'g'))"


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    return markdown.parsed(table(spark, folder, "documents"), "doc_id", "text")


@query(f"with {LINES}, h as (select doc_id, n, length(regexp_extract(line, '^(#{{1,6}}) ', 1)) as level, {STRIP.format(chr(39).join(['regexp_replace(trim(regexp_extract(line, ', '^#{1,6} (.*)$', ', 1)), ', '#+$', ', ', '', ')']))} as text from free where regexp_matches(line, '^#{{1,6}} ')) select doc_id, n::int as line, level::int as level, text from h where text <> ''")
def md_headings(spark: SparkSession, folder: str) -> DataFrame:
    return markdown.relation(_parsed(spark, folder), "doc_id", "headings").select("doc_id", "line", "level", "text")


@query(f"with {LINES} select doc_id, n::int as line, regexp_extract(bare, '^[-*+] *\\[([ xX])\\]', 1) <> ' ' as checked, {STRIP.format(chr(39).join(['regexp_extract(bare, ', '^[-*+] *\\[[ xX]\\](.*)$', ', 1)']))} as text from free where regexp_matches(bare, '^[-*+] *\\[[ xX]\\]') and length(bare) >= 5")
def md_tasks(spark: SparkSession, folder: str) -> DataFrame:
    return markdown.relation(_parsed(spark, folder), "doc_id", "tasks").select("doc_id", "line", "checked", "text")


@query(f"with {LINES} select distinct doc_id, lower(regexp_extract(trim(substring(bare, 4)), '^([^ \\t]+)', 1)) as lang from opens where trim(substring(bare, 4)) <> ''")
def md_code_langs(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder).select("doc_id", F.explode("doc.code_langs").alias("lang"))


@query(
    rf"""with {LINES}, l as (select doc_id, unnest(regexp_extract_all(line, '\[[^\]]*\]\(([^)\s]+)(?:\s+"[^"]*")?\)', 1)) as url, false as wiki from free
union all select doc_id, unnest(regexp_extract_all(line, '\[\[([^\]]+)\]\]', 1)), true from free),
p as (select doc_id, wiki, regexp_extract(url, '^[^#]*') as path, case when url like '%#%' then regexp_extract(url, '#(.*)$', 1) end as anchor from l)
select doc_id, case when wiki then 'wiki' when regexp_matches(path, '^[a-z][a-z0-9+.-]*:') then 'external' when lower(path) like '%.md' then 'md' else 'asset' end as kind, path as target_path, anchor, count(*) as n from p group by all"""
)
def md_links(spark: SparkSession, folder: str) -> DataFrame:
    return markdown.relation(_parsed(spark, folder), "doc_id", "links").groupBy("doc_id", "kind", "target_path", "anchor").agg(F.count(F.lit(1)).alias("n"))


_HEAD_TEXT = STRIP.format("regexp_replace(trim(regexp_extract(line, '^#{1,6} (.*)$', 1)), '#+$', '')")


@query(
    rf"""with {LINES}, h0 as (select doc_id, n, length(regexp_extract(line, '^(#{{1,6}}) ', 1)) as level, {_HEAD_TEXT} as text from free where regexp_matches(line, '^#{{1,6}} ')),
h1 as (select *, trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_ -]', '', 'g'), '[ -]+', '-', 'g'), '-') as base from h0 where text <> ''),
h as (select *, case when row_number() over w = 1 then base else base || '-' || (row_number() over w - 1) end as slug from h1 window w as (partition by doc_id, base order by n)),
up as (select h.doc_id, h.n, string_agg(g.text, ' > ' order by g.n) as path from h join h g on g.doc_id = h.doc_id and g.n <= h.n
  and (g.n = h.n or g.level < h.level) and not exists (select 1 from h k where k.doc_id = h.doc_id and k.n > g.n and k.n < h.n and k.level <= g.level) group by all),
first as (select doc_id, min(n) as n from body group by doc_id),
s as (select doc_id, n, slug, path from h join up using (doc_id, n) union all select doc_id, n, '', '' from first where not exists (select 1 from h where h.doc_id = first.doc_id and h.n = first.n)),
e as (select *, coalesce(lead(n) over (partition by doc_id order by n) - 1, (select max(b.n) from body b where b.doc_id = s.doc_id)) as last from s),
t as (select e.doc_id, slug as heading_slug, path as heading_path, trim(string_agg(b.line, chr(10) order by b.n), {WHITE}) as text, e.n::int as start_line, e.last::int as end_line from e join body b on b.doc_id = e.doc_id and b.n between e.n and e.last group by all)
select * from t where text <> ''"""
)
def md_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of all documents with slugs, breadcrumbs and lines."""
    return markdown.relation(_parsed(spark, folder), "doc_id", "chunks")


@query(
    rf"""with {LINES}, l as (select r.doc_id, r.n, r.line, trim(r.line, {WHITE}) as bare from raw r join fm on r.doc_id = fm.doc_id where r.n > 1 and r.n < fm.fm_end),
k as (select *, bare like '- %' as item, trim(split_part(line, ':', 1), {WHITE}) as key, trim(substring(line, instr(line, ':') + 1), {WHITE}) as v from l where bare <> '' and (bare like '- %' or instr(line, ':') > 0)),
o as (select *, last_value(case when not item then key end ignore nulls) over w as under, last_value(case when not item then v end ignore nulls) over w as under_v from k window w as (partition by doc_id order by n rows unbounded preceding)),
p as (select doc_id, n, under as key, [trim(substring(bare, 3), {WHITE})] as vs from o where item and under_v = ''
  union all select doc_id, n, key, case when v like '[%]' then list_transform(string_split(v[2:-2], ','), lambda x: trim(x, {WHITE})) else [v] end from o where not item and v <> '' and key <> ''),
q as (select doc_id, n, key, unnest(vs) as v, generate_subscripts(vs, 1) as i from p),
u as (select doc_id, n, i, lower(key) as key, case when length(v) >= 2 and left(v, 1) = right(v, 1) and left(v, 1) in (chr(34), chr(39)) then v[2:-2] else v end as value from q)
select doc_id, (row_number() over (partition by doc_id order by n, i) - 1)::int as pos, key, value from u where value <> ''"""
)
def md_frontmatter(spark: SparkSession, folder: str) -> DataFrame:
    return markdown.relation(_parsed(spark, folder), "doc_id", "frontmatter")


@query(
    rf"""with c as (select distinct chunk_id, trim(text, {WHITE}) as whole from chunks where trim(text, {WHITE}) <> ''),
p as (select chunk_id, whole, unnest(regexp_split_to_array(whole, '\n(?:[^\S\n]*\n)+')) as p, generate_subscripts(regexp_split_to_array(whole, '\n(?:[^\S\n]*\n)+'), 1) as i from c),
j as (select chunk_id, whole, i, array_to_string(list_transform(string_split(p, chr(10)), lambda x: trim(x, {WHITE})), ' ') as p from p),
r as (select chunk_id, whole, i, case when length(p) <= 220 then [p] else list_reduce(list_transform(regexp_extract_all(p, '[^。！？.!?]*[。！？.!?]|[^。！？.!?]+$'), lambda x: [x]),
  lambda acc, x: case when length(acc[-1]) + length(x[1]) > 220 then list_append(acc, x[1]) else list_append(acc[:-2], acc[-1] || x[1]) end) end as runs from j),
k as (select chunk_id, i, unnest(runs) as segment, generate_subscripts(runs, 1) as n, len(runs) as most from r),
good as (select * from k where n < most or length(segment) >= 4),
found as (select chunk_id, (row_number() over (partition by chunk_id order by i, n) - 1)::int as seg, segment from good)
select * from found union all select chunk_id, 0, left(whole, 220) from c where chunk_id not in (select chunk_id from good)"""
)
def segment_text(spark: SparkSession, folder: str) -> DataFrame:
    return markdown.segmented(_chunks(spark, folder))


@query(
    """with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents where text is not null),
w as (select doc_id, i // 80 as w, min(i) + 1 as start_line, max(i) + 1 as end_line, max(case when trim(line, ' ' || chr(9) || chr(13) || '　') <> '' then 1 else 0 end) as full_of from l where i < 4000 group by all)
select doc_id, start_line::int as start_line, end_line::int as end_line from w where full_of = 1"""
)
def plain_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of 80 lines of every text, as for files that are no Markdown."""
    lines = F.slice(F.split("text", "\n"), 1, markdown.MOST_LINES)
    rows = table(spark, folder, "documents").select("doc_id", F.posexplode(lines).alias("i", "line"))
    w = rows.groupBy("doc_id", F.floor(F.col("i") / markdown.WINDOW_LINES).alias("w"))
    out = w.agg((F.min("i") + 1).alias("start_line"), (F.max("i") + 1).alias("end_line"), F.bool_or(F.trim(F.regexp_replace("line", r"[\s　]", "")) != "").alias("any"))
    return out.where("any").select("doc_id", "start_line", "end_line")


@query(
    """with v as (select file_id, value, row_number() over (partition by file_id order by pos, fm_id) as n from (select distinct * from frontmatter) where lower(key) in ('date', 'published', 'published_at', 'created', 'created_at', 'updated') and file_id is not null)
select file_id, epoch(try_strptime(left(value, 10), ['%Y-%m-%d', '%Y/%m/%d', '%Y-%m', '%Y']))::double as doc_date from v where n = 1 and value is not null"""
)
def doc_date_coalesce(spark: SparkSession, folder: str) -> DataFrame:
    fm = once(table(spark, folder, "frontmatter"), "fm_id").where("file_id is not null")
    first = fm.where(F.lower("key").isin(*markdown.DATE_KEYS)).groupBy("file_id").agg(F.min_by(F.struct("value"), F.struct("pos", "fm_id")).alias("v")).where("v.value is not null")
    return vault.document_date(first.select("file_id", F.lit("date").alias("key"), F.lit(0).alias("pos"), "v.value"))


@query(
    """with h as (select file_id, arg_min(text, line) as h1 from (select distinct * from headings) where level = 1 and text is not null group by file_id)
select f.file_id, coalesce(nullif(f.title, ''), nullif(h.h1, ''), regexp_replace(regexp_replace(f.rel_path, '^.*/', ''), '\\.[^.]*$', '')) as title from (select distinct * from files) f left join h on f.file_id = h.file_id"""
)
def title_coalesce(spark: SparkSession, folder: str) -> DataFrame:
    h = table(spark, folder, "headings").where("level = 1 and text is not null").groupBy("file_id").agg(F.min_by("text", "line").alias("h1"))
    stem = F.regexp_replace(F.element_at(F.split("rel_path", "/"), -1), r"\.[^.]*$", "")
    return _files(spark, folder).join(h, "file_id", "left").select("file_id", F.coalesce(F.nullif("title", F.lit("")), F.nullif("h1", F.lit("")), stem).alias("title"))


# --- links -------------------------------------------------------------------------------

RESOLVED = """
f as (select distinct * from files), by_path as (select rel_path, min(file_id) as fid from f group by rel_path),
l as (select l.*, s.dir as src_dir from (select distinct * from links) l left join f s on l.src_file_id = s.file_id),
r as (select l.link_id, l.src_file_id, l.kind, l.anchor, case when kind in ('md', 'wiki') and target_path <> '' then case when a.fid is not null then target_path when b.fid is not null then src_dir || '/' || target_path end end as target_rel,
  case when kind in ('md', 'wiki') and target_path <> '' then coalesce(a.fid, b.fid) end as target_file_id
  from l left join by_path a on a.rel_path = target_path left join by_path b on b.rel_path = src_dir || '/' || target_path)"""


def _resolved(spark: SparkSession, folder: str) -> DataFrame:
    return links.resolve(once(table(spark, folder, "links"), "link_id"), _files(spark, folder))


@query(f"with {RESOLVED} select link_id, target_rel, target_file_id from r")
def link_resolve(spark: SparkSession, folder: str) -> DataFrame:
    return _resolved(spark, folder).select("link_id", "target_rel", "target_file_id")


@query(f"with {RESOLVED} select r.target_rel, s.rel_path as src_rel, s.title, r.anchor, count(*) as n from r join f s on r.src_file_id = s.file_id where r.target_rel is not null group by all")
def backlinks(spark: SparkSession, folder: str) -> DataFrame:
    out = links.backlinks(_resolved(spark, folder), _files(spark, folder))
    return out.groupBy("target_rel", "src_rel", "title", "anchor").agg(F.count(F.lit(1)).alias("n"))


@query("select kind, case when anchor is null or anchor = '' then false else true end as has_anchor, count(*) as n from (select distinct * from links) group by all")
def link_kinds(spark: SparkSession, folder: str) -> DataFrame:
    has = F.coalesce(F.col("anchor") != "", F.lit(False))
    return once(table(spark, folder, "links"), "link_id").groupBy("kind", has.alias("has_anchor")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """with c as (select file_id, heading_path, text, row_number() over (partition by file_id order by start_line, chunk_id) as n from (select distinct * from chunks)), f as (select distinct * from files)
select f.rel_path, '# ' || coalesce(nullif(c.heading_path, ''), f.title, '') || chr(10) || chr(10) || c.text as section from f join c on f.file_id = c.file_id where n = 1"""
)
def section_fetch(spark: SparkSession, folder: str) -> DataFrame:
    """The first section of every file, as the section tool shows it."""
    first = filters.first_chunks(_chunks(spark, folder)).select("file_id", "heading_path", "text")
    head = F.coalesce(F.nullif("heading_path", F.lit("")), "title", F.lit(""))
    return _files(spark, folder).join(first, "file_id").select("rel_path", F.concat(F.lit("# "), head, F.lit("\n\n"), F.col("text")).alias("section"))


# --- vectors -----------------------------------------------------------------------------


def _units(spark: SparkSession, folder: str) -> tuple[DataFrame, list[float]]:
    units = semantic.unit_segments(table(spark, folder, "segments"))
    first = units.orderBy("seg_id").limit(1).collect()
    return units, list(first[0].u) if first else [0.0] * 64


SIM = f"{UNITS}, {QUERY_VECTOR}, s as (select seg_id, chunk_id, file_id, seg, round(list_dot_product(u, q), 9) as sim from u cross join qv)"
BEST = "b as (select chunk_id, file_id, sim, seg as best_seg from (select *, row_number() over (partition by chunk_id order by sim desc, seg, seg_id) as n from s) where n = 1)"
CENT = """pos as (select file_id, generate_subscripts(u, 1) as i, unnest(u) as x from u), sums as (select file_id, i, sum(x) as x from pos group by all),
raw_cent as (select file_id, list(x order by i) as v from sums group by file_id),
cent as (select file_id, round(list_dot_product(v, q) / sqrt(list_dot_product(v, v)), 9) as cent from raw_cent cross join qv)"""
SUPP = "supp as (select file_id, avg(sim) as support from (select *, row_number() over (partition by file_id order by sim desc, seg_id) as n from s) where n <= 2 group by file_id)"


@query(f"with {SIM} select seg_id, round(sim, 6) as sim from s order by sim desc, seg_id limit 20")
def semantic_topk(spark: SparkSession, folder: str) -> DataFrame:
    units, q = _units(spark, folder)
    top = semantic.similarities(units, q).orderBy(F.desc("sim"), "seg_id").limit(20)
    return top.select("seg_id", F.round("sim", 6).alias("sim"))


@query(f"with {SIM}, {BEST} select chunk_id, best_seg, round(sim, 6) as sim from b")
def semantic_segment_max(spark: SparkSession, folder: str) -> DataFrame:
    units, q = _units(spark, folder)
    return semantic.chunk_best(semantic.similarities(units, q)).select("chunk_id", "best_seg", F.round("sim", 6).alias("sim"))


@query(
    """with u as (select distinct on (seg_id) seg_id as id, vec::double[] as v from segments where len(vec) = 64 and len(list_filter(vec, lambda x: isnan(x) or isinf(x) or x is null)) = 0 and list_dot_product(vec::double[], vec::double[]) > 0),
s as (select q.id as query_id, r.id, round(list_dot_product(q.v, r.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(r.v, r.v)), 9) as sim from u q, u r where q.id % 100 = 0)
select query_id, id as seg_id, rank, round(sim, 6) as sim from (select *, row_number() over (partition by query_id order by sim desc, id)::int as rank from s) where rank <= 10"""
)
def semantic_batch_topk(spark: SparkSession, folder: str) -> DataFrame:
    """A batch of queries, every segment whose id is divisible by 100, against all segments."""
    rows = table(spark, folder, "segments").select(F.col("seg_id").alias("id"), "vec")
    top = semantic.batch_topk(rows.where("id % 100 = 0").withColumnRenamed("id", "query_id"), rows)
    return top.select("query_id", F.col("id").alias("seg_id"), "rank", F.round("sim", 6).alias("sim"))


@query(f"with {SIM}, {CENT} select file_id, round(cent, 5) as cent from cent")
def file_centroid_cosine(spark: SparkSession, folder: str) -> DataFrame:
    units, q = _units(spark, folder)
    return semantic.similarities(semantic.centroids(units), q).select("file_id", F.round("sim", 5).alias("cent"))


@query(f"with {SIM}, {SUPP} select file_id, round(support, 6) as support from supp")
def support_top2_mean(spark: SparkSession, folder: str) -> DataFrame:
    units, q = _units(spark, folder)
    return semantic.file_support(semantic.similarities(units, q)).select("file_id", F.round("support", 6).alias("support"))


@query(f"with {SIM}, {BEST}, {SUPP}, {CENT} select b.chunk_id, b.best_seg, round(b.sim + 0.3 * coalesce(support, 0) + 0.2 * coalesce(cent, 0), 5) as semantic_score from b left join supp on b.file_id = supp.file_id left join cent on b.file_id = cent.file_id")
def semantic_sum(spark: SparkSession, folder: str) -> DataFrame:
    units, q = _units(spark, folder)
    return semantic.combined(units, q).select("chunk_id", "best_seg", F.round("semantic_score", 5).alias("semantic_score"))


@query(f"with {UNITS}, p as (select seg_id, generate_subscripts(u, 1) as i, unnest(u) as x from u), m as (select i, avg(x) as m from p group by i), c as (select seg_id, sum((x - m) * (x - m)) as d from p join m using (i) group by seg_id) select seg_id, round(sqrt(d), 6) as away from c")
def center_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """How far every unit vector lies from the mean of all."""
    units = semantic.unit_segments(table(spark, folder, "segments"))
    mean = units.select(F.posexplode("u").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))
    away = T.norm(F.zip_with("u", "mean", lambda a, b: a - b))
    return units.join(F.broadcast(mean)).select("seg_id", F.round(away, 6).alias("away"))


# --- hits: fusion, order, presentation ------------------------------------------------------


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "hits").dropDuplicates(["query_id", "chunk_id"])


HITS = "h as (select distinct on (query_id, chunk_id) * from hits)"


@query(
    f"""with {HITS}, r as (
select query_id, chunk_id, 2.0 / (60 + row_number() over (partition by query_id order by bm25, chunk_id) - 1) as s from h where bm25 is not null
union all select query_id, chunk_id, 1.0 / (60 + row_number() over (partition by query_id order by semantic_score desc, chunk_id) - 1) from h where semantic_score is not null)
select query_id, chunk_id, round(sum(s), 9) as score from r group by all"""
)
def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    h = _hits(spark, folder).withColumnRenamed("chunk_id", "id")
    lists = fusion.ranked_lists({"strict": (h.where("bm25 is not null"), [F.col("bm25")]), "semantic": (h.where("semantic_score is not null"), [F.desc("semantic_score")])})
    return fusion.rrf(lists).select("query_id", F.col("id").alias("chunk_id"), F.round("score", 9).alias("score"))


@query(f"with {HITS} select query_id, chunk_id, row_number() over (partition by query_id order by score desc nulls last, coalesce(semantic_score, -1) desc, rel_path || '#' || heading_slug, chunk_id)::int as place from h")
def hit_order(spark: SparkSession, folder: str) -> DataFrame:
    key = F.concat("rel_path", F.lit("#"), "heading_slug")
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), F.desc(F.coalesce("semantic_score", F.lit(-1.0))), F.asc_nulls_last(key), "chunk_id")
    return _hits(spark, folder).select("query_id", "chunk_id", F.row_number().over(w).alias("place"))


@query(f"with {HITS}, k as (select query_id, unnest(kinds) as kind from h) select kind, count(*) as n from k group by kind")
def hit_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(spark, folder).select(F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {HITS} select query_id, rel_path, min(rank) as first_rank, count(*) as n from h group by all")
def group_hits_by_file(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(spark, folder).groupBy("query_id", "rel_path").agg(F.min("rank").alias("first_rank"), F.count(F.lit(1)).alias("n"))


@query(f"with {HITS}, m as (select query_id, max(score) as top from h group by query_id) select h.query_id, chunk_id, round(score / top, 6) as relevance from h join m on h.query_id = m.query_id where top <> 0")
def relative_relevance(spark: SparkSession, folder: str) -> DataFrame:
    h = _hits(spark, folder)
    top = h.groupBy("query_id").agg(F.max("score").alias("top")).where("top <> 0")
    return h.join(top, "query_id").select("query_id", "chunk_id", F.round(F.col("score") / F.col("top"), 6).alias("relevance"))


FLAT = "trim(replace(text, chr(10), ' '))"


@query(
    f"""with c as (select distinct chunk_id, {FLAT} as t from chunks), p as (select *, coalesce(nullif(instr(lower(t), 'watcher'), 0), nullif(instr(lower(t), 'notes'), 0), 0) as hit from c),
e as (select *, greatest(hit - 60, 1) as b, least(hit - 1 + 60, length(t)) as z from p)
select chunk_id, case when hit > 0 then case when b > 1 then '…' else '' end || substring(t, b, z - b + 1) || case when z < length(t) then '…' else '' end else left(t, 120) end as snippet from e"""
)
def snippet_window(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder).select("chunk_id", T.snippet(F.col("text"), ["watcher", "Notes"]).alias("snippet"))


@query(
    f"""with {HITS}, p as (select query_id, chunk_id, unnest(regexp_split_to_array(best_passage, '[`*_\\[\\]()#|<>\\n]')) as part, generate_subscripts(regexp_split_to_array(best_passage, '[`*_\\[\\]()#|<>\\n]'), 1) as i from h where best_passage is not null),
b as (select *, row_number() over (partition by query_id, chunk_id order by length(part) desc, i) as n from p)
select query_id, chunk_id, case when length(trim(part)) >= 8 then left(trim(part), 28) end as phrase from b where n = 1"""
)
def landing_phrase(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(spark, folder).where("best_passage is not null").select("query_id", "chunk_id", T.landing_phrase(F.col("best_passage")).alias("phrase"))


@query(f"with {HITS} select query_id, chunk_id, regexp_replace(snippet, '(?i)(notes|the|索引)', '<mark>\\1</mark>', 'g') as marked from h")
def highlight_terms(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(spark, folder).select("query_id", "chunk_id", T.highlighted(F.col("snippet"), ["the", "notes", "索引", "x"]).alias("marked"))


@query("select distinct chunk_id, least(5000, ((length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), 'note', ''))) / 4)::int)::int as n from chunks")
def find_occurrences(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder).select("chunk_id", T.occurrences(F.col("text"), "note").alias("n"))


@query("select doc_id, coalesce(regexp_matches(left(text, 4096), '\"(openapi|swagger)\"\\s*:\\s*\"') or regexp_matches(left(text, 4096), '(?m)^(openapi|swagger)\\s*:'), false) as openapi from documents")
def openapi_detect(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.coalesce(is_openapi(F.col("text")), F.lit(False)).alias("openapi"))


@query(
    """with c as (select distinct chunk_id, lower(text) as t from chunks), p as (select chunk_id, string_split(t, 'the') as parts from c where contains(t, 'the'))
select chunk_id, (length(parts[1]))::int as first_at, (len(parts) - 1)::int as n from p"""
)
def find_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Where a term stands first in each chunk that has it, and how often it stands there."""
    at = T.positions(F.col("text"), "the")
    rows = _chunks(spark, folder).select("chunk_id", at.alias("at")).where(F.size("at") > 0)
    return rows.select("chunk_id", F.element_at("at", 1).alias("first_at"), F.size("at").alias("n"))


@query(r"""select doc_id, unnest(regexp_extract_all(text, '(?m)^[ \t]*>[ \t]*\[!(NOTE|TIP|IMPORTANT|WARNING|CAUTION)\]', 1)) as alert from documents where text is not null""")
def md_alerts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.explode(T.alerts(F.col("text"))).alias("alert"))


# --- evaluation and feeds --------------------------------------------------------------------

EVAL = f"""{HITS}, gold as (select query_id, arg_max(rel_path, struct_pack(a := semantic_score, b := -chunk_id)) as gold from h where semantic_score is not null group by query_id),
l as (select query_id, 'bm25' as mode, rel_path, row_number() over (partition by query_id order by bm25, chunk_id) as rank from h where bm25 is not null
      union all select query_id, 'score', rel_path, row_number() over (partition by query_id order by score desc, chunk_id) from h where score is not null),
m1 as (select query_id, mode, rel_path, min(rank) as first_rank from l group by all),
d as (select query_id, mode, rel_path, row_number() over (partition by query_id, mode order by first_rank, rel_path) as doc_rank from m1),
g as (select m.mode, case when g.query_id % 2 = 0 then 'even' else 'odd' end as type, g.query_id, d.doc_rank as gold_rank from gold g cross join (values ('bm25'), ('score')) m(mode)
      left join d on d.query_id = g.query_id and d.mode = m.mode and d.rel_path = g.gold)"""


@query(
    f"""with {EVAL} select mode, coalesce(type, 'ALL') as type, count(*) as n, round(avg(case when gold_rank <= 1 then 1.0 else 0 end), 6) as r1, round(avg(case when gold_rank <= 5 then 1.0 else 0 end), 6) as r5,
round(avg(case when gold_rank <= 10 then 1.0 else 0 end), 6) as r10, round(avg(coalesce(1.0 / gold_rank, 0)), 6) as mrr from g group by rollup (mode, type) having mode is not null"""
)
def eval_recall_mrr(spark: SparkSession, folder: str) -> DataFrame:
    """How well bm25 and the fused score find the file that the vectors prefer."""
    h = _hits(spark, folder)
    gold = h.where("semantic_score is not null").groupBy("query_id").agg(F.max_by("rel_path", F.struct("semantic_score", -F.col("chunk_id"))).alias("gold"))
    w = Window.partitionBy("query_id")
    a = h.where("bm25 is not null").select("query_id", F.lit("bm25").alias("mode"), "rel_path", F.row_number().over(w.orderBy("bm25", "chunk_id")).alias("rank"))
    b = h.where("score is not null").select("query_id", F.lit("score").alias("mode"), "rel_path", F.row_number().over(w.orderBy(F.desc("score"), "chunk_id")).alias("rank"))
    ranks = evaluate.document_ranks(a.unionByName(b), ["query_id", "mode"]).withColumnRenamed("rel_path", "gold")
    asked = gold.withColumn("mode", F.explode(F.array(F.lit("bm25"), F.lit("score"))))
    got = asked.join(ranks, ["query_id", "mode", "gold"], "left")
    typed = got.select("mode", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd").alias("type"), F.col("doc_rank").alias("gold_rank"))
    return evaluate.recall_table(typed, ["mode", "type"])


@query(
    f"""with {HITS}, got as (select distinct query_id, rel_path from h where array_contains(kinds, 'structured')), want as (select distinct query_id, rel_path from h where rank <= 10),
b as (select coalesce(a.query_id, w.query_id) as query_id, count(a.rel_path) as g, count(w.rel_path) as w, sum(case when a.rel_path is not null and w.rel_path is not null then 1 else 0 end) as hit
  from got a full join want w on a.query_id = w.query_id and a.rel_path = w.rel_path group by 1)
select query_id, round(case when g > 0 then hit / g else 0.0 end, 6) as precision, round(case when w > 0 then hit / w else 1.0 end, 6) as recall, hit = g and hit = w as exact from b"""
)
def eval_precision_recall(spark: SparkSession, folder: str) -> DataFrame:
    h = _hits(spark, folder).withColumnRenamed("rel_path", "item")
    return evaluate.precision_recall(h.where(F.array_contains("kinds", "structured")), h.where("rank <= 10"))


@query(
    f"""with {HITS}, s as (select query_id, score, row_number() over (partition by query_id order by score) - 1 as i, count(*) over (partition by query_id) as n from h where score is not null)
select query_id, max(case when i = least(floor(0.5 * n), n - 1) then score end) as p50, max(case when i = least(floor(0.95 * n), n - 1) then score end) as p95, max(score) as p100 from s group by query_id"""
)
def latency_percentile_index(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles by index, as the latency report takes them, of each query's scores."""
    return evaluate.index_percentiles(_hits(spark, folder), "query_id", "score")


@query(
    """with e as (select distinct * from file_changes), g as (select path, seen_at, case when lag(seen_at) over w is null or epoch(seen_at) - epoch(lag(seen_at) over w) > 86400 then 1 else 0 end as fresh from e window w as (partition by path order by seen_at)),
s as (select path, seen_at, sum(fresh) over (partition by path order by seen_at rows unbounded preceding) as k from g)
select path, min(seen_at) as start_at, max(seen_at) as end_at, count(*) as n from s group by path, k"""
)
def debounce_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Bursts of changes of each path, parted by gaps of more than a day."""
    return sessions(once(table(spark, folder, "file_changes"), "change_id"), "path", "seen_at", 86_400)


@query()
def known_item_queries(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.known_items(table(spark, folder, "documents"))


@query()
def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    """One search over the vault's tables with text, date and path filters and vectors."""
    from inkwell.operators.embed import HashingEmbedder, embedded
    from inkwell.operators.service import SearchService

    # The tables' vectors are of an unknown model: texts and query get vectors of the same one.
    own = table(spark, folder, "segments").where("text is not null").dropDuplicates(["chunk_id", "seg"]).select("chunk_id", "file_id", F.col("seg").cast("int").alias("seg"), "text", F.col("text").alias("input"))
    rel = {"files": _files(spark, folder), "chunks": _chunks(spark, folder), "frontmatter": table(spark, folder, "frontmatter"), "links": _resolved(spark, folder), "segments": embedded(own, HashingEmbedder(64))}
    return SearchService(rel, HashingEmbedder(64)).search("watcher notes path:inbox", now=1.79e9)

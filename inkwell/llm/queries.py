"""The queries of the problems tagged llm, and their SQL where SQL can express them."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.bpe import encode_corpus
from inkwell.llm.fusion import HIT_SCORES, fuse, in_front
from inkwell.llm.knn import close_pairs, nearest, reranked
from inkwell.llm.leaks import leaked, leaks
from inkwell.llm.markup import clean
from inkwell.llm.sentences import sentences
from inkwell.llm.terms import CJK, distinctive, term_frequencies, value_frequencies
from inkwell.sources.tables import once, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "segments")
    return close_pairs(nearest(rows), rows).toDF("seg_id_a", "seg_id_b")


def p1_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest of every segment, reranked by the vectors as given."""
    rows = table(spark, folder, "segments")
    return reranked(nearest(rows), rows).withColumnsRenamed({"id": "seg_id"})


def p2_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Clean text, blocks and pieces of every chunk and heading, each id once."""
    parts = []
    for tab, key in (("chunks", "chunk_id"), ("headings", "heading_id")):
        rows = clean(once(table(spark, folder, tab).select(key, "text"), key), key)
        parts.append(rows.select(F.lit(tab).alias("tab"), "row_id", "clean", "blocks", F.map_entries("pieces").alias("pieces")))
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = []
    for tab, key in (("chunks", "chunk_id"), ("headings", "heading_id")):
        rows = clean(table(spark, folder, tab), key)
        parts.append(rows.where(F.size("pieces") > 0).select(F.lit(tab).alias("tab"), "row_id"))
    return parts[0].unionByName(parts[1]).distinct()  # copies of a row have the same pieces


def p4_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences and records of every term of chunks and every value of front matter."""
    a = term_frequencies(table(spark, folder, "chunks"), "chunk_id", "text")
    b = value_frequencies(table(spark, folder, "frontmatter"), "fm_id", "file_id", "value")
    return a.select(F.lit("chunks").alias("tab"), "*").unionByName(b.select(F.lit("frontmatter").alias("tab"), "*"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_frequencies(spark, folder).where("band is not null").select("tab", "term", "band")


def p5_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score of every term of every chunk and title, to nine decimals."""
    a = distinctive(table(spark, folder, "chunks"), "chunk_id", "text")
    b = distinctive(table(spark, folder, "files"), "file_id", "title")
    both = a.select(F.lit("chunks").alias("tab"), "*").unionByName(b.select(F.lit("files").alias("tab"), "*"))
    return both.withColumn("score", F.round("score", 9))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    a = distinctive(table(spark, folder, "chunks"), "chunk_id", "text", least_tf=3)
    b = distinctive(table(spark, folder, "files"), "file_id", "title")
    both = a.select(F.lit("chunks").alias("tab"), "*").unionByName(b.select(F.lit("files").alias("tab"), "*"))
    return both.where(F.col("df").between(2, 5)).select("tab", "row_id", "term")


def p7_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """The fused ranking of every query."""
    return fuse(table(spark, folder, "hits"), HIT_SCORES)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return in_front(fuse(table(spark, folder, "hits"), HIT_SCORES), list(HIT_SCORES)).select("query_id", "chunk_id")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked(leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")))


def p9_windows(spark: SparkSession, folder: str) -> DataFrame:
    """All documents that share a template window with an item, and how much of it."""
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences(table(spark, folder, "documents")).select("doc_id", "start_at")


def p10_units(spark: SparkSession, folder: str) -> DataFrame:
    """The units with their text."""
    return sentences(table(spark, folder, "documents"), with_text=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_nearest": p1_nearest,
    "p2_found": p2_found,
    "p2_clean": p2_clean,
    "p4_found": p4_found,
    "p4_frequencies": p4_frequencies,
    "p5_found": p5_found,
    "p5_scores": p5_scores,
    "p7_found": p7_found,
    "p7_ranking": p7_ranking,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_windows": p9_windows,
    "p10_found": p10_found,
    "p10_units": p10_units,
}

#: Terms of a text column in DuckDB: CJK runs are set apart, then paired.
_TERMS = rf"""
runs as (
  select tab, row_id, unnest(regexp_extract_all(regexp_replace(lower(text), '([{CJK}]+)', ' \1 ', 'g'), '[{CJK}]+|[\p{{L}}\p{{N}}]+')) as run from texts where text is not null),
terms as (
  select tab, row_id, unnest(case when regexp_matches(run, '^[{CJK}]') and length(run) > 1
    then list_transform(range(1, length(run)), lambda i: substring(run, i, 2)) else [run] end) as term from runs)
"""



def _compatible() -> tuple[str, str]:
    """Characters whose compatible form (NFKC) is one other character, and those forms: with
    them DuckDB's nfc_normalize gives NFKC, but for forms of several characters."""
    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b and b != "'"]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FREQUENCIES = rf"""
with texts as (select distinct 'chunks' as tab, chunk_id as row_id, text from chunks),
{_TERMS},
tf as (select row_id, term, count(*) as n from terms group by all),
c as (select 'chunks' as tab, term, sum(n)::bigint as cf, count(*) as df, (select count(distinct chunk_id) from chunks) * 0.35 as most from tf group by term),
v as (select file_id, trim(regexp_replace(lower(nfc_normalize(translate(value, '{_compatible()[0]}', '{_compatible()[1]}'))), '\s+', ' ', 'g')) as term from (select distinct * from frontmatter)),
f as (select 'frontmatter' as tab, term, count(*) as cf, count(distinct file_id) as df, (select count(distinct file_id) from frontmatter) * 0.10 as most from v where term <> '' group by term),
b as (select tab, term, cf, df, case when df = 1 then 'rare' when df > most then 'common' end as band from (from c union all by name from f))
"""

SQL: dict[str, str] = {
    "p4_found": _FREQUENCIES + "select tab, term, band from b where band is not null",
    "p4_frequencies": _FREQUENCIES + "select tab, term, cf, df, band from b",
    "p5_scores": f"""
with texts as (select distinct 'chunks' as tab, chunk_id as row_id, text from chunks union all select distinct 'files', file_id, title from files),
{_TERMS},
tf as (select tab, row_id, term, count(*) as tf from terms group by all),
n as (select tab, count(distinct row_id)::double as n from texts group by tab),
s as (select tab, term, sum(tf)::bigint as cf, count(*) as df from tf group by all)
select tf.tab, row_id, tf.term, tf, cf, df, round(tf * (-log2(df / n) + log2(1 - exp(-cf / n))), 9) as score
from tf join s on tf.tab = s.tab and tf.term = s.term join n on tf.tab = n.tab
""",
    "p5_found": f"""
with texts as (select distinct 'chunks' as tab, chunk_id as row_id, text from chunks union all select distinct 'files', file_id, title from files),
{_TERMS},
tf as (select tab, row_id, term, count(*) as tf from terms group by all),
df as (select tab, term, count(*) as df from tf group by all)
select tf.tab, row_id, tf.term from tf join df on tf.tab = df.tab and tf.term = df.term where df between 2 and 5 and (tf.tab = 'files' or tf >= 3)
""",
    "p7_found": """
with h as (select distinct query_id, chunk_id, bm25, semantic_score, score from hits),
r as (select *, rank() over (partition by query_id order by bm25 nulls last) as a,
        rank() over (partition by query_id order by semantic_score desc nulls last) as b,
        rank() over (partition by query_id order by score desc nulls last) as c from h)
select query_id, chunk_id from r where bm25 is not null and semantic_score is not null and score is not null and a <= 5 and b <= 5 and c <= 5
""",
}

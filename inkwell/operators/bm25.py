"""Inverted index and BM25 for one query or many, strict (all terms) or relaxed (any term).

Scores follow the full-text engine's built-in ranking: k1 = 1.2, b = 0.75,
idf = ln((N - n + 0.5) / (n + 0.5)), a non-positive idf counts as 1e-6, and the score is
negative, smaller is better. Corpus numbers are always those of all records: a filter on
records changes neither N nor n nor the mean length.

Texts are tokenised once: `build` describes the index, `lay` writes it to the shared folder,
from where any number of searches read it. Only postings of wanted terms are joined: the
terms of all queries are laid down, and as long as they are small (the planner sees their
size) they are broadcast, so that a stop word's postings stay where they are; else both
sides are shuffled by term. A term's number of records is counted over its own postings.
Scores are summed with partial aggregates; the best of each query by a ranked window that
Spark limits before the shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import RELAXED_MOST, tokens
from inkwell.sources.tables import shared_dir

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


@dataclass
class Index:
    """postings(term, id, tf, dl), lengths(id, dl), document frequencies df(term, n)."""

    postings: DataFrame
    lengths: DataFrame
    df: DataFrame
    _numbers: tuple[int, float] | None = None

    def numbers(self) -> tuple[int, float]:
        """(records, mean length), read once for an index that doesn't change."""
        if self._numbers is None:
            r = self.stats().first()
            self._numbers = r.n_records, r.avgdl or 0.0
        return self._numbers

    def stats(self) -> DataFrame:
        """One row: n_records, avgdl."""
        return self.lengths.agg(F.count(F.lit(1)).alias("n_records"), F.avg("dl").alias("avgdl"))


def build(records: DataFrame, id_col: str, text_col: str) -> Index:
    """The index of records (each id once); records without terms count with length 0."""
    tok = records.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("toks"))
    each = tok.select("id", F.size("toks").alias("dl"), F.explode("toks").alias("term"))
    postings = each.groupBy("term", "id").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.first("dl").alias("dl"))
    return Index(postings, tok.select("id", F.size("toks").alias("dl")), postings.groupBy("term").agg(F.count(F.lit(1)).alias("n")))


def lay(records: DataFrame, id_col: str, text_col: str) -> Index:
    """build(), written to the shared folder: records as lists of terms with their counts,
    tokenised once, then read as postings and as lengths."""
    spark, folder = records.sparkSession, shared_dir(records.sparkSession)
    tok = records.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("toks"))
    kind = tok.schema["id"].dataType.simpleString()
    tok.withColumn("dl", F.size("toks")).write.parquet(f"{folder}/tokens")
    tok = spark.read.schema(f"id {kind}, toks array<string>, dl int").parquet(f"{folder}/tokens")
    each = tok.select("id", "dl", F.explode("toks").alias("term"))
    # A record's tokens lie in one row, so its terms are counted without looking elsewhere.
    each.groupBy("term", "id").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.first("dl").alias("dl")).sortWithinPartitions("term").write.parquet(f"{folder}/postings")
    postings = spark.read.schema(f"term string, id {kind}, tf int, dl int").parquet(f"{folder}/postings")
    return Index(postings, tok.select("id", "dl"), postings.groupBy("term").agg(F.count(F.lit(1)).alias("n")))


def query_terms(queries: DataFrame, relaxed: bool = False, most: int | None = RELAXED_MOST) -> DataFrame:
    """(query_id, term, mult, wanted) of queries (query_id, query): how often the query has the
    term, and how many different terms it has. most: terms of a relaxed query (None: all)."""
    from inkwell.functions.text import relaxed_tokens

    toks = relaxed_tokens(F.col("query"), most) if relaxed else tokens(F.col("query"))
    each = queries.select("query_id", F.explode(toks).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("mult"))
    return each.withColumn("wanted", F.count(F.lit(1)).over(Window.partitionBy("query_id")))


def search(index: Index, terms: DataFrame, strict: bool = True, keep: DataFrame | None = None) -> DataFrame:
    """(query_id, id, bm25) of the records that hold all (strict) or some terms of a query.

    keep: ids to restrict the result to, or (query_id, id) for a filter of each query.
    """
    spark, folder = terms.sparkSession, shared_dir(terms.sparkSession)
    terms.write.parquet(f"{folder}/terms")
    terms = spark.read.schema(terms.schema).parquet(f"{folder}/terms")
    hits = index.postings.join(terms, "term")
    n = index.postings.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    if keep is not None:
        hits = hits.join(keep, ["query_id", "id"] if "query_id" in keep.columns else "id", "left_semi")
    hits = hits.join(n, "term").join(F.broadcast(index.stats()))  # stats: one row
    idf = F.log((F.col("n_records") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    out = hits.groupBy("query_id", "id").agg((-F.sum(idf * tf * F.col("mult"))).alias("bm25"), F.count(F.lit(1)).alias("got"), F.first("wanted").alias("wanted"))
    return (out.where("got = wanted") if strict else out).select("query_id", "id", "bm25")


def search_text(index: Index, text: str, strict: bool = True, keep: DataFrame | None = None, most: int | None = RELAXED_MOST) -> DataFrame:
    """search() of one query string (query_id 0) without jobs for the query itself: its terms
    are worked out by the optimiser and become a filter on the postings that reaches the scan.
    Two small jobs, the terms' numbers of records and the scores, remain."""
    from inkwell.functions.text import relaxed_tokens

    spark = index.postings.sparkSession
    toks = (tokens(F.lit(text)) if strict else relaxed_tokens(F.lit(text), most)).alias("t")
    words = spark.range(1).select(toks).first().t or []
    wanted = Counter(words)
    schema = f"query_id int, id {index.postings.schema['id'].dataType.simpleString()}, bm25 double"
    if not wanted:
        return spark.createDataFrame([], schema)
    records, mean = index.numbers()
    hits = index.postings.where(F.col("term").isin(list(wanted)))
    n = {r.term: r.n for r in hits.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a term
    if not n or strict and len(n) < len(wanted):
        return spark.createDataFrame([], schema)
    idf = {t: math.log((records - k + 0.5) / (k + 0.5)) for t, k in n.items()}
    weight = F.create_map(*(F.lit(x) for t, v in idf.items() for x in (t, (v if v > 0 else LEAST_IDF) * wanted[t])))
    if keep is not None:
        hits = hits.join(keep, "id", "left_semi")
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean)))
    out = hits.groupBy("id").agg((-F.sum(weight[F.col("term")] * tf)).alias("bm25"), F.count(F.lit(1)).alias("got"))
    return (out.where(F.col("got") == len(wanted)) if strict else out).select(F.lit(0).alias("query_id"), "id", "bm25")


def best(scored: DataFrame, score: Column, k: int, by: str = "query_id", tie: str = "id") -> DataFrame:
    """The k rows of each query with the smallest `score`, with rank from 1; ties by id."""
    w = Window.partitionBy(by).orderBy(score, F.col(tie))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

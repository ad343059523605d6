"""Retrieval quality and latency figures, vocabulary and alias mining."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vocabulary: Katakana of three or more, or Latin words of three or more (fixed value).
VOCABULARY = r"[\p{IsKatakana}ー]{3,}|[A-Za-z][A-Za-z0-9.+-]{2,}"
DF_SHARE, MOST_TERMS = 0.4, 400


def document_ranks(hits: DataFrame, by: list[str], document: str = "rel_path", order: str = "rank") -> DataFrame:
    """(by..., document, doc_rank): documents in the order of their first hit."""
    first = hits.groupBy(*by, document).agg(F.min(order).alias("first"))
    return first.withColumn("doc_rank", F.row_number().over(Window.partitionBy(*by).orderBy("first", document))).drop("first")


def recall_table(ranks: DataFrame, group: list[str]) -> DataFrame:
    """Recall at 1, 5 and 10 and mean reciprocal rank of (group..., rank of the gold or null),
    for every group and, by rollup, for all ("ALL")."""
    hit = lambda k: F.round(F.avg(F.when(F.col("gold_rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"r{k}")
    out = ranks.rollup(*group).agg(F.count(F.lit(1)).alias("n"), hit(1), hit(5), hit(10), F.round(F.avg(F.coalesce(1.0 / F.col("gold_rank"), F.lit(0.0))), 6).alias("mrr"))
    return out.where(F.col(group[0]).isNotNull()).select(*(F.coalesce(F.col(g).cast("string"), F.lit("ALL")).alias(g) for g in group), "n", "r1", "r5", "r10", "mrr")


def precision_recall(returned: DataFrame, gold: DataFrame, by: str = "query_id", item: str = "item") -> DataFrame:
    """(by, precision, recall, exact) of result sets against gold sets, each pair once."""
    a = returned.select(by, item).distinct().withColumn("got", F.lit(1))
    b = gold.select(by, item).distinct().withColumn("want", F.lit(1))
    both = a.join(b, [by, item], "full_outer").groupBy(by).agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("got", "want")), F.sum(F.when(F.col("got").isNotNull() & F.col("want").isNotNull(), 1).otherwise(0)).alias("hit"))
    # Nothing returned where something was wanted has precision 0; nothing wanted has recall 1.
    share = lambda n, none: F.round(F.when(F.col(n) > 0, F.col("hit") / F.col(n)).otherwise(none), 6)
    return both.select(by, share("got", 0.0).alias("precision"), share("want", 1.0).alias("recall"), ((F.col("hit") == F.col("got")) & (F.col("hit") == F.col("want"))).alias("exact"))


def index_percentiles(values: DataFrame, by: str, value: str, shares: tuple[float, ...] = (0.5, 0.95, 1.0)) -> DataFrame:
    """The value at index floor(share * n) of each group's sorted values, the last at most."""
    sized = values.where(F.col(value).isNotNull()).select(by, value)
    w = Window.partitionBy(by)
    place = sized.withColumn("i", F.row_number().over(w.orderBy(value)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    at = [F.max(F.when(F.col("i") == F.least(F.floor(F.lit(s) * F.col("n")), F.col("n") - 1), F.col(value))).alias(f"p{int(s * 100)}") for s in shares]
    return place.groupBy(by).agg(*at)


def vocabulary(docs: DataFrame, text_col: str = "text", most: int = MOST_TERMS, share: float = DF_SHARE) -> DataFrame:
    """(term, n) of words in at least two documents and at most a share of all, the most
    frequent first; ties by term."""
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    found = docs.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(VOCABULARY), F.lit(0)), F.lower))).alias("term"))
    n = found.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total))
    some = n.where((F.col("n") >= 2) & (F.col("n") <= F.greatest(F.lit(2), F.floor(F.col("total") * share))))
    return some.select("term", "n").orderBy(F.desc("n"), "term").limit(most)


def mutual_neighbours(terms: list[str], vectors: np.ndarray, least: float) -> list[tuple[str, str, float]]:
    """Pairs that are each other's nearest, no part of one another, with similarity `least` or
    more, after the mean is taken off. For a vocabulary of bounded size (400 terms)."""
    x = np.asarray(vectors, float)
    x = x - x.mean(0)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    s = x @ x.T
    for i, a in enumerate(terms):
        for j, b in enumerate(terms):
            if i == j or a in b or b in a:
                s[i, j] = -2
    top = s.argmax(1) if len(terms) else []
    return [(terms[i], terms[j], float(s[i, j])) for i, j in enumerate(top) if i < j and top[j] == i and s[i, j] >= least]


def mine_aliases(docs: DataFrame, embedder, least: float = 0.9, text_col: str = "text") -> list[tuple[str, str, float]]:
    """Candidate aliases of a corpus: vocabulary, embedded in a template, mutual neighbours."""
    terms = [r.term for r in vocabulary(docs, text_col).collect()]  # 400 at most
    return mutual_neighbours(terms, embedder.embed([f"「{t}」について" for t in terms], "query"), least) if terms else []


def known_items(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = None, seed: int = 42) -> DataFrame:
    """(id, type, query): queries whose answer is known: the title, two sections and two
    sentences of each document, picked by hashes instead of chance."""
    body = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"(?s)(```|~~~).*?(\1|$)", " ")
    heads = F.regexp_extract_all(body, F.lit(r"(?m)^#{2,3} +(.{6,})$"), F.lit(1))
    prose = F.regexp_replace(F.regexp_replace(body, r"(?m)^(#|---|[a-z_]+:).*$", " "), r"\[([^\]]*)\]\([^)]*\)|[*_`>]", "$1")
    sents = F.regexp_extract_all(prose, F.lit(r"[^。.!?！？\s][^。.!?！？]{23,138}[。.!?！？]"), F.lit(0))
    pick = lambda kind, found: docs.select(id_col, F.lit(kind).alias("type"), F.explode(F.array_distinct(found)).alias("query"))
    some = pick("heading", heads).unionByName(pick("sentence", sents)).withColumn("query", F.trim(F.regexp_replace("query", r"\s+", " ")))
    w = Window.partitionBy(id_col, "type").orderBy(F.xxhash64("query", F.lit(seed)), "query")
    out = some.withColumn("n", F.row_number().over(w)).where("n <= 2").drop("n")
    if title_col:
        out = out.unionByName(docs.where(F.col(title_col).isNotNull()).select(id_col, F.lit("title").alias("type"), F.col(title_col).alias("query")))
    return out

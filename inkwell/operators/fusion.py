"""Reciprocal rank fusion of ranked lists, and the order of fused hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
#: Weights of the four signals (fixed values).
WEIGHTS = {"strict": 2.0, "semantic": 1.0, "structured": 1.0, "relaxed": 1.0}


def ranked_lists(signals: dict[str, tuple[DataFrame, list]], by: str = "query_id") -> DataFrame:
    """(query_id, id, signal, rank0) of signals given as (frame, order)."""
    out = None
    for name, (df, order) in signals.items():
        w = Window.partitionBy(by).orderBy(*order, "id")
        part = df.select(by, "id", F.lit(name).alias("signal"), (F.row_number().over(w) - 1).alias("rank0"))
        out = part if out is None else out.unionByName(part)
    return out


def rrf(lists: DataFrame, weights: dict[str, float] = WEIGHTS, k: int = RRF_K, by: str = "query_id") -> DataFrame:
    """(query_id, id, score, signals): sum of weight / (k + rank) over the lists with the item."""
    pairs = [x for name, w in weights.items() for x in (F.lit(name), F.lit(float(w)))]
    weight = F.coalesce(F.element_at(F.create_map(*pairs), F.col("signal")), F.lit(1.0))
    return lists.groupBy(by, "id").agg(F.sum(weight / (k + F.col("rank0"))).alias("score"), F.array_sort(F.collect_set("signal")).alias("signals"))

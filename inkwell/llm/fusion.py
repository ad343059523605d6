"""One ranking from several scores on different scales (problem 7).

Method: rank-walk Markov chain. From an item the walk picks one of the item's scores at
random and jumps to one of the items that are strictly better by it, each equally likely;
where none is better it stays. With probability 1 - damping it jumps anywhere. Items are
ordered by their share of the stationary distribution, which depends on orders only, so
no score rules by its range. The step is never written as a matrix: what an item receives
by a score is a sum over all items worse by it, a prefix sum in the order of that score.

Queries of up to `most` items are iterated whole, many in a task. Larger ones (a query may
hold a third of all rows) are iterated as tables: values are cut into ranges, counts and
masses summed over ranges first, so no task ever holds a query. Both stop by the same rule,
when a round moves less than CLOSE of all mass or after ROUNDS, and give the same places.

Defined results: an item without a score isn't picked or reached by it; NaN counts as null;
items without any score are last; equal shares are ordered by item id; copies of a row
(same query and item) count once; rows without query or item are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.sources.tables import remove, shared_dir

DAMPING, ROUNDS, CLOSE = 0.9, 200, 1e-12
#: Decimals to which shares, times the number of items, are told apart.
EQUAL = 8
#: Items of a query that one task iterates; ranges of a larger query's values.
MOST, RANGES = 200_000, 512


def walk(scores: np.ndarray, damping: float = DAMPING) -> tuple[np.ndarray, np.ndarray]:
    """(shares, counts of strictly better items) of the items of one query.

    scores: items by scores, greater is better, NaN is none; -1 for the count of a missing one.
    """
    n, m = scores.shape
    better = np.full((n, m), -1, np.int64)
    has = ~np.isnan(scores)
    orders = []
    for j in range(m):
        at = np.flatnonzero(has[:, j])
        s = scores[at, j]
        order = np.argsort(-s, kind="stable")
        at, s = at[order], s[order]
        first = np.searchsorted(-s, -s, side="left")
        end = np.searchsorted(-s, -s, side="right")
        better[at, j] = first
        orders.append((at, first, end))
    kinds = has.sum(1)
    p = np.full(n, 1.0 / n)
    for _ in range(ROUNDS):
        share = np.divide(p, kinds, out=np.zeros(n), where=kinds > 0)
        q = np.where(kinds > 0, 0.0, p)
        for at, first, end in orders:
            mine = share[at]
            flow = np.divide(mine, first, out=np.zeros(len(at)), where=first > 0)
            total = np.concatenate([[0.0], np.cumsum(flow)])
            q[at] += total[-1] - total[end] + np.where(first == 0, mine, 0.0)
        q = (1 - damping) / n + damping * q
        moved = np.abs(q - p).sum()
        p = q
        if moved < CLOSE:
            break
    return p, better


def ranked(p: np.ndarray, items: np.ndarray, any_score: np.ndarray) -> np.ndarray:
    """Places from 1: by share, larger first, items without any score last, then by id."""
    order = np.lexsort((items, -np.round(p * len(p), EQUAL), ~any_score))
    place = np.empty(len(p), np.int64)
    place[order] = np.arange(1, len(p) + 1)
    return place


def fuse(
    hits: DataFrame,
    scores: dict[str, bool],
    query_col: str = "query_id",
    item_col: str = "chunk_id",
    damping: float = DAMPING,
    most: int = MOST,
) -> DataFrame:
    """(query, item, place, share, better_<score>...): the fused ranking of each query.

    scores: whether more is better, by column. better_<score> is the number of items of the
    query that are strictly better by it, null where the item has no such score.
    """
    names = list(scores)
    cols = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double") * (1.0 if up else -1.0)).alias(c) for c, up in scores.items()]
    base = hits.select(F.col(query_col).cast("bigint").alias("q"), F.col(item_col).cast("bigint").alias("i"), *cols).where("q is not null and i is not null")
    base = base.groupBy("q", "i").agg(*(F.max(c).alias(c) for c in names))
    # Fewer than rows / most queries, eight bytes each: small beside the rows at any size.
    large = base.groupBy("q").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("q")
    any_large = not large.isEmpty()
    schema = "q bigint, i bigint, place bigint, share double, " + ", ".join(f"better_{c} bigint" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows)
            q, i = t.column(0).to_numpy(), t.column(1).to_numpy()
            x = np.stack([t.column(2 + k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(names))], 1)
            edges = [0, *(np.flatnonzero(np.diff(q)) + 1).tolist(), len(q)]
            place, share, better = np.empty(len(q), np.int64), np.empty(len(q)), np.empty(x.shape, np.int64)
            for a, b in zip(edges, edges[1:]):
                share[a:b], better[a:b] = walk(x[a:b], damping)
                place[a:b] = ranked(share[a:b], i[a:b], ~np.isnan(x[a:b]).all(1))
            counts = [pa.array(better[:, k], mask=better[:, k] < 0) for k in range(len(names))]
            return pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(place), pa.array(share), *counts], names=["q", "i", "place", "share", *(f"better_{c}" for c in names)])

        for batch in batches:
            if not batch.num_rows:
                continue
            q = batch.column(0).to_numpy()
            cut = int(np.searchsorted(q, q[-1]))  # the last query may go on
            if cut:
                yield finish([*held, batch.slice(0, cut)])
                held = []
            elif held and held[-1].column(0)[-1].as_py() != q[0]:
                yield finish(held)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield finish(held)

    small = base.join(F.broadcast(large), "q", "left_anti") if any_large else base
    out = small.repartition("q").sortWithinPartitions("q").mapInArrow(run, schema)
    if any_large:
        out = out.unionByName(_large(base.join(F.broadcast(large), "q", "left_semi"), names, damping))
    return out.withColumnsRenamed({"q": query_col, "i": item_col})


def _prefixed(totals: DataFrame, group: list[str], part: str, order: str, value: str) -> DataFrame:
    """Adds `before`: the sum of `value` over rows of the group with smaller `order`. Parts
    ascend with the order; sums of parts are added up first (few rows for each group)."""
    parts = totals.groupBy(*group, part).agg(F.sum(value).alias("sum"))
    w = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*group, part, F.coalesce(F.sum("sum").over(w), F.lit(0.0)).alias("earlier"))
    inner = Window.partitionBy(*group, part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(value).over(inner), F.lit(0.0))
    return totals.withColumn("within", own).join(parts, [*group, part]).withColumn("before", F.col("earlier") + F.col("within")).drop("earlier", "within")


def _large(base: DataFrame, names: list[str], damping: float) -> DataFrame:
    """fuse() of queries too large for a task, by tables; the same chain and stopping rule, the
    latter for all of them together (further rounds move a settled one by less than CLOSE)."""
    spark, folder = base.sparkSession, shared_dir(base.sparkSession)

    def laid(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    base = laid(base, "base")
    long = base.select("q", "i", F.explode(F.array(*(F.struct(F.lit(k).alias("s"), (-F.col(c)).alias("v")) for k, c in enumerate(names)))).alias("x")).select("q", "i", "x.s", "x.v").where("v is not null")
    cuts = long.groupBy("q", "s").agg(F.percentile_approx("v", F.array(*(F.lit(k / RANGES) for k in range(1, RANGES))), 10 * RANGES).alias("cuts"))
    values = long.groupBy("q", "s", "v").agg(F.count(F.lit(1)).cast("double").alias("n"))
    part = F.size(F.filter("cuts", lambda c: c < F.col("v")))
    values = values.join(F.broadcast(cuts), ["q", "s"]).select("q", "s", "v", "n", part.alias("part"))
    values = laid(_prefixed(values, ["q", "s"], "part", "v", "n"), "values")  # before: strictly better items
    items = laid(long.join(values.select("q", "s", "v", "part", F.col("before").alias("better")), ["q", "s", "v"]), "items")
    sizes = base.groupBy("q").agg(F.count(F.lit(1)).cast("double").alias("size"))
    kinds = items.groupBy("q", "i").agg(F.count(F.lit(1)).alias("kinds"))
    state = laid(base.select("q", "i").join(F.broadcast(sizes), "q").join(kinds, ["q", "i"], "left").withColumn("p", 1 / F.col("size")), "state-0")
    for n in range(1, ROUNDS + 1):
        mass = items.join(state.select("q", "i", (F.col("p") / F.col("kinds")).alias("m")), ["q", "i"])
        flow = F.when(F.col("better") > 0, F.col("m") / F.col("better")).otherwise(0.0)
        by_value = mass.groupBy("q", "s", "v", "part").agg(F.sum(flow).alias("flow"))
        sums = by_value.groupBy("q", "s").agg(F.sum("flow").alias("all"))
        by_value = _prefixed(by_value, ["q", "s"], "part", "v", "flow").join(F.broadcast(sums), ["q", "s"])
        worse = by_value.select("q", "s", "v", (F.col("all") - F.col("before") - F.col("flow")).alias("inflow"))
        got = mass.join(worse, ["q", "s", "v"]).groupBy("q", "i").agg(F.sum(F.col("inflow") + F.when(F.col("better") == 0, F.col("m")).otherwise(0.0)).alias("got"))
        new = state.join(got, ["q", "i"], "left").select("q", "i", "size", "kinds", ((1 - damping) / F.col("size") + damping * F.when(F.col("kinds").isNull(), F.col("p")).otherwise(F.coalesce("got", F.lit(0.0)))).alias("new"), "p")
        new = laid(new, f"state-{n}")
        moved = new.groupBy("q").agg(F.sum(F.abs(F.col("new") - F.col("p"))).alias("d")).agg(F.max("d")).first()[0]
        state = new.select("q", "i", "size", "kinds", F.col("new").alias("p"))
        remove(spark, f"{folder}/state-{n - 1}")
        if moved < CLOSE:
            break
    better = items.groupBy("q", "i").pivot("s", list(range(len(names)))).agg(F.first("better"))
    # Places are counts of what stands before, by the same ranges as above.
    keyed = state.withColumn("key", F.when(F.col("kinds").isNull(), 1e12).otherwise(-F.round(F.col("p") * F.col("size"), EQUAL)))
    edges = keyed.groupBy("q").agg(F.percentile_approx("key", F.array(*(F.lit(k / RANGES) for k in range(1, RANGES))), 10 * RANGES).alias("cuts"))
    keyed = keyed.join(F.broadcast(edges), "q").withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("key")))).drop("cuts")
    by_key = _prefixed(keyed.groupBy("q", "part", "key").agg(F.count(F.lit(1)).cast("double").alias("n")), ["q"], "part", "key", "n")
    tie = F.row_number().over(Window.partitionBy("q", "key").orderBy("i"))
    placed = keyed.withColumn("tie", tie).join(by_key.select("q", "key", "before"), ["q", "key"])
    placed = placed.join(better, ["q", "i"], "left")
    return placed.select("q", "i", (F.col("before") + F.col("tie")).cast("bigint").alias("place"), F.col("p").alias("share"), *(F.col(str(k)).cast("bigint").alias(f"better_{c}") for k, c in enumerate(names)))


#: bm25 is negative and smaller is better; the others grow with quality.
HIT_SCORES = {"bm25": False, "semantic_score": True, "score": True}


def in_front(fused: DataFrame, names: list[str], fewer: int = 5) -> DataFrame:
    """Items of a fused ranking that have every score, with fewer than `fewer` strictly better
    by each."""
    out = fused
    for c in names:
        out = out.where(F.coalesce(F.col(f"better_{c}") < fewer, F.lit(False)))
    return out

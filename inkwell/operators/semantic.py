"""Similarity of segment vectors with query vectors, for chunks and files.

One query is answered in the JVM (dot products as array expressions over the scan); the
signals of the combined score come from one pass over the products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import dot, unit, usable

SUPPORT, CENTROID, SUPPORT_DEPTH = 0.3, 0.2, 2


def unit_segments(segments: DataFrame, dim: int = 64) -> DataFrame:
    """(seg_id, chunk_id, file_id, seg, u) of usable vectors, each segment once."""
    some = segments.where(usable(F.col("vec"), dim)).dropDuplicates(["seg_id"])
    return some.select("seg_id", "chunk_id", "file_id", "seg", unit(F.col("vec")).alias("u"))


def similarities(units: DataFrame, query: list[float]) -> DataFrame:
    """Adds `sim`: the product with the query's unit vector."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return units.withColumn("sim", F.round(dot(F.col("u"), q), 9)).drop("u")


def chunk_best(sims: DataFrame) -> DataFrame:
    """(chunk_id, file_id, sim, best_seg): the best segment of each chunk, the first of equals."""
    top = F.max_by(F.struct("sim", "seg", "file_id"), F.struct("sim", -F.col("seg"), -F.col("seg_id"))).alias("t")
    return sims.groupBy("chunk_id").agg(top).select("chunk_id", "t.file_id", "t.sim", F.col("t.seg").alias("best_seg"))


def file_support(sims: DataFrame, depth: int = SUPPORT_DEPTH) -> DataFrame:
    """(file_id, support): mean of the best `depth` similarities of each file."""
    w = Window.partitionBy("file_id").orderBy(F.desc("sim"), "seg_id")
    return sims.withColumn("n", F.row_number().over(w)).where(F.col("n") <= depth).groupBy("file_id").agg(F.avg("sim").alias("support"))


def centroids(units: DataFrame) -> DataFrame:
    """(file_id, u): unit mean direction of each file. Vectors are added up in Arrow batches, so
    a sum for each file of a batch is shuffled, not 64 rows a vector."""
    kind = units.schema["file_id"].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1)
            v = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            names = batch.column(0).dictionary_encode(null_encoding="encode")
            which = names.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(which, kind="stable")
            at = np.flatnonzero(np.append(True, np.diff(which[order]) != 0))
            total = np.add.reduceat(v[order], at, axis=0)
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(which[order][at])), pa.array(list(total), pa.list_(pa.float64()))], names=["file_id", "v"])

    parts = units.select("file_id", "u").mapInArrow(sums, f"file_id {kind}, v array<double>")
    whole = parts.groupBy("file_id").agg(F.collect_list("v").alias("some"))
    vec = F.aggregate(F.slice("some", 2, F.size("some")), F.col("some")[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return whole.select("file_id", unit(vec).alias("u"))


def batch_topk(queries: DataFrame, rows: DataFrame, k: int = 10, block: int = 2_048) -> DataFrame:
    """(query_id, id, rank, sim): of every query (query_id, vec) the k rows (id, vec) with the
    greatest cosine, ties by id; a stated set of queries against all rows, in blocks.

    Both sides are packed to blocks of vectors; every block of queries meets every block of
    rows in a matrix product, which leaves k candidates a query. Unusable vectors (null, NaN,
    infinite or zero) are in no block; vectors of another length than the queries' are left out.
    """
    first = queries.where("vec is not null").select(F.size("vec").alias("n")).agg(F.max("n")).first()[0] or 0

    def packed(df: DataFrame, key: str, name: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, block):
                    part = batch.slice(a, block)
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                    x /= np.sqrt((x * x).sum(1))[:, None]
                    yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=[f"{name}_ids", f"{name}_x"])

        some = df.where(F.col(key).isNotNull() & usable(F.col("vec"), first)).groupBy(key).agg(F.first("vec").alias("vec"))
        return some.select(F.col(key).cast("bigint"), F.col("vec").cast("array<double>")).mapInArrow(run, f"{name}_ids binary, {name}_x binary")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qi, qx, ri, rx in zip(*(c.to_pylist() for c in batch.columns)):
                q, ids = np.frombuffer(qi, "<i8"), np.frombuffer(ri, "<i8")
                s = np.round(np.frombuffer(qx).reshape(len(q), -1) @ np.frombuffer(rx).reshape(len(ids), -1).T, 9)
                order = np.argsort(ids, kind="stable")
                top = order[np.argsort(-s[:, order], axis=1, kind="stable")[:, :k]]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, top.shape[1])), pa.array(ids[top].ravel()), pa.array(np.take_along_axis(s, top, 1).ravel())], names=["query_id", "id", "sim"])

    # Blocks, not rows, are paired: a block of queries for every two thousand of them.
    pairs = packed(queries, "query_id", "q").crossJoin(packed(rows, "id", "r"))
    found = pairs.mapInArrow(compare, "query_id bigint, id bigint, sim double")
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "id", "rank", "sim")


def combined(units: DataFrame, query: list[float]) -> DataFrame:
    """(chunk_id, file_id, best_seg, semantic_score): best segment, plus shares of the file's
    support and of its centroid's similarity."""
    sims = similarities(units, query)
    cent = similarities(centroids(units), query).withColumnRenamed("sim", "cent")
    out = chunk_best(sims).join(file_support(sims), "file_id", "left").join(cent, "file_id", "left")
    score = F.col("sim") + SUPPORT * F.coalesce("support", F.lit(0.0)) + CENTROID * F.coalesce("cent", F.lit(0.0))
    return out.select("chunk_id", "file_id", "best_seg", score.alias("semantic_score"))


def centred(units: DataFrame) -> DataFrame:
    """Unit vectors less their mean, made unit again. The mean is one row of `dim` sums."""
    sums = units.select(F.posexplode("u").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"))
    mean = F.broadcast(sums.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean")))
    away = unit(F.zip_with("u", "mean", lambda a, b: a - b))
    return units.join(mean).select(*[c for c in units.columns if c != "u"], away.alias("u"))

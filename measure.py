"""

    python measure.py /root/testdata/sf0.01 /root/testdata/sf0.1
"""

from __future__ import annotations

import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from inkwell.operators import bm25, semantic
from inkwell.operators.vault import Vault
from inkwell.sources.tables import table


def timed(f) -> tuple[float, object]:
    began = time.perf_counter()
    out = f()
    return time.perf_counter() - began, out


def main(small: str, large: str) -> None:
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found: dict[str, float] = {}
    spark.range(10).count()
    for name, folder in (("small", small), ("large", large)):
        docs = table(spark, folder, "documents")
        found[f"index_build_{name}_s"], index = timed(lambda d=docs: bm25.lay(d, "doc_id", "text"))
        if name == "small":
            warm = bm25.Index(index.postings.cache(), index.lengths.cache(), index.df)
            warm.postings.count(), warm.lengths.count()
            took = []
            for word in ["team review", "notes", "watcher index", "archive team", "review", "index", "short note", "team"] * 4:
                took.append(timed(lambda w=word: bm25.search_text(warm, w).orderBy("bm25", "id").limit(10).collect())[0])
            took = sorted(took[8:])
            found["warm_query_p50_ms"], found["warm_query_p95_ms"] = 1000 * took[len(took) // 2], 1000 * took[int(len(took) * 0.95)]
        else:
            items = table(spark, folder, "eval_items").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
            s, rows = timed(lambda: bm25.best(bm25.search(index, bm25.query_terms(items, True), False), F.col("bm25"), 10).count())
            found["batch_bm25_queries_per_s"] = items.count() / s
    rows = table(spark, large, "segments").select(F.col("seg_id").alias("id"), "vec")
    asked = rows.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    s, n = timed(lambda: semantic.batch_topk(asked, rows).select("query_id").distinct().count())
    found["batch_vector_queries_per_s"] = n / s
    scanned = table(spark, large, "documents").where("text is not null").select(F.concat(F.lit("/v/"), F.col("doc_id"), F.lit(".md")).alias("path"), F.concat(F.col("doc_id"), F.lit(".md")).alias("rel_path"), F.lit(1.0).alias("mtime"), F.length("text").cast("bigint").alias("size"), F.col("text").alias("content"))
    v = Vault(spark)
    found["vault_first_reconcile_s"], _ = timed(lambda: v.reconcile(scanned, 1.0))
    edited = scanned.withColumn("content", F.when(F.xxhash64("path") % 100 == 0, F.concat("content", F.lit("\nmore"))).otherwise(F.col("content")))
    found["reconcile_1_percent_s"], _ = timed(lambda: v.reconcile(edited, 2.0))
    print(json.dumps({k: round(x, 2) for k, x in found.items()}))
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:3])

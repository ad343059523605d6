"""Commands over a folder: index, search, evaluate, mine aliases, and the tool server.

    python -m inkwell.cli --index FOLDER
    python -m inkwell.cli --search FOLDER -- WORDS
    python -m inkwell.cli --eval FOLDER QUERIES.json
    python -m inkwell.cli --eval-structured FOLDER QUERIES.json
    python -m inkwell.cli --mine-aliases FOLDER OUT.json [LEAST]
    python -m inkwell.cli --serve FOLDER
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
import time
from typing import IO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import evaluate
from inkwell.operators.embed import HashingEmbedder
from inkwell.operators.service import SearchService, handle
from inkwell.operators.vault import Vault
from inkwell.plans.query import load_aliases
from inkwell.sources.files import scan

MODES = ("lexical", "semantic", "hybrid")


def warehouse(root: str, base: str) -> str:
    """The folder of a vault's index: one for each real path."""
    return f"{base.rstrip('/')}/{hashlib.md5(os.path.realpath(root).encode()).hexdigest()}"


def opened(spark: SparkSession, root: str, base: str | None, embed: bool = True) -> tuple[Vault, SearchService]:
    """The vault of a folder, brought up to date, and a service over it."""
    v = Vault(spark, warehouse(root, base) if base else None)
    v.reconcile(scan(spark, root))
    embedder = HashingEmbedder()
    if embed:
        v.embed_missing(embedder)
    names = ("files", "chunks", "frontmatter", "tasks", "code_blocks", "segments")
    rel = {n: v.read(n) for n in names} | {"links": v.resolved_links()}
    return v, SearchService(rel, embedder if embed else None, load_aliases(root)).cache()


def read_queries(path: str) -> list[dict]:
    """Labelled queries: {query, gold, type} or {query, gold_set}."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def gold_rank(hits: DataFrame, gold: str) -> int | None:
    """The place of the gold file among the files of the hits, each counted once."""
    seen: dict[str, int] = {}
    for r in hits.select("rel_path").collect():
        seen.setdefault(r.rel_path, len(seen) + 1)
    return next((n for p, n in seen.items() if p == gold or p.rsplit("/", 1)[-1] == gold), None)


def evaluated(service: SearchService, queries: list[dict], limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """(recall table, latency percentiles in ms by mode) of labelled queries in all modes."""
    ranks, times = [], []
    for mode in MODES:
        for q in queries:
            began = time.perf_counter()
            ranks.append((mode, q.get("type", "query"), gold_rank(service.search(q["query"], limit, mode), q["gold"])))
            times.append((mode, 1000 * (time.perf_counter() - began)))
    spark = service.spark
    table = evaluate.recall_table(spark.createDataFrame(ranks, "mode string, type string, gold_rank int"), ["mode", "type"])
    return table, evaluate.index_percentiles(spark.createDataFrame(times, "mode string, ms double"), "mode", "ms")


def evaluated_structured(service: SearchService, queries: list[dict], limit: int = 500) -> DataFrame:
    """Precision and recall of filter queries against their gold sets."""
    got = [(n, r.rel_path) for n, q in enumerate(queries) for r in service.search(q["query"], limit).select("rel_path").collect()]
    want = [(n, g) for n, q in enumerate(queries) for g in q["gold_set"]]
    make = lambda rows: service.spark.createDataFrame(rows, "query_id int, item string")
    return evaluate.precision_recall(make(got), make(want))


def serve(service: SearchService, lines: IO[str], out: IO[str]) -> None:
    """Answers JSON-RPC requests, one a line, until the input ends."""
    for line in lines:
        if line.strip() and (answer := handle(service, line)):
            out.write(answer + "\n")
            out.flush()


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    if len(argv) < 2 or not argv[0].startswith("--"):
        print(__doc__)
        return 2
    command, root, *rest = argv
    spark = spark or SparkSession.builder.getOrCreate()
    vault, service = opened(spark, root, os.environ.get("INKWELL_WAREHOUSE"), embed=command not in ("--mine-aliases",))
    if command == "--index":
        print(json.dumps(vault.counts()))
    elif command == "--search":
        words = " ".join(rest[1:] if rest[:1] == ["--"] else rest)
        hits = service.search(words, 20).collect()
        top = max([r.score for r in hits], default=1.0)
        for r in hits:
            print(f"{round(100 * r.score / top):3d} {r.rel_path}#{r.heading_slug or ''} {r.snippet}")
    elif command == "--eval":
        for part in evaluated(service, read_queries(rest[0])):
            part.orderBy(part.columns[0]).show(100, False)
    elif command == "--eval-structured":
        table = evaluated_structured(service, read_queries(rest[0]))
        table.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.bool_and("exact").alias("all_exact")).show()
    elif command == "--mine-aliases":
        found = evaluate.mine_aliases(vault.read("chunks"), HashingEmbedder(), float(rest[1]) if len(rest) > 1 else 0.9)
        with open(rest[0], "w", encoding="utf-8") as f:
            json.dump([[a, b] for a, b, _ in found], f, ensure_ascii=False, indent=1)
    elif command == "--serve":
        serve(service, sys.stdin, sys.stdout)
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

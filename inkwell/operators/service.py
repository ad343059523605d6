"""Search over a vault's relations: strict and relaxed text, structured and semantic signals
fused into hits; sections, backlinks and the tool façade."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import snippet, unit, usable
from inkwell.operators import bm25, filters, fusion, semantic
from inkwell.operators.links import backlinks
from inkwell.plans import query as plans

POOL, CONCEPT = 200, 3


class SearchService:
    """relations: files, chunks, frontmatter, links (resolved), and if there are such tasks,
    code_blocks and segments. embedder and segments together enable the semantic signal."""

    def __init__(self, relations: dict[str, DataFrame], embedder=None, aliases: list[list[str]] = (), zone: str = "UTC"):
        self.r, self.embedder, self.aliases, self.zone = relations, embedder, list(aliases), zone
        self.index = bm25.lay(relations["chunks"], "chunk_id", "text")
        self.spark = relations["chunks"].sparkSession

    def cache(self) -> SearchService:
        """Keeps the laid-down postings and lengths in memory for many queries."""
        for df in (self.index.postings, self.index.lengths):
            df.cache()
        return self

    def _files(self, f: plans.Filters) -> DataFrame:
        return filters.matching(self.r["files"], f, self.r["frontmatter"], self.r.get("tasks"), self.r.get("code_blocks"))

    def _text(self, text: str, strict: bool, pool: int, f: plans.Filters) -> DataFrame:
        keep = self.r["chunks"].join(self._files(f).select("file_id"), "file_id", "left_semi").select(F.col("chunk_id").alias("id")) if f else None
        top = bm25.search_text(self.index, text, strict, keep).orderBy("bm25", "id").limit(pool)
        return top.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("bm25", "id")))

    def search(self, raw: str, limit: int = 50, mode: str = "hybrid", excluded: frozenset[str] = frozenset(), now: float | None = None, pre_filter: bool = False) -> DataFrame:
        """Hits of one search string, best first; mode is hybrid, lexical or semantic."""
        clock = plans.Clock.at(time.time() if now is None else now, self.zone)
        q = plans.without(plans.plan(raw, clock), set(excluded), clock)
        f, pool = q.filters, max(limit, POOL)
        signals: dict[str, tuple[DataFrame, list]] = {}
        concept = False
        if q.terms and mode != "semantic":
            strict = self._text(q.text, True, pool, f)
            concept = mode == "hybrid" and strict.limit(CONCEPT).count() < CONCEPT
            signals["strict"] = (strict.drop("rank"), [F.col("bm25")])
        if not q.terms and f:
            top = filters.structured(self._files(f), self.r["chunks"]).orderBy(F.desc("mtime"), "file_id").limit(pool)
            # A file without chunk is a hit of its own, keyed by its negated id.
            signals["structured"] = (top.select(F.lit(0).alias("query_id"), F.coalesce("chunk_id", -F.col("file_id")).alias("id"), "mtime"), [F.desc("mtime")])
        sims = None
        if q.terms and mode != "lexical" and self.embedder is not None and "segments" in self.r:
            vec = [float(x) for x in self.embedder.embed([q.text], "query")[0]]
            dim = self.embedder.dimension
            some = self.r["segments"].where(usable(F.col("vec"), dim))
            if pre_filter and f:
                some = some.join(self._files(f).select("file_id"), "file_id", "left_semi")
            units = some.select(F.xxhash64("chunk_id", "seg").alias("seg_id"), "chunk_id", "file_id", "seg", unit(F.col("vec")).alias("u"))
            if concept:
                sims = semantic.combined(units, vec)
            else:
                sims = semantic.chunk_best(semantic.similarities(units, vec)).withColumnRenamed("sim", "semantic_score")
            sims = sims.orderBy(F.desc("semantic_score"), "chunk_id").limit(pool)
            if f:
                sims = sims.join(self._files(f).select("file_id"), "file_id", "left_semi")
            signals["semantic"] = (sims.select(F.lit(0).alias("query_id"), F.col("chunk_id").alias("id"), "semantic_score"), [F.desc("semantic_score")])
        if concept and any(df.limit(1).count() for df, _ in signals.values()):
            # Relaxed matches support the other signals; alone they are no result.
            text = " ".join([q.text, *plans.expand(q.text, self.aliases)])
            signals["relaxed"] = (self._text(text, False, pool, f).drop("rank"), [F.col("bm25")])
        if not signals:
            return self._empty()
        fused = fusion.rrf(fusion.ranked_lists(signals)).drop("query_id")
        strict_scores = signals["strict"][0].select("id", "bm25") if "strict" in signals else self.spark.createDataFrame([], "id bigint, bm25 double")
        sim_scores = (
            sims.select(F.col("chunk_id").alias("id"), "semantic_score", "best_seg") if sims is not None else self.spark.createDataFrame([], "id bigint, semantic_score double, best_seg int")
        )
        chunks = self.r["chunks"].select(F.col("chunk_id").alias("id"), "file_id", "heading_slug", "heading_path", "text")
        files = self.r["files"].select("file_id", "path", "rel_path", "title")
        hits = fused.join(chunks, "id", "left").withColumn("file_id", F.coalesce("file_id", -F.col("id"))).join(files, "file_id")
        hits = hits.join(strict_scores, "id", "left").join(sim_scores, "id", "left")
        has = lambda *names: F.arrays_overlap("signals", F.array(*(F.lit(n) for n in names)))
        kinds = F.array_compact(F.array(F.when(has("strict", "relaxed"), "lexical"), F.when(has("semantic"), "semantic"), F.when(F.lit(bool(f)), "structured")))
        key = F.concat("path", F.lit("#"), F.coalesce("heading_slug", F.lit("")))
        hits = hits.withColumns({"kinds": kinds, "key": key}).orderBy(F.desc("score"), F.desc(F.coalesce("semantic_score", F.lit(-1.0))), "key", "id").limit(limit)
        if sims is not None:
            seg_text = self.r["segments"].select(F.col("chunk_id").alias("id"), F.col("seg").alias("best_seg"), F.col("text").alias("best_passage"))
            hits = hits.join(seg_text, ["id", "best_seg"], "left")
        else:
            hits = hits.withColumn("best_passage", F.lit(None).cast("string"))
        passage = F.col("best_passage").isNotNull() & ~has("strict")
        shown = F.when(passage, snippet(F.col("best_passage"), list(q.terms))).otherwise(snippet(F.coalesce("text", F.lit("")), list(q.terms)))
        out = hits.select("path", "rel_path", "title", "heading_path", "heading_slug", shown.alias("snippet"), "score", "bm25", "semantic_score", "best_passage", "kinds", F.col("id").alias("chunk_id"), "key")
        return out.orderBy(F.desc("score"), F.desc(F.coalesce("semantic_score", F.lit(-1.0))), "key", "chunk_id").drop("key")

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], "path string, rel_path string, title string, heading_path string, heading_slug string, snippet string, score double, bm25 double, semantic_score double, best_passage string, kinds array<string>, chunk_id bigint")

    def search_batch(self, queries: DataFrame, limit: int = 50, relaxed: bool = False) -> DataFrame:
        """(query_id, id, bm25, rank) of many queries (query_id, query) in one plan."""
        return bm25.best(bm25.search(self.index, bm25.query_terms(queries, relaxed), not relaxed), F.col("bm25"), limit)

    def section(self, rel_path: str, slug: str | None = None) -> DataFrame:
        """The section with a slug, or the first one, as `# breadcrumb` and text."""
        own = self.r["files"].where(F.col("rel_path") == rel_path).select("file_id", "title")
        some = self.r["chunks"].join(own, "file_id")
        if slug is not None:
            some = some.where(F.col("heading_slug") == slug)
        top = some.orderBy("start_line", "chunk_id").limit(1)
        head = F.coalesce(F.nullif("heading_path", F.lit("")), "title", F.lit(""))
        return top.select(F.concat(F.lit("# "), head, F.lit("\n\n"), "text").alias("section"))

    def backlinks(self, rel_path: str) -> DataFrame:
        return backlinks(self.r["links"], self.r["files"]).where(F.col("target_rel") == rel_path).select("src_rel", "title", "anchor").orderBy("src_rel", "anchor")

    def structured_query(self, f: plans.Filters, limit: int = 50) -> DataFrame:
        top = filters.structured(self._files(f), self.r["chunks"]).orderBy(F.desc("mtime"), "file_id").limit(limit)
        return top.select("rel_path", "title", "heading_path", "heading_slug", F.substring("text", 1, 200).alias("snippet")).orderBy("rel_path")


# The tool façade: names, arguments and error codes are fixed values.
TOOLS = ["search", "structured_query", "get_section", "list_backlinks"]


def _many(v) -> tuple[str, ...]:
    return () if v is None else (v,) if isinstance(v, str) else tuple(v)


def tool_filters(args: dict, clock: plans.Clock) -> plans.Filters:
    """Arguments of structured_query as filters; modified_before is the start of that day."""
    start = lambda v: (plans.date_range(v, clock.now.tzinfo) or (None, None))[0] if v else None
    paths = _many(args.get("path"))
    return plans.Filters(
        tags=_many(args.get("tags")), status=_many(args.get("status")), paths=paths, exts=_many(args.get("ext")), langs=_many(args.get("lang")),
        after=start(args.get("modified_after")), before=start(args.get("modified_before")), task=args.get("is_task"),
    )


def handle(service: SearchService, request: str) -> str | None:
    """One JSON-RPC request line to its answer; notifications have none."""
    try:
        message = json.loads(request)
    except ValueError:
        return None
    ident = message.get("id")
    if ident is None:
        return None
    answer = {"jsonrpc": "2.0", "id": ident}
    method, params = message.get("method"), message.get("params") or {}
    if method == "initialize":
        result = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "inkwell", "version": "1"}}
    elif method == "ping":
        result = {}
    elif method == "tools/list":
        result = {"tools": [{"name": t} for t in TOOLS]}
    elif method != "tools/call":
        return json.dumps(answer | {"error": {"code": -32601, "message": f"method not found: {method}"}})
    else:
        name, args = params.get("name"), params.get("arguments") or {}
        if name == "search" and args.get("query"):
            hits = service.search(args["query"], int(args.get("limit", 20)))
            out = [
                {"relPath": r.rel_path, "title": r.title, "headingPath": r.heading_path, "headingSlug": r.heading_slug, "snippet": r.snippet, "kinds": sorted(r.kinds), "score": round(r.score, 4)}
                for r in hits.collect()
            ]
        elif name == "structured_query":
            f = tool_filters(args, plans.Clock.at(time.time(), service.zone))
            out = [{"relPath": r.rel_path, "title": r.title, "snippet": r.snippet} for r in service.structured_query(f, int(args.get("limit", 50))).collect()]
        elif name == "get_section" and args.get("path"):
            out = [r.section for r in service.section(args["path"], args.get("slug")).collect()]
        elif name == "list_backlinks" and args.get("path"):
            out = [{"relPath": r.src_rel, "title": r.title, "anchor": r.anchor} for r in service.backlinks(args["path"]).collect()]
        else:
            return json.dumps(answer | {"error": {"code": -32602, "message": f"invalid arguments for {name}"}})
        text = out[0] if name == "get_section" and out else json.dumps(out, ensure_ascii=False)
        result = {"content": [{"type": "text", "text": text}]}
    return json.dumps(answer | {"result": result}, ensure_ascii=False)

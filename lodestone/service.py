"""Search and lookups over an index store."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.embed import checked
from .functions.stem import added_stems
from .functions.text import ABSTENTION, code_parts, code_tokens
from .operators import answers, context, dense, fusion, graph, lexical, ranges
from .operators.replies import loop_cut
from .session import durable
from .sources.store import IndexStore

MODES = ("bm25", "dense", "fused")
MAX_K, MAX_LIMIT, MAX_ASKED = 50, 2000, 20
PLAIN = f"Answer from the code chunks alone. Cite what you use by its tag, as in [C1]. If they hold no answer, say just: {ABSTENTION}"
QUOTING = f"First write a section Evidence: with one line a tag and an exact quote, as in [C1] `x = 1`, then Answer: with the answer and its tags. If the chunks hold no answer, say just: {ABSTENTION}"


class Generator(Protocol):
    """A model that answers: a column of replies from columns of the system text and the message."""

    def replies(self, system: Column, message: Column) -> Column: ...


class ScriptedGenerator:
    """A stand-in: the first reply (pairs of a pattern and a reply) whose pattern the message holds."""

    def __init__(self, script: list[tuple[str, str]], otherwise: str = ABSTENTION):
        self.script, self.otherwise = script, otherwise

    def replies(self, system: Column, message: Column) -> Column:
        return F.coalesce(*(F.when(F.rlike(message, F.lit(p)), F.lit(r)) for p, r in self.script), F.lit(self.otherwise))


@dataclass(frozen=True)
class SearchSettings:
    """Dense retrieval with two hops of expansion at weight 2, unless told otherwise; no hops expand nothing."""

    mode: str = "dense"
    hops: int = 2
    weight: float = 2.0
    rrf_k: int = fusion.RRF_K
    dense_weight: float = 1.0

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        if self.hops < 0 or self.weight <= 0:
            raise ValueError("hops must not be negative and weight must be above 0")

    def describe(self) -> str:
        return self.mode + (f"+graph(hops={self.hops}, weight={self.weight:g})" if self.hops and self.mode != "bm25" else "")


class Service:
    """Reads the store's current generation; ``refresh`` follows a newer manifest."""

    def __init__(self, store: IndexStore):
        self.store, self.stamp = store, None
        self.refresh()

    def refresh(self) -> None:
        m = self.store.checked()
        if m is None:
            raise LookupError("there is no index yet")
        if m["data"] != self.stamp:
            self.stamp = m["data"]
            self.chunks, self.vectors, self.edges = (self.store.table(n).cache() for n in ("chunks", "vectors", "edges"))

    def search(self, queries: DataFrame, k: int = 10, settings: SearchSettings = SearchSettings()) -> DataFrame:
        """``qid, hit_rank, chunk_id, score, sources, ranks, raw_scores, first_line, last_line`` of ``queries``
        (qid, query); blank ones have no hits. Raw scores are those of the lists the hit was in; its lines are
        those of the best part where the dense list has it, else the whole chunk's."""
        if not 0 < k <= MAX_K:
            raise ValueError(f"k must be from 1 to {MAX_K}")
        lists, raw, relevance = self._lists(queries, max(4 * k, 50), settings)
        fused = fusion.fuse(lists, ["qid"], settings.rrf_k)
        if relevance is not None and settings.hops:
            fused = self._expanded(lists, fused, settings, relevance)
        return self._hits(fused.where(F.col("fused_rank") <= k), raw)

    def _asked(self, queries: DataFrame) -> DataFrame:
        return queries.where(F.trim("query") != "").select(F.lit("all").alias("part"), F.col("qid").cast("long").alias("qid"), "query")

    def _lists(self, queries: DataFrame, n: int, settings: SearchSettings):
        """Ranked lists (qid, source, item, item_rank, weight), raw scores with matched parts, and, unless the
        mode is bm25, the relevance that expansion weighs by."""
        asked, lists, raw, relevance = self._asked(queries), [], [], None
        if settings.mode != "dense":
            text = F.concat_ws(" ", "path", "qualname", "source")
            docs = self.chunks.select(F.lit("all").alias("part"), "doc", F.concat(code_tokens(text), added_stems(code_parts(text))).alias("tokens"))
            names = self.chunks.where("kind <> 'module'").select(F.lit("all").alias("part"), F.lower("symbol").alias("name"))
            found = lexical.bm25(docs, lexical.query_tokens(asked, names, stem=True), n)
            lists.append(found.select("qid", F.lit("bm25").alias("source"), F.col("doc").alias("item"), F.col("bm25_rank").alias("item_rank"), F.lit(1.0).alias("weight")))
            raw.append(found.select("qid", F.lit("bm25").alias("source"), F.col("doc").alias("item"), F.col("score").alias("raw"), F.lit(None).cast("int").alias("part_no")))
        if settings.mode != "bm25":
            parts = self.vectors.select(F.lit("all").alias("part"), "doc", "part_no", "vector")
            vectors = asked.select("part", "qid", checked(self.store.embedder.queries(F.col("query")), self.store.embedder.dim).alias("vector"))
            found = durable(dense.dense(parts, vectors, n))
            lists.append(found.select("qid", F.lit("dense").alias("source"), F.col("doc").alias("item"), F.col("dense_rank").alias("item_rank"), F.lit(settings.dense_weight).alias("weight")))
            raw.append(found.select("qid", F.lit("dense").alias("source"), F.col("doc").alias("item"), F.col("cosine").alias("raw"), "part_no"))
            relevance = dense.relevance(parts, vectors)
        return reduce(DataFrame.unionByName, lists), reduce(DataFrame.unionByName, raw), relevance

    def _expanded(self, lists: DataFrame, fused: DataFrame, settings: SearchSettings, relevance) -> DataFrame:
        """The fused order after expansion over the call graph, within its budget."""
        base = durable(fused.select("qid", "item", F.col("fused_rank").alias("item_rank")))
        edges = self.edges.select(F.col("src_doc").alias("src"), F.col("dst_doc").alias("dst"), "type")
        near = graph.expand(edges, base, ["qid"], relevance, settings.hops, settings.rrf_k)
        more = near.select("qid", F.lit("graph").alias("source"), "item", F.col("graph_rank").alias("item_rank"), F.lit(settings.weight).alias("weight"))
        again = fusion.fuse(lists.unionByName(more), ["qid"], settings.rrf_k)
        order = fusion.apply_budget(base, again.select("qid", "item", F.col("fused_rank").alias("item_rank")), ["qid"])
        return again.join(order, ["qid", "item"]).withColumn("fused_rank", F.col("final_rank"))

    def _hits(self, top: DataFrame, raw: DataFrame) -> DataFrame:
        scores = raw.groupBy("qid", "item").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "raw")))).alias("raw_scores"), F.max("part_no").alias("part_no"))
        rows = top.join(scores, ["qid", "item"], "left").withColumnRenamed("item", "doc")
        rows = rows.join(self.chunks.select("doc", "chunk_id", "start_line", "end_line", "spans"), "doc")
        parts = self.vectors.select("doc", "part_no", F.col("first_line").alias("a"), F.col("last_line").alias("b"))
        numbers = ranges.line_numbers(F.col("spans"), F.col("start_line"), F.col("end_line"))
        rows = rows.join(parts, ["doc", "part_no"], "left").withColumn("numbers", numbers)
        line = lambda c, whole: F.coalesce(F.get("numbers", F.least(F.col(c), F.size("numbers") - 1)), F.col(whole))
        order = F.array(*(F.lit(s) for s in ("bm25", "dense", "graph")))
        return rows.select(
            "qid", F.col("fused_rank").alias("hit_rank"), "chunk_id", "score", F.filter(order, lambda s: F.map_contains_key("ranks", s)).alias("sources"), "ranks",
            F.coalesce("raw_scores", F.create_map().cast("map<string,double>")).alias("raw_scores"), line("a", "start_line").alias("first_line"), line("b", "end_line").alias("last_line"),
        )

    def contexts(self, queries: DataFrame, hits: DataFrame, budget: int = 12_000) -> DataFrame:
        """The blocks of each query's ``hits`` that fit into ``budget``."""
        rows = hits.join(self.chunks.select("chunk_id", F.col("doc").alias("chunk_no"), "kind", "start_line", "end_line", "spans", "source"), "chunk_id")
        rows = rows.withColumn("numbers", ranges.line_numbers(F.col("spans"), F.col("start_line"), F.col("end_line")))
        narrow = F.map_contains_key("raw_scores", "dense")
        rows = rows.withColumn("from_line", F.when(narrow, F.col("first_line"))).withColumn("to_line", F.when(narrow, F.col("last_line")))
        return context.contexts(rows.join(queries.select("qid", F.col("query").alias("question")), "qid").withColumnRenamed("qid", "question_id"), budget)

    def ask(self, queries: DataFrame, generator: Generator, k: int = 8, settings: SearchSettings = SearchSettings(), budget: int = 12_000, quoting: bool = False) -> DataFrame:
        """``qid, text, status, verification, citations, unknown_tags, kept`` of each query: its hits packed into
        a context, answered by ``generator`` and checked. ``kept`` is the length kept of a reply that went round
        in circles. With ``quoting`` a reply whose quotes don't hold is withheld. Queries without hits abstain."""
        if not 0 < k <= MAX_ASKED:
            raise ValueError(f"k must be from 1 to {MAX_ASKED}")
        hits = durable(self.search(queries, k, settings))
        blocks = durable(self.contexts(queries, hits, budget))
        asked = queries.select(F.col("qid").alias("question_id"), F.col("query").alias("question"))
        messages = context.messages(blocks, asked).join(blocks.select("question_id").distinct(), "question_id")
        system = F.lit(QUOTING if quoting else PLAIN)
        replies = messages.select(F.col("question_id").alias("qid"), generator.replies(system, F.col("message")).alias("reply"))
        replies = replies.withColumn("kept", loop_cut(F.col("reply")))
        replies = durable(replies.withColumn("reply", F.when(F.col("kept").isNotNull(), F.expr("substring(reply, 1, kept)")).otherwise(F.col("reply"))))
        shown = blocks.select(F.col("question_id").alias("group"), "tag", F.concat_ws(":", "question_id", "tag").alias("item"), "first_shown", "text")
        return answers.checked(queries, replies, shown, quoting)

    def get_chunk(self, chunk_id: str) -> dict:
        row = self.chunks.where(F.col("chunk_id") == chunk_id).head()
        if row is None:
            raise LookupError(f"no chunk {chunk_id!r}")
        return row.asDict(recursive=True)

    def list_symbols(self, prefix: str = "", kind: str | None = None, limit: int = 200) -> dict:
        """The first symbols in order of path and line, their number before the cut, and whether it cut."""
        if not 0 < limit <= MAX_LIMIT:
            raise ValueError(f"limit must be from 1 to {MAX_LIMIT}")
        rows = self.chunks.where((F.col("kind") != "module") & F.startswith("path", F.lit(prefix.removeprefix("./"))))
        rows = rows if kind is None else rows.where(F.col("kind") == kind)
        total = rows.count()
        shown = rows.orderBy("path", "start_line", "chunk_id").limit(limit).select("chunk_id", "kind", "path", "start_line", "end_line").collect()
        return {"total": total, "truncated": total > limit, "symbols": [r.asDict() for r in shown]}

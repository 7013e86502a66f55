"""A versioned index: chunks, vectors and edges of one repository, in any folder that the session reaches.

A build writes a new generation beside the current one and then replaces the manifest in one step, so
readers see the old index or the new one. Vectors of chunks whose text hasn't changed are taken over. A
build that changes no row keeps the current generation; one that fails removes what it wrote. Chunks are
numbered in the order of their ids (``doc``); vectors and edges carry the numbers.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.embed import Embedder, HashEmbedder, checked
from ..functions.text import content_hash, embedding_header
from ..operators import callgraph, extract, packing
from ..operators.ranges import duplicate_ids
from ..operators.running import running_total
from ..session import durable
from .files import Files

VERSION = 2


class IndexMismatch(ValueError):
    """The index is of another version, model or repository."""


@dataclass(frozen=True)
class BuildStats:
    files: int
    chunks: int
    embedded: int
    reused: int
    deleted: int
    changed: bool


class IndexStore:
    def __init__(self, spark: SparkSession, root, embedder: Embedder | None = None, max_tokens: int = 512):
        self.spark, self.root, self.max_tokens = spark, str(root), max_tokens
        self.embedder = embedder or HashEmbedder()
        self.files = Files(spark, self.root)

    def manifest(self) -> dict | None:
        """What the manifest says; null if it is missing or unreadable."""
        try:
            found = json.loads(self.files.read("manifest.json") or "")
        except ValueError:
            return None
        return found if isinstance(found, dict) else None

    def checked(self, repository: str | None = None) -> dict | None:
        m = self.manifest()
        if m and (m.get("version") != VERSION or m.get("model") != self.embedder.name):
            raise IndexMismatch(f"index of version {m.get('version')} and model {m.get('model')}; rebuild it")
        if m and repository and m.get("repository") != repository:
            raise IndexMismatch(f"this index is of {m.get('repository')}")
        return m

    def table(self, name: str) -> DataFrame:
        m = self.checked()
        if not m:
            raise IndexMismatch("there is no index yet")
        return self.spark.read.parquet(f"{self.root}/{m['data']}/{name}")

    def chunks_of(self, files: DataFrame) -> DataFrame:
        rows = extract.symbols(files.withColumn("corpus", F.lit("repository"))).withColumn("qualname", F.concat_ws(".", "parent", "symbol"))
        rows = rows.withColumn("base", F.concat("path", F.lit("::"), "qualname"))
        rows = duplicate_ids(rows, ["path"], ["start_line", F.desc("end_line")], "base").drop("base", "corpus")
        header = embedding_header(F.col("path"), F.col("qualname"), F.col("kind"), F.coalesce("docstring", F.lit("")))
        rows = rows.withColumn("header", header)
        return rows.withColumn("hash", content_hash(F.lit(self.embedder.name), F.concat("header", "source")))

    def parts_of(self, chunks: DataFrame) -> DataFrame:
        """``chunk_id, hash, part_no, first_line, last_line, text``: whole texts of up to ``max_tokens``
        words, else greedy runs of lines, each after the header."""
        words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
        lines = F.split("source", "\n")
        budget = F.greatest(F.lit(self.max_tokens) - words(F.col("header")), F.lit(max(self.max_tokens // 4, 1)))
        whole = words(F.concat("header", "source")) <= self.max_tokens
        one = F.array(F.struct(F.lit(0).alias("first"), (F.size(lines) - 1).alias("last")))
        plan = F.when(whole, one).otherwise(packing.greedy_parts(F.transform(lines, words), budget))
        rows = chunks.select("chunk_id", "hash", "header", lines.alias("lines"), F.posexplode(plan).alias("part_no", "p"))
        text = F.concat("header", F.array_join(F.slice("lines", F.col("p.first") + 1, F.col("p.last") - F.col("p.first") + 1), "\n"))
        return rows.select("chunk_id", "hash", "part_no", F.col("p.first").alias("first_line"), F.col("p.last").alias("last_line"), text.alias("text"))

    def build(self, files: DataFrame, repository: str, rebuild: bool = False) -> BuildStats:
        """Indexes ``files`` (path, source)."""
        old = None if rebuild else self.checked(repository)
        chunks = durable(running_total(self.chunks_of(files).withColumn("one", F.lit(1).cast("long")), ["chunk_id"], "one").drop("one").withColumnRenamed("running", "doc"))
        empty = "chunk_id string, hash string, part_no int, first_line int, last_line int, vector array<double>"
        before = self.table("vectors").drop("doc") if old else self.spark.createDataFrame([], empty)
        known = self.table("chunks") if old else chunks.limit(0)
        same = before.join(chunks.select("chunk_id", "hash"), ["chunk_id", "hash"], "left_semi")
        stale = chunks.join(before.select("chunk_id", "hash").distinct(), ["chunk_id", "hash"], "left_anti")
        vector = checked(self.embedder.documents(F.col("text")), self.embedder.dim)
        fresh = self.parts_of(stale).select("chunk_id", "hash", "part_no", "first_line", "last_line", vector.alias("vector"))
        # whole rows, as a chunk can move without a change of its text
        row = lambda df: df.select("chunk_id", F.xxhash64(*[c for c in sorted(chunks.columns) if c != "doc"]).alias("row"))
        moved = row(chunks).join(row(known), ["chunk_id", "row"], "left_anti").count()
        gone = known.select("chunk_id").join(chunks.select("chunk_id"), "chunk_id", "left_anti").count()
        n_stale = stale.count()
        n = chunks.agg(F.count("*").alias("chunks"), F.count_distinct("path").alias("files")).head()
        stats = BuildStats(n.files, n.chunks, n_stale, n.chunks - n_stale, gone, bool(moved or gone or not old))
        if not stats.changed:
            return stats
        name = f"gen-{uuid.uuid4().hex}"
        target = f"{self.root}/{name}"
        try:
            chunks.write.parquet(f"{target}/chunks")
            numbers = chunks.select("chunk_id", "doc")
            same.unionByName(fresh).join(numbers, "chunk_id").write.parquet(f"{target}/vectors")
            edges, outcomes = callgraph.call_graph(extract.facts(files.withColumn("corpus", F.lit("repository"))))
            ends = edges.join(numbers.toDF("src", "src_doc"), "src").join(numbers.toDF("dst", "dst_doc"), "dst")
            ends.select("src", "dst", "type", "src_doc", "dst_doc").write.parquet(f"{target}/edges")
            resolution(outcomes).write.parquet(f"{target}/outcomes")
            self.files.write("manifest.json", json.dumps({"version": VERSION, "model": self.embedder.name, "repository": repository, "data": name, "stats": asdict(stats)}))
        except BaseException:
            self.files.delete(name)
            raise
        if old:
            self.files.delete(old["data"])
        return stats


def resolution(outcomes: DataFrame, examples: int = 8) -> DataFrame:
    """``use, outcome, n, examples``: what became of references by use, with the first ``examples`` places of
    each reason."""
    rows = outcomes.select(F.col("target").alias("use"), F.coalesce("reason", F.lit("resolved")).alias("outcome"), F.concat_ws(" ", F.concat("path", F.lit(":"), "line"), "text").alias("text"))
    counts = rows.groupBy("use", "outcome", "text").agg(F.count("*").alias("n"))
    order = Window.partitionBy("use", "outcome").orderBy("text")
    first = counts.where("outcome <> 'resolved'").withColumn("place", F.row_number().over(order)).where(F.col("place") <= examples)
    shown = first.groupBy("use", "outcome").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]).alias("examples"))
    return counts.groupBy("use", "outcome").agg(F.sum("n").alias("n")).join(shown, ["use", "outcome"], "left")

"""The registered queries of the engine; each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.embed import hash_embedding
from ..functions.stem import stems
from ..operators import callgraph, context, dense, evaluation, evidence, extract, fusion, graph, lexical, packing, ranges
from ..operators.latest import latest
from ..operators.replies import loop_cut
from ..session import durable, shuffle_width
from ..sources.tables import load
from . import base

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# Text functions


@query
def tokenize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = base.chunks(spark, sf_dir, "corpus", "source").select("corpus", F.explode(T.identifier_words(F.col("source"))).alias("word"))
    return words.groupBy("corpus", "word").agg(F.count("*").alias("n"))


@query
def tokenize_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = base.chunks(spark, sf_dir, "symbol").select("symbol").where("symbol is not null").distinct()
    return names.select("symbol", F.array_join(T.identifier_tokens(F.col("symbol")), " ").alias("tokens"))


def _asked(spark: SparkSession, sf_dir: str, stem: bool = True) -> DataFrame:
    rows = base.questions(spark, sf_dir, "corpus", "question").where("question is not null")
    asked = rows.select(F.col("corpus").alias("part"), F.col("question_id").alias("qid"), F.col("question").alias("query"))
    return lexical.query_tokens(asked, base.symbol_names(spark, sf_dir), stem)


@query
def query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query_tokens(spark, sf_dir, False)


def _query_tokens(spark: SparkSession, sf_dir: str, stem: bool) -> DataFrame:
    return _asked(spark, sf_dir, stem).select(F.col("qid").alias("question_id"), "token", "qtf")


@query
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.questions(spark, sf_dir, "question").select("question_id", F.explode(T.query_terms(F.col("question"))).alias("term"))


@query
def embedding_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.embedding_texts(spark, sf_dir).select("chunk_no", "header")


@query
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = base.embedding_texts(spark, sf_dir)
    return texts.select("chunk_no", T.content_hash(F.lit("hash-64"), F.concat("header", "source")).alias("hash"))


@query
def module_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = base.chunks(spark, sf_dir, "path").select("path").where("path is not null").distinct()
    return paths.select("path", T.module_name(F.col("path")).alias("module"), T.is_test_path(F.col("path")).alias("is_test"))


@query
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.chunks(spark, sf_dir, "kind", "source")
    return rows.select("chunk_no", T.signature(F.col("source"), F.col("kind")).alias("signature"))


@query
def normalised_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "index_vectors", "vec_id", "embedding").where(dense.usable(F.col("embedding"), 64))
    unit = T.normalised(F.col("embedding"))
    return rows.select("vec_id", F.posexplode(unit).alias("axis", "value")).select("vec_id", "axis", F.round("value", 6).alias("value"))


# Lexical and dense retrieval


@query
def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_lengths(spark, sf_dir, False)


def _doc_lengths(spark: SparkSession, sf_dir: str, stem: bool) -> DataFrame:
    return base.token_table(spark, sf_dir, stem).select(F.col("doc").alias("chunk_no"), F.size("tokens").alias("n_tokens"))


@query
def term_df_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _term_df_idf(spark, sf_dir, False)


def _term_df_idf(spark: SparkSession, sf_dir: str, stem: bool) -> DataFrame:
    table = base.token_table(spark, sf_dir, stem)
    docs = table.groupBy("part").agg(F.count("*").alias("docs"))
    df = table.select("part", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("part", "token").agg(F.count("*").alias("df"))
    return df.join(docs, "part").select(F.col("part").alias("corpus"), "token", "df", F.round(T.idf(F.col("docs"), F.col("df")), 6).alias("idf"))


@query
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks of each question in its corpus."""
    return _bm25_topk(spark, sf_dir, False)


def _bm25_topk(spark: SparkSession, sf_dir: str, stem: bool) -> DataFrame:
    found = lexical.bm25(base.text_table(spark, sf_dir), _asked(spark, sf_dir, stem), 10, stem)
    return found.select(F.col("qid").alias("question_id"), "bm25_rank", F.col("doc").alias("chunk_no"), "score")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Part and question vectors of the newest generation that each has."""
    vectors = load(spark, sf_dir, "index_vectors").where(dense.usable(F.col("embedding"), 64))
    newest = lambda key: vectors.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by("embedding", F.struct("generation", "vec_id")).alias("vector"))
    chunk = base.chunks(spark, sf_dir, "corpus").select("chunk_no", F.col("corpus").alias("part"))
    # ids meet before vectors, which move once less
    parts = load(spark, sf_dir, "embedding_parts", "part_id", "chunk_no", "part_no").join(chunk, "chunk_no").join(newest("part_id"), "part_id")
    asked = base.questions(spark, sf_dir, "corpus").join(newest("question_id"), "question_id")
    return (
        parts.select("part", F.col("chunk_no").alias("doc"), "part_no", "vector"),
        asked.select(F.col("corpus").alias("part"), F.col("question_id").alias("qid"), "vector"),
    )


def _dense(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return dense.dense(*_vectors(spark, sf_dir), n)


@query
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest chunks of each question in its corpus, by their best part."""
    found = _dense(spark, sf_dir, 10)
    return found.select(F.col("qid").alias("question_id"), "dense_rank", F.col("doc").alias("chunk_no"), "part_no", "cosine")


@query
def dense_part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File lines of the part that each dense hit matched."""
    found = _dense(spark, sf_dir, 10).select(F.col("qid").alias("question_id"), F.col("doc").alias("chunk_no"), "part_no")
    parts = load(spark, sf_dir, "embedding_parts", "chunk_no", "part_no", "first_line", "last_line")
    parts = parts.groupBy("chunk_no", "part_no").agg(F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"))
    start = base.chunks(spark, sf_dir, "start_line", "end_line", "spans")
    numbers = ranges.line_numbers(F.col("spans"), F.col("start_line"), F.col("end_line"))
    rows = found.join(parts, ["chunk_no", "part_no"]).join(start, "chunk_no").withColumn("numbers", numbers)
    line = lambda c: F.get("numbers", F.least(F.col(c), F.size("numbers") - 1))
    return rows.select("question_id", "chunk_no", "part_no", line("first_line").alias("from_line"), line("last_line").alias("to_line"))


# Fusion


def _fused(spark: SparkSession, sf_dir: str, stem: bool) -> DataFrame:
    lex = lexical.bm25(base.text_table(spark, sf_dir), _asked(spark, sf_dir, stem), 50, stem)
    sem = _dense(spark, sf_dir, 50)
    lists = lex.select("qid", F.lit("bm25").alias("source"), F.col("doc").alias("item"), F.col("bm25_rank").alias("item_rank")).unionByName(
        sem.select("qid", F.lit("dense").alias("source"), F.col("doc").alias("item"), F.col("dense_rank").alias("item_rank"))
    )
    return fusion.fuse(lists.withColumn("weight", F.lit(1.0)), ["qid"])


@query
def rrf_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both retrievers' 50 best chunks of each question fused; the first ten."""
    return _rrf_fused(spark, sf_dir, False)


def _rrf_fused(spark: SparkSession, sf_dir: str, stem: bool) -> DataFrame:
    top = _fused(spark, sf_dir, stem).where("fused_rank <= 10")
    return top.select(F.col("qid").alias("question_id"), "fused_rank", F.col("item").alias("chunk_no"), "score")


def _packed(spark: SparkSession, sf_dir: str, *sources: str, depth: int | None = None) -> DataFrame:
    """question_id, source, items: the engine's own lists, of 200 places, which configurations fuse. They move as
    one row a list, all lists of a question to one partition, so that fusing moves no items."""
    depth, out = depth or LIST_DEPTH, None
    for source in sources or ("bm25", "dense"):
        if source == "bm25":
            found = lexical.bm25(base.text_table(spark, sf_dir), _asked(spark, sf_dir, False), depth).withColumnRenamed("bm25_rank", "item_rank")
        else:
            found = _dense(spark, sf_dir, depth).withColumnRenamed("dense_rank", "item_rank")
        items = F.transform(F.array_sort(F.collect_list(F.struct("item_rank", "doc"))), lambda r: r["doc"])
        one = found.groupBy("part", "qid").agg(items.alias("items")).select(F.col("qid").alias("question_id"), F.lit(source).alias("source"), "items")
        out = one if out is None else out.unionByName(one)
    return out.repartition(shuffle_width(spark), "question_id")


def _lists(spark: SparkSession, sf_dir: str, *sources: str, depth: int | None = None) -> DataFrame:
    """question_id, source, item, item_rank of ``_packed``."""
    rows = _packed(spark, sf_dir, *sources, depth=depth).select("question_id", "source", F.posexplode("items").alias("place", "item"))
    return rows.withColumn("item_rank", F.col("place") + 1).drop("place")


def _own(lists: DataFrame) -> DataFrame:
    """question_id, item, item_rank of the default configuration, both lists fused, and the rank in the dense list."""
    fused = fusion.fuse(lists.withColumn("weight", F.lit(1.0)), ["question_id"], unique=True, of="dense")
    return fused.select("question_id", "item", F.col("fused_rank").alias("item_rank"), "of_rank")


#: Places of a list that configurations are fused from.
LIST_DEPTH = 200
#: The grid that fusion is swept over.
SWEEP = [(k, w) for k in (5, 10, 20, 60) for w in (1.0, 1.5, 2.0, 3.0)]


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, a, b: the dense list and the lexical one of each question, made once for all configurations."""
    ranked = F.transform("items", lambda x, i: F.struct(x.alias("item"), (i + 1).alias("item_rank")))
    side = lambda source: F.first(F.when(F.col("source") == source, ranked), True)
    return _packed(spark, sf_dir).groupBy("question_id").agg(side("dense").alias("a"), side("bm25").alias("b"))


@query
def rrf_weighted_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.sweep_rows(_both(spark, sf_dir), "question_id", SWEEP)
    return rows.select("config", "question_id", "fused_rank", F.col("item").alias("chunk_no"), "score")


@query
def single_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list alone keeps its order; its scores are 1 / (60 + rank)."""
    one = _lists(spark, sf_dir, "dense").withColumn("weight", F.lit(1.0))
    rows = fusion.fuse(one, ["question_id"])
    return rows.select("question_id", "fused_rank", F.col("item").alias("chunk_no"), "score")


@query
def budget_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused order, bounded by what the dense list allows."""
    # every item of the dense list is in the fused order
    rows = _own(_lists(spark, sf_dir)).withColumn("base_rank", F.when(F.col("of_rank") <= fusion.WINDOW, F.col("of_rank"))).drop("of_rank")
    return fusion.budgeted(rows, ["question_id"]).withColumnRenamed("item", "chunk_no")


@query
def dense_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of the 200 nearest chunks of each question over the best one's."""
    scores = _dense(spark, sf_dir, LIST_DEPTH).select(F.col("qid").alias("question_id"), F.col("doc").alias("chunk_no"), "cosine")
    rows = graph.relative_relevance(scores, ["question_id"], "cosine")
    return rows.select("question_id", "chunk_no", F.round("relevance", 6).alias("relevance"))


# Graph


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that one definition of a corpus bears alone."""
    rows = base.chunks(spark, sf_dir, "corpus", "symbol", "kind").where("kind in ('function', 'class')")
    return rows.groupBy("corpus", "symbol").agg(F.count("*").alias("n"), F.min("chunk_no").alias("dst"), F.min("kind").alias("target"))


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_no, corpus, path, name, via: called names of functions and methods, bases of classes."""
    rows = base.chunks(spark, sf_dir, "corpus", "path", "kind", "source")
    uses = F.regexp_replace("source", r"(def|class)\s+[A-Za-z_][A-Za-z0-9_]*", " ")
    called = F.regexp_extract_all(uses, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), F.lit(1))
    head = F.regexp_extract("source", r"class [A-Za-z0-9_]+\(([^()]*)\)", 1)
    calls = rows.where("kind in ('function', 'method')").select("chunk_no", "corpus", "path", F.explode(F.array_distinct(called)).alias("name"), F.lit("call").alias("via"))
    bases = rows.where("kind = 'class'").select("chunk_no", "corpus", "path", F.explode(F.array_distinct(F.regexp_extract_all(head, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))).alias("name"), F.lit("base").alias("via"))
    return calls.unionByName(bases)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, type between chunks of one corpus, from unambiguous names and parents."""
    symbols = _symbols(spark, sf_dir).where("n = 1").select("corpus", F.col("symbol").alias("name"), "dst", "target")
    found = _mentions(spark, sf_dir).join(symbols, ["corpus", "name"])
    kind = (
        F.when(T.is_test_path(F.col("path")), "tested_by")
        .when((F.col("via") == "base") & (F.col("target") == "class"), "inherits")
        .when((F.col("via") == "call") & (F.col("target") == "class"), "instantiates")
        .when(F.col("via") == "call", "calls")
    )
    named = found.select(F.col("chunk_no").alias("src"), "dst", kind.alias("type"))
    rows = base.chunks(spark, sf_dir, "corpus", "path", "parent", "symbol")
    owner = rows.groupBy("corpus", "path", "qualname").agg(F.max("chunk_no").alias("src"))
    held = rows.where("parent is not null").select("corpus", "path", F.col("parent").alias("qualname"), F.col("chunk_no").alias("dst"))
    contains = held.join(owner, ["corpus", "path", "qualname"]).select("src", "dst", F.lit("contains").alias("type"))
    return named.unionByName(contains).where("src <> dst and type is not null").distinct()


@query
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@query
def graph_in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.in_degree(_edges(spark, sf_dir))


@query
def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(_edges(spark, sf_dir))


def _expanded(spark: SparkSession, sf_dir: str, hops: int) -> DataFrame:
    """From each question's nearest chunks, each neighbour weighed by its cosine to the question among all
    chunks of the corpus."""
    seeds = _dense(spark, sf_dir, graph.SEEDS).select(F.col("qid").alias("question_id"), F.col("doc").alias("item"), F.col("dense_rank").alias("item_rank"))
    near = dense.relevance(*_vectors(spark, sf_dir), "question_id")
    rows = graph.expand(_edges(spark, sf_dir), seeds, ["question_id"], near, hops)
    return rows.select("question_id", "graph_rank", F.col("item").alias("chunk_no"), "score")


@query
def graph_rank_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir, 1)


@query
def graph_rank_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir, 2)


@query
def graph_rank_unweighed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops without relevance: each node passes on to the same neighbours for every question."""
    seeds = base.hits(spark, sf_dir).select("question_id", F.col("chunk_no").alias("item"), F.col("hit_rank").alias("item_rank"))
    rows = graph.expand(_edges(spark, sf_dir), seeds, ["question_id"])
    return rows.select("question_id", "graph_rank", F.col("item").alias("chunk_no"), "score")


@query
def drop_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that no edge came of, by reason, with up to eight examples a reason."""
    symbols = _symbols(spark, sf_dir).select("corpus", F.col("symbol").alias("name"), "n")
    lost = _mentions(spark, sf_dir).join(symbols, ["corpus", "name"], "left").where("n is null or n > 1")
    lost = lost.select(F.concat("via", F.when(F.col("n").isNull(), ":unknown").otherwise(":ambiguous")).alias("reason"), "name")
    counts = lost.groupBy("reason", "name").agg(F.count("*").alias("n"))
    order = Window.partitionBy("reason").orderBy(F.desc("n"), "name")
    shown = counts.withColumn("place", F.row_number().over(order)).where("place <= 8")
    examples = shown.groupBy("reason").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda r: r["name"]), ",").alias("examples"))
    return counts.groupBy("reason").agg(F.sum("n").alias("dropped")).join(examples, "reason")


@query
def call_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = _symbols(spark, sf_dir).where("n = 1").select("corpus", F.col("symbol").alias("name"), "dst")
    calls = _mentions(spark, sf_dir).where("via = 'call'").join(symbols, ["corpus", "name"], "left")
    return calls.groupBy("corpus").agg(F.count("*").alias("calls"), F.count("dst").alias("resolved"))


@query
def relevant_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose relevant chunks include all of another's, of two and more, in the same corpus."""
    rows = base.questions(spark, sf_dir, "corpus", "relevant").select("question_id", "corpus", F.explode("relevant").alias("chunk_id"))
    held = rows.select(F.col("question_id").alias("cls"), F.concat_ws("::", "corpus", "chunk_id").alias("name"))
    found = graph.implementers(held, held, held.withColumnRenamed("cls", "protocol"))
    return found.select(F.col("protocol").alias("question_id"), F.col("cls").alias("includes_in"))


@query
def scope_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of a name where all its definitions agree, else null."""
    rows = base.chunks(spark, sf_dir, "corpus", "symbol", "kind")
    agree = (F.count_distinct("kind") == 1) & (F.count("kind") == F.count("*"))
    return rows.groupBy("corpus", "symbol").agg(F.when(agree, F.min("kind")).alias("kind"), F.count("*").alias("n"))


@query
def extract_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol of every source file, as the parser finds it now."""
    return extract.symbols(_files(spark, sf_dir)).drop("source")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = load(spark, sf_dir, "source_files", "file_id", "corpus", "path", "source", "indexed_at")
    return latest(files, ["file_id"], "indexed_at").select("corpus", "path", "source")


@query
def call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges between the symbols of each corpus, by full name resolution."""
    return callgraph.call_graph(extract.facts(_files(spark, sf_dir)))[0]


@query
def call_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every reference: resolved, or the reason why not."""
    outcomes = callgraph.call_graph(extract.facts(_files(spark, sf_dir)))[1]
    return outcomes.groupBy("corpus", F.col("target").alias("use"), F.coalesce("reason", F.lit("resolved")).alias("outcome")).agg(F.count("*").alias("n"))


# Symbols and lines


@query
def symbol_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 symbols below ``src/`` of each corpus, with the number before the cut."""
    rows = base.chunks(spark, sf_dir, "corpus", "path", "chunk_id", "kind", "start_line").where(F.startswith("path", F.lit("src/")) & (F.col("kind") != "module"))
    order = Window.partitionBy("corpus").orderBy("path", "start_line", "chunk_id", "chunk_no")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("total", F.count("*").over(Window.partitionBy("corpus")))
    return rows.where("place <= 200").select("corpus", "place", "chunk_no", "kind", "total", (F.col("total") > 200).alias("truncated"))


@query
def line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.chunks(spark, sf_dir, "start_line", "end_line", "spans")
    lines = rows.select("chunk_no", F.explode(ranges.line_numbers(F.col("spans"), F.col("start_line"), F.col("end_line"))).alias("line"))
    return ranges.format_ranges(lines, ["chunk_no"], "line")


@query
def merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.chunks(spark, sf_dir, "corpus", "path", "start_line", "end_line").select("corpus", "path", "start_line", "end_line")
    return ranges.merge_ranges(rows, ["corpus", "path"], "start_line", "end_line")


@query
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.chunks(spark, sf_dir, "corpus", "path", "parent", "symbol", "start_line")
    rows = rows.withColumn("base", F.concat("path", F.lit("::"), "qualname"))
    return ranges.duplicate_ids(rows, ["corpus"], ["start_line", "chunk_no"], "base").select("chunk_no", "chunk_id")


@query
def hit_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.hits(spark, sf_dir, "first_line", "last_line").join(base.chunks(spark, sf_dir, "path", "start_line", "end_line"), "chunk_no")
    first, last = F.coalesce("first_line", "start_line"), F.coalesce("last_line", "end_line")
    return rows.select("question_id", "hit_rank", "chunk_no", F.concat("path", F.lit(":"), first, F.lit("-"), last).alias("location"))


@query
def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows before and after re-delivered ones count once."""
    files = load(spark, sf_dir, "source_files", "file_id", "corpus", "path", "indexed_at")
    return files.groupBy("corpus").agg(F.count("*").alias("n_rows"), F.count_distinct("file_id").alias("files"), F.max("indexed_at").cast("string").alias("newest"))


@query
def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the vectors of generation b take over from a: per corpus the reused, embedded and deleted."""
    vectors = load(spark, sf_dir, "index_vectors", "part_id", "generation", "embedding").where("part_id is not null")
    side = lambda g, c: vectors.where(F.col("generation") == g).groupBy("part_id").agg(F.max("embedding").alias(c), F.lit(True).alias(f"in_{c}"))
    both = side("gen-a", "old").join(side("gen-b", "new"), "part_id", "full")
    state = F.when(F.col("in_new").isNull(), "deleted").when(F.col("in_old").isNull(), "embedded").when(F.col("old").eqNullSafe(F.col("new")), "reused").otherwise("changed")
    chunk = base.chunks(spark, sf_dir, "corpus")
    owner = load(spark, sf_dir, "embedding_parts", "part_id", "chunk_no").join(chunk, "chunk_no").select("part_id", "corpus")
    return both.select("part_id", state.alias("state")).join(owner, "part_id").groupBy("corpus", "state").agg(F.count("*").alias("parts"))


@query
def build_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.chunks(spark, sf_dir, "corpus", "path")
    parts = load(spark, sf_dir, "embedding_parts", "chunk_no", "part_id").groupBy("chunk_no").agg(F.count_distinct("part_id").alias("parts"))
    joined = rows.join(parts, "chunk_no", "left")
    return joined.groupBy("corpus").agg(
        F.count_distinct("path").alias("files"), F.count("*").alias("chunks"), F.coalesce(F.sum("parts"), F.lit(0)).alias("parts"), F.count_if(F.col("parts").isNull()).alias("without_parts")
    )


# Evaluation


@query
def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.qrels(spark, sf_dir).withColumnRenamed("item", "chunk_no")


@query
def missing_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant ids that name no chunk of the question's corpus."""
    wanted = base.questions(spark, sf_dir, "corpus", "relevant").select("question_id", "corpus", F.explode("relevant").alias("chunk_id")).distinct()
    return wanted.join(base.chunks(spark, sf_dir, "corpus", "chunk_id"), ["corpus", "chunk_id"], "left_anti").select("question_id", "chunk_id")


@query
def question_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest(load(spark, sf_dir, "questions", "question_id", "qtype", "question", "relevant", "expect_abstain", "split", "created_at"), ["question_id"], "created_at")
    many = F.coalesce(F.size("relevant"), F.lit(0)) > 0
    letters = F.regexp_replace(F.lower(F.coalesce("split", F.lit(""))), "[^a-z]", "")
    checks = {
        "unknown_type": ~F.coalesce(F.col("qtype").isin("exact_name", "behavior", "location", "flow", "negative"), F.lit(False)),
        "blank_question": F.trim(F.coalesce("question", F.lit(""))) == "",
        "negative_with_relevant": (F.col("qtype") == "negative") & many,
        "positive_without_relevant": (F.col("qtype") != "negative") & ~many,
        "abstention_mismatch": F.coalesce(F.col("expect_abstain"), F.lit(False)) != (F.col("qtype") == "negative"),
        "blank_split": letters == "",
        "odd_split": (letters != "") & ~F.coalesce(F.col("split").isin("tune", "heldout"), F.lit(False)),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return rows.select("question_id", F.explode(found).alias("problem"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.per_question(_own(_lists(spark, sf_dir)), base.qrels(spark, sf_dir), ["question_id"])


@query
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scores(spark, sf_dir)
    return rows.select("question_id", F.col("first_rank").cast("double").alias("first_rank"), "hit1", "hit5", F.round("rr", 6).alias("rr"), F.round("recall10", 6).alias("recall10"))


@query
def metrics_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scores(spark, sf_dir).join(base.questions(spark, sf_dir, "qtype", "split"), "question_id")
    return evaluation.summary(rows, [[], ["qtype"], ["split"], ["split", "qtype"]])


@query
def containment_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hit of a question that covers every line of a relevant chunk of the same file."""
    lines = ranges.line_numbers(F.col("spans"), F.col("start_line"), F.col("end_line"))
    shape = base.chunks(spark, sf_dir, "corpus", "path", "start_line", "end_line", "spans").select("chunk_no", "corpus", "path", lines.alias("lines"))
    inner = base.qrels(spark, sf_dir).withColumnRenamed("item", "chunk_no").join(shape, "chunk_no").select("question_id", "corpus", "path", F.col("lines").alias("inner"))
    outer = base.hits(spark, sf_dir).join(shape, "chunk_no").select("question_id", "corpus", "path", "hit_rank", F.col("lines").alias("outer"))
    covered = inner.join(outer, ["question_id", "corpus", "path"]).where(F.size(F.array_except("inner", "outer")) == 0)
    return covered.groupBy("question_id").agg(F.min("hit_rank").alias("first_rank"))


def _single(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    lists = _lists(spark, sf_dir, source, depth=evaluation.DEPTH)
    rows = evaluation.per_question(lists, base.qrels(spark, sf_dir), ["question_id"])
    return rows.join(base.questions(spark, sf_dir, "qtype"), "question_id")


@query
def paired_wlt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical list against the dense one, by question type and overall."""
    return evaluation.paired(_single(spark, sf_dir, "bm25"), _single(spark, sf_dir, "dense"), "question_id", "qtype")


@query
def decision_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fusion of the grid against the dense list, and which one the rule selects."""
    wanted = durable(base.qrels(spark, sf_dir))
    # only relevant items are looked up
    held = _both(spark, sf_dir).join(wanted.groupBy("question_id").agg(F.collect_set("item").alias("wanted")), "question_id")
    found = fusion.sweep_rows(held, "question_id", SWEEP)
    # the dense list, whose ranks come with each configuration, takes part as number -1
    rank = lambda config, r: F.struct(config.alias("config"), F.col(r).alias("item_rank"))
    alone = F.when((F.col("config") == 0) & F.col("of_rank").isNotNull(), rank(F.lit(-1), "of_rank"))
    ranks = found.select("question_id", "item", F.explode(F.array(rank(F.col("config"), "fused_rank"), alone)).alias("r")).where("r is not null")
    relevant = wanted.withColumn("config", F.explode(F.sequence(F.lit(-1), F.lit(len(SWEEP) - 1))))
    each = evaluation.per_question(ranks.select("r.config", "question_id", "item", "r.item_rank"), relevant, ["config", "question_id"])
    theirs = F.max(F.when(F.col("config") == -1, F.col("first_rank"))).over(Window.partitionBy("question_id"))
    mine = each.withColumn("theirs", theirs).where("config >= 0")
    beats = evaluation.beats
    cells = mine.groupBy("config").agg(
        F.count_if(beats(F.col("first_rank"), F.col("theirs"))).alias("wins"),
        F.count_if(beats(F.col("theirs"), F.col("first_rank"))).alias("losses"),
        F.count_if((F.col("theirs") <= 3) & (F.col("first_rank").isNull() | (F.col("first_rank") > F.col("theirs")))).alias("top3"),
        F.round(F.avg("rr"), 6).alias("mrr"),
    )
    cells = durable(cells.withColumn("is_reference", F.lit(False)).withColumn("position", F.col("config")))
    base_row = spark.createDataFrame([(-1, 0, 0, 0, None, True, len(SWEEP))], "config int, wins long, losses long, top3 long, mrr double, is_reference boolean, position int")
    chosen = evaluation.select_candidate(cells.unionByName(base_row)).select(F.col("config").alias("chosen"))
    return cells.select("config", "wins", "losses", "top3", "mrr").join(F.broadcast(chosen))


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.answers(spark, sf_dir, "question_id", "text")
    told = T.answer_status(F.coalesce("text", F.lit("")))
    return rows.where("question_id is not null").select("answer_id", "question_id", told.alias("status")).join(base.questions(spark, sf_dir, "corpus", "expect_abstain"), "question_id")


@query
def abstention_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of abstaining; strict counts abstentions, lenient also mixed answers."""
    rows = _statuses(spark, sf_dir)
    out = None
    for name, positive in (("strict", F.col("status") == "abstained"), ("lenient", F.col("status") != "answered")):
        right = positive & F.col("expect_abstain")
        one = rows.agg(
            F.lit(name).alias("mode"), F.count_if(positive).alias("abstained"), F.count_if(F.col("expect_abstain")).alias("expected"), F.count_if(right).alias("correct"),
            F.round(F.count_if(right) / F.nullif(F.count_if(positive), F.lit(0)), 6).alias("precision"), F.round(F.count_if(right) / F.nullif(F.count_if(F.col("expect_abstain")), F.lit(0)), 6).alias("recall"),
        )
        out = one if out is None else out.unionByName(one)
    return out


@query
def context_relative_abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstentions by corpus and by whether a relevant chunk was among the first eight hits."""
    shown = base.hits(spark, sf_dir).where("hit_rank <= 8").select("question_id", F.col("chunk_no").alias("item")).join(base.qrels(spark, sf_dir), ["question_id", "item"], "left_semi")
    rows = _statuses(spark, sf_dir).join(shown.select("question_id").distinct().withColumn("in_context", F.lit(True)), "question_id", "left")
    rows = rows.withColumn("in_context", F.coalesce("in_context", F.lit(False)))
    return rows.groupBy("corpus", "in_context").agg(F.count("*").alias("replies"), F.count_if(F.col("status") == "abstained").alias("abstained"), F.count_if(F.col("status") == "mixed").alias("mixed"))


@query
def context_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose first eight chunks differ between the lexical and the dense list."""
    lists = _lists(spark, sf_dir, depth=8)
    side = lambda s: lists.where(F.col("source") == s).groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_rank", "item"))), lambda r: r["item"].cast("string")), ",").alias(s))
    both = side("bm25").join(side("dense"), "question_id", "full")
    return both.where(~F.col("bm25").eqNullSafe(F.col("dense")))


@query
def graded_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's first reply against its last: what was right and isn't any more."""
    right = F.when(F.col("expect_abstain"), F.col("status") == "abstained").otherwise(F.col("status") == "answered")
    rows = _statuses(spark, sf_dir).withColumn("right", F.coalesce(right, F.lit(False)))
    ends = rows.groupBy("question_id").agg(F.min_by("right", "answer_id").alias("old_right"), F.max_by("right", "answer_id").alias("new_right"), F.max_by("status", "answer_id").alias("new_status"), F.count("*").alias("replies"))
    state = F.when(F.col("replies") == 1, "ungraded").when(F.col("old_right") & (F.col("new_status") == "abstained") & ~F.col("new_right"), "regressed_abstained").when(F.col("old_right") & ~F.col("new_right"), "regressed").when(~F.col("old_right") & F.col("new_right"), "improved").otherwise("same")
    return ends.groupBy(state.alias("state")).agg(F.count("*").alias("questions"))


@query
def decision_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact rational criteria over the abstention counts: void, fail or pass for each corpus."""
    rows = _statuses(spark, sf_dir)
    counts = rows.groupBy("corpus").agg(F.count("*").alias("n"), F.count_if((F.col("status") == "abstained") & ~F.col("expect_abstain")).alias("false_abstentions"), F.count_if((F.col("status") == "answered") & F.col("expect_abstain")).alias("unsupported"))
    verdict = F.when(F.col("n") < 5, "VOID").when((F.col("false_abstentions") * 12 > F.col("n")) | (F.col("unsupported") * 18 > F.col("n")), "FAIL").otherwise("PASS")
    return counts.withColumn("verdict", verdict)


@query
def median_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("prompt_tokens").isNotNull(), F.col("answer_id"))
    rows = base.answers(spark, sf_dir, "question_id", "ttft_s", "prompt_tokens", "generated_tokens").where("question_id is not null").join(base.questions(spark, sf_dir, "corpus"), "question_id")
    return rows.groupBy("corpus").agg(
        F.count("*").alias("n"), F.round(F.median("ttft_s"), 6).alias("median_ttft"), F.median("prompt_tokens").alias("median_prompt"), F.max("generated_tokens").cast("double").alias("max_generated"),
        (F.max_by("prompt_tokens", known) - F.min_by("prompt_tokens", known)).cast("double").alias("last_minus_first"),
    )


# Context and replies


@query
def budget_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fair shares of 1,200 tokens among the chunks of each question, at four characters a token."""
    size = base.chunks(spark, sf_dir, "source").select("chunk_no", F.ceil(F.length(F.coalesce("source", F.lit(""))) / 4).alias("size"))
    rows = base.hits(spark, sf_dir).join(size, "chunk_no")
    shares = packing.fair_shares(rows, ["question_id"], "size", "hit_rank", F.lit(1200))
    return shares.select("question_id", "hit_rank", "chunk_no", "size", "share")


@query
def truncation_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each hit the line with the most distinct terms of the question, the first of equals."""
    terms = base.questions(spark, sf_dir, "question").select("question_id", T.query_terms(F.col("question")).alias("terms"))
    lines = base.chunks(spark, sf_dir, "source").select("chunk_no", F.posexplode(F.split("source", "\n")).alias("line", "text")).select("chunk_no", "line", F.array_distinct(T.code_tokens(F.col("text"))).alias("tokens"))
    rows = base.hits(spark, sf_dir).select("question_id", "chunk_no").distinct().join(terms, "question_id").join(lines, "chunk_no")
    scored = rows.select("question_id", "chunk_no", "line", F.size(F.array_intersect("terms", "tokens")).alias("score")).where("score > 0")
    best = scored.groupBy("question_id", "chunk_no").agg(F.max(F.struct("score", (-F.col("line")).alias("at"))).alias("b"))
    return best.select("question_id", "chunk_no", (-F.col("b.at")).alias("anchor"), F.col("b.score").alias("score"))


@query
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags cited by each reply, in order; known ones have a hit of that rank."""
    tags = base.answers(spark, sf_dir, "question_id", "text").select("answer_id", "question_id", F.posexplode(T.cited_tags(F.col("text"))).alias("place", "tag"))
    shown = base.hits(spark, sf_dir).groupBy("question_id", "hit_rank").agg(F.min("chunk_no").alias("chunk_no")).select("question_id", F.concat(F.lit("C"), "hit_rank").alias("tag"), "chunk_no")
    return tags.join(shown, ["question_id", "tag"], "left").select("answer_id", "place", "tag", F.col("chunk_no").isNotNull().alias("known"), F.col("chunk_no").cast("double").alias("chunk_no"))


@query
def classify_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.answers(spark, sf_dir, "text")
    return rows.select("answer_id", T.answer_status(F.coalesce("text", F.lit(""))).alias("status"), F.coalesce(T.near_miss(F.col("text")), F.lit(False)).alias("near_miss"))


def _evidence_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.answers(spark, sf_dir, "question_id", "text", "raw_text")
    return rows.select("answer_id", F.col("question_id").alias("group"), F.coalesce("raw_text", "text").alias("reply"))


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group, tag, item: the chunks that each question's replies were shown, by the rank of their hit."""
    rows = base.hits(spark, sf_dir).groupBy("question_id", "hit_rank").agg(F.min("chunk_no").alias("item"))
    return rows.select(F.col("question_id").alias("group"), F.concat(F.lit("C"), "hit_rank").alias("tag"), "item")


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = evidence.sections(_evidence_replies(spark, sf_dir), "reply")
    quotes = evidence.entries(replies, "answer_id").join(replies.select("answer_id", "group"), "answer_id")
    rows = base.chunks(spark, sf_dir, "source", "start_line", "end_line", "spans")
    numbers = ranges.line_numbers(F.col("spans"), F.col("start_line"), F.col("end_line"))
    lines = rows.select(F.col("chunk_no").alias("item"), numbers.alias("numbers"), F.posexplode(F.split("source", "\n")).alias("i", "text"))
    lines = lines.select("item", "i", F.get("numbers", F.col("i")).alias("line"), "text")
    found = evidence.verified(quotes, _shown(spark, sf_dir), lines, ["answer_id", "place"])
    return found.withColumn("line", F.col("line").cast("double"))


@query
def evidence_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tagged quotes of each reply's evidence section."""
    return evidence.entries(evidence.sections(_evidence_replies(spark, sf_dir), "reply"), "answer_id")


@query
def quote_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each quoted line stands in the chunk of its tag."""
    return _verified(spark, sf_dir)


@query
def evidence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with evidence: abstained, unverified, verified (all quotes and all cited tags) or partial."""
    marks = _verified(spark, sf_dir).groupBy("answer_id").agg(F.count("*").alias("quotes"), F.count_if(F.col("result") == "verified").alias("ok"), F.array_distinct(F.collect_list(F.when(F.col("result") == "verified", F.col("tag")))).alias("supported"))
    rows = base.answers(spark, sf_dir, "text").select("answer_id", T.answer_status(F.coalesce("text", F.lit(""))).alias("told"), T.cited_tags(F.col("text")).alias("cited"))
    unsupported = F.size(F.array_except(F.coalesce("cited", F.array().cast("array<string>")), "supported"))
    status = F.when(F.col("told") == "abstained", "abstained").when(F.col("ok") == 0, "unverified").when((F.col("ok") == F.col("quotes")) & (unsupported == 0), "verified").otherwise("partial")
    return rows.join(marks, "answer_id").select("answer_id", status.alias("status"), "quotes", F.col("ok").alias("verified_quotes"))


@query
def evidence_enforced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown of each reply with an evidence section: its status, verification and citations."""
    replies = _evidence_replies(spark, sf_dir).where("reply is not null")
    told = evidence.sections(replies, "reply").where("evidence is not null").select("answer_id")
    found = evidence.enforced(replies.join(told, "answer_id", "left_semi"), "answer_id", "reply", _verified(spark, sf_dir), _shown(spark, sf_dir))
    return found.select("answer_id", "status", "verification", F.array_join("citations", ",").alias("citations"), F.size("unsupported").alias("n_unsupported"))


# Queries without SQL: their folds and models are tested on small inputs


@query
def stem_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stem of every distinct token of the chunks, where it differs."""
    tokens = base.token_table(spark, sf_dir, False).select(F.explode("tokens").alias("token")).distinct()
    return tokens.withColumn("stem", stems(F.col("token"))).where("stem <> token")


@query
def query_tokens_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_tokens`` with stems, as retrieval asks them; the four below likewise. SQL can't stem."""
    return _query_tokens(spark, sf_dir, True)


@query
def doc_lengths_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_lengths(spark, sf_dir, True)


@query
def term_df_idf_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _term_df_idf(spark, sf_dir, True)


@query
def bm25_topk_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25_topk(spark, sf_dir, True)


@query
def rrf_fused_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rrf_fused(spark, sf_dir, True)


@query
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash embedding of every question."""
    rows = base.questions(spark, sf_dir, "question")
    vector = F.posexplode(hash_embedding(F.col("question"))).alias("axis", "value")
    return rows.select("question_id", vector).where("value <> 0").select("question_id", "axis", F.round("value", 9).alias("value"))


@query
def part_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ranges of each chunk filled greedily up to 200 words less those of its header."""
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    rows = base.embedding_texts(spark, sf_dir).withColumn("lines", F.split("source", "\n"))
    budget = F.greatest(F.lit(200) - words(F.col("header")), F.lit(50))
    return rows.select("chunk_no", F.posexplode(packing.greedy_parts(F.transform("lines", words), budget)).alias("part_no", "p")).select("chunk_no", "part_no", F.col("p.first").alias("first_line"), F.col("p.last").alias("last_line"))


@query
def reply_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the guard cuts each reply that loops, beside the logged flag."""
    rows = base.answers(spark, sf_dir, "text", "raw_text", "stopped_for_repetition")
    cut = loop_cut(F.coalesce("raw_text", "text"))
    return rows.select("answer_id", cut.alias("keep"), "stopped_for_repetition").where("keep is not null")


@query
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks that fit into 1,500 tokens, of each question's ranked chunks."""
    rows = base.chunks(spark, sf_dir, "chunk_id", "kind", "start_line", "end_line", "spans", "source")
    rows = rows.withColumn("numbers", ranges.line_numbers(F.col("spans"), F.col("start_line"), F.col("end_line"))).drop("spans").where("source is not null")
    asked = base.questions(spark, sf_dir, "question")
    hits = base.hits(spark, sf_dir, "first_line", "last_line").withColumnsRenamed({"first_line": "from_line", "last_line": "to_line"})
    found = context.contexts(hits.join(asked, "question_id").join(rows, "chunk_no"), 1500)
    return found.select("question_id", "tag", "chunk_no", "cut", "first_shown", "last_shown", "n_tokens")

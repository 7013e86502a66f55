"""The registered queries of this subpackage; each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.latest import current
from ..session import durable
from ..sources.tables import load
from . import broken_pairs, cross_split, functions_docs, leakage, mixing, near_duplicates, neighbours, repetition, sentences, splitting

NEAR_CODE = near_duplicates.JoinSettings(similarity=0.6, shingle=3, least=40)
NEAR_VECTORS = neighbours.CurveSettings(min_cosine=0.95)
EVERY_VECTOR = neighbours.CurveSettings(settle=True)


def _defective(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = load(spark, sf_dir, "answers", "answer_id", "question_id", "text", "logged_at")
    questions = load(spark, sf_dir, "questions", "question_id", "question", "expect_abstain", "created_at")
    return broken_pairs.broken_pairs(
        answers, "answer_id", "question_id", "text", "logged_at", questions, "question", "expect_abstain", "created_at"
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _defective(spark, sf_dir).select("answer_id", F.col("defects")[0].alias("defect"))


def p1_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every defect that triggers, with its place in the order of the rules, and the languages; a null
    language means that the pair's language wasn't judged."""
    found = _defective(spark, sf_dir)
    return found.select("answer_id", F.posexplode("defects").alias("place", "defect"), "question_lang", "reply_lang")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = neighbours.nearest(load(spark, sf_dir, "index_vectors", "vec_id", "embedding"), "vec_id", "embedding", NEAR_VECTORS)
    return lists.select(
        F.least("vec_id", "neighbour_id").alias("vec_id_a"), F.greatest("vec_id", "neighbour_id").alias("vec_id_b")
    ).distinct()


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every vector."""
    lists = neighbours.nearest(load(spark, sf_dir, "index_vectors", "vec_id", "embedding"), "vec_id", "embedding", EVERY_VECTOR)
    return lists.select("vec_id", "neighbour_rank", "neighbour_id", F.round("cosine", 4).alias("cosine"))


def p2_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all rows for every row whose id is divisible by 50."""
    vectors = load(spark, sf_dir, "index_vectors", "vec_id", "embedding")
    asked = vectors.where(F.col("vec_id") % 50 == 0)
    lists = neighbours.nearest_of(vectors, "vec_id", "embedding", asked, NEAR_VECTORS)
    return lists.select("vec_id", "neighbour_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = current(load(spark, sf_dir, "source_files", "file_id", "lang", "source", "indexed_at"), "file_id", "indexed_at")
    return functions_docs.documented_functions(files, "file_id", "lang", "source", with_text=False).select("file_id", "start_line")


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = current(load(spark, sf_dir, "source_files", "file_id", "lang", "source", "indexed_at"), "file_id", "indexed_at")
    return functions_docs.documented_functions(files, "file_id", "lang", "source")


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = load(spark, sf_dir, "answers", "answer_id", "text", "raw_text")
    return repetition.repetition(answers, "answer_id", F.coalesce("raw_text", "text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replies(spark, sf_dir).where(F.col("repeated_share") >= 0.5).select(F.col("item_id").alias("answer_id"))


def p5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of every reply beside the flag of its latest row."""
    flags = load(spark, sf_dir, "answers", "answer_id", "stopped_for_repetition", "logged_at")
    flag = flags.groupBy("answer_id").agg(F.max_by("stopped_for_repetition", "logged_at").alias("stopped_for_repetition"))
    return _replies(spark, sf_dir).withColumnRenamed("item_id", "answer_id").join(flag, "answer_id")


def _oversized(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    chunks = current(load(spark, sf_dir, "chunks", "chunk_no", "source", "indexed_at"), "chunk_no", "indexed_at")
    parts = load(spark, sf_dir, "embedding_parts", "part_id", "text")
    return splitting.split_oversized(chunks, "chunk", "chunk_no", "source", with_text=with_text).unionByName(
        splitting.split_oversized(parts, "part", "part_id", "text", with_text=with_text)
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _oversized(spark, sf_dir, False).where("piece_no = 0").select("item_kind", "item_id")


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _oversized(spark, sf_dir, True)


def _routines(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = load(spark, sf_dir, "chunks", "chunk_no", "kind", "source")
    return chunks.where(~F.coalesce(F.lower(F.trim("kind")), F.lit("")).isin("class", "module"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, members = near_duplicates.similar(_routines(spark, sf_dir), "chunk_no", "source", NEAR_CODE)
    pairs = near_duplicates.expanded_pairs(links, members, NEAR_CODE.expand)
    return pairs.select(F.col("a").alias("chunk_no_a"), F.col("b").alias("chunk_no_b"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every chunk that has a near-duplicate."""
    links, members = near_duplicates.similar(_routines(spark, sf_dir), "chunk_no", "source", NEAR_CODE)
    return near_duplicates.groups(durable(links), members).withColumnRenamed("id", "chunk_no")


_CROSSING = ("question_id", "question", "relevant", "split")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cross_split.overlaps(load(spark, sf_dir, "questions", *_CROSSING), *_CROSSING)
    return pairs.select(F.least("id", "other").alias("question_id_a"), F.greatest("id", "other").alias("question_id_b"))


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that stand in the other split too, and all, per split and corpus; pairs are counted by the
    sizes of the classes, not made."""
    questions = load(spark, sf_dir, "questions", "question_id", "corpus", "split").dropDuplicates(["question_id"])
    pairs, members = cross_split.class_overlaps(load(spark, sf_dir, "questions", *_CROSSING), *_CROSSING)
    pairs, members = durable(pairs), durable(members)
    both = pairs.select("id", "other", "kind").unionByName(pairs.select(F.col("other").alias("id"), F.col("id").alias("other"), "kind"))
    size = members.select(F.col("rep").alias("other"), "n").distinct()
    linked = both.join(size, "other").groupBy(F.col("id").alias("rep")).agg(F.max(F.col("kind") == "same").alias("same"), F.sum("n").alias("pairs"))
    hit = members.join(linked, "rep").select(F.col("id").alias("question_id"), "same", "pairs")
    rows = questions.withColumn("split", cross_split.reduced_split(F.col("split"))).join(hit, "question_id", "left")
    return rows.groupBy("split", "corpus").agg(
        F.count("*").alias("questions"), F.count("pairs").alias("overlapping"), F.count_if("same").alias("same"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")
    )


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of held-out items in documents, to be removed."""
    items = load(spark, sf_dir, "eval_items", "item_id", "split", "text").where(F.lower(F.trim("split")) == "heldout")
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    return leakage.leaked_spans(docs, "doc_id", "text", items, "item_id", F.col("text"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_spans(spark, sf_dir).select("doc_id", "item_id").distinct()


def p9_by_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture with the stored number of characters as size, which SQL can follow."""
    docs = load(spark, sf_dir, "documents", "doc_id", "source", "text", "n_chars")
    taken, _ = mixing.mixture(docs, "doc_id", "source", "text", load(spark, sf_dir, "mix_targets"), size=F.col("n_chars"))
    return taken.select("doc_id", "source", "copy_no", F.col("tokens").alias("n_chars"), "place_end")


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = load(spark, sf_dir, "documents", "doc_id", "source", "text")
    return mixing.mixture(docs, "doc_id", "source", "text", load(spark, sf_dir, "mix_targets"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text", "layout")
    return sentences.split_sentences(docs.where(F.lower(F.trim("layout")) == "prose"), "doc_id", "text", "layout")


def p10_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of documents of every layout."""
    return sentences.split_sentences(load(spark, sf_dir, "documents", "doc_id", "text", "layout"), "doc_id", "text", "layout")


QUERIES = {
    "p1_found": p1_found,
    "p1_defects": p1_defects,
    "p2_found": p2_found,
    "p2_neighbours": p2_neighbours,
    "p2_top5": p2_top5,
    "p3_found": p3_found,
    "p3_pairs": p3_pairs,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_repetition": p5_repetition,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p7_found": p7_found,
    "p7_counts": p7_counts,
    "p8_found": p8_found,
    "p8_spans": p8_spans,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p9_by_chars": p9_by_chars,
    "p10_found": p10_found,
    "p10_sentences": p10_sentences,
}

"""The tables as the plans use them: re-delivered rows once, spellings made one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stem import added_stems
from ..functions.text import code_parts, code_tokens, embedding_header
from ..operators.latest import latest, newest
from ..sources.tables import load


def kind_of(kind: Column) -> Column:
    low = F.lower(F.trim(kind))
    return F.when(low == "def", "function").otherwise(low)


def qualname(parent: Column, symbol: Column) -> Column:
    return F.concat_ws(".", parent, symbol)


def chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Chunks with ``kind`` normalised and ``qualname`` where both its parts are asked for."""
    df = latest(load(spark, sf_dir, "chunks", *dict.fromkeys(["chunk_no", *columns, "indexed_at"])), ["chunk_no"], "indexed_at").drop("indexed_at")
    if "kind" in columns:
        df = df.withColumn("kind", kind_of(F.col("kind")))
    if {"parent", "symbol"} <= set(columns):
        df = df.withColumn("qualname", qualname(F.col("parent"), F.col("symbol")))
    return df


def questions(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = latest(load(spark, sf_dir, "questions", *dict.fromkeys(["question_id", *columns, "created_at"])), ["question_id"], "created_at").drop("created_at")
    if "split" in columns:
        letters = F.regexp_replace(F.lower("split"), "[^a-z]", "")
        df = df.withColumn("split", F.when(letters == "heldout", "heldout").otherwise("tune"))
    return df


def answers(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return latest(load(spark, sf_dir, "answers", *dict.fromkeys(["answer_id", *columns, "logged_at"])), ["answer_id"], "logged_at").drop("logged_at")


def hits(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = load(spark, sf_dir, "hits", *dict.fromkeys(["question_id", "hit_rank", "chunk_no", *columns]))
    return df.dropDuplicates(["question_id", "hit_rank", "chunk_no"])


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, item of the relevant chunks, found by id within the question's corpus."""
    wanted = questions(spark, sf_dir, "corpus", "relevant").select("question_id", "corpus", F.explode("relevant").alias("chunk_id"))
    ids = chunks(spark, sf_dir, "corpus", "chunk_id").select("corpus", "chunk_id", F.col("chunk_no").alias("item"))
    return wanted.distinct().join(ids, ["corpus", "chunk_id"]).select("question_id", "item").distinct()


def token_table(spark: SparkSession, sf_dir: str, stem: bool = True) -> DataFrame:
    """part, doc, tokens of every chunk: path, qualified name and source, with the stems of their parts."""
    rows = chunks(spark, sf_dir, "corpus", "path", "parent", "symbol", "source")
    text = F.concat_ws(" ", "path", "qualname", F.coalesce("source", F.lit("")))
    return rows.select(F.col("corpus").alias("part"), F.col("chunk_no").alias("doc"), (F.concat(code_tokens(text), added_stems(code_parts(text))) if stem else code_tokens(text)).alias("tokens"))


def text_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, doc, text of every chunk: what ``token_table`` cuts into tokens."""
    columns = ["chunk_no", "corpus", "path", "parent", "symbol", "source", "indexed_at"]
    rows = newest(load(spark, sf_dir, "chunks", *columns), "chunk_no", "indexed_at")
    text = F.concat_ws(" ", "path", qualname(F.col("parent"), F.col("symbol")), F.coalesce("source", F.lit("")))
    return rows.select(F.col("corpus").alias("part"), F.col("chunk_no").alias("doc"), text.alias("text"))


def symbol_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir, "corpus", "symbol", "kind").where("kind <> 'module' and symbol is not null")
    return rows.select(F.col("corpus").alias("part"), F.lower("symbol").alias("name")).distinct()


def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir, "path", "parent", "symbol", "kind", "docstring", "source")
    header = embedding_header(F.coalesce("path", F.lit("")), F.col("qualname"), F.coalesce("kind", F.lit("")), F.coalesce("docstring", F.lit("")))
    return rows.select("chunk_no", header.alias("header"), F.coalesce("source", F.lit("")).alias("source"))

"""Mixing sources to target weights, by weighted fair queueing.

Sizes are tokens of a public tokenizer. The documents of a source come in a shuffled order (a seeded hash
of the id), again in each further copy. A copy's virtual finish time is the number of tokens of its source
up to and with it, divided by the source's weight. The mixture takes the copies of all sources in order of
their finish times until the total budget is used up.

The budget is the largest one that every source can fill with at most ``max_repeats`` copies of itself,
unless a smaller one is given. Weights are the target shares of the sources that have documents, scaled
to a sum of one: a source without documents can reach no share.

Defined cases: source names are compared trimmed, lower-cased, with hyphens and blanks as underscores;
documents of other or null sources take no part. Null texts have no tokens and, like empty ones, are left
out. Re-delivered documents count once. Targets that are null or not above zero take no part, and
``max_repeats`` that is null or below one counts as one. No target or no document: an empty mixture.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import batch
from ..operators.running import running_total
from ..session import durable

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Bound of the rank file that is sent to the executors.
MAX_RANKS = 16_000_000
# Fixed value: the pattern that the public byte-level vocabularies split text with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoding(name: str, ranks: bytes, pattern: str = PATTERN):
    """The tokenizer of a rank file's contents, made once a process."""
    import tiktoken
    from tiktoken import registry

    if name not in registry.ENCODINGS:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        registry.ENCODINGS[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return registry.ENCODINGS[name]


def _count(path: str, spark: SparkSession):
    """Counts tokens; the rank file is read by the driver and goes to the executors with the job, so only the
    driver needs ``path``."""
    with open(path, "rb") as f:
        ranks = f.read(MAX_RANKS + 1)
    if len(ranks) > MAX_RANKS:
        raise ValueError(f"{path} is longer than {MAX_RANKS} bytes")
    held = spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoding(path, held.value)
        for b in batches:
            sizes = [len(tokens.encode_ordinary(t)) for t in b.column(2).to_pylist()]
            yield batch(("doc_id", "source", "tokens"), (b.column(0), b.column(1), pa.array(sizes, pa.int64())))

    return run


def source_name(source: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(source)), r"[-\s]+", "_")


def mixture(
    docs: DataFrame, doc_col: str, source_col: str, text_col: str, targets: DataFrame, seed: int = 1,
    budget: int | None = None, tokenizer: str = TOKENIZER, size: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The rows ``doc_id, source, copy_no, tokens, finish, place_end`` of the mixture (``place_end`` is the
    running total of tokens in the mixture's order) and the ``shares`` reached by each target source. With
    ``size`` (whole numbers, a column of ``docs``) that is used in place of a count of tokens."""
    goal = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(1)).alias("repeats"))
    goal = goal.where("share > 0 and source is not null").groupBy("source").agg(F.max("share").alias("share"), F.greatest(F.max("repeats"), F.lit(1)).alias("repeats"))
    named = docs.select(F.col(doc_col).cast("long").alias("doc_id"), source_name(F.col(source_col)).alias("source"), F.col(text_col).alias("text"), (F.lit(None) if size is None else size).cast("long").alias("tokens"))
    kept = named.where("doc_id is not null and source is not null and length(text) > 0").join(F.broadcast(goal.select("source")), "source", "left_semi")
    if size is None:
        counted = kept.select("doc_id", "source", "text").mapInArrow(_count(tokenizer, docs.sparkSession), "doc_id long, source string, tokens long")
    else:
        counted = kept.where("tokens > 0").select("doc_id", "source", "tokens")
    sized = durable(counted.dropDuplicates(["doc_id"]))
    # one row a target source: bounded by the table of targets
    rows = goal.join(sized.groupBy("source").agg(F.sum("tokens").alias("total"), F.count("*").alias("n_docs")), "source", "left").collect()
    full = [r for r in rows if r["total"]]
    scale = sum(r["share"] for r in full)
    plan = {r["source"]: (r["share"] / scale, r["total"], r["repeats"]) for r in full}
    most = min((total * repeats / weight for weight, total, repeats in plan.values()), default=0)
    limit = most if budget is None else min(budget, most)
    spark = docs.sparkSession
    weights = spark.createDataFrame(
        [(s, w, t, min(n, math.ceil(w * limit / t) + 1)) for s, (w, t, n) in plan.items()],
        "source string, weight double, total long, copies int",
    )
    laid = running_total(sized.withColumn("turn", F.substring(F.md5(F.concat_ws(":", "doc_id", F.lit(seed))), 1, 16)), ["turn", "doc_id"], "tokens", "source")
    each = laid.join(F.broadcast(weights), "source").withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    reached = F.col("copy_no") * F.col("total") + F.col("running")
    each = each.withColumn("finish", reached / F.col("weight")).where((reached - F.col("tokens")) / F.col("weight") < limit)
    taken = running_total(each.select("doc_id", "source", "copy_no", "tokens", "finish"), ["finish", "source", "doc_id", "copy_no"], "tokens")
    taken = taken.where(F.col("running") <= F.lit(float(limit))).withColumnRenamed("running", "place_end")
    return taken, _shares(taken, rows, plan, spark)


def _shares(taken: DataFrame, rows: list, plan: dict, spark) -> DataFrame:
    base = spark.createDataFrame(
        [(r["source"], r["share"], plan.get(r["source"], (0.0,))[0], r["repeats"], r["total"] or 0, r["n_docs"] or 0) for r in rows],
        "source string, target_share double, weight double, max_repeats int, available_tokens long, n_docs long",
    )
    got = taken.groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"), F.count("*").alias("mixed_rows"), F.max("copy_no").alias("last_copy"))
    whole = taken.agg(F.sum("tokens").alias("all_tokens"))
    out = base.join(got, "source", "left").join(F.broadcast(whole))
    return out.select(
        "source", "target_share", "weight", "max_repeats", "available_tokens", "n_docs",
        F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("mixed_rows", F.lit(0)).alias("mixed_rows"),
        F.coalesce(F.col("last_copy") + 1, F.lit(0)).alias("copies_used"), F.coalesce(F.col("mixed_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("reached_share"),
    )

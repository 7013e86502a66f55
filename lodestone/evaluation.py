"""Evaluation of an index by questions: the engine's own retrieval under many configurations, and answer runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import is_test_path
from .operators import answers, evaluation, ranges
from .service import SearchSettings, Service
from .session import durable
from .sources.review import Limit

#: Places of a retriever's list that configurations are fused from.
LIST_DEPTH = 200


def numbered(questions: DataFrame) -> DataFrame:
    """``questions`` (id, type, question, relevant, split, ...) with ``qid``, a number by the order of ids; a set of
    questions is small, and written by hand."""
    ids = {r["id"]: n for n, r in enumerate(questions.select("id").distinct().orderBy("id").collect(), 1)}
    spark = questions.sparkSession
    return questions.join(F.broadcast(spark.createDataFrame(list(ids.items()), "id string, qid long")), "id")


def check_relevant(service: Service, questions: DataFrame) -> None:
    """An error that names every relevant id which the index lacks."""
    wanted = questions.select("id", F.explode("relevant").alias("chunk_id"))
    lost = wanted.join(service.chunks.select("chunk_id"), "chunk_id", "left_anti").orderBy("id", "chunk_id").collect()
    if lost:
        raise ValueError("relevant chunks that the index lacks:\n" + "\n".join(f"{r['id']}: {r['chunk_id']}" for r in lost))


def retrieval(service: Service, questions: DataFrame, configs: list[dict]) -> dict[str, DataFrame]:
    """``ranked`` (config, qid, item, item_rank), and over scored questions ``strict``, ``contained`` (config, qid,
    metrics), ``slots`` and the ``summary`` by split and type. Questions without relevant chunks aren't scored."""
    asked = questions.select("qid", F.col("question").alias("query"))
    lists, _, relevance = service._lists(asked, LIST_DEPTH, SearchSettings("fused", 0))
    edges = service.edges.select(F.col("src_doc").alias("src"), F.col("dst_doc").alias("dst"), "type")
    ranked = durable(evaluation.evaluate_configs(lists.drop("weight"), configs, edges, relevance, ["qid"]))
    chunks = service.chunks.select(F.col("doc").alias("item"), "chunk_id", "path", ranges.line_numbers(F.col("spans"), F.col("start_line"), F.col("end_line")).alias("lines"))
    qrels = questions.select("qid", F.explode("relevant").alias("chunk_id")).distinct().join(chunks, "chunk_id")
    names = F.explode(F.array(*[F.lit(c["name"]) for c in configs])).alias("config")
    wanted = qrels.select("qid", "item", "path", "lines", names)
    keys = ["config", "qid"]
    strict = evaluation.per_question(ranked, wanted, keys)
    # a chunk of the same file that has all lines of a relevant one stands for it, at the best rank
    outer = ranked.where(F.col("item_rank") <= evaluation.DEPTH).join(chunks.select("item", "path", F.col("lines").alias("outer")), "item")
    covering = wanted.withColumnRenamed("item", "inner").join(outer, ["config", "qid", "path"]).where(F.size(F.array_except("lines", "outer")) == 0)
    contained = evaluation.per_question(covering.select("config", "qid", F.col("inner").alias("item"), "item_rank"), wanted, keys)
    tests = service.chunks.where(is_test_path(F.col("path"))).select(F.col("doc").alias("item"))
    places = evaluation.slots(ranked, tests, keys)
    scores = strict.join(questions.select("qid", "type", "split"), "qid")
    summary = evaluation.summary(scores, [["config"], ["config", "split"], ["config", "type"], ["config", "split", "type"]])
    return {"ranked": ranked, "strict": durable(strict), "contained": durable(contained), "slots": places, "summary": summary}


def report(found: dict[str, DataFrame], questions: DataFrame, configs: list[dict], rules: list[dict]) -> str:
    """The configurations' means, and what the rules decide, as text."""
    overall = found["summary"].where("all_split = 1 and all_type = 1").collect()
    by = {r["config"]: r.asDict() for r in overall}
    columns = ["config", "n", "hit_at_1", "hit_at_5", "mrr_at_50", "recall_at_10"]
    text = evaluation.table([by[c["name"]] for c in configs if c["name"] in by], columns)
    scored = questions.where(F.size("relevant") > 0).select("qid", "split")
    for r in evaluation.decide(found["strict"], found["contained"], configs, rules, scored, "qid"):
        text += f"\n\n{r['rule']} ({r['kind']}, {'complete' if r['complete'] else 'partial'}): {r.get('chosen') or ', '.join(r['adopted']) or 'none'}\n"
        text += evaluation.table(r["rows"], ["config", "other", "wins", "losses", "ties", "top3", "mrr", "passes"])
    return text


def compare_runs(base: DataFrame, new: DataFrame, criteria: dict[str, Limit]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two answer runs over the same questions (qid, negative, status, grade, cited_relevant, context array of
    strings): the ``verdicts`` of the ``criteria``, the ``decision``, and the ``regressions``. Criteria:
    unsupported (answered though nothing was to be found, or graded wrong), false_abstentions,
    relevant_citation_rate (over scored questions) and regressions."""
    spark = new.sparkSession
    answered = F.col("status") == "answered"
    ungraded = F.col("grade").isNull()
    counts = new.agg(
        F.count_if(answered & (F.col("negative") | (F.col("grade") == "wrong"))).alias("unsupported"), F.count_if(answered & ~F.col("negative") & ungraded).alias("unsupported_pending"),
        F.count_if((F.col("status") == "abstained") & ~F.col("negative")).alias("false_abstentions"), F.count_if(~F.col("negative") & F.coalesce("cited_relevant", F.lit(False))).alias("cited"), F.count_if(~F.col("negative")).alias("scored"),
    )
    lost = durable(answers.regressions(base.select("qid", "grade"), new.select("qid", "status", "grade")))
    states = lost.agg(F.count_if(F.col("state") != "pending").alias("lost"), F.count_if(F.col("state") == "pending").alias("lost_pending"))
    one = counts.join(F.broadcast(states))
    row = lambda name, numerator, denominator, pending: F.struct(F.lit(name).alias("criterion"), F.col(numerator).alias("numerator"), denominator.cast("long").alias("denominator"), pending.cast("long").alias("pending"))
    told = one.select(F.explode(F.array(
        row("unsupported", "unsupported", F.lit(1), F.col("unsupported_pending")), row("false_abstentions", "false_abstentions", F.lit(1), F.lit(0)),
        row("relevant_citation_rate", "cited", F.greatest(F.col("scored"), F.lit(1)), F.lit(0)), row("regressions", "lost", F.lit(1), F.col("lost_pending")),
    )).alias("x")).select("x.*")
    limits = spark.createDataFrame([(n, c.op, c.numerator, c.denominator) for n, c in criteria.items()], "criterion string, op string, limit long, over long")
    judged = durable(answers.verdicts(told.withColumn("run", F.lit("new")), limits))
    place = lambda df: df.select("qid", F.posexplode("context").alias("place", "item")).withColumn("location", F.lit(""))
    differing = answers.context_differences(place(base), place(new)).withColumn("run", F.lit("new"))
    return judged, answers.decision(judged, differing, ["run"]), lost

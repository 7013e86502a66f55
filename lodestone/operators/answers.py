"""Answers: checks of fresh replies, records of answered questions, and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ABSTENTION, answer_status, cited_tags, near_miss
from . import evidence


def checked(queries: DataFrame, replies: DataFrame, shown: DataFrame, quoting: bool) -> DataFrame:
    """``qid, text, status, verification, citations, unknown_tags, near_miss, kept`` of ``queries`` (qid) with
    their ``replies`` (qid, reply, kept), against the blocks ``shown`` (group, tag, item, first_shown, text).
    A query without reply abstains."""
    none = F.array().cast("array<string>")
    tags = shown.groupBy(F.col("group").alias("qid")).agg(F.collect_set("tag").alias("tags"))
    rows = queries.select("qid").join(replies, "qid", "left").join(tags, "qid", "left").withColumn("tags", F.coalesce("tags", none))
    rows = rows.withColumn("reply", F.coalesce("reply", F.lit(ABSTENTION))).withColumn("cited", F.coalesce(cited_tags(F.col("reply")), none))
    unknown = F.array_except("cited", "tags").alias("unknown_tags")
    near = F.coalesce(near_miss(F.col("reply")), F.lit(False)).alias("near_miss")
    if not quoting:
        return rows.select("qid", F.col("reply").alias("text"), answer_status(F.col("reply")).alias("status"), F.lit(None).cast("string").alias("verification"), F.array_intersect("cited", "tags").alias("citations"), unknown, near, "kept")
    asked = rows.select("qid", F.col("qid").alias("group"), "reply")
    quotes = evidence.entries(evidence.sections(asked, "reply"), "qid").withColumn("group", F.col("qid"))
    lines = shown.select("item", "first_shown", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    # the block's opening tag is no shown line
    lines = lines.where(~F.startswith("text", F.lit("<chunk ")) & (F.col("text") != "</chunk>")).select("item", "i", (F.col("first_shown") + F.col("i") - 1).alias("line"), "text")
    results = evidence.verified(quotes, shown.select("group", "tag", "item"), lines, ["qid", "place"])
    told = evidence.enforced(asked, "qid", "reply", results, shown.select("group", "tag"))
    return told.join(rows.select("qid", unknown, near, "kept"), "qid").select("qid", F.col("shown_text").alias("text"), "status", "verification", "citations", "unknown_tags", "near_miss", "kept")


def records(answers: DataFrame, context: DataFrame, cited: DataFrame, strict: DataFrame, contained: DataFrame) -> DataFrame:
    """One record per answer of ``answers`` (id, qid, negative, status, seconds): whether a relevant chunk was in
    its context and among its citations, by id (``strict``) and by lines (``contained``); both tables are (qid,
    item), ``context`` is (qid, item), ``cited`` (id, item). Null for negative questions, which have none."""
    out = answers
    for name, relevant in (("strict", strict), ("contained", contained)):
        there = context.join(relevant.distinct(), ["qid", "item"], "left_semi").select("qid").distinct().withColumn(f"in_context_{name}", F.lit(True))
        mine = cited.join(answers.select("id", "qid"), "id").join(relevant.distinct(), ["qid", "item"], "left_semi").select("id").distinct().withColumn(f"cited_{name}", F.lit(True))
        out = out.join(there, "qid", "left").join(mine, "id", "left")
    flags = [f"{a}_{b}" for b in ("strict", "contained") for a in ("in_context", "cited")]
    return out.select(*answers.columns, *[F.when(~F.coalesce("negative", F.lit(False)), F.coalesce(c, F.lit(False))).alias(c) for c in flags])


def evidence_summary(results: DataFrame, formatted: DataFrame, keys: list[str]) -> DataFrame:
    """Per ``keys``: replies, those in the format, quotes by result and the share of verified ones. ``results`` is
    (keys, id, result), ``formatted`` (keys, id, parseable, abstained)."""
    kinds = ("verified", "wrong_tag", "unknown_tag", "too_short", "not_found")
    counts = results.groupBy(*keys).agg(F.count("*").alias("quotes"), *[F.count_if(F.col("result") == k).alias(k) for k in kinds])
    rows = formatted.groupBy(*keys).agg(F.count("*").alias("replies"), F.count_if("parseable").alias("parseable"), F.count_if("abstained").alias("abstentions"), F.count_if(F.col("parseable") | F.col("abstained")).alias("compliant"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("quotes", *kinds)]
    both = rows.join(counts, keys, "left").select(*keys, "replies", "parseable", "abstentions", "compliant", *zero)
    return both.withColumn("verified_share", F.round(F.col("verified") / F.nullif("quotes", F.lit(0)), 6))


def context_differences(one: DataFrame, other: DataFrame) -> DataFrame:
    """``qid, base, new``: questions whose ordered contexts (qid, place, item, location) differ, or that only one
    run has."""
    def side(df: DataFrame, name: str) -> DataFrame:
        entry = F.concat_ws(" ", F.col("item").cast("string"), "location")
        rows = df.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", entry.alias("entry")))).alias("x"))
        return rows.select("qid", F.array_join(F.transform("x", lambda r: r["entry"]), ";").alias(name))

    both = side(one, "base").join(side(other, "new"), "qid", "full")
    return both.where(~F.col("base").eqNullSafe(F.col("new")))


def regressions(base: DataFrame, new: DataFrame) -> DataFrame:
    """``qid, state`` of questions that the base run (qid, grade) got right and the new one (qid, status, grade)
    doesn't: ``abstained``, ``not_correct`` or, without a grade, ``pending``."""
    right = base.where(F.col("grade").isin("correct", "correctly abstained")).select("qid", F.col("grade").alias("was"))
    rows = right.join(new.select("qid", "status", "grade"), "qid")
    still = F.col("grade") == F.col("was")
    state = F.when((F.col("was") == "correct") & (F.col("status") == "abstained"), "abstained").when(F.col("grade").isNull(), "pending").when(~still, "not_correct")
    return rows.select("qid", state.alias("state")).where("state is not null")


def holds(numerator: Column, denominator: Column, op: Column, limit: Column, over: Column) -> Column:
    """Whether numerator / denominator stands to limit / over as ``op`` says, by cross multiplication."""
    a, b = numerator * over, limit * denominator
    return F.when(op == "<=", a <= b).when(op == ">=", a >= b).when(op == "==", a == b).when(op == "<", a < b).when(op == ">", a > b)


def verdicts(counts: DataFrame, criteria: DataFrame) -> DataFrame:
    """``counts`` (run keys, criterion, numerator, denominator, pending) against ``criteria`` (criterion, op,
    limit, over): ``verdict`` of each, PENDING while an ungraded answer could change it."""
    rows = counts.join(F.broadcast(criteria), "criterion")
    ok = holds(F.col("numerator"), F.col("denominator"), F.col("op"), F.col("limit"), F.col("over"))
    return rows.withColumn("verdict", F.when(F.col("pending") > 0, "PENDING").when(ok, "PASS").otherwise("FAIL"))


def decision(judged: DataFrame, differing: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, decision``: VOID where contexts differ (``differing`` has the keys), else the worst of FAIL, PENDING
    and PASS of ``judged`` (keys, verdict)."""
    void = differing.select(*keys).distinct().withColumn("void", F.lit(True))
    rows = judged.groupBy(*keys).agg(F.bool_or(F.col("verdict") == "FAIL").alias("fails"), F.bool_or(F.col("verdict") == "PENDING").alias("waits"))
    rows = rows.join(void, keys, "left")
    return rows.select(*keys, F.when(F.col("void"), "VOID").when(F.col("fails"), "FAIL").when(F.col("waits"), "PENDING").otherwise("PASS").alias("decision"))

"""Ranking metrics, their summaries, paired comparison and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from . import fusion, graph

DEPTH = 50
MISS = 2147483647


def per_question(ranked: DataFrame, qrels: DataFrame, keys: list[str]) -> DataFrame:
    """First rank, hits, reciprocal rank and recall of each row of ``qrels``' keys: ``ranked`` (keys, item,
    item_rank) against ``qrels`` (keys, item); ranks beyond 50 are misses. A question without a hit keeps
    its row, with a null first rank."""
    wanted = qrels.select(*keys, "item").distinct()
    seen = ranked.where(F.col("item_rank") <= DEPTH).groupBy(*keys, "item").agg(F.min("item_rank").alias("item_rank"))
    joined = wanted.join(seen, [*keys, "item"], "left")
    first = F.min("item_rank")
    return joined.groupBy(*keys).agg(
        first.alias("first_rank"),
        F.coalesce(first == 1, F.lit(False)).alias("hit1"),
        F.coalesce(first <= 5, F.lit(False)).alias("hit5"),
        F.coalesce(F.lit(1.0) / first, F.lit(0.0)).alias("rr"),
        (F.count_if(F.col("item_rank") <= 10) / F.count("*")).alias("recall10"),
    )


def summary(scores: DataFrame, dimensions: list[list[str]]) -> DataFrame:
    """Means over each grouping set of ``dimensions``; a column that isn't grouped by is null and has a
    flag ``all_<column>`` of 1."""
    columns = list(dict.fromkeys(c for d in dimensions for c in d))
    sets = [[F.col(c) for c in d] for d in dimensions]
    return scores.groupingSets(sets, *[F.col(c) for c in columns]).agg(
        *[F.grouping(c).cast("int").alias(f"all_{c}") for c in columns],
        F.count("*").alias("n"),
        F.round(F.avg(F.col("hit1").cast("int")), 6).alias("hit_at_1"),
        F.round(F.avg(F.col("hit5").cast("int")), 6).alias("hit_at_5"),
        F.round(F.avg("rr"), 6).alias("mrr_at_50"),
        F.round(F.avg("recall10"), 6).alias("recall_at_10"),
    )


def beats(a: Column, b: Column) -> Column:
    """Rank ``a`` is better than ``b``; a miss (null) is worse than any rank and ties with a miss."""
    return F.coalesce(a, F.lit(MISS)) < F.coalesce(b, F.lit(MISS))


def paired(mine: DataFrame, reference: DataFrame, key: str, dimension: str) -> DataFrame:
    """Wins, losses and ties of first ranks by ``dimension`` and overall (null), and the questions of the
    reference's top 3 that come later or not at all."""
    both = mine.select(key, dimension, F.col("first_rank").alias("mine")).join(reference.select(key, F.col("first_rank").alias("theirs")), key)
    lost = (F.col("theirs") <= 3) & (F.col("mine").isNull() | (F.col("mine") > F.col("theirs")))
    return both.groupingSets([[F.col(dimension)], []], F.col(dimension)).agg(
        F.grouping(dimension).cast("int").alias("overall"),
        F.count_if(beats(F.col("mine"), F.col("theirs"))).alias("wins"),
        F.count_if(beats(F.col("theirs"), F.col("mine"))).alias("losses"),
        F.count_if(~beats(F.col("mine"), F.col("theirs")) & ~beats(F.col("theirs"), F.col("mine"))).alias("ties"),
        F.array_join(F.array_sort(F.collect_list(F.when(lost, F.col(key)))), ",").alias("top3_losses"),
    )


def select_candidate(cells: DataFrame) -> DataFrame:
    """The chosen row of ``cells`` (config, position, is_reference, wins, losses, top3, mrr): of those with
    more wins than losses and no top-3 loss, the one with the greatest lead, then the fewest losses, the
    best mrr and the first position; else the reference. A bounded table: one row a configuration."""
    able = (F.col("wins") > F.col("losses")) & (F.col("top3") == 0) & ~F.col("is_reference")
    order = Window.orderBy(F.desc(able), F.when(able, F.col("losses") - F.col("wins")), F.when(able, F.col("losses")), F.when(able, -F.col("mrr")), F.desc("is_reference"), "position")
    return cells.withColumn("able", able).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


#: The grids of configurations that are swept.
RRF_KS, DENSE_WEIGHTS, HOPS = (5, 10, 20, 60), (1.0, 1.5, 2.0, 3.0), (1, 2)
GRAPH_WEIGHTS = {"dense-only": (0.5, 1.0, 2.0, 3.0, 4.0), "default": (0.5, 1.0, 2.0), "k10-w3": (0.5, 1.0, 2.0, 3.0, 4.0)}


def config(name: str, mode: str = "fused", rrf_k: int = 60, dense_weight: float = 1.0, graph_hops: int = 0, graph_weight: float = 1.0, counterpart: str | None = None) -> dict:
    return locals().copy()


BASES = {c["name"]: c for c in (config("bm25-only", "bm25"), config("dense-only", "dense"), config("default"), config("k10-w3", rrf_k=10, dense_weight=3.0))}


def fusion_grid() -> list[dict]:
    """The single lists, the default, and every other fusion of the grid."""
    grid = [config(f"k{k}-w{w:g}", "fused", k, w) for k in RRF_KS for w in DENSE_WEIGHTS if (k, w) != (60, 1.0)]
    return [BASES["bm25-only"], BASES["dense-only"], BASES["default"], *grid]


def graph_grid() -> list[dict]:
    """The bases of the graph grid and each with every number of hops and weight of its own."""
    bases = [BASES[n] for n in GRAPH_WEIGHTS]
    return bases + [b | {"name": f"{b['name']}+g{h}-w{w:g}", "graph_hops": h, "graph_weight": w, "counterpart": b["name"]} for b in bases for h in HOPS for w in GRAPH_WEIGHTS[b["name"]]]


def evaluate_configs(lists: DataFrame, configs: list[dict], edges: DataFrame | None, relevance, keys: list[str]) -> DataFrame:
    """``config, keys, item, item_rank`` of every configuration, from the two retrievers' ``lists`` (keys, source,
    item, item_rank), which are made once. Configurations with hops expand over ``edges`` (src, dst, type),
    weighed by ``relevance`` (a function of pairs of keys and item), and keep within the budget."""
    spark = lists.sparkSession
    lists = durable(lists)
    # a bounded table: one row a configuration
    rows = spark.createDataFrame([(c["name"], c["mode"], c["rrf_k"], float(c["dense_weight"]), c["graph_hops"], float(c["graph_weight"])) for c in configs], "config string, mode string, rrf_k int, dense_weight double, graph_hops int, graph_weight double")
    each = lists.join(F.broadcast(rows), (F.col("mode") == "fused") | (F.col("mode") == F.col("source")))
    each = each.withColumn("weight", F.when(F.col("source") == "dense", F.col("dense_weight")).otherwise(1.0))
    by = ["config", "rrf_k", *keys]
    fused = durable(fusion.fuse(each, by, "rrf_k").select(*by, "item", F.col("fused_rank").alias("item_rank")))
    hops = {(c["graph_hops"], c["rrf_k"]) for c in configs if c["graph_hops"]}
    if edges is None or not hops:
        return fused.drop("rrf_k")
    plain = rows.where("graph_hops = 0").select("config")
    out = fused.join(F.broadcast(plain), "config", "left_semi").drop("rrf_k")

    def related(pairs: DataFrame) -> DataFrame:
        known = relevance(pairs.select(*keys, "item").distinct())
        return pairs.select("config", *keys, "item").distinct().join(known, [*keys, "item"])

    for n, k in sorted(hops):
        mine = [c for c in configs if (c["graph_hops"], c["rrf_k"]) == (n, k)]
        # variants of one counterpart that differ by their weight share their expansion
        lead = {c["counterpart"] or c["name"]: c["name"] for c in mine}
        base = fused.where(F.col("config").isin(*lead.values())).drop("rrf_k")
        near = durable(graph.expand(edges, base, ["config", *keys], related, n, k).select(F.col("config").alias("lead"), *keys, F.lit("graph").alias("source"), "item", F.col("graph_rank").alias("item_rank")))
        of = spark.createDataFrame([(c["name"], lead[c["counterpart"] or c["name"]], float(c["graph_weight"])) for c in mine], "config string, lead string, weight double")
        more = near.join(F.broadcast(of), "lead").withColumn("rrf_k", F.lit(k)).select(*by, "source", "item", "item_rank", "weight")
        own = each.join(F.broadcast(of.select("config")), "config", "left_semi").select(*by, "source", "item", "item_rank", "weight")
        again = fusion.fuse(own.unionByName(more), by, "rrf_k").select("config", *keys, "item", F.col("fused_rank").alias("item_rank"))
        bases = fused.join(F.broadcast(of.select("config")), "config", "left_semi").drop("rrf_k")
        order = fusion.apply_budget(bases, again, ["config", *keys])
        out = out.unionByName(order.select("config", *keys, "item", F.col("final_rank").alias("item_rank")))
    return out


def slots(ranked: DataFrame, tests: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, slots, test_slots``: how many of the first five places are filled, and by items of ``tests`` (item)."""
    top = ranked.where(F.col("item_rank") <= 5).join(tests.select("item").distinct().withColumn("is_test", F.lit(True)), "item", "left")
    return top.groupBy(*keys).agg(F.count("*").alias("slots"), F.count("is_test").alias("test_slots"))


def cells(scores: DataFrame, contained: DataFrame, pairs: list[tuple[str, str]], key: str) -> DataFrame:
    """``config, other, wins, losses, ties, top3, top3_contained, mrr, n`` of each of ``pairs`` (config, the one it
    is held against) over ``scores`` and ``contained`` (config, key, first_rank)."""
    spark = scores.sparkSession
    wanted = F.broadcast(spark.createDataFrame(sorted(set(pairs)), "config string, other string"))

    def meet(rows: DataFrame) -> DataFrame:
        mine = rows.select("config", key, F.col("first_rank").alias("mine")).join(wanted, "config")
        theirs = rows.select(F.col("config").alias("other"), key, F.col("first_rank").alias("theirs"))
        return mine.join(theirs, ["other", key]).withColumn("lost", F.coalesce((F.col("theirs") <= 3) & (F.col("mine").isNull() | (F.col("mine") > F.col("theirs"))), F.lit(False)))

    mine, theirs = F.col("mine"), F.col("theirs")
    strict = meet(scores).groupBy("config", "other").agg(
        F.count_if(beats(mine, theirs)).alias("wins"), F.count_if(beats(theirs, mine)).alias("losses"), F.count_if(~beats(mine, theirs) & ~beats(theirs, mine)).alias("ties"),
        F.count_if("lost").alias("top3"), F.round(F.avg(F.coalesce(F.lit(1.0) / mine, F.lit(0.0))), 6).alias("mrr"), F.count("*").alias("n"),
    )
    wide = meet(contained).groupBy("config", "other").agg(F.count_if("lost").alias("top3_contained"))
    return strict.join(wide, ["config", "other"], "left")


def decide(scores: DataFrame, contained: DataFrame, configs: list[dict], rules: list[dict], split_of: DataFrame, key: str) -> list[dict]:
    """What each rule decides over the questions of its splits (``split_of`` is key, split): ``select`` the best
    candidate that beats the reference, else the reference; ``adopt`` each variant that beats its counterpart,
    with ``after`` only those of what the rule before chose. A rule is ``complete`` if all its splits were run.
    Only counts of configurations, one row each, come to the driver."""
    counterpart = {c["name"]: c["counterpart"] for c in configs}
    order = list(counterpart)
    there = {r["split"] for r in split_of.select("split").distinct().collect()}
    outcomes, chosen = [], None
    for rule in rules:
        splits = list(rule.get("splits") or ("tune", "heldout"))
        mine = split_of.where(F.col("split").isin(*splits)).select(key)
        names = rule.get("candidates") if rule["kind"] == "select" else rule.get("variants") or [n for n in order if counterpart[n]]
        against = [(n, rule["reference"] if rule["kind"] == "select" else counterpart[n]) for n in names]
        found = cells(scores.join(mine, key, "left_semi"), contained.join(mine, key, "left_semi"), against, key)
        rows = {r["config"]: r.asDict() for r in found.collect()}
        follow = chosen if rule.get("after") else None
        for n, other in against:
            row = rows.setdefault(n, {"config": n, "other": other, "wins": 0, "losses": 0, "ties": 0, "top3": 0, "top3_contained": 0, "mrr": 0.0, "n": 0})
            row["considered"] = not rule.get("after") or other == follow
            row["passes"] = row["considered"] and row["wins"] > row["losses"] and not row["top3"]
        passing = sorted((n for n, _ in against if rows[n]["passes"]), key=lambda n: (rows[n]["losses"] - rows[n]["wins"], rows[n]["losses"], -rows[n]["mrr"], names.index(n)))
        fallback = rule.get("reference") if rule["kind"] == "select" else follow
        settles = rule["kind"] == "select" or bool(rule.get("after"))
        out = {"rule": rule.get("name") or rule["kind"], "kind": rule["kind"], "splits": splits, "complete": set(splits) <= there, "rows": [rows[n] for n in names], "adopted": passing}
        if settles:
            chosen = out["chosen"] = passing[0] if passing else fallback
        outcomes.append(out)
    return outcomes


def table(rows: list[dict], columns: list[str]) -> str:
    """Rows as text in aligned columns."""
    said = [columns, *[["-" if r.get(c) is None else f"{r[c]:.3f}" if isinstance(r[c], float) else str(r[c]) for c in columns] for r in rows]]
    widths = [max(map(len, c)) for c in zip(*said)]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(line, widths)).rstrip() for line in said)

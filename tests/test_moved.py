"""How much the operators move, and that their results stay whole in tiles and blocks."""

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import words
from lodestone.functions.stem import added_stems
from lodestone.operators import dense, fusion, lexical
from lodestone.operators.latest import newest
from lodestone.plans import queries


def shuffled(spark, run):
    """Rows written to shuffles while ``run`` runs."""
    sc = spark.sparkContext
    kind = sc._gateway.new_array(sc._jvm.double, 0)

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, kind, sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # one partition needs no shuffle
    run()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return total() - before


def ranked(rows):
    return sorted((r.part, r.qid, r.bm25_rank, r.doc, r.score) for r in rows.collect())


def corpus(spark, n_docs, n_queries):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(rng.choice("pq"), i, ["all", *rng.choices(words, k=rng.randrange(9))]) for i in range(n_docs)], "part string, doc long, tokens array<string>")
    asked = [(rng.choice("pqr"), i, t, rng.randrange(1, 3)) for i in range(n_queries) for t in ["all", *rng.sample(words, 3)]]
    part = {i: p for p, i, *_ in asked}
    return docs, spark.createDataFrame([(part[i], i, t, n) for _, i, t, n in asked], "part string, qid long, token string, qtf long")


def test_bm25_moves_documents_not_tokens(spark):
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([("p", i, words) for i in range(300)], "part string, doc long, tokens array<string>")
    queries = spark.createDataFrame([("p", i, w, 1) for i in range(5) for w in words], "part string, qid long, token string, qtf long")
    assert shuffled(spark, lambda: lexical.bm25(docs, queries, 2).collect()) < 3_000  # of 9,000 tokens


def test_bm25_in_pieces(spark, monkeypatch):
    docs, queries = corpus(spark, 120, 60)
    want = ranked(lexical.bm25(docs, queries, 5))
    assert len(want) > 150
    for name, value in (("TILE_DOCUMENTS", 7), ("TILE_QUERIES", 4), ("FEW_TOKENS", 9)):
        monkeypatch.setattr(lexical, name, value)
        assert ranked(lexical.bm25(docs, queries, 5)) == want


@pytest.mark.parametrize("stem", [False, True])
def test_bm25_of_texts_is_that_of_their_tokens(spark, stem):
    texts = ["parseHTTPResponse closes _private __x__ 7Up utf8 _ 42", "größe_wert Straße_Closing ²x ΑΣ_Ω base64Encode İx", "", "ÄrgerLich A1B closed HTTPServer2Go x__y ٣٤ a٣", "Größe parse closing"]
    rows = spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)], "part string, doc int, text string")
    tokens = F.concat(T.code_tokens(F.col("text")), added_stems(T.code_parts(F.col("text")))) if stem else T.code_tokens(F.col("text"))
    asked = rows.select("part", F.col("doc").alias("qid"), F.explode(F.array_distinct(tokens)).alias("token")).withColumn("qtf", F.lit(1))
    want = ranked(lexical.bm25(rows.select("part", "doc", tokens.alias("tokens")), asked, 9))
    assert want and ranked(lexical.bm25(rows, asked, 9, stem)) == want


def test_newest(spark):
    rows = [(1, 1, "a"), (1, 3, "b"), (1, None, "c"), (2, None, "d"), (3, 2, "e"), (None, 1, "f"), (None, 2, "g"), (4, 5, "h"), (4, 5, "h")]
    got = newest(spark.createDataFrame(rows, "k int, at int, x string"), "k", "at").collect()
    assert sorted((r.k or 0, r.x) for r in got) == [(0, "g"), (1, "b"), (2, "d"), (3, "e"), (4, "h")]


def test_dense_in_pieces(spark, monkeypatch):
    rng = random.Random(3)
    vector = lambda: [float(rng.randrange(-2, 3)) for _ in range(3)] + [1.0]
    parts = spark.createDataFrame([(rng.choice("pq"), i // 3, i % 3, vector()) for i in range(150)], "part string, doc long, part_no int, vector array<double>")
    asked = spark.createDataFrame([(rng.choice("pqr"), i, vector()) for i in range(40)], "part string, qid long, vector array<double>")
    found = lambda: sorted(map(tuple, dense.dense(parts, asked, 4).collect()))
    want = found()
    monkeypatch.setattr(dense, "TILE_VECTORS", 11)
    monkeypatch.setattr(dense, "TILE_QUERIES", 3)
    assert want and found() == want


def test_dense_moves_vectors_not_pairs(spark):
    one = lambda n, key: spark.range(n, numPartitions=4).select(F.lit("p").alias("part"), F.col("id").alias(key), F.array(F.cos("id"), F.sin("id")).alias("vector"))
    parts = one(200, "doc").withColumn("part_no", F.lit(0))
    assert shuffled(spark, lambda: dense.dense(parts, one(100, "qid"), 50).collect()) < 12_000  # of 20,000 pairs


def test_sweep_is_fusion_of_each_configuration(spark):
    rng = random.Random(8)
    rows = [(q, s, i, r) for q in range(6) for s in ("bm25", "dense") for r, i in enumerate(rng.sample(range(15), 9), 1)]
    lists = spark.createDataFrame(rows, "q int, source string, item long, item_rank int")
    grid = [(5, 1.0), (60, 2.5)]
    got = sorted((r.config, r.q, r.fused_rank, r.item, r.score) for r in fusion.sweep(lists, "q", grid, "dense").collect())
    want = []
    for i, (k, w) in enumerate(grid):
        each = fusion.fuse(lists.withColumn("weight", F.when(F.col("source") == "dense", w).otherwise(1.0)), ["q"], k)
        want += [(i, r.q, r.fused_rank, r.item, r.score) for r in each.collect()]
    assert got == sorted(want)


def test_fusing_moves_no_items(spark):
    lists = spark.range(2000).select((F.col("id") % 10).alias("q"), F.lit("dense").alias("source"), F.col("id").alias("item"), F.col("id").cast("int").alias("item_rank"), F.lit(1.0).alias("weight"))
    assert shuffled(spark, lambda: fusion.fuse(lists.repartition(4, "q"), ["q"], unique=True, of="dense").collect()) <= 2000
    assert shuffled(spark, lambda: fusion.sweep(lists.repartition(4, "q"), "q", [(5, 1.0), (60, 2.0)], "dense").collect()) <= 2000


def test_sweep_of_wanted_items(spark):
    rng = random.Random(9)
    rows = [(q, s, i, r) for q in range(7) for s in ("bm25", "dense")[: 1 + q % 2] for r, i in enumerate(rng.sample(range(15), 9), 1)]
    lists = spark.createDataFrame(rows, "q int, source string, item long, item_rank int")
    grid = [(5, 1.0), (20, 3.0)]
    every = {(r.config, r.q, r.item): (r.fused_rank, r.score) for r in fusion.sweep(lists, "q", grid, "dense").collect()}
    dense_rank = {(q, i): r for q, s, i, r in rows if s == "dense"}
    side = lambda s: F.collect_list(F.when(F.col("source") == s, F.struct("item", "item_rank")))
    held = lists.groupBy("q").agg(side("dense").alias("a"), side("bm25").alias("b")).withColumn("wanted", F.expr("array(q, 3L, 99L)"))
    got = {(r.config, r.q, r.item): (r.fused_rank, r.score, r.of_rank) for r in fusion.sweep_rows(held, "q", grid).collect()}
    assert got == {(c, q, i): (*x, dense_rank.get((q, i))) for (c, q, i), x in every.items() if i in (q, 3)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_selection_takes_the_lists_once(spark, monkeypatch):
    made = []
    dense_of = queries._dense
    monkeypatch.setattr(queries, "_dense", lambda *a: made.append(a) or dense_of(*a))
    queries.QUERIES["decision_select"](spark, "/root/testdata/sf0.001")
    assert len(made) == 1


def test_a_part_of_a_word_is_stemmed_once_a_task(monkeypatch):
    asked, real = [], words.stem_word if hasattr(words, "stem_word") else lexical.stem_word
    for module in (words, lexical):
        monkeypatch.setattr(module, "stem_word", lambda w: asked.append(w) or real(w), raising=False)
    columns = [["p", "q", "r"], [1, 2, 3], ["closing parsed_names", "parsedNames closing", "closing_names"], [None] * 3, [None] * 3]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
    rows = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "doc", "text", "words", "tokens"])
    found = [b.to_pylist() for b in lexical._postings({"q": {"clos": 1, "close": 2, "closing": 3}}, True)([rows])][0]
    assert [bool(r["ids"]) for r in found] == [False, True, False]
    assert sorted(asked) == ["closing", "names", "parsed"]

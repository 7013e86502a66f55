"""Operators on small inputs with known results, and against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import dense, evaluation, fusion, graph, lexical, packing, ranges, running
from lodestone.operators.latest import current, latest


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).head().x


@pytest.mark.parametrize(
    "text, want",
    [
        ("parseHTTPResponse", "parsehttpresponse parse http response"),
        ("_private __dunder__", "_private private __dunder__ dunder"),
        ("utf8 base64Encode", "utf8 base64encode base64 encode"),
        ("größe_wert", "größe_wert größe wert"),
        ("x = 42 + y", "x 42 y"),
        ("_ 7Up", "_ 7 up"),
        ("", ""),
    ],
)
def test_code_tokens(spark, text, want):
    assert " ".join(one(spark, T.code_tokens(F.lit(text)))) == want


def test_query_tokens(spark):
    q = spark.createDataFrame([("p", 1, "Where is `the is` and is_set doesNot The limit limit"), ("p", 2, "what is it"), ("p", 3, None)], "part string, qid long, query string")
    names = spark.createDataFrame([("p", "and")], "part string, name string")
    got = {(r.qid, r.token): r.qtf for r in lexical.query_tokens(q, names).collect()}
    assert got == {(1, "the"): 1, (1, "is"): 2, (1, "and"): 1, (1, "is_set"): 1, (1, "set"): 1, (1, "doesnot"): 1, (1, "does"): 1, (1, "not"): 1, (1, "limit"): 2}


def test_text_functions(spark):
    assert one(spark, T.module_name(F.lit("src/a/b/__init__.py"))) == "a.b"
    assert one(spark, T.module_name(F.lit("a/c.py"))) == "a.c"
    for path, want in {"tests/a.py": True, "a/test/b.py": True, "test_x.py": True, "a/x_test.py": True, "conftest.py": True, "email/test.py": False, "src/contest.py": False}.items():
        assert one(spark, T.is_test_path(F.lit(path))) is want
    absolute = lambda m, n, p: one(spark, T.absolute_import(F.lit(m), F.lit(n), F.lit(p)))
    assert absolute("x", 1, "a.b") == "a.b.x" and absolute("x", 2, "a.b") == "a.x" and absolute("x", 4, "a.b") == "" and absolute("x", 0, "a") == "x"
    assert one(spark, T.signature(F.lit("@d\n# c\n\n  def f(): pass"), F.lit("function"))) == "def f(): pass"
    assert one(spark, T.signature(F.lit("import a"), F.lit("module"))) is None
    assert one(spark, T.attribute(F.lit('a<"b&'))) == "a&lt;&quot;b&amp;"
    assert one(spark, T.newlines(F.lit("a\r\nb\rc d"))) == "a\nb\nc d"
    assert one(spark, T.normalised(F.array(F.lit(0.0), F.lit(0.0)))) == [0, 0]
    assert one(spark, F.array_join(T.cited_tags(F.lit("a [C1] b [C2, C03; C1] [C]")), " ")) == "C1 C2 C3"


@pytest.mark.parametrize("text, want", [('*None of the  retrieved code answers this question*', "abstained"), ("None of the retrieved code answers this question. But x.", "mixed"), ("No answer", "answered"), ("", "answered")])
def test_answer_status(spark, text, want):
    assert one(spark, T.answer_status(F.lit(text))) == want


@pytest.mark.parametrize("texts", [["parse a", "parse b"], ["parse"], ["parse x", "y"], ["parse", "parse parse", "z", ""]])
def test_bm25_is_positive_for_matches_only(spark, texts):
    docs = spark.createDataFrame([("p", i, t.split()) for i, t in enumerate(texts)], "part string, doc long, tokens array<string>")
    q = spark.createDataFrame([("p", 1, "parse", 1), ("p", 2, "missing", 1), ("other", 3, "parse", 1)], "part string, qid long, token string, qtf long")
    got = lexical.bm25(docs, q, 10).collect()
    assert {r.doc for r in got} == {i for i, t in enumerate(texts) if "parse" in t} and all(r.score > 0 and r.qid == 1 for r in got)


@pytest.mark.parametrize("numbers", [8, 4_000_000])
def test_dense_takes_the_best_part_and_splits_blocks(spark, monkeypatch, numbers):
    monkeypatch.setattr(dense, "BLOCK_NUMBERS", numbers)
    rng = random.Random(2)
    parts = [("p", d, n, [rng.gauss(0, 1) for _ in range(4)]) for d in range(30) for n in range(rng.randint(1, 3))]
    asked = [("p", q, [rng.gauss(0, 1) for _ in range(4)]) for q in range(7)] + [("q", 99, [1.0, 0.0, 0.0, 0.0])]
    p = spark.createDataFrame(parts, "part string, doc long, part_no int, vector array<double>")
    a = spark.createDataFrame(asked, "part string, qid long, vector array<double>")
    cos = lambda x, y: sum(i * j for i, j in zip(x, y)) / (sum(i * i for i in x) * sum(j * j for j in y)) ** 0.5
    want = set()
    for _, q, v in asked[:7]:
        best = {}
        for _, d, n, u in parts:
            best[d] = max(best.get(d, (-2, 0)), (round(cos(u, v), 5), -n))
        for rank, (d, (c, n)) in enumerate(sorted(best.items(), key=lambda x: (-x[1][0], x[0]))[:5], 1):
            want.add((q, d, -n, rank))
    got = dense.dense(p, a, 5).collect()
    assert {(r.qid, r.doc, r.part_no, r.dense_rank) for r in got} == want


def test_fusion(spark):
    lists = spark.createDataFrame([(1, "x", "a", 1), (1, "x", "b", 2), (1, "y", "b", 1), (1, "y", "c", 2), (1, "y", "b", 3)], "q int, source string, item string, item_rank int").withColumn("weight", F.lit(1.0))
    got = [(r.item, r.score) for r in fusion.fuse(lists, ["q"]).orderBy("fused_rank").collect()]
    assert got == [("b", round(1 / 62 + 1 / 61, 9)), ("a", round(1 / 61, 9)), ("c", round(1 / 62, 9))]


def merged(base, expanded):
    """The budget as a plain loop."""
    out, taken, n = list(base[:3]), set(base[:3]), 0
    for x in expanded:
        if len(out) >= 10:
            break
        if x in taken or (x not in base[:10] and n >= 3):
            continue
        n += x not in base[:10]
        out.append(x)
        taken.add(x)
    return out + [x for x in expanded if x not in taken]


def test_budget_against_a_loop(spark):
    rng = random.Random(3)
    cases = [([f"b{i:02d}" for i in range(20)], ["x1", "x2", "b05", "x3", "x4", "x5"] + [f"b{i:02d}" for i in range(20) if i != 5])]
    for _ in range(120):
        b = rng.sample([f"i{j:02d}" for j in range(30)], rng.randint(0, 15))
        e = b + rng.sample([f"z{j:02d}" for j in range(9)], rng.randint(0, 9))
        rng.shuffle(e)
        cases.append((b, e))
    frame = lambda i: spark.createDataFrame([(n, x, r) for n, c in enumerate(cases) for r, x in enumerate(c[i], 1)], "q int, item string, item_rank int")
    got = {}
    for r in fusion.apply_budget(frame(0), frame(1), ["q"]).orderBy("q", "final_rank").collect():
        got.setdefault(r.q, []).append(r.item)
    for n, (b, e) in enumerate(cases):
        assert got.get(n, []) == merged(b, e)


def edges(spark, rows):
    return spark.createDataFrame(rows, "src int, dst int, type string")


def test_expansion_one_hop(spark):
    e = edges(spark, [(0, i, "calls") for i in range(1, 13)] + [(i, 12, "calls") for i in range(1, 12)])
    seeds = spark.createDataFrame([(1, 0, 1)], "q int, item int, item_rank int")
    relevance = spark.createDataFrame([(1, i, 0.0 if i == 3 else 1.0) for i in range(14)], "q int, item int, relevance double")
    got = [r.item for r in graph.expand(e, seeds, ["q"], relevance, hops=1).orderBy("graph_rank").collect()]
    assert got == [1, 2, 4, 5, 6, 7, 8, 9]


def test_expansion_two_hops(spark):
    e = edges(spark, [(0, 1, "calls"), (1, 2, "calls"), (3, 0, "calls"), (4, 0, "tested_by"), (1, 4, "contains")])
    seeds = spark.createDataFrame([(1, 0, 1)], "q int, item int, item_rank int")
    assert {r.item for r in graph.expand(e, seeds, ["q"], hops=1).collect()} == {1, 3}
    got = [r.item for r in graph.expand(e, seeds, ["q"], hops=2).orderBy("graph_rank").collect()]
    assert set(got) == {0, 1, 2, 3, 4} and got.index(1) < got.index(2)
    with pytest.raises(ValueError):
        graph.expand(e, seeds, ["q"], hops=0)


def test_division(spark):
    m = spark.createDataFrame([("P", "a"), ("P", "b"), ("P", "__init__"), ("C", "a"), ("C", "b"), ("C", "z"), ("D", "a"), ("S", "q")], "cls string, name string")
    got = graph.implementers(m, m, m.withColumnRenamed("cls", "protocol")).collect()
    assert {(r.protocol, r.cls) for r in got} == {("P", "C")}


def test_ranges(spark):
    n = spark.createDataFrame([(1, x) for x in (1, 2, 3, 7, 8, 8)], "k int, n int")
    assert ranges.format_ranges(n, ["k"], "n").head().ranges == "1-3,7-8"
    r = spark.createDataFrame([(1, 1, 4), (1, 2, 3), (1, 5, 6), (1, 9, 9), (2, 1, 1)], "k int, s int, e int")
    assert sorted(tuple(x) for x in ranges.merge_ranges(r, ["k"], "s", "e").collect()) == [(1, 1, 6), (1, 9, 9), (2, 1, 1)]
    d = spark.createDataFrame([(1, "a", 1), (1, "a", 5), (1, "b", 2), (1, "a", 9)], "k int, base string, line int")
    assert [x.chunk_id for x in ranges.duplicate_ids(d, ["k"], ["line"], "base").orderBy("line").collect()] == ["a", "b", "a~2", "a~3"]


def shares(sizes, budget):
    """Fair shares as a plain loop."""
    out, left, todo = [0] * len(sizes), max(budget, 0), sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    while todo:
        equal = left // len(todo)
        if sizes[todo[0]] > equal:
            for i in todo:
                out[i] = equal
            break
        out[todo[0]] = sizes[todo[0]]
        left -= sizes[todo.pop(0)]
    return out


def test_fair_shares_against_a_loop(spark):
    rng = random.Random(4)
    cases = [([10, 100, 100], 150), ([10, 20], 100), ([50, 50, 50], 90), ([5], 0)] + [([rng.randint(0, 90) for _ in range(rng.randint(1, 9))], rng.randint(-5, 400)) for _ in range(150)]
    df = spark.createDataFrame([(n, b, i, x) for n, (c, b) in enumerate(cases) for i, x in enumerate(c)], "q int, budget int, pos int, size long")
    got = {}
    for r in packing.fair_shares(df, ["q"], "size", "pos", F.col("budget")).orderBy("q", "pos").collect():
        got.setdefault(r.q, []).append(r.share)
    assert [got[n] for n in range(len(cases))] == [shares(c, b) for c, b in cases]


def test_greedy_parts(spark):
    cases = [([1, 1, 1], 2, [(0, 1), (2, 2)]), ([5, 1], 2, [(0, 0), (1, 1)]), ([1], 9, [(0, 0)]), ([2, 2, 9, 1, 1], 4, [(0, 1), (2, 2), (3, 4)])]
    df = spark.createDataFrame([(s, b) for s, b, _ in cases], "sizes array<int>, budget int")
    got = df.select(packing.greedy_parts(F.col("sizes"), F.col("budget")).alias("x")).collect()
    assert [[tuple(p) for p in r.x] for r in got] == [w for _, _, w in cases]


def test_metrics_and_pairs(spark):
    ranked = spark.createDataFrame([(1, f"i{n}", n) for n in range(1, 17)] + [(2, "late", 51)], "q int, item string, item_rank int")
    rel = spark.createDataFrame([(1, "i3"), (1, "i9"), (1, "i12"), (1, "i3"), (2, "late")], "q int, item string")
    a, b = evaluation.per_question(ranked, rel, ["q"]).orderBy("q").collect()
    assert (a.first_rank, a.hit1, a.hit5, a.rr, a.recall10) == (3, False, True, 1 / 3, 2 / 3)
    assert (b.first_rank, b.hit5, b.rr, b.recall10) == (None, False, 0.0, 0.0)
    schema = "q string, c string, first_rank int"
    mine = spark.createDataFrame([("a", "x", 1), ("b", "x", 5), ("c", "y", None), ("d", "y", None), ("e", "y", 3)], schema)
    ref = spark.createDataFrame([("a", "x", 2), ("b", "x", 5), ("c", "y", 4), ("d", "y", None), ("e", "y", None)], schema)
    got = {r.c: (r.wins, r.losses, r.ties) for r in evaluation.paired(mine, ref, "q", "c").collect()}
    assert got == {None: (2, 1, 2), "x": (1, 0, 1), "y": (1, 1, 1)}


def test_selection(spark):
    schema = "config int, wins int, losses int, top3 int, mrr double, is_reference boolean, position int"
    ref = (-1, 0, 0, 0, None, True, 9)
    pick = lambda *c: evaluation.select_candidate(spark.createDataFrame([*c, ref], schema)).head().config
    assert pick((0, 3, 1, 0, 0.5, False, 0), (1, 9, 1, 1, 0.9, False, 1)) == 0
    assert pick((0, 1, 1, 0, 0.5, False, 0)) == -1
    assert pick((0, 4, 2, 0, 0.5, False, 0), (1, 3, 1, 0, 0.4, False, 1)) == 1
    assert pick((0, 3, 1, 0, 0.5, False, 0), (1, 3, 1, 0, 0.6, False, 1)) == 1


def test_running_total_over_a_hot_group(spark):
    rng = random.Random(5)
    data = [("hot" if i % 3 else f"g{i % 7}", i * 37 % 1009, i, rng.randint(0, 9)) for i in range(1000)]
    df = spark.createDataFrame(data, "g string, t int, id int, v long")
    got = {r.id: r.running for r in running.running_total(df, ["t", "id"], "v", "g").collect()}
    sums = {}
    for g, _, i, v in sorted(data):
        sums[g] = sums.get(g, 0) + v
        assert got[i] == sums[g]
    total = [r.running for r in running.running_total(df, ["t", "id"], "v").orderBy("t", "id").collect()]
    assert total[-1] == sum(d[3] for d in data) and total == sorted(total)
    assert running.running_total(df.limit(0), ["t", "id"], "v", "g").count() == 0


def test_latest(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, "c", None), (2, None, None)], "k int, x string, by int")
    assert sorted((r.k, r.x) for r in latest(df, ["k"], "by").collect()) == [(1, "b"), (2, None)]


def test_current(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 2), (2, "c", None), (2, "d", 0), (3, "e", None), (None, "f", 1), (4, "g", 7)], "k long, text string, at long")
    assert sorted(r.text for r in current(df, "k", "at").collect()) == ["b", "b", "d", "e", "g"]
    assert current(df.where("k > 2"), "k", "at").count() == 2 and current(df.limit(0), "k", "at").count() == 0


def test_retrieval_takes_stems_beside_tokens(spark, tmp_path):
    from lodestone.functions.stem import stem_word
    from lodestone.plans.queries import QUERIES

    sources = {1: "close all", 2: "closing_handles runningJobs", 3: "opens a b c d e f", 4: "x y z"}
    chunks = [(n, "c", "p.py", None, f"f{n}", "function", text, 1) for n, text in sources.items()]
    spark.createDataFrame(chunks, "chunk_no long, corpus string, path string, parent string, symbol string, kind string, source string, indexed_at long").write.parquet(f"{tmp_path}/chunks.parquet")
    asked = [(1, "c", "Who closes the `running_jobs`?", "tune", [], 1)]
    spark.createDataFrame(asked, "question_id long, corpus string, question string, split string, relevant array<string>, created_at long").write.parquet(f"{tmp_path}/questions.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert {(r.token, r.qtf) for r in run("query_tokens_stemmed")} == {("closes", 1), ("close", 1), ("running_jobs", 1), ("running", 1), ("jobs", 1), ("run", 1), ("job", 1)}
    # by hand: p py, the name, then the source's words, parts and their stems
    two = "p py f2 closing_handles closing handles close handl runningjobs running jobs run job".split()
    assert [stem_word(w) for w in ("closing", "handles", "running", "jobs")] == ["close", "handl", "run", "job"]
    lengths = {r.chunk_no: r.n_tokens for r in run("doc_lengths_stemmed")}
    assert lengths == {1: 5, 2: len(two), 3: 11, 4: 6}
    df = {r.token: r.df for r in run("term_df_idf_stemmed")}
    assert df["close"] == 2 and df["closing"] == 1 and df["open"] == 1
    import math

    idf = lambda n: math.log(1 + (4 - n + 0.5) / (n + 0.5))
    norm = lambda n: 1.5 * (0.25 + 0.75 * n / (sum(lengths.values()) / 4))
    part = lambda n, dl: idf(n) * 2.5 / (1 + norm(dl))
    got = {(r.chunk_no, r.bm25_rank): r.score for r in run("bm25_topk_stemmed")}
    want = {(2, 1): part(2, len(two)) + 4 * part(1, len(two)), (1, 2): part(2, 5)}
    assert got == pytest.approx(want, abs=1e-6)
    assert {r.chunk_no for r in run("bm25_topk")} == {2}

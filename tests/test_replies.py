"""Contexts, evidence and the files around an evaluation."""

import random
import sys

import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import ABSTENTION
from lodestone.operators import context, evidence
from lodestone.sources import review


def chunk(n, lines=5, **more):
    return {"chunk_no": n, "chunk_id": f"a.py::f{n}", "kind": "function", "start_line": 1, "end_line": lines, "numbers": list(range(1, lines + 1)), "source": "\n".join(f"line {i} of chunk {n}" for i in range(1, lines + 1)), **more}


HIT = "question_id long, question string, hit_rank int, chunk_no long, chunk_id string, kind string, start_line int, end_line int, numbers array<int>, source string, from_line int, to_line int"


def laid(spark, question, chunks, budget):
    rows = [(1, question, i, c["chunk_no"], c["chunk_id"], c["kind"], 1, c["end_line"], c["numbers"], c["source"], c.get("from_line"), c.get("to_line")) for i, c in enumerate(chunks, 1)]
    return context.contexts(spark.createDataFrame(rows, HIT), budget).orderBy("tag").collect()


def grown(costs, scores, room):
    """Window of lines by one step after the other."""
    at = scores.index(max(scores)) if max(scores) else 0
    first = last = at
    used, turn = costs[at], "below"
    while True:
        able = {"below": last + 1 < len(costs) and used + costs[last + 1] <= room, "above": max(scores) > 0 and first > 0 and used + costs[first - 1] <= room}
        if not any(able.values()):
            return first, last
        side = turn if able[turn] else "above" if turn == "below" else "below"
        first, last = (first - 1, last) if side == "above" else (first, last + 1)
        used += costs[first if side == "above" else last]
        turn = "above" if turn == "below" else "below"


def test_windows_against_steps(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(60):
        n = rng.randint(1, 12)
        words = [rng.randint(0, 6) for _ in range(n)]
        hits = [rng.random() < 0.3 and w > 0 for w in words]
        lines = [" ".join(["pool" if h and j == 0 else "x" for j in range(w)]) for w, h in zip(words, hits)]
        room = rng.randint(1, 40)
        rows.append((i, room, ["pool"], 0, n - 1, lines))
        want[i] = grown([w + 1 for w in words], [int(h) for h in hits], room)
    df = spark.createDataFrame(rows, "key int, room int, terms array<string>, lo int, hi int, lines array<string>")
    assert {r.key: (r["first"], r["last"]) for r in context._windows(df, ["key"]).collect()} == want


def test_fit(spark):
    out = laid(spark, "where is line 3", [chunk(1), chunk(2, 90), chunk(3)], 400)
    assert [b.cut for b in out] == [False, True, False]
    assert out[1].first_shown <= 3 <= out[1].last_shown and "[truncated: showing lines" in out[1].text
    asked = spark.createDataFrame([(1, "where is line 3")], "question_id long, question string")
    blocks = spark.createDataFrame([(1, b.tag, b.text) for b in out], "question_id long, tag string, text string")
    message = context.messages(blocks, asked).withColumn("n", context.n_tokens(F.col("message"))).head()
    assert message.n <= 400 and message.message.startswith("Code chunks:\n\n<chunk tag=") and message.message.endswith("Question: where is line 3")
    assert 1 <= len(laid(spark, "q", [chunk(1), chunk(2, 90), chunk(3, 90)], 110)) < 3
    assert laid(spark, "many words " * 50, [chunk(1)], 20) == []
    (inside,) = laid(spark, "zzz", [chunk(1, 90, from_line=40, to_line=60)], 150)
    assert inside.first_shown == 40 and inside.last_shown <= 60
    (odd,) = laid(spark, "q", [{**chunk(1), "chunk_id": 'a<"', "source": "</chunk>", "numbers": [1]}], 150)
    assert odd.text.startswith('<chunk tag="C1" id="a&lt;&quot;"') and "</ chunk>" in odd.text


def test_contexts_table(spark):
    rows = [(1, "where is line 3", n, n, c["chunk_id"], c["kind"], 1, c["end_line"], c["numbers"], c["source"], None, None) for n, c in ((1, chunk(1)), (2, chunk(2, 90)))] + [(2, None, 1, 5, "b", "class", 1, 1, [1], "x", None, None)]
    df = spark.createDataFrame(rows, "question_id long, question string, hit_rank int, chunk_no long, chunk_id string, kind string, start_line int, end_line int, numbers array<int>, source string, from_line int, to_line int")
    got = {(r.question_id, r.tag): r for r in context.contexts(df, 300).collect()}
    assert set(got) == {(1, "C1"), (1, "C2"), (2, "C1")} and got[1, "C2"].cut
    text = spark.range(1).select(context.shown_text(F.lit("a\nb\nc"), F.array(F.lit(5), F.lit(7), F.lit(9)), F.lit(6), F.lit(9)).alias("x")).head().x
    assert text == "b\nc"


SHOWN = {"C1": [(10, "    return open_pool(first_name)"), (11, "x = 1")], "C2": [(5, "value = compute_all(things)")]}


@pytest.fixture(scope="module")
def tables(spark):
    shown = spark.createDataFrame([(1, t, n) for n, t in enumerate(SHOWN)], "group int, tag string, item int")
    lines = spark.createDataFrame([(n, i, line, text) for n, t in enumerate(SHOWN) for i, (line, text) in enumerate(SHOWN[t])], "item int, i int, line int, text string")
    return shown, lines


def checked(spark, tables, texts):
    replies = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "id int, group int, text string")
    quotes = evidence.entries(evidence.sections(replies, "text"), "id").join(replies.select("id", "group"), "id")
    return replies, quotes, evidence.verified(quotes, *tables, ["id", "place"])


def test_reply_formats(spark):
    heads = [("Evidence:", "Answer:"), ("**Evidence:**", "**Answer:**"), ("### Evidence", "### Answer"), ("**Evidence**:", "__Answer__:"), ("evidence", "ANSWER:")]
    texts = [f"{e}\n- [C1] `return open_pool(first_name)`\n```\n2. [C2]:\n\n\"value = compute_all(things)\"\n\n{a}\nIt opens [C1]." for e, a in heads]
    df = spark.createDataFrame([*enumerate(texts), (9, "Evidence of nothing. Answer me"), (10, None)], "id int, text string")
    parsed = evidence.sections(df, "text")
    assert [r.answer for r in parsed.orderBy("id").collect()] == ["It opens [C1]."] * 5 + [None] * 2
    got = [(r.id, r.tag, r.quote) for r in evidence.entries(parsed, "id").orderBy("id", "place").collect()]
    assert got == [(i, t, q) for i in range(5) for t, q in (("C1", "return open_pool(first_name)"), ("C2", "value = compute_all(things)"))]
    alone = evidence.sections(spark.createDataFrame([(1, "Evidence:\n[C1]\n[C2] `some other quote`\nplain\nAnswer: x")], "id int, text string"), "text")
    assert [(r.tag, r.quote) for r in evidence.entries(alone, "id").collect()] == [("C2", "some other quote")]


def test_quotes(spark, tables):
    cases = [("C1", "return  open_pool(first_name)", "verified", 10, None), ("C01", "open_pool(first_name) …", "verified", 10, None), ("C1", "value = compute_all(things)", "wrong_tag", None, "C2"),
             ("C9", "value = compute_all(things)", "unknown_tag", None, None), ("C1", "x = 1", "too_short", None, None), ("C1", "nowhere to be found", "not_found", None, None)]
    _, _, results = checked(spark, tables, [f"Evidence:\n[{t}] {q}\nAnswer: a" for t, q, *_ in cases])
    assert [(r.result, r.line, r.found_in) for r in results.orderBy("id").collect()] == [tuple(c[2:]) for c in cases]


def test_enforcement(spark, tables):
    good = "Evidence:\n[C1] return open_pool(first_name)\n\nAnswer:\nIt opens it [C1]."
    texts = [good, good.replace("it [C1]", "it [C1, C2]"), good.replace("first_name", "second_name"), ABSTENTION, "Evidence:\n[C1] return open_pool(first_name)\nAnswer:", "No format [C1]."]
    replies, _, results = checked(spark, tables, texts)
    got = evidence.enforced(replies, "id", "text", results, tables[0]).orderBy("id").collect()
    assert [r.verification for r in got] == ["verified", "partial", "unverified", "abstained", "unverified", "unverified"]
    assert [list(r.citations) for r in got] == [["C1"], ["C1", "C2"], [], [], [], []]
    assert got[0].shown_text == good and got[2].shown_text == ABSTENTION and got[2].status == "abstained" and list(got[1].unsupported) == ["C2"]


def test_released_pieces(spark, tables):
    good = "Evidence:\n[C1] return open_pool(first_name)\n\n**Answer:** It opens."
    texts = [good, "Evidence:\n[C1] nothing that is there\n\nAnswer: no more", "No heading"]
    _, _, results = checked(spark, tables, texts)
    pieces = spark.createDataFrame([(i, n, t[n : n + 3]) for i, t in enumerate(texts) for n in range(0, len(t), 3)], "id int, seq int, piece string")
    out = evidence.released(pieces, "id", results).orderBy("id", "seq").collect()
    assert {r.id for r in out} == {0} and "".join(r.piece for r in out) == "It opens."


def test_limits():
    assert review.Limit.parse(">= 26/36").passes(13, 18) and not review.Limit.parse(">= 26/36").passes(25, 36) and review.Limit.parse("== 0").passes(0)
    with pytest.raises(ValueError):
        review.Limit.parse("about 3")
    assert [review.decide(n, s) for n, s in ((1, ["PASS"]), (0, ["PASS", "FAIL", "PENDING"]), (0, ["PENDING", "PASS"]), (0, ["PASS"]))] == ["VOID", "FAIL", "PENDING", "PASS"]


def test_review_round_trip(spark, tmp_path):
    pytest.importorskip("yaml")
    rows = spark.createDataFrame([("q1", "flow", "c", False, "Where?", "answered", "Here.\nThere."), ("q2", "negative", "c", True, "Why?", "abstained", None), ("q3", "flow", "c", False, "Who?", "answered", "x")], "id string, type string, corpus string, expect_abstain boolean, question string, classification string, answer string")
    assert review.write_review(rows, tmp_path / "r.md") == 3
    text = (tmp_path / "r.md").read_text()
    assert review.read_review(text) == ({}, ["q1", "q2", "q3"], [])
    filled = text.replace("____", "**Partial** - misses `retry_it`.", 1).replace("____", "unsure", 1)
    assert review.read_review(filled) == ({"q1": ("partial", "misses retry_it")}, ["q3"], ["q2: unknown verdict 'unsure'"])
    table = review.review_rows(spark.createDataFrame([("r", filled), ("none", "no sections"), ("null", None)], "review string, text string"))
    assert [(r.id, r.state, r.grade) for r in table.orderBy("id").collect()] == [("q1", "grade", "partial"), ("q2", "problem", ""), ("q3", "open", "")]
    assert table.where("id = 'q1'").head().note == "misses retry_it"
    review.write_grades(tmp_path / "g.yaml", "r.json", {"q1": "partial"}, {"by": "me", "on": "x"})
    review.write_grades(tmp_path / "g.yaml", "r.json", {"q1": "correct"}, {"on": "y"})
    assert [tuple(r) for r in review.load_grades(spark, tmp_path / "g.yaml").collect()] == [("q1", "correct")] and "by: me" in (tmp_path / "g.yaml").read_text()


def test_questions_tell_all_problems(spark, tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "q.yaml"
    path.write_text("- {id: a, corpus: c, type: flow, question: 'Where?', relevant: [x], expect_abstain: false}\n- {id: n, corpus: c, type: negative, question: 'Why?', expect_abstain: true, split: heldout}\n")
    assert review.load_questions(spark, path).count() == 2
    path.write_text("- {id: a, type: odd, question: '', relevant: []}\n- {id: a, type: flow, question: x, relevant: [y]}\n")
    with pytest.raises(ValueError) as e:
        review.load_questions(spark, path)
    assert all(x in str(e.value) for x in ("unknown type", "no question", "repeated id"))
    path.write_text("criteria: {unsupported: {pass_if: '<= 2'}}\n")
    assert review.load_criteria(path) == {"unsupported": review.Limit("<=", 2)}


def test_corpora_and_configs(tmp_path):
    pytest.importorskip("yaml")
    version = ".".join(map(str, sys.version_info[:2]))
    path = tmp_path / "c.yaml"
    path.write_text(f"std: {{path: std, source: {{kind: python_stdlib, python_version: '{version}', packages: [json]}}}}\n")
    corpus = review.load_corpora(path)["std"]
    folder = review.materialise(corpus, tmp_path)
    assert (folder / "json" / "decoder.py").is_file() and not (folder / "json" / "__pycache__").exists()
    (folder / "mark").write_text("x")
    assert review.materialise(corpus, tmp_path) == folder and (folder / "mark").exists()
    corpus["source"]["python_version"] = "2.7"
    with pytest.raises(ValueError):
        review.materialise(corpus, tmp_path)
    path.write_text("a: {path: x, source: {kind: odd}}\nb: {source: {kind: git_archive}}\n")
    with pytest.raises(ValueError) as e:
        review.load_corpora(path)
    assert all(x in str(e.value) for x in ("a: unknown kind", "b: no path", "b: no ref"))
    path.write_text("configs: [{name: d, mode: dense}, {name: g, mode: dense, graph_hops: 2, counterpart: d}]\ndecision_rules: [{name: r, kind: select, reference: d, candidates: [g]}, {name: s, kind: adopt, after: r, reference: d, variants: [g]}]\n")
    configs, rules = review.load_configs(path)
    assert configs[1]["rrf_k"] == 60 and [r["name"] for r in rules] == ["r", "s"]
    path.write_text("configs: [{name: d, mode: odd}, {name: d, counterpart: z}]\ndecision_rule: {name: r, kind: guess, candidates: [q], after: x}\n")
    with pytest.raises(ValueError) as e:
        review.load_configs(path)
    assert all(x in str(e.value) for x in ("repeated name", "unknown mode", "unknown counterpart", "unknown kind", "unknown configuration", "isn't before it"))
    assert review.results_name("t", "abc", True, "", "tune") == "t-abc-dirty-tune.json"

"""Configurations over own retrieval, decision rules, answer runs and the commands around them."""

import json

import pytest

from lodestone import cli, evaluation
from lodestone.operators import answers
from lodestone.operators import evaluation as measures
from lodestone.service import ScriptedGenerator, Service
from lodestone.sources import review
from lodestone.sources.store import IndexStore

CORE = "def open_pool():\n    return read_rows()\n\n\ndef read_rows():\n    return 1\n\n\nclass Pool:\n    def close(self):\n        return open_pool()\n"


def scripted():
    return ScriptedGenerator([("open", "It opens [C1].")])


def test_decisions(spark):
    ranks = {"ref": [1, 5, None, 9, 4], "good": [1, 2, 3, 9, 4], "loses": [4, 1, 1, 1, 1], "v": [1, 1, 3, 9, 4], "w": [1, 1, 1, 1, 1]}
    scores = spark.createDataFrame([(c, q, r) for c, rs in ranks.items() for q, r in enumerate(rs)], "config string, qid long, first_rank int")
    split_of = spark.createDataFrame([(q, "tune" if q < 3 else "heldout") for q in range(5)], "qid long, split string")
    configs = [measures.config(n) for n in ("ref", "good", "loses")] + [measures.config("v", graph_hops=1, counterpart="good"), measures.config("w", graph_hops=1, counterpart="ref")]
    rules = [{"name": "s", "kind": "select", "reference": "ref", "candidates": ["loses", "good"]}, {"name": "a", "kind": "adopt", "after": "s"}, {"kind": "select", "reference": "ref", "candidates": ["loses"], "splits": ["tune"]}, {"kind": "adopt", "splits": ["other"]}]
    got = measures.decide(scores, scores, configs, rules, split_of, "qid")
    assert [g.get("chosen") for g in got] == ["good", "v", "ref", None]
    assert [g["complete"] for g in got] == [True, True, True, False]
    assert [(r["config"], r["considered"], r["passes"]) for r in got[1]["rows"]] == [("v", True, True), ("w", False, False)]
    assert (got[0]["rows"][1]["wins"], got[0]["rows"][1]["losses"], got[0]["rows"][1]["ties"]) == (2, 0, 3)


def test_grids():
    assert len(measures.fusion_grid()) == 18 and len(measures.graph_grid()) == 3 + 2 * (5 + 3 + 5)
    assert "1.000" in measures.table([{"a": 1.0, "b": None}], ["a", "b"])


def test_records_and_evidence(spark):
    rows = spark.createDataFrame([(1, 1, False, "answered"), (2, 2, True, "abstained"), (3, 1, False, "answered")], "id int, qid int, negative boolean, status string")
    pairs = lambda rows, a: spark.createDataFrame(rows, f"{a} int, item int")
    got = answers.records(rows, pairs([(1, 7), (2, 7)], "qid"), pairs([(1, 7), (3, 8)], "id"), pairs([(1, 7)], "qid"), pairs([(1, 7), (1, 8)], "qid")).orderBy("id").collect()
    assert [(r.in_context_strict, r.cited_strict, r.cited_contained) for r in got] == [(True, True, True), (None, None, None), (True, False, True)]
    results = spark.createDataFrame([("c", 1, "verified"), ("c", 1, "not_found")], "corpus string, id int, result string")
    formatted = spark.createDataFrame([("c", 1, True, False), ("c", 2, False, True), ("d", 3, False, False)], "corpus string, id int, parseable boolean, abstained boolean")
    by = {r.corpus: r for r in answers.evidence_summary(results, formatted, ["corpus"]).collect()}
    assert (by["c"].quotes, by["c"].verified, by["c"].compliant, by["c"].verified_share) == (2, 1, 2, 0.5) and by["d"].verified_share is None


def test_runs_are_compared(spark):
    run = lambda rows: spark.createDataFrame(rows, cli.RUN)
    base = [("a", False, "answered", "correct", True, ["x", "y"]), ("b", False, "answered", "partial", False, ["x"]), ("n", True, "abstained", "correctly abstained", None, ["z"])]
    criteria = {"unsupported": review.Limit("<=", 0), "relevant_citation_rate": review.Limit(">=", 1, 2), "regressions": review.Limit("==", 0)}
    judged, decision, lost = evaluation.compare_runs(run(base), run(base), criteria)
    assert {r.criterion: r.verdict for r in judged.collect()} == {"unsupported": "PASS", "relevant_citation_rate": "PASS", "regressions": "PASS"} and decision.head().decision == "PASS" and lost.count() == 0
    new = [("a", False, "abstained", None, False, ["x", "y"]), base[1], ("n", True, "answered", None, None, ["z"])]
    judged, decision, lost = evaluation.compare_runs(run(base), run(new), criteria)
    assert {r.criterion: r.verdict for r in judged.collect()}["unsupported"] == "FAIL" and decision.head().decision == "FAIL"
    assert {(r.qid, r.state) for r in lost.collect()} == {("a", "abstained"), ("n", "pending")}
    other = [(*base[0][:5], ["y", "x"]), *base[1:]]
    assert evaluation.compare_runs(run(base), run(other), criteria)[1].head().decision == "VOID"
    pending = [base[0], base[1], ("n", True, "abstained", None, None, ["z"])]
    assert evaluation.compare_runs(run(base), run(pending), criteria)[1].head().decision == "PENDING"


def test_own_retrieval_and_commands(spark, tmp_path, capsys):
    pytest.importorskip("yaml")
    repo = tmp_path / "repo"
    (repo / "tests").mkdir(parents=True)
    (repo / "core.py").write_text(CORE)
    (repo / "tests" / "test_core.py").write_text("def test_pool(): open_pool()\n")
    questions = tmp_path / "q.yaml"
    questions.write_text("- {id: a, corpus: c, type: flow, question: 'where is open_pool', relevant: ['core.py::open_pool'], split: tune}\n- {id: b, corpus: c, type: location, question: 'close Pool', relevant: ['core.py::Pool.close'], split: heldout}\n- {id: n, corpus: c, type: negative, question: 'zebra', expect_abstain: true}\n")
    assert cli.main(["index", str(repo)]) == 0
    service = Service(IndexStore(spark, repo / cli.FOLDER))
    asked = evaluation.numbered(review.load_questions(spark, questions))
    configs = [measures.BASES["dense-only"], measures.BASES["default"], measures.config("dense+g", "dense", graph_hops=1, graph_weight=2.0, counterpart="dense-only")]
    found = evaluation.retrieval(service, asked, configs)
    strict = {(r.config, r.qid): r for r in found["strict"].collect()}
    assert set(strict) == {(c["name"], q) for c in configs for q in (1, 2)} and strict["default", 1].first_rank <= 2
    assert all(r.first_rank <= strict[r.config, r.qid].first_rank for r in found["contained"].collect())
    assert found["slots"].where("test_slots > 0").count() > 0
    text = evaluation.report(found, asked, configs, [{"name": "r", "kind": "adopt"}])
    assert "dense+g" in text and "r (adopt, complete)" in text
    capsys.readouterr()
    assert cli.main(["search", str(repo), "open pool", "-k", "2", "--no-graph", "--json"]) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["settings"] == "dense" and told["hits"][0]["sources"] == ["dense"]
    assert cli.main(["ask", str(repo), "open pool", "--generator", f"{__name__}:scripted"]) == 0 and "cited: C1" in capsys.readouterr().out
    assert cli.main(["ask", str(repo), "open pool"]) == 1
    questions.write_text("- {id: a, corpus: c, type: flow, question: x, relevant: ['no::such'], split: tune}\n")
    assert cli.main(["eval", str(repo), str(questions)]) == 1 and "no::such" in capsys.readouterr().err


def test_grade_and_compare_commands(spark, tmp_path, capsys):
    pytest.importorskip("yaml")
    text = tmp_path / "r.md"
    text.write_text("## q1 (flow, c, answerable)\n\n**Verdict:** correct\n\n## q2 (flow, c, answerable)\n\n**Verdict:** ____\n")
    assert cli.main(["grade", str(text), str(tmp_path / "g.yaml"), "--meta", "by=me"]) == 0 and "1 graded, 1 open" in capsys.readouterr().out
    assert cli.main(["grade", str(text), str(tmp_path / "g.yaml"), "--meta", "by"]) == 1
    run = spark.createDataFrame([("a", False, "answered", "correct", True, ["x"])], cli.RUN)
    review.save_results(run, tmp_path / "one.json", {"k": 8})
    (tmp_path / "c.yaml").write_text("criteria: {false_abstentions: {pass_if: '<= 0'}, regressions: {pass_if: '== 0'}}\n")
    assert cli.main(["compare-answers", str(tmp_path / "one.json"), str(tmp_path / "one.json"), str(tmp_path / "c.yaml")]) == 0
    assert capsys.readouterr().out.rstrip().endswith("PASS")
    assert cli.main(["compare-answers", str(tmp_path / "none.json"), str(tmp_path / "one.json"), str(tmp_path / "c.yaml")]) == 1


def test_settings_order(monkeypatch):
    monkeypatch.setenv("LODESTONE_HOPS", "1")
    assert cli.setting(3, "HOPS", 2, int) == 3 and cli.setting(None, "HOPS", 2, int) == 1 and cli.setting(None, "WEIGHT", 2.0, float) == 2.0
